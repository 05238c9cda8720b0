"""Engine tables derived from the given parquet tables.

Each view is one SQL text that both engines can read; the few functions whose names differ
are filled in per dialect. The texts only bind data; all analytics live in the package.
Amounts are taken in thousands, so that liquidity gates divide the symbols.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from tapeloom import constants as K
from tapeloom.sources.sinks import shared_dir, ship_package

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations"]

# the instant at which live scores are taken on the derived tables
AS_OF = "2001-07-29 12:00:00"


def pick(index: str, values: list[str]) -> str:
    """CASE expression choosing a text by position."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE {index} {whens} END)"


SPARK = {
    "us": lambda x: f"unix_micros(cast({x} as timestamp))",
    "from_us": lambda x: f"timestamp_micros({x})",
    "stamp": lambda x, f: f"date_format({x}, '{f}')",
    "plus_days": lambda d, n: f"date_add({d}, cast({n} as int))",
    "quarter_end": lambda d: f"last_day(add_months(trunc({d}, 'QUARTER'), 2))",
    "json_k": lambda x: f"cast(get_json_object({x}, '$.k') as bigint)",
    "bytes": lambda x: f"encode({x}, 'utf-8')",
}
_STRF = {"ddMMyyyy": "%d%m%Y", "yyyyMMdd": "%Y%m%d", "HHmmss": "%H%M%S", "dd-MMM-yyyy HH:mm:ss": "%d-%b-%Y %H:%M:%S",
         "dd-MMM-yyyy HH:mm": "%d-%b-%Y %H:%M", "dd-MMM-yyyy": "%d-%b-%Y", "yyyy-MM-dd": "%Y-%m-%d"}
DUCK = {
    "us": lambda x: f"epoch_us({x})",
    "from_us": lambda x: f"make_timestamp({x})",
    "stamp": lambda x, f: f"strftime({x}, '{_STRF[f]}')",
    "plus_days": lambda d, n: f"(({d}) + cast({n} as int))",
    "quarter_end": lambda d: f"last_day(cast(date_trunc('quarter', {d}) + INTERVAL 2 MONTH as date))",
    "json_k": lambda x: f"cast(json_extract_string({x}, '$.k') as bigint)",
    "bytes": lambda x: f"encode({x})",
}

# short notices covering every rule tier, chosen by position
PHRASES = [
    "Resignation of Statutory Auditor of the company", "Change in internal auditor: auditor has resigned",
    "SEBI interim order dated today received by the company", "Update under SEBI (LODR) on contract received from a client",
    "Commencement of corporate insolvency resolution process", "Temporary shutdown: plant operations suspension at unit two",
    "Fire at a warehouse of the company", "Credit rating downgrade by the agency", "Credit rating upgrade to AA",
    "CRISIL reaffirms facilities", "Letter of award received worth Rs 540 crore", "Capacity expansion at the new plant",
    "Capital expenditure plan approved", "Scheme of amalgamation with subsidiary", "Demerger of the retail business",
    "Qualified institutional placement of shares", "Allotment of non-convertible debentures", "Buyback of equity shares",
    "Interim dividend declared", "Audited financial results for the quarter", "Revenue guidance for next year",
    "Appointment of managing director", "Arbitration award in a dispute", "Clarification on news item in the press",
    "Disclosure under regulation 29 of takeover code", "Creation of pledge: pledge created by promoter",
    "Declaration of NAV for the scheme", "Trading window closure", "Newspaper publication of results",
    "Certificate under Regulation 74 (5)", "Analysts meet scheduled", "Loss of share certificate",
    "Intimation of board meeting to consider dividend", "Compliance certificate for the half year",
    "Monitoring agency report", "Annual disclosure by the company", "General update to shareholders",
    "Change of registered office", "Outcome of annual general meeting", "",
]
FEED_NAMES = [f for f, _ in K.FEEDS]

VIEWS = {
    "trades": """
        SELECT l_suppkey AS k, cast(l_shipdate as date) AS d, l_quantity AS q, l_returnflag AS rf, l_linestatus AS ls,
               l_linenumber AS ln, l_orderkey AS ok, cast(round(l_extendedprice * 100) as bigint) AS c,
               l_extendedprice / l_quantity * (CASE WHEN l_suppkey % 23 = 6 THEN 1e-3 ELSE 1e0 END) AS px,
               cast(round(l_discount * 100) as bigint) AS disc, cast(round(l_tax * 100) as bigint) AS tax,
               l_orderkey * 33554432 + l_linenumber * 4194304 + l_partkey % 4194304 AS seq
        FROM {lineitem}""",
    "bars": """
        SELECT 'S' || cast(k as string) AS symbol, d AS trade_date,
               CASE WHEN k % 13 = 2 THEN 'BE' WHEN k % 31 = 9 THEN 'BZ' ELSE 'EQ' END AS series,
               min_by(px, seq) AS open,
               CASE WHEN k % 19 = 4 AND day(d) % 3 = 0 THEN max_by(px, seq) ELSE max(px * (100 + disc) / 100) END AS high,
               CASE WHEN k % 19 = 4 AND day(d) % 3 = 0 THEN max_by(px, seq) ELSE min(px * (100 - tax) / 100) END AS low,
               max_by(px, seq) AS close, sum(q) AS volume, sum(c) / 1e5 AS turnover,
               cast(count(*) as double) AS trades, sum(CASE WHEN rf = 'N' THEN q ELSE 0e0 END) AS delivery_qty,
               100e0 * sum(CASE WHEN rf = 'N' THEN q ELSE 0e0 END) / sum(q) AS delivery_pct
        FROM {trades} GROUP BY k, d""",
    "index_bars": """
        SELECT 'IDX:ALL' AS symbol, d AS trade_date, sum(c) / 100e0 / sum(q) AS close
        FROM {trades} GROUP BY d""",
    "book": """
        SELECT k, {quarter_end(d)} AS qe, cast(year(d) * 4 + quarter(d) as bigint) AS qn, sum(c) AS g_all,
               sum(CASE WHEN ls = 'F' THEN c ELSE 0 END) AS g_f, sum(c * (100 - disc)) AS r_all,
               sum(CASE WHEN ls = 'F' THEN c * (100 - disc) ELSE 0 END) AS r_f, sum(c * disc) AS o_all,
               sum(CASE WHEN ls = 'F' THEN c * disc ELSE 0 END) AS o_f, sum(c * tax) AS t_all,
               sum(CASE WHEN ls = 'F' THEN c * tax ELSE 0 END) AS t_f
        FROM {trades} GROUP BY k, {quarter_end(d)}, year(d) * 4 + quarter(d)""",
    "quarter_base": """
        SELECT k, qe, qn, 'consolidated' AS basis, g_all * 10e0 AS gross, r_all / 10e0 AS revenue,
               o_all * (1 + k % 6) / 10e0 AS other_income, t_all * (k % 7) / 10e0 AS finance_costs
        FROM {book} WHERE k % 5 <> 0
        UNION ALL
        SELECT k, qe, qn, 'standalone' AS basis, g_f * 10e0, r_f / 10e0, o_f * (1 + k % 6) / 10e0, t_f * (k % 7) / 10e0
        FROM {book} WHERE (k % 5 = 0 OR k % 7 = 0) AND g_f > 0""",
    "quarter_pnl": """
        SELECT *, gross * (60 + (k + qn) % 45) / 100e0 AS expenses, gross * 3 / 100e0 AS depreciation,
               revenue + other_income - gross * (60 + (k + qn) % 45) / 100e0 AS pbt
        FROM {quarter_base}""",
    "quarters": """
        SELECT 'S' || cast(k as string) AS symbol, k, qn, qe AS period_end, basis, k % 2 = 0 AS audited, revenue,
               other_income, revenue + other_income AS total_income, expenses, finance_costs, depreciation, pbt,
               pbt * (CASE WHEN k % 8 = 1 THEN 5 ELSE 25 END) / 100e0 AS tax,
               pbt - pbt * (CASE WHEN k % 8 = 1 THEN 5 ELSE 25 END) / 100e0 AS pat,
               (pbt - pbt * (CASE WHEN k % 8 = 1 THEN 5 ELSE 25 END) / 100e0) / 1e7 AS eps_basic,
               CASE WHEN k % 12 = 5 THEN pbt * 40 / 100e0 END AS exceptional,
               CASE WHEN k % 9 = 3 THEN 1e6 ELSE 1e8 END AS paidup, 10e0 AS face,
               k * 1000000 + qn * 10 + (CASE WHEN basis = 'consolidated' THEN 1 ELSE 0 END) AS filing_id,
               CASE WHEN k % 6 <> 0 THEN cast({plus_days(qe, 20 + k % 30)} as timestamp) END AS event_at
        FROM {quarter_pnl}""",
    "securities": """
        SELECT s_suppkey AS security_id, 'S' || cast(s_suppkey as string) AS symbol,
               CASE WHEN s_suppkey % 16 <> 3 THEN 'IN' || lpad(cast(s_suppkey as string), 10, '0') END AS isin,
               s_name AS company_name, CASE WHEN s_suppkey % 13 = 2 THEN 'BE' ELSE 'EQ' END AS series,
               s_suppkey % 10 = 0 AS is_sme, 10e0 AS face_value,
               CASE WHEN s_suppkey % 29 <> 11 THEN n_name END AS industry
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "aliases": """
        SELECT s_suppkey AS security_id, 'OLD' || cast(s_suppkey as string) AS alias, 'old_symbol' AS alias_type
        FROM {supplier} WHERE s_suppkey % 4 = 0
        UNION ALL
        SELECT s_suppkey, 'Former ' || s_name, 'old_name' FROM {supplier} WHERE s_suppkey % 3 = 0""",
    "event_base": f"""
        SELECT event_id, user_id, event_type, value, ts, {{json_k(props)}} AS k,
               {{from_us(789004800000000 + ({{us(ts)}} - 1704067200000000) * 80)}} AS event_at,
               {{from_us(789004800000000 + ({{us(ts)}} - 1704067200000000) * 80 + (event_id % 48) * 3600000000)}} AS observed_at,
               CASE WHEN event_type IN ('click', 'view') THEN 'announcements'
                    ELSE {pick('event_id % 23', FEED_NAMES)} END AS feed
        FROM {{events}}""",
    "filing_heads": f"""
        SELECT e.event_id AS filing_id, e.feed, CASE WHEN e.event_id % 7 <> 3 THEN 'S' || cast(e.user_id as string) END AS symbol,
               CASE WHEN e.feed = 'shareholding_pattern'
                    THEN 'PR_AND_PRGRP: ' || cast(20 + e.k % 60 as string) || '.' || lpad(cast(e.event_id % 100 as string), 2, '0')
                         || ' | PUBLIC_VAL: ' || cast(80 - e.k % 60 as string) || '.00'
                    ELSE {pick('e.event_id % 40', PHRASES)} END AS subject,
               'https://files.example/x/' || cast(e.event_id as string) || '.pdf' AS link,
               CASE WHEN e.event_id % 3 = 0 THEN 'api_backfill' ELSE 'rss' END AS source,
               CASE WHEN e.event_id % 7 <> 3 THEN e.user_id END AS security_id,
               CASE WHEN e.event_id % 4 = 0 THEN 'IND' || cast(e.k % 12 as string) WHEN e.event_id % 4 = 1 THEN '-' END AS stated_industry,
               e.event_at, e.observed_at
        FROM {{event_base}} e""",
    "filings": """
        SELECT h.filing_id, h.feed, h.symbol, h.subject, d.text AS description, h.link, h.source, h.security_id, h.stated_industry, h.event_at, h.observed_at
        FROM {filing_heads} h LEFT JOIN {documents} d ON d.doc_id = h.filing_id""",
    "classifications": f"""
        SELECT event_id AS filing_id, {pick('(event_id * 13) % 21', K.CATEGORIES)} AS category,
               cast((event_id * 7 + k) % 11 as int) AS materiality, ((event_id * 37) % 201 - 100) / 100e0 AS sentiment,
               (40 + k % 60) / 100e0 AS confidence, event_id % 9 = 0 AS routine,
               CASE WHEN event_id % 3 = 0 THEN 'summary of ' || cast(event_id as string) END AS summary,
               CASE WHEN event_id % 4 = 0 THEN 'model' ELSE 'rules' END AS engine,
               CASE WHEN event_id % 8 = 1 THEN 'no_rule|backlog_no_llm' ELSE 'feed:x' END AS rule_trace,
               CASE WHEN event_id % 10 = 0 THEN 'rules-v4' ELSE '{K.CLASSIFIER_VERSION}' END AS model_version,
               event_at, {{from_us({{us(observed_at)}} + 3600000000)}} AS observed_at
        FROM {{event_base}}""",
    "raw_entries": f"""
        SELECT event_id AS filing_id, feed, observed_at,
               (CASE WHEN event_id % 5 = 0 THEN upper('Supplier#  ' || lpad(cast(user_id as string), 9, '0'))
                     WHEN event_id % 9 = 1 THEN 'Former Supplier#' || lpad(cast(user_id as string), 9, '0')
                     ELSE 'Supplier#' || lpad(cast(user_id as string), 9, '0') END)
               || (CASE WHEN event_id % 4 = 0 THEN ' - Ex-Date: 28-Aug-2026' ELSE '' END) AS title,
               CASE event_id % 6
                    WHEN 0 THEN 'https://files.example/corporate/S' || cast(user_id as string) || '_' || {{stamp(event_at, ddMMyyyy)}} || '000000_x.pdf'
                    WHEN 1 THEN 'https://files.example/corporate/xbrl/INDAS_' || cast(event_id as string) || '_' || {{stamp(event_at, yyyyMMdd)}} || '_' || {{stamp(event_at, HHmmss)}} || '123.xml'
                    WHEN 2 THEN 'https://files.example/corporate/M&M-' || cast(user_id % 10 as string) || '_' || {{stamp(event_at, ddMMyyyy)}} || '120000.PDF'
                    WHEN 3 THEN ''
                    WHEN 4 THEN 'https://files.example/pages/' || cast(event_id as string) || '.html'
                    ELSE 'https://files.example/corporate/S' || cast(user_id as string) || '_' || {{stamp(event_at, ddMMyyyy)}} || {{stamp(event_at, HHmmss)}} || '.zip' END AS link,
               CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN {{stamp(event_at, dd-MMM-yyyy)}} WHEN 2 THEN {{stamp(event_at, dd-MMM-yyyy HH:mm)}}
                    WHEN 3 THEN 'not a date' ELSE {{stamp(event_at, dd-MMM-yyyy HH:mm:ss)}} END AS pub,
               CASE event_id % 5
                    WHEN 0 THEN 'free text about ' || feed || ' |SUBJECT: ' || {pick('event_id % 40', PHRASES)} || ' |PERIOD: ' || cast(k as string)
                    WHEN 1 THEN 'SUBJECT: first |SUBJECT: second ' || cast(k as string)
                    WHEN 2 THEN 'only free text | more ' || cast(k as string)
                    WHEN 3 THEN ''
                    ELSE 'AS ON DATE: 31-MAR-2001 | note with: colon' END AS description
        FROM {{event_base}}""",
    "deals": """
        SELECT d AS day, 'S' || cast(k as string) AS symbol, 'C' || cast(ok as string) AS client,
               CASE WHEN rf = 'A' OR (rf = 'N' AND ls = 'O') THEN 'BUY' ELSE 'SELL' END AS side, q AS qty, px AS price,
               CASE WHEN ln % 2 = 0 THEN 'bulk' ELSE 'block' END AS kind, seq
        FROM {trades} WHERE q >= 40""",
    "surveillance": """
        SELECT s.day AS as_of, 'S' || cast(s_suppkey as string) AS symbol, f.framework,
               CASE WHEN f.framework = 'gsm' THEN 'GSM ' || cast(1 + s_suppkey % 4 as string)
                    WHEN s_suppkey % 3 = 0 THEN 'Stage I' WHEN s_suppkey % 3 = 1 THEN 'Stage II' ELSE 'Stage III' END AS stage
        FROM {supplier}
        CROSS JOIN (VALUES (DATE '2001-05-31', 1), (DATE '2001-06-30', 2), (DATE '2001-07-28', 3)) AS s(day, n)
        CROSS JOIN (VALUES ('asm_lt'), ('asm_st'), ('gsm')) AS f(framework)
        WHERE (f.framework = 'asm_lt' AND s_suppkey % 11 = 3) OR (f.framework = 'asm_st' AND s_suppkey % 13 = 5 AND s.n < 3)
           OR (f.framework = 'gsm' AND s_suppkey % 17 = 7 AND s.n = 3)""",
    "pledge": """
        SELECT 'S' || cast(s_suppkey as string) AS symbol, 'R' || cast(r.n as string) AS record_id,
               CASE WHEN s_suppkey % 21 = 1 THEN 0e0 ELSE 30e0 + s_suppkey % 50 END AS promoter_pct,
               CASE WHEN NOT (s_suppkey % 10 = 4 AND r.n = 2) THEN cast((s_suppkey * 7 + r.n * 5) % 45 as double) END AS encumbered_pct,
               cast(r.day as timestamp) AS observed_at, CASE WHEN s_suppkey % 4 <> 1 THEN r.day END AS shp_date
        FROM {supplier} CROSS JOIN (VALUES (1, DATE '2001-01-15'), (2, DATE '2001-06-15')) AS r(n, day)
        WHERE s_suppkey % 3 <> 2""",
    "signals": f"""
        SELECT k * 1000000 + qn AS signal_id, symbol, CASE WHEN qn % 2 = 0 THEN 'default' ELSE 'short' END AS profile,
               {pick('(k + qn) % 6', ['buy', 'accumulate', 'hold', 'reduce', 'exit', 'suppressed'])} AS stance,
               ((k * 17 + qn * 29) % 1000) / 10e0 AS conviction, ((k * 3 + qn) % 100) / 100e0 AS confidence,
               CASE WHEN k % 4 <> 0 THEN 95e0 + k % 7 END AS entry_low, CASE WHEN k % 4 <> 0 THEN 100e0 + k % 7 END AS entry_high,
               CASE WHEN k % 4 <> 0 THEN 110e0 + qn % 20 END AS target_low, CASE WHEN k % 4 <> 0 THEN 130e0 + qn % 20 END AS target_high,
               CASE WHEN k % 4 <> 0 THEN 90e0 END AS invalidation, CASE WHEN k % 10 = 9 THEN 'fusion-old' ELSE '{K.FUSION_VERSION}' END AS model_version,
               'clear' AS risk_verdict, '3-6m' AS horizon,
               {{from_us({{us(cast(period_end as timestamp))}} + 36000000000)}} AS as_of
        FROM {{quarters}} WHERE basis = CASE WHEN k % 5 <> 0 THEN 'consolidated' ELSE 'standalone' END""",
    "polls": f"""
        SELECT {pick('event_id % 23', FEED_NAMES)} AS feed, event_id AS poll_id, cast(ts as timestamp) AS moment,
               CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'not_modified' ELSE 'ok' END AS status,
               k AS seen, k % 5 AS new
        FROM {{event_base}}""",
    "audit": """
        SELECT event_id AS request_id, cast(ts as timestamp) AS observed_at,
               CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL WHEN event_type = 'error' THEN 503
                    WHEN event_type = 'view' THEN 304 ELSE 200 END AS status
        FROM {events}""",
    "outbox": """
        SELECT event_id AS id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'filing.received' ELSE 'signal.issued' END AS topic,
               cast(ts as timestamp) AS created_at
        FROM {events}""",
    "attempts": """
        SELECT event_id AS attempt_id, cast(floor(event_id / 5) as bigint) AS doc_id, cast(ts as timestamp) AS moment,
               CASE WHEN event_type = 'error' THEN 'deferred' WHEN event_type = 'purchase' AND k > 40 THEN 'ok'
                    WHEN event_type = 'signup' AND k > 90 THEN 'error' ELSE 'unavailable' END AS outcome
        FROM {event_base}""",
    "alert_log": f"""
        SELECT event_id AS alert_id, CASE WHEN event_type IN ('error', 'click', 'view') THEN 'high' ELSE 'medium' END AS severity,
               CASE WHEN event_type = 'signup' THEN 'signal_' || {pick('event_id % 3', ['buy', 'exit', 'suppressed'])} ELSE 'results' END AS category,
               'S' || cast(user_id as string) AS symbol, 'message ' || cast(event_id as string) AS message,
               {{from_us(1704067200000000 + cast(floor(({{us(ts)}} - 1704067200000000) / 8) as bigint))}} AS observed_at
        FROM {{event_base}}""",
    "stored_scores": """
        SELECT a.agent, 'S' || cast(s_suppkey as string) AS symbol, cast((s_suppkey * 37 + v.n * 11 + a.i * 101) % 1000 as double) / 10 AS score,
               s_suppkey * 100 + a.i * 10 + v.n AS score_id, cast(v.day as timestamp) AS as_of, cast(v.day as timestamp) AS observed_at
        FROM {supplier} CROSS JOIN (VALUES ('a3', 1), ('a4', 2), ('a5', 3), ('a6', 4)) AS a(agent, i)
        CROSS JOIN (VALUES (1, DATE '2001-07-01'), (2, DATE '2001-07-28')) AS v(n, day)
        WHERE (s_suppkey + a.i + v.n) % 4 <> 0""",
    "snapshot": """
        SELECT CASE WHEN s_suppkey % 15 = 2 THEN 'N' ELSE 'S' END || cast(s_suppkey as string) AS symbol,
               CASE WHEN s_suppkey % 16 <> 3 THEN 'IN' || lpad(cast(s_suppkey as string), 10, '0') END AS isin,
               CASE WHEN s_suppkey % 12 = 1 THEN 'Renamed ' || s_name ELSE s_name END AS company_name,
               CASE WHEN s_suppkey % 13 = 2 THEN 'BE' ELSE 'EQ' END AS series, s_suppkey % 10 = 0 AS is_sme,
               CASE WHEN s_suppkey % 20 = 5 THEN 5e0 ELSE 10e0 END AS face_value, s_suppkey AS line_no
        FROM {supplier}""",
    "model_raw": f"""
        SELECT event_id AS filing_id, feed, event_at,
               CASE WHEN event_id % 7 = 2 THEN 'no object at all'
                    ELSE 'Answer: ' || chr(123) || '"category": "' || (CASE WHEN event_id % 13 = 3 THEN 'gossip' ELSE {pick('(event_id * 13) % 21', K.CATEGORIES)} END)
                      || '", "materiality": ' || (CASE WHEN event_id % 11 = 4 THEN '"high"' WHEN event_id % 11 = 5 THEN '12' ELSE cast(k % 11 as string) || '.5' END)
                      || (CASE WHEN event_id % 17 = 5 THEN '' ELSE ', "sentiment": ' || cast((k % 20) / 10e0 - 1 as string) END)
                      || ', "confidence": 0.' || cast(10 + k % 90 as string) || ', "summary": "' || (CASE WHEN event_id % 19 = 6 THEN '' ELSE 'short words' END)
                      || '", "entities": ' || (CASE WHEN event_id % 23 = 7 THEN '[1]' ELSE chr(123) || '"n": "Rs ' || cast(k as string) || ' crore"' || chr(125) END)
                      || chr(125) || ' done' END AS raw
        FROM {{event_base}}""",
    "label_rows": f"""
        SELECT doc_id AS filing_id, CASE WHEN quality = 1 THEN {pick('(doc_id * 13) % 21', K.CATEGORIES)} ELSE {pick('(doc_id * 5) % 21', K.CATEGORIES)} END AS label_category,
               cast((doc_id * 7 + toxic * 3 + quality) % 11 as double) AS label_materiality
        FROM {{labels}}""",
    "theirs": """
        SELECT symbol, period_end, revenue / 1e7 * (CASE WHEN k % 10 = 1 THEN 1.05e0 ELSE 1.01e0 END) AS revenue_cr,
               pat / 1e7 * (CASE WHEN k % 14 = 2 THEN 1.5e0 ELSE 1e0 END) AS pat_cr
        FROM {quarters} WHERE basis = CASE WHEN k % 5 <> 0 THEN 'consolidated' ELSE 'standalone' END AND qn % 9 <> 0""",
    "revisions": """
        SELECT symbol, period_end, basis, 'd' || cast(filing_id as string) || '-' || cast(v.n as string) AS doc, filing_id * 10 + v.n AS doc_no,
               revenue * v.f AS revenue, filing_id
        FROM {quarters} CROSS JOIN (VALUES (1, 1e0), (2, 1.02e0), (3, 1e1), (4, 1e-1), (5, 1.5e0)) AS v(n, f)
        WHERE v.n = 1 OR (v.n = 2 AND k % 2 = 0) OR (v.n = 3 AND (k + qn) % 4 = 1) OR (v.n = 4 AND (k + qn) % 6 = 1) OR (v.n = 5 AND (k + qn) % 5 = 1)""",
    "result_facts": """
        SELECT 'd' || cast(q.filing_id as string) AS doc, f.seq + 100 * x.n AS seq, f.fact,
               CASE WHEN x.n = 1 THEN 'OneD' ELSE 'PrevD' END AS context,
               CASE f.fact WHEN 'DateOfEndOfReportingPeriod' THEN {stamp(q.period_end, yyyy-MM-dd)}
                    WHEN 'DateOfStartOfReportingPeriod' THEN {stamp(q.start, yyyy-MM-dd)}
                    WHEN 'Symbol' THEN CASE WHEN q.k % 4 = 0 THEN ' ' ELSE lower(q.symbol) END
                    WHEN 'NatureOfReportStandaloneConsolidated' THEN CASE WHEN q.basis = 'consolidated' THEN 'Consolidated' ELSE 'Non-Consolidated' END
                    WHEN 'WhetherResultsAreAuditedOrUnaudited' THEN CASE WHEN q.audited THEN 'Audited' ELSE 'Unaudited' END
                    ELSE cast(cast(round((CASE f.fact WHEN 'RevenueFromOperations' THEN q.revenue WHEN 'InterestEarned' THEN q.revenue
                         WHEN 'OtherIncome' THEN q.other_income WHEN 'Income' THEN q.total_income WHEN 'Expenses' THEN q.expenses
                         WHEN 'FinanceCosts' THEN q.finance_costs WHEN 'ProfitBeforeTax' THEN q.pbt WHEN 'TaxExpense' THEN q.tax
                         WHEN 'ProfitLossForPeriod' THEN q.pat END) / x.n) as bigint) as string) END AS text
        FROM (SELECT *, CASE WHEN k % 9 = 4 AND qn % 4 = 3 THEN {plus_days(period_end, -180)} ELSE {plus_days(period_end, -90)} END AS start FROM {quarters}) q
        CROSS JOIN (VALUES (1, 'Symbol'), (2, 'DateOfStartOfReportingPeriod'), (3, 'DateOfEndOfReportingPeriod'),
             (4, 'NatureOfReportStandaloneConsolidated'), (5, 'WhetherResultsAreAuditedOrUnaudited'), (6, 'RevenueFromOperations'),
             (7, 'InterestEarned'), (8, 'OtherIncome'), (9, 'Income'), (10, 'Expenses'), (11, 'FinanceCosts'), (12, 'ProfitBeforeTax'),
             (13, 'TaxExpense'), (14, 'ProfitLossForPeriod')) AS f(seq, fact)
        CROSS JOIN (VALUES (1), (2)) AS x(n)
        WHERE (q.k % 7 = 3) = (f.fact = 'InterestEarned') OR f.fact NOT IN ('InterestEarned', 'RevenueFromOperations')""",
    "holding_facts": f"""
        SELECT 'h' || cast(s_suppkey as string) AS doc, f.seq, f.fact, CASE WHEN f.seq = 1 THEN 'OtherHolder' ELSE 'Promoter' END AS context,
               CASE WHEN f.seq = 1 THEN '1' WHEN f.seq = 2 THEN '0.' || lpad(cast(10 + s_suppkey % 80 as string), 2, '0')
                    WHEN f.seq IN (3, 4) THEN '0.' || lpad(cast(s_suppkey % 60 as string), 2, '0') || '19'
                    WHEN f.seq = 5 THEN cast(1000 * s_suppkey as string) WHEN s_suppkey % 5 = 3 THEN 'true' ELSE 'false' END AS text,
               f.seq > 1 AS promoter
        FROM {{supplier}} CROSS JOIN (VALUES (1, '{K.PROMOTER_PCT_FACT}'), (2, '{K.PROMOTER_PCT_FACT}'), (3, '{K.ENCUMBERED_PCT_FACTS[0]}'),
             (4, '{K.ENCUMBERED_PCT_FACTS[1]}'), (5, '{K.ENCUMBERED_NUM_FACTS[0]}'), (6, '{K.ENCUMBRANCE_FLAG_PREFIX}Pledged')) AS f(seq, fact)
        WHERE NOT (f.seq IN (2, 3, 4, 5, 6) AND s_suppkey % 9 = 8) AND NOT (f.seq = 3 AND s_suppkey % 2 = 0)
          AND NOT (f.seq IN (3, 4, 5) AND s_suppkey % 4 = 1)""",
}

def _expand(text: str, dialect: dict, table) -> tuple[str, list[str]]:
    """Fills dialect calls and table names; returns the SQL and the tables it reads."""
    out, used, i = [], [], 0
    while i < len(text):
        if text[i] != "{":
            out.append(text[i])
            i += 1
            continue
        depth, j = 1, i + 1
        while depth:
            depth += {"{": 1, "}": -1}.get(text[j], 0)
            j += 1
        body = text[i + 1 : j - 1]
        if "(" in body:
            name, arg = body.split("(", 1)
            arg, more = _expand(arg.rsplit(")", 1)[0], dialect, table)
            used += more
            args = arg.rsplit(",", 1) if name in ("stamp", "plus_days") else [arg]
            out.append(dialect[name](*[a.strip() for a in args]))
        else:
            used.append(body)
            out.append(table(body))
        i = j
    return "".join(out), used


def duck_view(name: str) -> tuple[str, list[str]]:
    return _expand(VIEWS[name], DUCK, lambda t: t)


class Tables:
    """Engine tables of one data folder as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        self.spark, self.dir, self._made, self._root = spark, sf_dir, {}, None

    def store(self, *names: str) -> "Tables":
        """Writes tables that several stages of a chain read, once, to the shared folder.

        Bars and quarters are aggregates far smaller than the trades below them; stored, the
        trades are scanned once per chain instead of once per stage. A lost executor costs a
        re-read of the files, not a recomputation.
        """
        if self._root is None:
            self._stored = set()
            self._root = f"{shared_dir(self.spark)}/tables-{uuid.uuid4().hex}"
        todo = [n for n in names if n not in self._stored]
        while todo:
            # tables that read none of the others are written side by side
            ready = [n for n in todo if not self._below(n) & set(todo)]
            frames = [getattr(self, n) for n in ready]
            paths = [f"{self._root}/{n}" for n in ready]
            with ThreadPoolExecutor(len(ready)) as pool:
                list(pool.map(lambda df, path: df.write.parquet(path), frames, paths))
            self._made |= {n: self.spark.read.parquet(p) for n, p in zip(ready, paths)}
            self._stored |= set(ready)
            todo = [n for n in todo if n not in self._stored]
        return self

    def _below(self, name: str) -> set[str]:
        """The views under a view that are not stored yet."""
        used = set(_expand(VIEWS[name], SPARK, lambda t: t)[1]) if name in VIEWS else set()
        return {u for n in used for u in ({n} | self._below(n) if n not in self._stored else ())}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in BASE):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            else:
                sql, used = _expand(VIEWS[name], SPARK, lambda t: "{" + t + "}")
                df = self.spark.sql(sql, **{t: getattr(self, t) for t in set(used)})
            self._made[name] = df
        return self._made[name]
