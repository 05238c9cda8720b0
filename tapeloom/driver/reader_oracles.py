"""Expected results of the reader queries, from the tables and not from the texts."""

from __future__ import annotations

from tapeloom import constants as K
from tapeloom.driver.oracles import MID, NOW, oracle, part, pyr


def grouped(n: str) -> str:
    """The number that the text of a whole number below a million stands for."""
    return f"(CASE WHEN ({n}) % 7 >= 2 THEN ({n}) + 0.5e0 END)"


oracle("announcements_json", f"""SELECT 'S' || user_id AS symbol, cast(NULL as string) AS isin, event_type AS subject, CASE WHEN event_id % 3 = 0 THEN 'body text' END AS description, k AS dedup_key,
    sha256('api|announcements|' || k) AS content_hash, 'IND' || event_id % 5 AS industry, strftime(date_trunc('second', ts) - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS event_at, 'api_backfill' AS source
    FROM (SELECT *, CASE WHEN event_id % 4 <> 0 THEN 'https://f.example/' || event_id || '.pdf' WHEN event_id % 8 <> 0 THEN 'seq:' || event_id END AS k FROM events) WHERE k IS NOT NULL""")
oracle("price_csv", f"""SELECT 'S' || l_suppkey AS symbol, series, 'bhavcopy' AS source, count(*) AS n, sum({grouped('l_partkey')}) AS open, sum({grouped('l_partkey + 1')}) AS high, sum({grouped('l_partkey + 2')}) AS low,
    cast(sum(l_linenumber) as double) AS close, cast(sum(l_orderkey) as double) AS trades, cast(sum(CASE WHEN l_partkey % 2 = 1 THEN l_partkey % 100 END) as double) AS delivery_pct,
    count({grouped('l_partkey')}) AS n_open, count(CASE WHEN l_partkey % 2 = 1 THEN 1 END) AS n_delivery_pct, cast(0 as bigint) AS n_volume
    FROM (SELECT *, ['EQ', 'BE', 'GB', 'SM', 'ST', 'BZ', 'N1'][l_linenumber] AS series FROM lineitem) WHERE series IN ('EQ', 'BE', 'SM', 'ST', 'BZ') GROUP BY 1, 2""")
_IDX = "[" + ", ".join(f"'{s}'" for s in K.KEEP_INDICES) + "]"
oracle("index_csv", f"""SELECT 'IDX:' || {_IDX}[o_custkey % {len(K.KEEP_INDICES) + 1} + 1] AS symbol, 'index' AS source, count(*) AS n, sum({grouped('o_custkey')}) AS open, sum({grouped('o_custkey + 3')}) AS close,
    cast(sum(o_custkey) as double) AS volume, cast(sum(o_orderkey) as double) AS turnover, cast(0 as bigint) AS n_high, cast(0 as bigint) AS n_prev FROM orders WHERE o_custkey % {len(K.KEEP_INDICES) + 1} < {len(K.KEEP_INDICES)} GROUP BY 1""")
oracle("market_flow_json", f"""SELECT cast(o_orderdate as date) AS day, CASE WHEN o_custkey % 2 = 0 THEN 'FII/FPI *' WHEN o_custkey % 3 = 0 THEN 'DII' ELSE '' END AS category, count(*) AS n,
    sum({grouped('o_custkey')}) AS buy_value, sum({grouped('o_custkey + 1')}) AS sell_value, cast(sum(o_custkey) as double) AS net_value FROM orders WHERE o_custkey % 11 <> 5 GROUP BY 1, 2""")
part("deal_lines", "SELECT DISTINCT cast(l_shipdate as date) AS day, 'S' || l_suppkey AS symbol, 'Client ' || l_partkey % 50 AS client, CASE WHEN l_partkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, cast(floor(l_quantity) as bigint) * 1000 AS qty FROM lineitem WHERE l_linenumber <= 2 AND l_partkey % 13 <> 0")
oracle("large_deals_csv", "SELECT symbol, client, side, kind, count(*) AS n, cast(sum(qty) as double) AS qty, min(day) AS first_day FROM deal_lines, (VALUES ('bulk'), ('block')) AS k(kind) GROUP BY 1, 2, 3, 4")
part("asm_rows", """SELECT 'S' || s_suppkey % 40 AS symbol, 'asm_lt' AS framework, 'Stage ' || s_suppkey % 3 AS stage, 0 AS p, s_name AS d FROM supplier UNION ALL SELECT 'S' || s_suppkey % 40, 'asm_lt', 'Stage late', 2, s_name FROM supplier
    UNION ALL SELECT 'S' || s_suppkey % 40, 'asm_st', '', 0, s_name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'S' || s_suppkey % 40, 'gsm', 'G' || s_suppkey % 4, 0, (CASE WHEN s_suppkey % 5 <> 0 THEN 'C' ELSE '' END) || ' d' FROM supplier WHERE s_suppkey % 3 = 0""")
oracle("surveillance_json", "SELECT symbol, framework, stage, DATE '2001-07-27' AS as_of FROM (SELECT *, row_number() OVER (PARTITION BY symbol, framework ORDER BY p, stage, d) AS r FROM asm_rows) WHERE r = 1")
oracle("listing_csv", """SELECT 'S' || c_custkey AS symbol, 'INE' || c_custkey AS isin, 'Co ' || c_custkey AS company_name, CASE WHEN c_custkey % 6 <> 0 THEN 'EQ' END AS series, false AS is_sme,
    CASE WHEN c_custkey % 4 <> 3 THEN DATE '2001-01-01' + cast(c_custkey % 900 as int) END AS listing_date, CASE WHEN c_custkey % 3 <> 0 THEN 10e0 END AS face_value FROM customer""")
oracle("rename_files", """SELECT security_id, alias, alias_type FROM (SELECT s_suppkey AS security_id, 'OLD' || s_suppkey AS alias, 'old_symbol' AS alias_type FROM supplier WHERE s_suppkey % 5 <> 0
    UNION ALL SELECT s_suppkey, 'Former ' || s_name, 'old_name' FROM supplier WHERE s_suppkey % 4 <> 0) EXCEPT SELECT security_id, alias, alias_type FROM aliases""")
oracle("holidays_json", "SELECT DISTINCT cast(o_orderdate as date) AS day, CASE WHEN day(o_orderdate) % 2 = 0 THEN 'feast' ELSE 'holiday' END AS name FROM orders WHERE o_custkey % 50 = 7 AND day(o_orderdate) <> 13")
_AT = "strftime(cast({} as timestamp) - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S')"
oracle("results_index", f"""SELECT 'http://x/' || o_orderkey || '.xml' AS xbrl, {_AT.format('o_orderdate')} AS to_date,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(cast(o_orderdate as timestamp) + INTERVAL 300 MINUTE, '%Y-%m-%d %H:%M:%S') WHEN o_orderkey % 3 = 0 THEN strftime(cast(o_orderdate as timestamp) + INTERVAL 1110 MINUTE, '%Y-%m-%d %H:%M:%S') ELSE {_AT.format('o_orderdate')} END AS broadcast,
    CASE WHEN o_orderkey % 2 = 1 THEN 'Integrated filing results (Standalone)' WHEN o_orderkey % 3 = 0 THEN 'First Quarter results (Consolidated)' ELSE 'results (Consolidated)' END AS subject FROM orders WHERE o_orderkey % 5 <> 0""")
part("subs", "SELECT 'S' || o_custkey AS symbol, CASE WHEN o_orderkey % 9 <> 0 THEN lpad(cast(o_orderkey as string), 9, '0') END AS rec, CASE WHEN o_orderkey % 4 <> 0 THEN 'http://x/' || o_orderkey END AS url, CASE WHEN o_orderkey % 7 <> 0 THEN cast(o_orderdate as timestamp) END AS sent FROM orders")
oracle("latest_submission", f"""SELECT s.symbol, coalesce(u.rec, 'none') AS record_id, u.url AS xbrl, {_AT.format('u.sent')} AS event_at FROM (SELECT DISTINCT symbol FROM subs) s
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sent DESC NULLS LAST, rec DESC NULLS LAST) AS r FROM subs WHERE url IS NOT NULL) WHERE r = 1) u ON u.symbol = s.symbol""")
oracle("text_markers", """SELECT event_id, CASE WHEN s > 0.15e0 THEN '+' WHEN s < -0.15e0 THEN '-' ELSE '=' END AS direction, event_type || ' &lt;b&gt; &amp; ' || event_id AS escaped,
    CASE WHEN event_id % 6 = 0 THEN '–' WHEN event_id % 4 = 0 THEN format('{:g}', lo) ELSE format('{:g}', lo) || ' – ' || format('{:g}', lo + 0.5e0) END AS value_range
    FROM (SELECT *, (event_id % 41) / 20e0 - 1e0 AS s, (event_id % 1000) / 4e0 AS lo FROM events)""")
oracle("muhurat_days", "SELECT year, count(*) AS n, CASE year WHEN 2024 THEN DATE '2024-11-01' WHEN 2025 THEN DATE '2025-10-21' WHEN 2026 THEN DATE '2026-11-08' END AS muhurat FROM (SELECT year(o_orderdate) % 4 + 2023 AS year FROM orders) GROUP BY 1")
oracle("freshness_split", f"SELECT feed, observed_at >= {NOW} - INTERVAL {K.FRESH_HOURS} HOUR AS fresh, count(*) AS n FROM filings GROUP BY 1, 2")
oracle("score_events", """SELECT CASE agent WHEN 'a3' THEN 'fundamental.scored' WHEN 'a4' THEN 'technical.scored' WHEN 'a5' THEN 'flow.scored' ELSE 'risk.assessed' END AS topic,
    '{"symbol":"' || symbol || '"' || (CASE WHEN score IS NOT NULL THEN ',"score":' || cast(score as string) ELSE '' END) || ',"score_id":' || score_id || '}' AS payload FROM stored_scores WHERE agent IN ('a3', 'a4', 'a5', 'a6')
    UNION ALL SELECT 'signal.issued', '{"symbol":"' || symbol || '","profile":"' || profile || '","stance":"' || stance || '","signal_id":' || signal_id || '}' FROM signals""")
oracle("report_sink", "SELECT 'event_counts' AS name, event_type, count(*) AS n FROM events GROUP BY 2")

# ---------------------------------------------------------------- chained views

_list = lambda line, order: f"coalesce(string_agg({line}, chr(10) ORDER BY {order}), '')"
part("cd_sig", f"SELECT symbol, {_list('concat_ws(chr(32), profile, stance, cast(conviction as varchar), signal_id)', 'profile')} AS x FROM (SELECT *, row_number() OVER (PARTITION BY symbol, profile ORDER BY as_of DESC, signal_id DESC) AS r FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY as_of DESC, signal_id DESC) AS top FROM signals WHERE as_of <= {NOW}) WHERE top <= 20) WHERE r = 1 GROUP BY 1")
part("cd_sco", f"SELECT symbol, {_list('''concat_ws(chr(32), agent, cast(score as varchar), strftime(as_of, '%Y-%m-%d'))''', 'agent')} AS x FROM (SELECT *, row_number() OVER (PARTITION BY symbol, agent ORDER BY as_of DESC, score_id DESC) AS r FROM stored_scores WHERE as_of <= {NOW}) WHERE r = 1 GROUP BY 1")
_cr = lambda c: f"CASE WHEN {c} <> 0 THEN cast({pyr(f'({c} / 1e7)', 1)} as varchar) END"
part("cd_qua", f"SELECT symbol, {_list(f'concat_ws(chr(32), cast(period_end as varchar), basis, {_cr('revenue')}, {_cr('pat')})', 'r')} AS x FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC, basis) AS r FROM quarters_live) WHERE r <= 12 GROUP BY 1")
part("cd_fil", f"SELECT symbol, {_list('concat_ws(chr(32), filing_id, feed)', 'r')} AS x FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_at DESC, filing_id) AS r FROM filing_heads WHERE observed_at <= {NOW} AND event_at >= {NOW} - INTERVAL 90 DAY) WHERE r <= 15 GROUP BY 1")
part("cd_clo", f"SELECT symbol, {_list('concat_ws(chr(32), cast(trade_date as varchar), cast(floor(close * 1e6 + 0.5e0) / 1e6 as varchar))', 'trade_date')} AS x FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS r FROM bars WHERE trade_date <= cast({NOW} as date)) WHERE r <= 90 GROUP BY 1")
oracle("company_detail", "SELECT s.symbol, s.company_name, s.industry, a.x AS signals, b.x AS scores, q.x AS quarters, f.x AS filings, c.x AS closes FROM securities s LEFT JOIN cd_sig a ON a.symbol = s.symbol LEFT JOIN cd_sco b ON b.symbol = s.symbol LEFT JOIN cd_qua q ON q.symbol = s.symbol LEFT JOIN cd_fil f ON f.symbol = s.symbol LEFT JOIN cd_clo c ON c.symbol = s.symbol")
oracle("health_status", """SELECT CASE WHEN n > 0 THEN 'degraded' ELSE 'ok' END AS status, (SELECT strftime(max(moment) + INTERVAL 3 SECOND, '%Y-%m-%d %H:%M:%S') FROM polls) AS last_pass, n AS problems FROM (
    SELECT sum((CASE WHEN last_polled_at IS NULL THEN 1 ELSE 0 END) + (CASE WHEN age > CASE priority WHEN 'P0' THEN 300 WHEN 'P1' THEN 1800 ELSE 7200 END THEN 1 ELSE 0 END) + (CASE WHEN consecutive_errors >= 3 THEN 1 ELSE 0 END)) AS n FROM ages)""")
_ctx = lambda rest, name: f"(SELECT cast(sum(o_custkey) as double) FROM orders WHERE o_custkey % 2 = {rest} AND o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_custkey % 2 = {rest} AND {MID('o_orderdate')} <= {NOW})) AS {name}"
oracle("flow_context", f"SELECT symbol, score, {_ctx(0, 'fii')}, {_ctx(1, 'dii')} FROM flow_live")
part("asked_days", "SELECT DISTINCT cast(l_shipdate as date) AS day FROM lineitem UNION SELECT cast(l_shipdate + INTERVAL 1200 MONTH as date) FROM lineitem")
part("open_days", "SELECT d.day FROM (SELECT cast(unnest(generate_series(DATE '1990-01-01', DATE '2101-12-31', INTERVAL 1 DAY)) as date) AS day) d WHERE isodow(d.day) < 6 AND d.day NOT IN (SELECT day FROM holiday_days)")
oracle("adjacent_trading_days", "SELECT a.day, n.day AS next_trading_day, p.day AS prev_trading_day FROM asked_days a ASOF LEFT JOIN open_days n ON n.day > a.day ASOF LEFT JOIN open_days p ON p.day < a.day")
part("parsed_q", "SELECT i.doc, q.filing_id, coalesce(i.own_symbol, q.symbol) AS symbol, i.period_end, i.basis, i.revenue FROM instances i JOIN quarters q ON i.doc = 'd' || cast(q.filing_id as string) WHERE i.period_end - i.period_start BETWEEN 80 AND 100")
part("old_q", "SELECT symbol, period_end, basis, 's' || filing_id AS doc FROM quarters WHERE filing_id % 2 = 0 UNION ALL SELECT 'Z' || symbol, period_end, basis, 's' || filing_id FROM quarters WHERE filing_id % 2 = 0")
part("raw_n", "SELECT doc, count(DISTINCT fact) AS n, any_value(text) FILTER (fact = 'DateOfEndOfReportingPeriod') AS e FROM (SELECT r.* FROM result_facts r JOIN (SELECT doc, arg_min(context, seq) AS context FROM result_facts WHERE fact = 'DateOfEndOfReportingPeriod' GROUP BY 1) m ON m.doc = r.doc AND m.context = r.context) GROUP BY 1")
oracle("financials_upsert", """SELECT coalesce(p.symbol, o.symbol) AS symbol, coalesce(p.period_end, o.period_end) AS period_end, coalesce(p.basis, o.basis) AS basis, coalesce(p.doc, o.doc) AS doc, s.security_id,
    CASE WHEN p.doc IS NULL THEN -1e0 ELSE floor(p.revenue * 1e6 + 0.5e0) / 1e6 END AS revenue, CASE WHEN p.doc IS NULL THEN 1 ELSE r.n END AS n_raw, r.e AS raw_end
    FROM parsed_q p FULL JOIN old_q o ON o.symbol = p.symbol AND o.period_end = p.period_end AND o.basis = p.basis LEFT JOIN securities s ON s.symbol = p.symbol LEFT JOIN raw_n r ON r.doc = p.doc""")
