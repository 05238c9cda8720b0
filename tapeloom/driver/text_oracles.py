"""Expected reason texts, theses and rendered messages."""

from __future__ import annotations

from tapeloom import constants as K
from tapeloom.driver.oracles import NOW, V5, oracle, part, pyr, r6

fix = lambda x, d=0, plus="": f"format('{{:{plus}.{d}f}}', {x})"
text = lambda x: f"coalesce(cast({x} as varchar), 'None')"
some = lambda *items: "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"

# ---------------------------------------------------------------- risk and quality

part("sv_text", """SELECT symbol, list_sort(list(DISTINCT t) FILTER (hard)) AS sh_text, list_sort(list(DISTINCT t) FILTER (NOT hard)) AS ss_text FROM (
    SELECT symbol, framework = 'gsm' OR (framework = 'asm_lt' AND stage <> 'Stage I') AS hard,
      CASE WHEN framework = 'gsm' THEN 'GSM surveillance (' || stage || ')' WHEN framework = 'asm_lt' AND stage <> 'Stage I' THEN 'ASM long-term ' || stage ELSE 'surveillance ' || framework || ':' || stage END AS t
    FROM surveillance WHERE as_of <= """ + f"cast({NOW} as date)" + """) GROUP BY 1""")
part("risk_text", f"""SELECT r.*, list_concat(coalesce(v.sh_text, []), {some(
    f"CASE WHEN median_turnover < 10 THEN 'illiquid (median 20d turnover ₹' || {fix('median_turnover')} || 'L < ₹10L)' END",
    "CASE WHEN last_close < 5 THEN 'penny stock (close ₹' || cast(last_close as varchar) || ')' END",
    f"CASE WHEN lock_ratio > 0.2e0 THEN 'circuit-locked ' || {fix('lock_ratio * 100e0')} || '% of last 60 sessions' END",
    "CASE WHEN aud > 0 THEN 'statutory auditor resignation in last 12m (' || aud || ' filing(s))' END",
    f"CASE WHEN pp > 0 AND ep > 25 THEN 'promoter pledge ' || {fix('ep', 1)} || '% of promoter holding (> 25%, SHP ' || coalesce(strftime(l.shp_date, '%Y-%m-%d'), 'None') || ')' END")}) AS blocks,
    list_concat(coalesce(v.ss_text, []), {some(
    "CASE WHEN last_series IN ('BE', 'BZ') THEN 'trade-for-trade series (' || last_series || ')' END",
    "CASE WHEN reg > 0 THEN 'regulatory action filings in last 180d (' || reg || ')' END",
    f"CASE WHEN NOT (pp > 0 AND ep > 25) AND ep > 10 THEN 'promoter pledge ' || {fix('ep', 1)} || '% of promoter holding' END",
    "CASE WHEN n_enc > 0 THEN 'pledge/encumbrance activity in last 180d (' || n_enc || ')' || CASE WHEN ep IS NULL THEN '; pledge % unavailable' ELSE '' END END",
    f"CASE WHEN mcap_cr < 300 THEN 'microcap (₹' || {fix('mcap_cr')} || ' Cr)' END")}) AS soft_text
    FROM risk_live r LEFT JOIN sv_text v ON v.symbol = r.symbol LEFT JOIN plg l ON l.symbol = r.symbol""")
_UN = "'going_concern (needs audit-report text)' || chr(10) || 'free_float (needs full shareholding parse)' || chr(10) || 'portfolio_caps (needs holdings source — Phase 5)'"
oracle("risk_reasons", f"SELECT symbol, verdict, array_to_string(blocks, chr(10)) AS hard_blocks, array_to_string(soft_text, chr(10)) AS penalties, {_UN} || CASE WHEN ep IS NULL THEN chr(10) || 'pledge_pct (SHP XBRL not yet fetched)' ELSE '' END AS unavailable FROM risk_text")
_FLAGS = some(
    f"CASE WHEN oi > 0.5e0 THEN 'other_income ' || {fix('oi * 100e0')} || '% of PBT' WHEN oi > 0.3e0 THEN 'other_income ' || {fix('oi * 100e0')} || '% of PBT (mild)' END",
    f"CASE WHEN rate < 0.10e0 OR rate > 0.45e0 THEN 'tax rate anomaly ' || {fix('rate * 100e0')} || '%' END",
    "CASE WHEN pbt <> 0 AND abs(exceptional) > 0.25e0 * abs(pbt) THEN 'exceptional items >25% of PBT' END",
    f"CASE WHEN burden > 0.15e0 THEN 'finance costs ' || {fix('burden * 100e0')} || '% of revenue' END", "CASE WHEN pat < 0 THEN 'loss-making quarter' END")
part("fund_text", f"SELECT *, {_FLAGS} AS flags FROM fund_live")
oracle("quality_flags", f"SELECT symbol, as_of, n_flags, array_to_string(flags, chr(10)) AS flags, {r6('quality_pts')} FROM fund_text")

# ---------------------------------------------------------------- theses

_LINE = lambda width: f"category || ' m' || materiality || ' (' || substr(coalesce(subject, ''), 1, {width}) || ') [filing#' || filing_id || ']'"
_ITEM = lambda line: f"list(struct_pack(t := {line}, good := sentiment > 0, id := filing_id) ORDER BY materiality DESC, filing_id DESC)"
part("cite_own", f"SELECT symbol, {_ITEM(_LINE(80))} AS items FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY materiality DESC, filing_id) AS r FROM ev_live) WHERE r <= 10 GROUP BY symbol")
part("cite_peer", f"""SELECT symbol, {_ITEM("'peer event (' || peer || ', ' || industry || '): ' || " + _LINE(70))} AS items FROM (
    SELECT me.symbol, e.symbol AS peer, p.industry, e.category, e.materiality, e.subject, e.filing_id, e.sentiment, row_number() OVER (PARTITION BY me.symbol ORDER BY e.materiality DESC, e.filing_id) AS r
    FROM securities me JOIN securities p ON p.industry = me.industry AND p.symbol <> me.symbol JOIN ev_live e ON e.symbol = p.symbol WHERE e.materiality >= 7) WHERE r <= 8 GROUP BY symbol""")
part("cites", "SELECT x.symbol, CASE WHEN p.peer_conf > 0 THEN list_concat(coalesce(o.items, []), q.items) ELSE coalesce(o.items, []) END AS items FROM ev_axis x LEFT JOIN cite_own o ON o.symbol = x.symbol LEFT JOIN cite_peer q ON q.symbol = x.symbol LEFT JOIN ev_peer p ON p.symbol = x.symbol")
part("axis_lines", f"""SELECT l.symbol, l.profile, l.stop, l.stance, l.conviction, l.confidence, l.horizon, l.verdict, l.fs, l.tsc, l.ws, l.wf, l.wt, l.wfl, l.c, l.atr14, l.t_low, l.t_high, l.sz, coalesce(r.blocks, []) AS blocks, coalesce(r.soft_text, []) AS soft_text, coalesce(f.flags, []) AS flags, coalesce(z.items, []) AS items,
    'technical ' || {fix('l.tsc')} || '/100 (' || t.label || '); close ' || {text('t.close')} || ' vs SMA200 ' || {text(pyr('t.sma200', 1))} || ', RSI ' || {text(pyr('t.rsi', 1))} || ' [score#]' AS tech_line,
    'fundamentals ' || {fix('l.fs')} || '/100 over ' || f.n_quarters || 'q (' || f.basis || '); rev YoY ' || coalesce({fix('f.rev_yoy * 100e0')} || '%', 'n/a') || ' [score#]' AS fund_line,
    'flow ' || {fix('l.ws')} || '/100 (' || w.label || ') [score#]' || coalesce('; 20d large-deal net ratio ' || {fix(pyr('w.deal_ratio', 4) + ' * 100e0', 1, '+')} || '%', '') || coalesce('; promoter Δ ' || {fix(pyr('w.promoter_delta', 2), 2, '+')} || 'pp', '') AS flow_line
    FROM lv0 l LEFT JOIN tech_live t ON t.symbol = l.symbol LEFT JOIN fund_text f ON f.symbol = l.symbol LEFT JOIN flow_live w ON w.symbol = l.symbol LEFT JOIN risk_text r ON r.symbol = l.symbol LEFT JOIN cites z ON z.symbol = l.symbol""")
_HAS = {"tech": "tsc IS NOT NULL AND wt > 0", "fund": "fs IS NOT NULL AND wf > 0", "flow": "ws IS NOT NULL AND wfl > 0"}
_SC = {"tech": "tsc", "fund": "fs", "flow": "ws"}
_one = lambda a, op: f"CASE WHEN {_HAS[a]} AND {_SC[a]} {op} 55 THEN {a}_line END"
_score = lambda items, word: f"list_transform(({items})[1:3], lambda x: 'A6 {word}: ' || x || ' [score#]')"
part("thesis", f"""SELECT *, CASE WHEN stance NOT IN ('exit', 'suppressed') THEN stop END AS inval,
    list_concat({some(*[_one(a, '>=') for a in _SC])}, list_transform(list_filter(items[1:3], lambda e: e.good), lambda e: e.t))[1:3] AS pro,
    list_concat({some(_one('tech', '<'), _one('fund', '<'))}, CASE WHEN {_HAS['fund']} THEN list_transform(flags[1:2], lambda x: 'forensic flag: ' || x || ' [score#]') ELSE [] END,
      {some(_one('flow', '<'))}, list_transform(list_filter(items[1:3], lambda e: NOT e.good), lambda e: e.t), {_score('blocks', 'block')}, {_score('soft_text', 'penalty')})[1:3] AS con
    FROM axis_lines""")
part("thesis2", f"""SELECT *, CASE WHEN len(blocks) > 0 THEN 'A6 clearing its block would restore scoring (currently: ' || blocks[1] || ')'
    WHEN {_HAS['tech']} AND inval IS NOT NULL THEN 'a close below ' || cast(inval as varchar) || ' (this profile''s ATR stop) invalidates the technical basis'
    WHEN {_HAS['fund']} THEN 'next quarterly result reversing the fundamental trend' ELSE 'any high-materiality filing (event coverage is the only input)' END AS changer FROM thesis""")
oracle("thesis_bullets", "SELECT symbol, profile, array_to_string(pro, chr(10)) AS thesis_for, array_to_string(con, chr(10)) AS thesis_against, changer AS view_changer, array_to_string(list_transform(items, lambda e: e.id), ',') AS event_filings FROM thesis2")

# ---------------------------------------------------------------- messages

esc = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
g = lambda x: f"format('{{:g}}', {x})"
_cap = lambda x: f"upper(substr({x}, 1, 1)) || substr({x}, 2)"
_NAME = f"coalesce(CASE WHEN s.company_name <> '' THEN ' · ' || {esc('substr(s.company_name, 1, 40)')} END, '')"
part("sig_now", f"SELECT DISTINCT ON (symbol) * FROM signals WHERE as_of <= {NOW} AND profile = 'default' ORDER BY symbol, as_of DESC, signal_id DESC")
oracle("alert_messages", f"""SELECT f.filing_id, CASE WHEN c.materiality >= 8 THEN 'high' ELSE 'medium' END AS severity, concat_ws(chr(10),
    CASE WHEN c.materiality >= 8 THEN '🔴' ELSE '🟠' END || ' <b>' || {esc("coalesce(f.symbol, '?')")} || '</b>' || {_NAME},
    '<b>Event:</b> ' || {esc('c.category')} || '  (materiality ' || c.materiality || '/10)',
    '<b>Expected impact:</b> ' || CASE WHEN coalesce(c.sentiment, 0) > 0.15e0 THEN '📈 positive' WHEN coalesce(c.sentiment, 0) < -0.15e0 THEN '📉 negative' ELSE '➖ neutral' END,
    CASE WHEN coalesce(c.summary, '') <> '' THEN '<b>What happened:</b> ' || {esc('substr(c.summary, 1, 180)')} END,
    CASE WHEN n.stance IS NULL THEN '<i>No standing signal for this symbol yet</i>' ELSE '<b>Standing view:</b> ' || {_cap('n.stance')} || ' (conviction ' || {g('n.conviction')} || ', confidence ' || {fix('100e0 * coalesce(n.confidence, 0e0)')} || '%)' END,
    CASE WHEN c.sentiment < -0.3e0 AND n.stance IN ('buy', 'accumulate') THEN '⚠️ <b>Adverse news against a long stance — review before acting</b>' WHEN c.sentiment < -0.3e0 AND n.stance = 'hold' THEN '⚠️ <b>Sell risk — adverse news while holding; review the position</b>' END,
    CASE WHEN n.invalidation IS NOT NULL THEN '<b>Stop:</b> ' || {g('n.invalidation')} END, '<i>evidence: filing #' || f.filing_id || '</i>') AS message
    FROM filings f JOIN classifications c ON c.filing_id = f.filing_id LEFT JOIN sig_now n ON n.symbol = f.symbol LEFT JOIN securities s ON s.symbol = f.symbol
    WHERE c.model_version = '{V5}' AND c.materiality >= 6 AND NOT coalesce(c.routine, false)""")
_rng = lambda lo, hi: f"{g(lo)} || coalesce(' – ' || {g(hi)}, '')"
_long = lambda x: f"CASE WHEN stance IN ('buy', 'accumulate') AND stop IS NOT NULL THEN {x} END"
part("msg0", f"""SELECT *, {_long(pyr('(c - 0.5e0 * atr14)', 2))} AS el, {_long(pyr('(c + 0.25e0 * atr14)', 2))} AS eh, {_long(pyr('(c + t_low * (c - stop))', 2))} AS tl, {_long(pyr('(c + t_high * (c - stop))', 2))} AS th, {_long(pyr('sz', 1))} AS size_pct
    FROM thesis2 WHERE profile = 'default' AND stance IN ('buy', 'exit', 'suppressed')""")
oracle("signal_messages", f"""SELECT m.symbol, 'medium' AS severity, concat_ws(chr(10),
    CASE m.stance WHEN 'buy' THEN '🟢' WHEN 'exit' THEN '🔴' ELSE '🚫' END || ' <b>' || {_cap('m.stance')} || ': ' || {esc('m.symbol')} || '</b>' || {_NAME},
    '<b>Horizon:</b> ' || m.horizon || ' (' || m.profile || ')', '<b>Conviction:</b> ' || {g('m.conviction')} || '/100 · <b>Confidence:</b> ' || {fix('100e0 * coalesce(m.confidence, 0e0)')} || '%',
    '<b>Risk check:</b> ' || m.verdict, CASE WHEN el IS NOT NULL THEN '<b>Entry zone:</b> ' || {_rng('el', 'eh')} END, CASE WHEN tl IS NOT NULL THEN '<b>Target zone:</b> ' || {_rng('tl', 'th')} END,
    CASE WHEN inval IS NOT NULL THEN '<b>Stop loss:</b> ' || {g('inval')} END, CASE WHEN size_pct IS NOT NULL THEN '<b>Position size:</b> ' || {g('size_pct')} || '% of capital' END,
    CASE WHEN len(pro) > 0 THEN '<b>Why:</b> ' || {esc('substr(pro[1], 1, 140)')} END, CASE WHEN changer <> '' THEN '<b>View changes if:</b> ' || {esc('substr(changer, 1, 120)')} END,
    '<i>evidence: signal #' || substr(m.symbol, 2) || '</i>') AS message FROM msg0 m LEFT JOIN securities s ON s.symbol = m.symbol""")

assert K.RISK_UNAVAILABLE[2].endswith("Phase 5)")
