"""DuckDB statements stating the expected result of every query.

A statement is a final SELECT plus the named parts it reads. Parts are written apart from the
package's plans: recursions replace closed forms, plain windows replace arrays, and joins
without any pruning replace the bounded ones.
"""

from __future__ import annotations

import re

from tapeloom import constants as K
from tapeloom.driver.tables import AS_OF, VIEWS, duck_view

NOW = f"TIMESTAMP '{AS_OF}'"
TODAY = f"DATE '{AS_OF[:10]}'"
POLL_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
V5 = K.CLASSIFIER_VERSION


def MID(day: str) -> str:
    """Market midnight of a day, in UTC."""
    return f"(cast({day} as timestamp) - INTERVAL 330 MINUTE)"


PARTS: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", re.sub(r"'[^']*'", "''", sql)))
    return [n for n in (*VIEWS, *PARTS) if n in words]


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


def oracle(name: str, sql: str) -> None:
    """Registers a statement with the parts it reads, in dependency order."""
    done: dict[str, str] = {}

    def add(n: str, trail: tuple = ()) -> None:
        if n in done or n in trail:
            return
        text = PARTS[n] if n in PARTS else duck_view(n)[0]
        inner = [m for m in (_needs(text) if n in PARTS else duck_view(n)[1]) if m in PARTS or m in VIEWS]
        for m in inner:
            if m != n:
                add(m, (*trail, n))
        done[n] = text

    for n in _needs(sql):
        add(n)
    head = ", ".join(f"{n} AS ({t})" for n, t in done.items())
    ORACLES[name] = (f"WITH RECURSIVE {head} " if done else "") + sql


def r6(*names: str) -> str:
    return ", ".join(f"{q6(n)} AS {n}" for n in names)


def q6(x: str) -> str:
    """Six decimals by one product and one floor, so both engines round alike."""
    return f"floor({x} * 1e6 + 0.5e0) / 1e6"


def ts(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c}"


def pyr(x: str, n: int) -> str:
    """Half-even rounding on the exact binary value, by an exact product remainder."""
    s, h = f"1e{n}", f"({x} * 134217729e0)"
    hi = f"({h} - ({h} - {x}))"
    p, low = f"({x} * {s})", f"floor({x} * {s})"
    over = f"(({p} - {low}) - 0.5e0 + (({hi} * {s} - {p}) + ({x} - {hi}) * {s}))"
    return f"(({low} + CASE WHEN {over} > 0 OR ({over} = 0 AND {low} % 2 <> 0) THEN 1e0 ELSE 0e0 END) / {s})"


W = "PARTITION BY symbol ORDER BY trade_date"

# ---------------------------------------------------------------- bars and indicators

part("bars_n", f"SELECT *, row_number() OVER ({W}) AS rn, lag(close) OVER ({W}) AS pc, lag(high) OVER ({W}) AS ph, lag(low) OVER ({W}) AS pl FROM bars")
part("moves", """SELECT symbol, rn - 1 AS i, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss,
    greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
    CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm,
    CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm FROM bars_n WHERE rn > 1""")
part("rec_wild", """SELECT symbol, cast(14 as bigint) AS i, sum(gain) / 14 AS ag, sum(loss) / 14 AS al, sum(tr) / 14 AS wat, sum(tr) AS trs, sum(pdm) AS ps, sum(mdm) AS ms
    FROM moves WHERE i <= 14 GROUP BY symbol HAVING count(*) = 14
    UNION ALL
    SELECT m.symbol, m.i, (w.ag * 13 + m.gain) / 14, (w.al * 13 + m.loss) / 14, (w.wat * 13 + m.tr) / 14,
           w.trs - w.trs / 14 + m.tr, w.ps - w.ps / 14 + m.pdm, w.ms - w.ms / 14 + m.mdm
    FROM rec_wild w JOIN moves m ON m.symbol = w.symbol AND m.i = w.i + 1""")
part("dir_moves", """SELECT symbol, i - 14 AS j, CASE WHEN trs <> 0 THEN 100 * ps / trs ELSE 0 END AS pdi, CASE WHEN trs <> 0 THEN 100 * ms / trs ELSE 0 END AS mdi
    FROM rec_wild WHERE i > 14""")
part("dx_rows", "SELECT *, CASE WHEN pdi + mdi <> 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) ELSE 0 END AS dx FROM dir_moves")
part("rec_adx", """SELECT symbol, cast(14 as bigint) AS j, sum(dx) / 14 AS adx FROM dx_rows WHERE j <= 14 GROUP BY symbol HAVING count(*) = 14
    UNION ALL SELECT d.symbol, d.j, (a.adx * 13 + d.dx) / 14 FROM rec_adx a JOIN dx_rows d ON d.symbol = a.symbol AND d.j = a.j + 1""")
part("ind_w", f"""SELECT *,
    CASE WHEN rn >= 20 THEN avg(close) OVER ({W} ROWS 19 PRECEDING) END AS sma20,
    CASE WHEN rn >= 50 THEN avg(close) OVER ({W} ROWS 49 PRECEDING) END AS sma50,
    CASE WHEN rn >= 200 THEN avg(close) OVER ({W} ROWS 199 PRECEDING) END AS sma200,
    avg(volume) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vm, stddev_pop(volume) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vs,
    min(volume) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vlo, max(volume) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vhi,
    max(close) OVER ({W} ROWS 249 PRECEDING) AS hi52, min(close) OVER ({W} ROWS 249 PRECEDING) AS lo52,
    close / lag(close, 63) OVER ({W}) - 1 AS ret63,
    list_sort(list(turnover) OVER ({W} ROWS 19 PRECEDING)) AS t20, list_filter(list(delivery_pct) OVER ({W} ROWS 19 PRECEDING), lambda x: x <> 0) AS d20 FROM bars_n""")
part("ind", """SELECT b.*, CASE WHEN b.rn > 20 THEN CASE WHEN vlo = vhi THEN sign(volume - vlo) * 5e0 ELSE (volume - vm) / vs END END AS vol_z,
    w.ag, w.al, w.wat AS atr, a.adx, CASE WHEN a.adx IS NOT NULL THEN d.pdi END AS plus_di, CASE WHEN a.adx IS NOT NULL THEN d.mdi END AS minus_di
    FROM ind_w b LEFT JOIN rec_wild w ON w.symbol = b.symbol AND w.i = b.rn - 1
    LEFT JOIN dir_moves d ON d.symbol = b.symbol AND d.j = b.rn - 15
    LEFT JOIN rec_adx a ON a.symbol = b.symbol AND a.j = b.rn - 15""")
part("ind2", """SELECT *, t20[len(t20) // 2 + 1] AS median_turnover,
    CASE WHEN ag IS NULL THEN NULL WHEN al = 0 THEN 100e0 ELSE 100e0 - 100e0 / (1 + ag / al) END AS rsi,
    CASE WHEN len(d20) >= 10 AND list_avg(d20[len(d20) // 2 + 1:]) > list_avg(d20[:len(d20) // 2]) THEN 5e0 ELSE 0e0 END AS delivery_pts FROM ind""")
part("index_n", f"SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER () AS n, close / lag(close, 63) OVER ({W}) - 1 AS idx_ret63 FROM index_bars")

oracle("daily_bars", f"SELECT symbol, trade_date, series, {r6('open', 'high', 'low', 'close', 'delivery_pct')}, volume, turnover, trades, delivery_qty FROM bars")
oracle("sma_stack", f"SELECT symbol, trade_date, {r6('sma20', 'sma50', 'sma200')} FROM ind2")
oracle("zscore_volume", f"SELECT symbol, trade_date, {r6('vol_z')} FROM ind2")
oracle("range_52w", f"SELECT symbol, trade_date, {r6('hi52', 'lo52')} FROM ind2")
oracle("upper_median_turnover", "SELECT symbol, trade_date, median_turnover FROM ind2")
oracle("rsi_wilder", f"SELECT symbol, trade_date, {r6('rsi')} FROM ind2")
oracle("atr_wilder", "SELECT symbol, trade_date, floor(atr * 1e4 + 0.5e0) / 1e4 AS atr FROM ind2")
oracle("adx_wilder", f"SELECT symbol, trade_date, {r6('adx', 'plus_di', 'minus_di')} FROM ind2")
oracle("delivery_trend", "SELECT symbol, trade_date, delivery_pts FROM ind2")
part("last_rs", f"SELECT symbol, close / lag(close, 63) OVER ({W}) - 1 AS ret63, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back FROM bars")
part("idx_last", "SELECT arg_max(idx_ret63, trade_date) AS idx_ret63 FROM index_n")
oracle("relative_strength", f"SELECT symbol, {r6('ret63', 'idx_ret63', 'excess')} FROM (SELECT symbol, ret63, idx_ret63, ret63 - idx_ret63 AS excess FROM last_rs, idx_last WHERE back = 1)")


def tech(src: str) -> str:
    """Score columns over rows holding the indicators and idx_ret63."""
    inner = f"""SELECT *, (CASE WHEN close > sma20 THEN 6e0 ELSE 0 END) + (CASE WHEN close > sma50 THEN 6e0 ELSE 0 END) + (CASE WHEN close > sma200 THEN 6e0 ELSE 0 END)
      + (CASE WHEN sma20 > sma50 THEN 6e0 ELSE 0 END) + (CASE WHEN sma50 > sma200 THEN 6e0 ELSE 0 END) AS trend,
      (CASE WHEN rsi IS NOT NULL THEN 10e0 * greatest(0e0, 1e0 - abs(rsi - 60e0) / 40e0) ELSE 0e0 END) + (CASE WHEN adx > 20 THEN CASE WHEN plus_di > minus_di THEN 10e0 ELSE 2e0 END ELSE 0e0 END) AS momentum,
      ret63 - idx_ret63 AS rs_excess,
      CASE WHEN ret63 - idx_ret63 IS NULL THEN 10e0 ELSE greatest(0e0, least(20e0, 10e0 + 100e0 * (ret63 - idx_ret63))) END AS rel_strength,
      least(15e0, (CASE WHEN vol_z IS NULL THEN 7.5e0 ELSE greatest(0e0, least(10e0, 5e0 + 2.5e0 * vol_z)) END) + delivery_pts) AS vol_delivery,
      15e0 * (CASE WHEN hi52 <> lo52 THEN (close - lo52) / (hi52 - lo52) ELSE 0.5e0 END) AS range_pos,
      100e0 * (close / hi52 - 1e0) AS pct_off_52w_high, close - 2e0 * nullif(atr, 0) AS atr_stop FROM {src}"""
    total = f"SELECT *, trend + momentum + rel_strength + vol_delivery + range_pos AS total FROM ({inner})"
    scored = f"SELECT *, {pyr('total', 1)} AS score, least(1e0, rn / 250e0) AS confidence FROM ({total})"
    return f"""SELECT *, CASE WHEN score >= 75 THEN 'strong_uptrend' WHEN score >= 60 THEN 'uptrend' WHEN score >= 40 THEN 'range' WHEN score >= 25 THEN 'downtrend' ELSE 'strong_downtrend' END AS label FROM ({scored})"""


part("last_bar", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back FROM ind2 WHERE trade_date <= {TODAY}) WHERE back = 1 AND rn >= 60 AND median_turnover >= 10")
part("idx_live", f"SELECT arg_max(idx_ret63, trade_date) AS idx_ret63 FROM index_n WHERE trade_date <= {TODAY}")
part("tech_live", tech("(SELECT * FROM last_bar, idx_live)"))
part("last_any", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back FROM ind2) WHERE back = 1 AND rn >= 60 AND median_turnover >= 10 AND trade_date = (SELECT max(trade_date) FROM bars)")
part("tech_latest", tech("(SELECT * FROM last_any, idx_last)"))
_COLS = r6("confidence", "trend", "momentum", "rel_strength", "vol_delivery", "range_pos", "rs_excess", "pct_off_52w_high", "atr_stop")
oracle("technical_score", f"SELECT symbol, trade_date AS as_of, score, label, {_COLS}, rn AS bar_no FROM tech_live")
oracle("technical_leaderboard", f"SELECT symbol, trade_date AS as_of, score, label, {r6('confidence', 'trend', 'range_pos')} FROM tech_latest")
oracle("liquid_universe", f"SELECT symbol, {r6('median_turnover')} FROM (SELECT symbol, quantile_cont(turnover, 0.5) AS median_turnover FROM bars GROUP BY symbol ORDER BY 2 DESC, 1 LIMIT 50)")
part("last90", "SELECT symbol, trade_date, close, min(close) OVER (PARTITION BY symbol) AS lo, max(close) OVER (PARTITION BY symbol) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS b FROM bars) WHERE b <= 90")
oracle("sparkline", f"SELECT symbol, trade_date, {r6('close', 'position')} FROM (SELECT *, CASE WHEN hi = lo THEN 0.5e0 ELSE (close - lo) / (hi - lo) END AS position FROM last90)")

# ---------------------------------------------------------------- as-of and performance

part("quarter_grid", "SELECT s.symbol, q.day FROM securities s, (SELECT DISTINCT period_end AS day FROM quarters) q")
oracle("asof_backward", f"SELECT g.symbol, g.day, b.trade_date AS bar_date, floor((b.close) * 1e6 + 0.5e0) / 1e6 AS close FROM quarter_grid g ASOF LEFT JOIN bars b ON g.symbol = b.symbol AND g.day >= b.trade_date")
oracle("asof_forward", f"SELECT g.symbol, g.day, b.trade_date AS bar_date, floor((b.close) * 1e6 + 0.5e0) / 1e6 AS close FROM quarter_grid g ASOF LEFT JOIN bars b ON g.symbol = b.symbol AND g.day <= b.trade_date")
part("fwd", f"SELECT symbol, trade_date, close, row_number() OVER ({W}) AS rn, " + ", ".join(f"lead(close, {n}) OVER ({W}) AS close_{k}, lead(close, {n}) OVER ({W}) / close - 1 AS ret_{k}" for k, n in K.FORWARD_WINDOWS.items()) + " FROM bars")
part("idx_fwd", f"SELECT trade_date, close, " + ", ".join(f"lead(close, {n}) OVER ({W}) AS close_{k}, lead(close, {n}) OVER ({W}) / close - 1 AS ret_{k}" for k, n in K.FORWARD_WINDOWS.items()) + " FROM index_bars")
oracle("forward_returns", f"SELECT symbol, trade_date, {r6('ret_1w', 'ret_4w', 'ret_12w')} FROM fwd")
part("entries", "SELECT s.*, b.rn AS brn, b.close AS entry_price FROM signals s ASOF JOIN fwd b ON s.symbol = b.symbol AND s.as_of <= b.trade_date")
part("idx_entries", "SELECT s.signal_id, i.close AS ic, i.close_1w AS i_1w, i.close_4w AS i_4w, i.close_12w AS i_12w FROM signals s ASOF JOIN idx_fwd i ON s.as_of <= i.trade_date")
part("measured", " UNION ALL ".join(
    f"SELECT e.signal_id, '{k}' AS \"window\", e.stance, e.profile, e.model_version, e.entry_price, f.close AS exit_price, f.close / e.entry_price - 1 AS ret, i.i_{k} / i.ic - 1 AS index_ret, f.close / e.entry_price - 1 - (i.i_{k} / i.ic - 1) AS excess FROM entries e JOIN fwd f ON f.symbol = e.symbol AND f.rn = e.brn + {n} LEFT JOIN idx_entries i ON i.signal_id = e.signal_id"
    for k, n in K.FORWARD_WINDOWS.items()))
oracle("signal_performance", f"SELECT signal_id, \"window\", stance, profile, {r6('entry_price', 'exit_price', 'ret', 'index_ret', 'excess')} FROM measured")
oracle("performance_pending", "SELECT \"window\", count(*) AS n FROM measured WHERE \"window\" <> '1w' GROUP BY 1")
oracle("performance_summary", f"SELECT stance, \"window\", n, {r6('avg_excess_pct', 'hit_rate_pct')} FROM (SELECT stance, \"window\", count(*) AS n, 100 * avg(excess) AS avg_excess_pct, 100 * avg(CASE WHEN excess > 0 THEN 1e0 WHEN excess <= 0 THEN 0e0 END) AS hit_rate_pct FROM measured WHERE model_version = '{K.FUSION_VERSION}' GROUP BY 1, 2)")
oracle("buy_and_hold", "SELECT floor((100 * ((SELECT arg_max(close, trade_date) FROM index_n) / (SELECT close FROM index_n WHERE i = 80) - 1)) * 1e6 + 0.5e0) / 1e6 AS buy_hold_pct")

# ---------------------------------------------------------------- fundamentals


def fund(src: str) -> str:
    """Score columns over quarter rows of (symbol, st); one row per (symbol, st)."""
    w = "PARTITION BY symbol, st ORDER BY period_end"
    m = "(revenue - (expenses - coalesce(finance_costs, 0) - coalesce(depreciation, 0))) / nullif(revenue, 0)"
    g = lambda c, n: f"CASE WHEN lag({c}, {n}) OVER ({w}) > 0 THEN ({c} - lag({c}, {n}) OVER ({w})) / lag({c}, {n}) OVER ({w}) END"
    rows = f"SELECT *, row_number() OVER ({w}) AS qno, count(*) OVER (PARTITION BY symbol, st) AS n_quarters, {g('revenue', 4)} AS rev_yoy, {g('pat', 4)} AS pat_yoy, {g('revenue', 1)} AS rev_qoq, {g('pat', 1)} AS pat_qoq, list(CASE WHEN revenue > 0 THEN {m} END) OVER ({w}) AS ml FROM {src}"
    last = f"SELECT *, list_filter(ml, lambda x: x IS NOT NULL) AS mm, coalesce(rev_yoy, rev_qoq) AS rg, coalesce(pat_yoy, pat_qoq) AS pg, CASE WHEN pbt > 0 AND other_income <> 0 THEN other_income / pbt END AS oi, CASE WHEN pbt > 0 THEN tax / pbt END AS rate, CASE WHEN revenue > 0 THEN finance_costs / revenue END AS burden FROM ({rows}) WHERE qno = n_quarters"
    cl = lambda x: f"(CASE WHEN {x} IS NULL THEN 10e0 ELSE greatest(0e0, least(20e0, 10e0 + 40e0 * {x})) END)"
    pts = f"""SELECT *, CASE WHEN rg IS NOT NULL OR pg IS NOT NULL THEN {cl('rg')} + {cl('pg')} END AS growth_pts, mm[-1] AS op_margin,
      CASE WHEN len(mm) > 0 THEN least(25e0, greatest(0e0, least(15e0, 15e0 * mm[-1] / 0.25e0)) + CASE WHEN len(mm) >= 3 THEN CASE WHEN mm[-1] > mm[-3] THEN 10e0 ELSE 2e0 END WHEN len(mm) = 2 THEN CASE WHEN mm[-1] > mm[-2] THEN 8e0 ELSE 3e0 END ELSE 5e0 END) END AS margin_pts,
      greatest(0e0, 35e0 - (CASE WHEN oi > 0.5e0 THEN 12 WHEN oi > 0.3e0 THEN 6 ELSE 0 END) - (CASE WHEN rate < 0.10e0 OR rate > 0.45e0 THEN 8 ELSE 0 END)
        - (CASE WHEN pbt <> 0 AND abs(exceptional) > 0.25e0 * abs(pbt) THEN 8 ELSE 0 END) - (CASE WHEN burden > 0.15e0 THEN 7 ELSE 0 END) - (CASE WHEN pat < 0 THEN 10 ELSE 0 END)) AS quality_pts,
      cast((CASE WHEN oi > 0.3e0 THEN 1 ELSE 0 END) + (CASE WHEN rate < 0.10e0 OR rate > 0.45e0 THEN 1 ELSE 0 END) + (CASE WHEN pbt <> 0 AND abs(exceptional) > 0.25e0 * abs(pbt) THEN 1 ELSE 0 END)
        + (CASE WHEN burden > 0.15e0 THEN 1 ELSE 0 END) + (CASE WHEN pat < 0 THEN 1 ELSE 0 END) as bigint) AS n_flags FROM ({last})"""
    cov = f"SELECT *, (CASE WHEN growth_pts IS NOT NULL THEN 40e0 ELSE 0e0 END) + (CASE WHEN margin_pts IS NOT NULL THEN 25e0 ELSE 0e0 END) + 35e0 AS weight_covered FROM ({pts})"
    raw = f"SELECT *, (coalesce(growth_pts, 0e0) + coalesce(margin_pts, 0e0) + quality_pts) * (100e0 / weight_covered) AS raw_score, least(1e0, n_quarters / 8e0) * (weight_covered / 100e0) AS raw_conf FROM ({cov})"
    return f"SELECT *, least(100e0, {pyr('raw_score', 1)}) AS score, {pyr('raw_conf', 2)} AS confidence, CASE WHEN n_flags >= 2 THEN 'flagged' WHEN n_flags = 0 THEN 'clean' ELSE 'watch' END AS label, period_end AS as_of FROM ({raw})"


part("quarters_v", f"SELECT *, coalesce(cast(event_at as date), period_end + {K.RESULT_LAG_DAYS}) AS visible_on FROM quarters")
part("quarters_live", f"SELECT * FROM quarters_v WHERE visible_on <= {TODAY}")
part("book_live", "SELECT *, 0 AS st FROM quarters_live q WHERE basis = 'consolidated' OR (basis = 'standalone' AND NOT EXISTS (SELECT 1 FROM quarters_live c WHERE c.symbol = q.symbol AND c.basis = 'consolidated'))")
part("fund_live", fund("book_live"))
part("cons", "SELECT * FROM quarters_v WHERE basis = 'consolidated'")
part("book_states", "SELECT c.*, s.st FROM cons c JOIN (SELECT DISTINCT symbol, visible_on AS st FROM cons) s ON s.symbol = c.symbol AND c.visible_on <= s.st")
part("fund_states", fund("book_states"))
oracle("quarterly_growth", f"SELECT symbol, as_of, {r6('rev_yoy', 'pat_yoy', 'rev_qoq', 'pat_qoq', 'growth_pts')} FROM fund_live")
oracle("margin_trajectory", f"SELECT symbol, as_of, {r6('op_margin', 'margin_pts')} FROM fund_live")
oracle("fundamental_score", "SELECT symbol, as_of, basis, score, label, confidence, weight_covered, n_quarters FROM fund_live")
oracle("fundamental_states", "SELECT symbol, st AS visible_on, score, label, confidence, n_quarters FROM fund_states")

part("rev_n", "SELECT *, row_number() OVER (PARTITION BY symbol, period_end, basis ORDER BY doc_no) AS rn FROM revisions")
part("rev_med", "SELECT p.symbol, p.period_end, list_sort(list(o.revenue)) AS o FROM (SELECT DISTINCT symbol, period_end FROM revisions) p JOIN revisions o ON o.symbol = p.symbol AND o.period_end <> p.period_end AND o.revenue <> 0 GROUP BY 1, 2")
part("rec_rev", """SELECT symbol, period_end, basis, rn, doc, revenue FROM rev_n WHERE rn = 1
    UNION ALL
    SELECT n.symbol, n.period_end, n.basis, n.rn,
      CASE WHEN greatest(n.revenue, r.revenue) > 5 * least(n.revenue, r.revenue) AND abs(r.revenue - m.o[len(m.o) // 2 + 1]) < abs(n.revenue - m.o[len(m.o) // 2 + 1]) THEN r.doc ELSE n.doc END,
      CASE WHEN greatest(n.revenue, r.revenue) > 5 * least(n.revenue, r.revenue) AND abs(r.revenue - m.o[len(m.o) // 2 + 1]) < abs(n.revenue - m.o[len(m.o) // 2 + 1]) THEN r.revenue ELSE n.revenue END
    FROM rec_rev r JOIN rev_n n ON n.symbol = r.symbol AND n.period_end = r.period_end AND n.basis = r.basis AND n.rn = r.rn + 1
    LEFT JOIN rev_med m ON m.symbol = n.symbol AND m.period_end = n.period_end""")
oracle("revision_dedup_misfile", "SELECT symbol, period_end, basis, arg_max(doc, rn) AS doc, floor((arg_max(revenue, rn)) * 1e6 + 0.5e0) / 1e6 AS revenue FROM rec_rev GROUP BY 1, 2, 3")
_FACT = lambda f: f"max(CASE WHEN fact = '{f}' THEN text END)"
_NUM = lambda f: f"try_cast({_FACT(f)} as double)"
part("main_facts", "SELECT f.* FROM result_facts f JOIN (SELECT doc, arg_min(context, seq) AS context FROM result_facts WHERE fact = 'DateOfEndOfReportingPeriod' GROUP BY 1) m ON m.doc = f.doc AND m.context = f.context")
part("instances", f"""SELECT doc, nullif(upper(trim({_FACT('Symbol')})), '') AS own_symbol, cast({_FACT('DateOfStartOfReportingPeriod')} as date) AS period_start, cast({_FACT('DateOfEndOfReportingPeriod')} as date) AS period_end,
    CASE WHEN lower({_FACT('NatureOfReportStandaloneConsolidated')}) LIKE '%consolidated%' AND lower({_FACT('NatureOfReportStandaloneConsolidated')}) NOT LIKE '%non%' THEN 'consolidated' ELSE 'standalone' END AS basis,
    lower({_FACT('WhetherResultsAreAuditedOrUnaudited')}) LIKE 'audited%' AS audited, coalesce({_NUM('RevenueFromOperations')}, {_NUM('InterestEarned')}) AS revenue,
    {_NUM('OtherIncome')} AS other_income, {_NUM('Income')} AS total_income, {_NUM('Expenses')} AS expenses, {_NUM('FinanceCosts')} AS finance_costs, {_NUM('ProfitBeforeTax')} AS pbt, {_NUM('TaxExpense')} AS tax, {_NUM('ProfitLossForPeriod')} AS pat
    FROM main_facts GROUP BY doc""")
oracle("xbrl_quarters", f"SELECT i.doc, coalesce(i.own_symbol, q.symbol) AS symbol, period_start, i.period_end, i.basis, i.audited, {', '.join(f'floor((i.{c}) * 1e6 + 0.5e0) / 1e6 AS {c}' for c in ('revenue', 'other_income', 'total_income', 'expenses', 'finance_costs', 'pbt', 'tax', 'pat'))} FROM instances i JOIN quarters q ON i.doc = 'd' || cast(q.filing_id as string) WHERE i.period_end - i.period_start BETWEEN 80 AND 100")
part("hold_raw", f"""SELECT doc, max(CASE WHEN promoter AND fact = '{K.PROMOTER_PCT_FACT}' THEN cast(text as double) END) AS p,
    coalesce(max(CASE WHEN promoter AND fact = '{K.ENCUMBERED_PCT_FACTS[0]}' THEN cast(text as double) END), max(CASE WHEN promoter AND fact = '{K.ENCUMBERED_PCT_FACTS[1]}' THEN cast(text as double) END)) AS e,
    max(CASE WHEN promoter AND fact = '{K.ENCUMBERED_NUM_FACTS[0]}' THEN cast(text as double) END) AS shares,
    coalesce(bool_and(CASE WHEN fact LIKE '{K.ENCUMBRANCE_FLAG_PREFIX}%' THEN text = 'false' END), false) AS zero FROM holding_facts GROUP BY doc""")
part("hold_pct", f"SELECT *, CASE WHEN p IS NULL THEN 0e0 ELSE {pyr('(p * 100e0)', 2)} END AS pp, CASE WHEN p IS NULL THEN 0e0 WHEN e IS NOT NULL THEN {pyr('(e * 100e0)', 2)} WHEN zero THEN 0e0 END AS ep FROM hold_raw")
oracle("shp_facts", f"SELECT doc, pp AS promoter_pct, CASE WHEN p IS NOT NULL THEN shares END AS encumbered_shares, ep AS encumbered_pct, {pyr('(pp * ep / 100e0)', 2)} AS encumbered_pct_of_total FROM hold_pct")

# ---------------------------------------------------------------- point in time, dedup, keys

part("live_f", f"SELECT * FROM filings WHERE observed_at <= {NOW}")
part("live_c", f"SELECT * FROM classifications WHERE observed_at <= {NOW}")
oracle("pit_filings", f"SELECT filing_id, symbol, subject, {ts('event_at')}, {ts('observed_at')} FROM live_f WHERE feed = 'announcements' AND event_at >= TIMESTAMP '2001-06-01'")
oracle("pit_classified", f"SELECT f.filing_id, f.symbol, c.category, cast(c.materiality as bigint) AS materiality, {ts('f.event_at', 'event_at')} FROM live_f f JOIN live_c c ON c.filing_id = f.filing_id WHERE c.model_version = '{V5}' AND c.materiality >= 5 AND NOT c.routine AND f.event_at >= TIMESTAMP '2000-01-01' ORDER BY c.materiality DESC, f.event_at DESC NULLS LAST, f.filing_id LIMIT 200")
oracle("pit_classified_all", f"SELECT f.filing_id, f.symbol, c.category, cast(c.materiality as bigint) AS materiality, {ts('f.event_at', 'event_at')} FROM live_f f JOIN live_c c ON c.filing_id = f.filing_id WHERE c.model_version = '{V5}' AND c.materiality >= 5 AND NOT c.routine AND f.event_at >= TIMESTAMP '2000-01-01'")
oracle("poison_check", "SELECT feed, count(*) AS n FROM live_f GROUP BY feed")

_T = "trim(coalesce(title, ''))"
_KEY = r"'^[A-Z0-9 /&()\-.]+$'"
part("ent0", f"SELECT *, trim(title) AS ti, trim(description) AS de, regexp_extract(link, '[^/]*$') AS name, list_filter(list_transform(string_split(trim(description), '|'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM raw_entries")
part("ent1", f"""SELECT *, list_filter(ps, lambda x: contains(x, ':') AND len(trim(split_part(x, ':', 1))) <= 40 AND regexp_matches(upper(trim(split_part(x, ':', 1))), {_KEY})) AS kv,
    array_to_string(list_filter(ps, lambda x: NOT (contains(x, ':') AND len(trim(split_part(x, ':', 1))) <= 40 AND regexp_matches(upper(trim(split_part(x, ':', 1))), {_KEY}))), ' | ') AS free FROM ent0""")
_LAST = lambda k: f"list_last(list_filter(kv, lambda x: upper(trim(split_part(x, ':', 1))) = '{k}'))"
_VAL = lambda k: f"trim(substr({_LAST(k)}, strpos({_LAST(k)}, ':') + 1))"
_UTC = "- INTERVAL 330 MINUTE"
part("ent2", f"""SELECT *, nullif({_VAL('SUBJECT')}, '') AS s_subject, {_VAL('PERIOD')} AS period, nullif(free, '') AS free_text,
    len(list_distinct(list_transform(kv, lambda x: upper(trim(split_part(x, ':', 1)))))) + (CASE WHEN free <> '' THEN 1 ELSE 0 END) AS n_fields,
    coalesce(try_strptime(pub, '%d-%b-%Y %H:%M:%S'), try_strptime(pub, '%d-%b-%Y %H:%M'), try_strptime(pub, '%d-%b-%Y')) {_UTC} AS p_at,
    try_strptime(nullif(regexp_extract(name, '_(20\\d{{6}})_(\\d{{6}})', 1) || regexp_extract(name, '_(20\\d{{6}})_(\\d{{6}})', 2), ''), '%Y%m%d%H%M%S') {_UTC} AS l1,
    try_strptime(nullif(regexp_extract(name, '_(\\d{{8}})(\\d{{6}})(?:\\D|$)', 1) || regexp_extract(name, '_(\\d{{8}})(\\d{{6}})(?:\\D|$)', 2), ''), '%d%m%Y%H%M%S') {_UTC} AS l2 FROM ent1""")
part("typed", f"""SELECT filing_id, feed, observed_at, ti AS company_title, nullif(regexp_extract(link, '/corporate/([A-Z0-9&\\-]{{1,20}})_\\d{{8,}}', 1), '') AS symbol_hint,
    coalesce(s_subject, free_text, ti) AS subject, sha256(feed || chr(31) || ti || chr(31) || link || chr(31) || pub || chr(31) || de) AS content_hash, nullif(link, '') AS dedup_key,
    CASE WHEN regexp_matches(lower(link), '\\.(pdf|xml|zip|xls|xlsx|csv)$') THEN link END AS attachment_url, coalesce(p_at, l1, l2) AS event_at, period, free_text, cast(n_fields as bigint) AS n_fields FROM ent2""")
oracle("rss_entries", f"SELECT filing_id, symbol_hint, subject, content_hash, dedup_key, attachment_url, {ts('event_at')}, period, free_text, n_fields FROM typed")
_DEDUP = lambda src: f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN dedup_key IS NULL THEN content_hash ELSE feed || '|' || dedup_key END ORDER BY observed_at, filing_id) AS r2
    FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY observed_at, filing_id) AS r1 FROM {src}) WHERE r1 = 1) WHERE r2 = 1"""
part("unique_all", _DEDUP("typed"))
part("unique_old", _DEDUP("(SELECT * FROM typed WHERE observed_at < TIMESTAMP '1998-06-01')"))
part("unique_new", _DEDUP("(SELECT * FROM typed WHERE observed_at >= TIMESTAMP '1998-06-01')"))
oracle("filing_dedup_two_layer", "SELECT filing_id, feed, dedup_key, content_hash FROM unique_all")
oracle("filing_dedup_stored", "SELECT n.filing_id, n.feed FROM unique_new n WHERE NOT EXISTS (SELECT 1 FROM unique_old o WHERE o.content_hash = n.content_hash) AND NOT EXISTS (SELECT 1 FROM unique_old o WHERE o.feed = n.feed AND o.dedup_key = n.dedup_key)")
oracle("first_wins_insert", f"SELECT day, symbol, side, kind, client, qty, {r6('price')} FROM (SELECT *, row_number() OVER (PARTITION BY day, symbol, side, kind ORDER BY seq, price, qty) AS r FROM deals) WHERE r = 1")
oracle("last_wins_upsert", f"SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.agent, n.agent) AS agent, coalesce(n.score, o.score) AS score, coalesce(o.score_id, n.score_id) AS score_id, {ts('coalesce(n.as_of, o.as_of)', 'as_of')} FROM (SELECT * FROM stored_scores WHERE as_of = TIMESTAMP '2001-07-01') o FULL JOIN (SELECT * FROM stored_scores WHERE as_of = TIMESTAMP '2001-07-28') n ON n.symbol = o.symbol AND n.agent = o.agent")
oracle("bucketed_upsert", f"SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.agent, n.agent) AS agent, coalesce(n.score, o.score) AS score, coalesce(o.score_id, n.score_id) AS score_id, {ts('coalesce(n.as_of, o.as_of)', 'as_of')} FROM (SELECT * FROM stored_scores WHERE as_of = TIMESTAMP '2001-07-01') o FULL JOIN (SELECT * FROM stored_scores WHERE as_of = TIMESTAMP '2001-07-28') n ON n.symbol = o.symbol AND n.agent = o.agent")
oracle("uniqueness_check", "SELECT feed, dedup_key, count(*) AS n FROM typed WHERE dedup_key IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
part("doc_files", "SELECT CASE WHEN octet_length(encode(text)) <= 52428800 THEN sha256(text) END AS h, cast(octet_length(encode(text)) as bigint) AS b, 'https://files.example/' || doc_id || '.txt' AS u FROM documents")
oracle("exact_document_dedup", """SELECT h AS sha256, max(b) AS bytes, count(*) AS copies, min(u) AS url, substr(h, 1, 2) || '/' || h || '.txt' AS path, 'fetched' AS fetch_status, cast(NULL as string) AS fetch_error FROM doc_files WHERE h IS NOT NULL GROUP BY h
    UNION ALL SELECT h, b, count(*), u, NULL, 'failed', 'too large: ' || b || ' bytes' FROM doc_files WHERE h IS NULL GROUP BY h, b, u""")
part("by_alias", "SELECT upper(alias) AS a, min(security_id) AS id FROM aliases GROUP BY 1")
part("by_old", "SELECT upper(alias) AS a, min(security_id) AS id FROM aliases WHERE alias_type = 'old_name' GROUP BY 1")
part("tokens", "SELECT event_id, upper(trim(CASE event_id % 5 WHEN 0 THEN ' s' || user_id WHEN 1 THEN 'IN' || lpad(cast(user_id as string), 10, '0') WHEN 2 THEN 'old' || user_id WHEN 3 THEN 'Former Supplier#' || lpad(cast(user_id as string), 9, '0') ELSE '??' END)) AS token FROM event_base")
oracle("resolve_entity", "SELECT t.event_id, coalesce(s.security_id, i.security_id, a.id) AS security_id FROM tokens t LEFT JOIN securities s ON s.symbol = t.token LEFT JOIN securities i ON i.isin = t.token AND len(t.token) = 12 LEFT JOIN by_alias a ON a.a = t.token")


def _named(src: str, key: str, title: str) -> str:
    n = f"upper(trim(regexp_replace({title}, '\\s+', ' ', 'g')))"
    return f"""SELECT t.{key}, coalesce(s.security_id, o.id, s2.security_id, o2.id) AS security_id FROM (SELECT *, {n} AS n, CASE WHEN contains({n}, ' - ') THEN trim(split_part({n}, ' - ', 1)) END AS h FROM {src}) t
        LEFT JOIN securities s ON upper(s.company_name) = t.n LEFT JOIN by_old o ON o.a = t.n LEFT JOIN securities s2 ON upper(s2.company_name) = t.h LEFT JOIN by_old o2 ON o2.a = t.h"""


oracle("resolve_name", _named("raw_entries", "filing_id", "replace(title, '#  ', '#')"))
part("named", _named("typed", "filing_id", "company_title"))
part("linked", "SELECT t.filing_id, t.symbol_hint, coalesce(s.security_id, a.id) AS lid FROM typed t LEFT JOIN securities s ON s.symbol = upper(t.symbol_hint) LEFT JOIN by_alias a ON a.a = upper(t.symbol_hint)")
oracle("attached_filings", "SELECT l.filing_id, coalesce(l.lid, n.security_id) AS security_id, coalesce(l.symbol_hint, s.symbol) AS symbol FROM linked l JOIN named n ON n.filing_id = l.filing_id LEFT JOIN securities s ON s.security_id = coalesce(l.lid, n.security_id)")


def _merge(stored: str) -> str:
    return f"""SELECT n.symbol, o.security_id, CASE WHEN o.security_id IS NULL THEN 'insert' WHEN n.symbol <> o.symbol OR n.company_name <> o.company_name OR n.series IS DISTINCT FROM o.series OR (n.isin IS NOT NULL AND n.isin IS DISTINCT FROM o.isin) OR n.is_sme <> o.is_sme OR n.face_value <> o.face_value THEN 'update' ELSE 'skip' END AS outcome,
        CASE WHEN n.symbol <> o.symbol THEN o.symbol END AS old_symbol, CASE WHEN n.company_name <> o.company_name THEN o.company_name END AS old_name, n.face_value
        FROM snapshot n LEFT JOIN {stored} o ON (n.isin = o.isin) OR (n.symbol = o.symbol AND n.series = o.series AND NOT EXISTS (SELECT 1 FROM {stored} x WHERE x.isin = n.isin))"""


part("held", "SELECT * FROM securities WHERE security_id % 10 <> 7")
oracle("securities_merge", _merge("held"))
part("merged_all", _merge("securities"))
oracle("rename_aliases", "SELECT security_id, old_symbol AS alias, 'old_symbol' AS alias_type FROM merged_all WHERE old_symbol IS NOT NULL UNION ALL SELECT security_id, old_name, 'old_name' FROM merged_all WHERE old_name IS NOT NULL")
part("stated", "SELECT DISTINCT ON (symbol) symbol, stated_industry AS ind_new FROM filings WHERE stated_industry IS NOT NULL AND stated_industry <> '-' AND symbol IS NOT NULL ORDER BY symbol, observed_at DESC, filing_id DESC")
oracle("industry_accretion", "SELECT s.security_id, s.symbol, s.industry AS old_industry, f.ind_new AS industry FROM securities s JOIN stated f ON f.symbol = s.symbol WHERE coalesce(s.industry, '') <> f.ind_new")
part("att_n", "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY moment, attempt_id) AS rn, sum(CASE WHEN outcome = 'unavailable' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY moment, attempt_id) AS tries FROM attempts")
part("att_end", "SELECT doc_id, min(CASE WHEN outcome IN ('ok', 'error') OR (outcome = 'unavailable' AND tries >= 4) THEN rn END) AS stop FROM att_n GROUP BY 1")
part("doc_states", """SELECT e.doc_id, CASE WHEN e.stop IS NULL THEN 'pending' WHEN t.outcome = 'ok' THEN 'fetched' ELSE 'failed' END AS fetch_status,
    cast((SELECT count(*) FROM att_n a WHERE a.doc_id = e.doc_id AND a.outcome = 'unavailable' AND a.rn <= coalesce(e.stop, 1000000)) as bigint) AS attempts,
    (SELECT max(moment) FROM att_n a WHERE a.doc_id = e.doc_id AND a.outcome = 'unavailable' AND e.stop IS NULL) AS last_try FROM att_end e LEFT JOIN att_n t ON t.doc_id = e.doc_id AND t.rn = e.stop""")
part("doc_next", "SELECT *, last_try + to_minutes(CASE attempts WHEN 1 THEN 5 WHEN 2 THEN 15 ELSE 45 END) AS next_attempt_at FROM doc_states")
oracle("document_state", f"SELECT doc_id, fetch_status, attempts, {ts('next_attempt_at')} FROM doc_next")
oracle("due_documents", "SELECT doc_id, attempts FROM doc_next WHERE fetch_status = 'pending' AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '2024-01-20') ORDER BY doc_id LIMIT 100")
oracle("due_documents_all", "SELECT doc_id, attempts FROM doc_next WHERE fetch_status = 'pending' AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '2024-01-20')")
part("pl_held", "SELECT symbol, max(observed_at) AS t FROM pledge WHERE record_id = 'R2' GROUP BY 1")
part("tiers", """SELECT symbol, 0 AS tier FROM live_f WHERE feed IN ('encumbrance', 'sast_reg31') AND symbol IS NOT NULL AND symbol NOT IN (SELECT symbol FROM pl_held)
    UNION ALL SELECT f.symbol, 1 FROM live_f f LEFT JOIN pl_held h ON h.symbol = f.symbol WHERE feed = 'shareholding_pattern' AND f.symbol IS NOT NULL GROUP BY f.symbol HAVING max(h.t) IS NULL OR max(f.observed_at) > max(h.t)
    UNION ALL SELECT symbol, 2 FROM stored_scores WHERE agent IN ('a3', 'a4', 'a5') AND symbol NOT IN (SELECT symbol FROM pl_held)""")
oracle("pledge_worklist", "SELECT symbol, cast(min(tier) as bigint) AS tier FROM tiers GROUP BY 1 ORDER BY 2, 1 LIMIT 200")
oracle("pledge_worklist_all", "SELECT symbol, cast(min(tier) as bigint) AS tier FROM tiers GROUP BY 1")

# ---------------------------------------------------------------- events, flow, risk

_AGE = lambda at, now=NOW: f"greatest(0e0, (epoch_us({now}) - epoch_us({at})) / 86400e6)"
part("ev_rows", f"SELECT f.filing_id, f.symbol, f.subject, f.event_at, c.category, c.materiality, c.sentiment, c.confidence, c.observed_at AS classified_at FROM filings f JOIN classifications c ON c.filing_id = f.filing_id WHERE f.symbol IS NOT NULL AND c.model_version = '{V5}' AND NOT c.routine AND c.materiality >= 3")
part("ev_live", f"SELECT *, 50e0 * pow(0.5e0, {_AGE('classified_at')} / 10e0) * (materiality / 10e0) * confidence * sentiment AS push FROM ev_rows WHERE classified_at <= {NOW} AND classified_at >= {NOW} - INTERVAL 30 DAY")
part("ev_own", "SELECT symbol, greatest(0e0, least(100e0, 50e0 + sum(push))) AS event_score, least(1e0, max(confidence)) AS event_conf, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY materiality DESC, filing_id) AS r FROM ev_live) WHERE r <= 10 GROUP BY symbol")
part("ev_peer", """SELECT symbol, greatest(0e0, least(100e0, 50e0 + sum(push * 0.35e0))) AS peer_score, least(1e0, max(confidence)) * 0.35e0 AS peer_conf, count(*) AS n
    FROM (SELECT me.symbol, e.push, e.confidence, row_number() OVER (PARTITION BY me.symbol ORDER BY e.materiality DESC, e.filing_id) AS r
          FROM securities me JOIN securities p ON p.industry = me.industry AND p.symbol <> me.symbol JOIN ev_live e ON e.symbol = p.symbol WHERE e.materiality >= 7) WHERE r <= 8 GROUP BY symbol""")
oracle("event_score", f"SELECT symbol, {r6('event_score', 'event_conf')}, n FROM ev_own")
oracle("peer_event_score", f"SELECT symbol, {r6('peer_score', 'peer_conf')}, n FROM ev_peer")
part("net", f"SELECT symbol, sum(CASE WHEN side = 'BUY' THEN qty * price ELSE -(qty * price) END) AS net_rs FROM deals WHERE {MID('day')} <= {NOW} AND {MID('day')} >= {NOW} - INTERVAL 28 DAY GROUP BY 1")
oracle("large_deal_net", "SELECT symbol, round(net_rs, 4) AS net_rs FROM net")
part("holdings", f"SELECT symbol, filing_id, event_at, try_cast(regexp_extract(subject, 'PR_AND_PRGRP:\\s*([\\d.]+)', 1) as double) AS pct, try_cast(regexp_extract(subject, 'PUBLIC_VAL:\\s*([\\d.]+)', 1) as double) AS pub, row_number() OVER (PARTITION BY symbol ORDER BY event_at DESC, filing_id DESC) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM live_f WHERE feed = 'shareholding_pattern' AND symbol IS NOT NULL")
part("prom", "SELECT symbol, max(CASE WHEN r = 1 THEN pct END) AS promoter_pct, max(CASE WHEN r = 1 THEN pct END) - max(CASE WHEN r = 2 THEN pct END) AS promoter_delta FROM holdings GROUP BY 1")
oracle("promoter_delta", f"SELECT symbol, {r6('promoter_pct', 'promoter_delta')} FROM prom")
part("surv3", f"SELECT symbol, min(CASE framework WHEN 'gsm' THEN 0e0 WHEN 'asm_lt' THEN 5e0 ELSE 10e0 END) AS surv_pts FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY as_of DESC, framework) AS r FROM surveillance WHERE as_of <= {TODAY}) WHERE r <= 3 GROUP BY 1")
part("flow0", f"""SELECT u.symbol, n.net_rs, t.rs, p.promoter_delta, coalesce(i.n, 0) AS insider_n, coalesce(s.surv_pts, 25e0) AS surv_pts,
    CASE WHEN t.rs > 0 AND n.net_rs IS NOT NULL THEN greatest(-0.5e0, least(0.5e0, n.net_rs / t.rs)) END AS deal_ratio
    FROM (SELECT symbol FROM deals WHERE {MID('day')} <= {NOW} UNION SELECT symbol FROM surveillance WHERE {MID('as_of')} <= {NOW} UNION SELECT symbol FROM live_f WHERE feed = 'shareholding_pattern' AND symbol IS NOT NULL) u
    LEFT JOIN net n ON n.symbol = u.symbol LEFT JOIN (SELECT symbol, sum(turnover) * 1e5 AS rs FROM bars WHERE {MID('trade_date')} <= {NOW} AND {MID('trade_date')} >= {NOW} - INTERVAL 28 DAY GROUP BY 1) t ON t.symbol = u.symbol
    LEFT JOIN prom p ON p.symbol = u.symbol LEFT JOIN (SELECT symbol, count(*) AS n FROM live_f WHERE feed IN ('insider_trading', 'sast_reg29') AND observed_at >= {NOW} - INTERVAL 30 DAY GROUP BY 1) i ON i.symbol = u.symbol
    LEFT JOIN surv3 s ON s.symbol = u.symbol""")
part("flow1", """SELECT *, 17.5e0 + 35e0 * deal_ratio AS deal_pts, CASE WHEN promoter_delta IS NOT NULL THEN greatest(0e0, least(25e0, 12.5e0 + 5e0 * promoter_delta)) END AS prom_pts,
    CASE WHEN insider_n = 0 THEN 7.5e0 ELSE least(15e0, 7.5e0 + insider_n * 0.75e0) END AS ins_pts FROM flow0""")
part("flow2", "SELECT *, (CASE WHEN deal_pts IS NOT NULL THEN 35e0 ELSE 0e0 END) + (CASE WHEN prom_pts IS NOT NULL THEN 25e0 ELSE 0e0 END) + 40e0 AS weight_covered, coalesce(deal_pts, 0e0) + coalesce(prom_pts, 0e0) + ins_pts + surv_pts AS points FROM flow1")
part("flow3", "SELECT *, points * 100e0 / weight_covered AS raw_flow, weight_covered / 100e0 AS raw_flow_conf FROM flow2")
part("flow_live", f"SELECT symbol, score, CASE WHEN surv_pts <= 10 THEN 'surveillance' WHEN score >= 65 THEN 'accumulation' WHEN score <= 35 THEN 'distribution' ELSE 'neutral' END AS label, {pyr('raw_flow_conf', 2)} AS confidence, weight_covered, deal_ratio, promoter_delta, surv_pts, insider_n FROM (SELECT *, least(100e0, {pyr('raw_flow', 1)}) AS score FROM flow3)")
oracle("flow_score", f"SELECT symbol, score, label, confidence, weight_covered, {r6('deal_ratio', 'promoter_delta', 'surv_pts')}, insider_n FROM flow_live")
part("px60", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back FROM bars WHERE trade_date <= {TODAY}) WHERE back <= 60")
part("px", "SELECT symbol, list_sort(list(turnover) FILTER (back <= 20)) AS tl, max(CASE WHEN back = 1 THEN close END) AS last_close, max(CASE WHEN back = 1 THEN series END) AS last_series, avg(CASE WHEN high = low THEN 1e0 ELSE 0e0 END) AS lock_ratio FROM px60 GROUP BY 1")
part("gov", f"""SELECT f.symbol, sum(CASE WHEN c.category = 'auditor_resignation' AND c.materiality >= 9 AND c.observed_at >= {NOW} - INTERVAL 365 DAY THEN 1 ELSE 0 END) AS aud,
    sum(CASE WHEN c.category = 'regulatory_action' AND c.observed_at >= {NOW} - INTERVAL 180 DAY THEN 1 ELSE 0 END) AS reg FROM live_f f JOIN live_c c ON c.filing_id = f.filing_id WHERE f.symbol IS NOT NULL GROUP BY 1""")
part("enc", f"SELECT symbol, count(*) AS n_enc FROM live_f WHERE feed = 'encumbrance' AND symbol IS NOT NULL AND observed_at >= {NOW} - INTERVAL 180 DAY GROUP BY 1")
part("plg", f"SELECT DISTINCT ON (symbol) symbol, promoter_pct, encumbered_pct, shp_date FROM pledge WHERE encumbered_pct IS NOT NULL AND observed_at <= {NOW} ORDER BY symbol, observed_at DESC, record_id DESC")
part("sv", f"SELECT symbol, sum(CASE WHEN framework = 'gsm' OR (framework = 'asm_lt' AND stage <> 'Stage I') THEN 1 ELSE 0 END) AS sh, sum(CASE WHEN framework = 'gsm' OR (framework = 'asm_lt' AND stage <> 'Stage I') THEN 0 ELSE 1 END) AS ss FROM (SELECT DISTINCT symbol, framework, stage FROM surveillance WHERE as_of <= {TODAY}) GROUP BY 1")
part("fin0", "SELECT DISTINCT ON (symbol) symbol, paidup, face FROM quarters_live ORDER BY symbol, period_end DESC, basis")
part("risk0", f"""SELECT u.symbol, p.tl[len(p.tl) // 2 + 1] AS median_turnover, p.last_close, p.last_series, p.lock_ratio, coalesce(s.sh, 0) AS sh, coalesce(s.ss, 0) AS ss, coalesce(g.aud, 0) AS aud, coalesce(g.reg, 0) AS reg,
    coalesce(e.n_enc, 0) AS n_enc, coalesce(l.promoter_pct, 0) AS pp, l.encumbered_pct AS ep, CASE WHEN p.last_close <> 0 AND f.paidup > 0 AND f.face > 0 THEN f.paidup / f.face * p.last_close / 1e7 END AS mcap_cr
    FROM (SELECT symbol FROM securities UNION SELECT symbol FROM surveillance WHERE as_of <= {TODAY}) u LEFT JOIN px p ON p.symbol = u.symbol LEFT JOIN sv s ON s.symbol = u.symbol LEFT JOIN gov g ON g.symbol = u.symbol
    LEFT JOIN enc e ON e.symbol = u.symbol LEFT JOIN plg l ON l.symbol = u.symbol LEFT JOIN fin0 f ON f.symbol = u.symbol""")
part("risk1", """SELECT *, sh + (CASE WHEN median_turnover < 10 THEN 1 ELSE 0 END) + (CASE WHEN last_close < 5 THEN 1 ELSE 0 END) + (CASE WHEN lock_ratio > 0.2e0 THEN 1 ELSE 0 END) + (CASE WHEN aud > 0 THEN 1 ELSE 0 END) + (CASE WHEN pp > 0 AND ep > 25 THEN 1 ELSE 0 END) AS n_hard,
    ss + (CASE WHEN last_series IN ('BE', 'BZ') THEN 1 ELSE 0 END) + (CASE WHEN reg > 0 THEN 1 ELSE 0 END) + (CASE WHEN NOT (pp > 0 AND ep > 25) AND ep > 10 THEN 1 ELSE 0 END) + (CASE WHEN n_enc > 0 THEN 1 ELSE 0 END) + (CASE WHEN mcap_cr < 300 THEN 1 ELSE 0 END) AS n_soft FROM risk0""")
part("risk_live", "SELECT *, CASE WHEN n_hard > 0 THEN 'hard_block' WHEN n_soft > 0 THEN 'penalty' ELSE 'clear' END AS verdict, CASE WHEN n_hard > 0 THEN 0e0 ELSE greatest(0e0, 100e0 - 15e0 * n_soft) END AS score FROM risk1")
oracle("risk_verdict", f"SELECT symbol, verdict, score, cast(n_hard as bigint) AS n_hard, cast(n_soft as bigint) AS n_soft, cast(CASE WHEN ep IS NULL THEN 4 ELSE 3 END as bigint) AS n_unavailable, {r6('median_turnover', 'lock_ratio', 'mcap_cr')} FROM risk_live")
oracle("risk_universe", f"SELECT symbol FROM stored_scores WHERE agent IN ('a3', 'a4', 'a5') AND observed_at >= {NOW} - INTERVAL 2 DAY AND observed_at <= {NOW} UNION SELECT symbol FROM surveillance WHERE as_of <= {TODAY}")

# ---------------------------------------------------------------- fusion

part("profs", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {f}e0, {t}e0, {fl}e0, {e}e0, '{h}', {s}e0, {lo}e0, {hi}e0)" for n, (f, t, fl, e, h, s, lo, hi) in K.PROFILES.items()) + ") AS p(profile, wf, wt, wfl, we, horizon, stop_atr, t_low, t_high)")
part("ev_axis", """SELECT coalesce(o.symbol, p.symbol) AS symbol, CASE WHEN p.peer_conf > 0 THEN greatest(0e0, least(100e0, coalesce(o.event_score, 50e0) + (p.peer_score - 50e0))) ELSE o.event_score END AS es,
    greatest(coalesce(o.event_conf, 0e0), coalesce(p.peer_conf, 0e0)) AS ec FROM ev_own o FULL JOIN ev_peer p ON p.symbol = o.symbol""")
_AX = lambda conf, at, hl: f"coalesce(nullif({conf}, 0e0), 0.5e0) * pow(0.5e0, {_AGE(at)} / {hl}e0)"
part("axes", f"""SELECT s.symbol, f.score AS fs, {_AX('f.confidence', 'cast(f.as_of as timestamp)', 100)} AS fc, t.score AS tsc, {_AX('t.confidence', 'cast(t.trade_date as timestamp)', 5)} AS tc, w.score AS ws, {_AX('w.confidence', NOW, 7)} AS wc,
    CASE WHEN e.ec > 0 THEN e.es END AS es, e.ec, t.close AS c, {pyr('t.atr', 2)} AS atr14, coalesce(r.verdict, 'unassessed') AS verdict
    FROM (SELECT symbol FROM fund_live UNION SELECT symbol FROM tech_live UNION SELECT symbol FROM flow_live) s LEFT JOIN fund_live f ON f.symbol = s.symbol LEFT JOIN tech_live t ON t.symbol = s.symbol
    LEFT JOIN flow_live w ON w.symbol = s.symbol LEFT JOIN ev_axis e ON e.symbol = s.symbol LEFT JOIN risk_live r ON r.symbol = s.symbol
    WHERE (CASE WHEN f.score IS NULL THEN 0 ELSE 1 END) + (CASE WHEN t.score IS NULL THEN 0 ELSE 1 END) + (CASE WHEN w.score IS NULL THEN 0 ELSE 1 END) >= 2""")
_SUM = lambda expr: " + ".join(f"(CASE WHEN {s} IS NOT NULL THEN {expr.format(w=w, s=s, c=c)} ELSE 0e0 END)" for s, c, w in (("fs", "fc", "wf"), ("tsc", "tc", "wt"), ("ws", "wc", "wfl"), ("es", "ec", "we")))
part("fuse0", f"SELECT *, 0e0 + {_SUM('{w}')} AS weight_covered, (0e0 + {_SUM('{w} * {s} / 100e0')}) AS acc, (0e0 + {_SUM('{w} * {c}')}) / 100e0 AS raw_c FROM axes, profs")
part("fuse1", "SELECT *, acc * 100e0 / weight_covered AS raw_v FROM fuse0 WHERE weight_covered >= 40")
part("fuse2", f"SELECT *, CASE verdict WHEN 'hard_block' THEN 0e0 WHEN 'penalty' THEN least({pyr('raw_v', 1)}, 55e0) ELSE {pyr('raw_v', 1)} END AS conviction, {pyr('raw_c', 2)} AS confidence FROM fuse1")
part("fused", "SELECT *, CASE WHEN verdict = 'hard_block' THEN 'suppressed' WHEN conviction >= 70 THEN 'buy' WHEN conviction >= 60 THEN 'accumulate' WHEN conviction >= 40 THEN 'hold' WHEN conviction >= 25 THEN 'reduce' ELSE 'exit' END AS stance FROM fuse2")
oracle("fuse_profiles", "SELECT symbol, profile, stance, conviction, confidence, weight_covered, verdict AS risk_verdict, horizon FROM fused")
part("lv0", f"SELECT *, CASE WHEN c <> 0 AND atr14 <> 0 THEN {pyr('(c - stop_atr * atr14)', 2)} END AS stop, CASE WHEN c <> 0 AND atr14 <> 0 THEN least(10e0, 1e0 / (stop_atr * atr14 / c)) / (CASE WHEN verdict = 'penalty' THEN 2e0 ELSE 1e0 END) END AS sz FROM fused")
_LONG = lambda x: f"CASE WHEN stance IN ('buy', 'accumulate') AND stop IS NOT NULL THEN {x} END"
oracle("stance_levels", f"SELECT symbol, profile, stance, {_LONG(pyr('(c - 0.5e0 * atr14)', 2))} AS entry_low, {_LONG(pyr('(c + 0.25e0 * atr14)', 2))} AS entry_high, {_LONG(pyr('(c + t_low * (c - stop))', 2))} AS target_low, {_LONG(pyr('(c + t_high * (c - stop))', 2))} AS target_high, CASE WHEN stance NOT IN ('exit', 'suppressed') THEN stop END AS invalidation, {_LONG(pyr('sz', 1))} AS size_pct FROM lv0 WHERE profile IN ('default', 'short')")
part("prev_sig", f"SELECT DISTINCT ON (symbol, profile) symbol, profile, stance AS p_stance, conviction AS p_conv, model_version AS p_ver FROM signals WHERE as_of <= {NOW} ORDER BY symbol, profile, as_of DESC, signal_id DESC")
part("new_sig", f"SELECT f.* FROM fused f LEFT JOIN prev_sig p ON p.symbol = f.symbol AND p.profile = f.profile WHERE p.symbol IS NULL OR p_stance <> f.stance OR abs(p_conv - f.conviction) > 8 OR p_ver <> '{K.FUSION_VERSION}'")
oracle("hysteresis_issue", f"SELECT symbol, profile, stance, conviction, '{K.FUSION_VERSION}' AS model_version FROM new_sig")
oracle("issue_stats", "SELECT a.n AS considered, b.n AS issued, b.s AS suppressed, a.n - b.n AS held_by_hysteresis FROM (SELECT count(*) AS n FROM fused) a, (SELECT count(*) AS n, count(*) FILTER (stance = 'suppressed') AS s FROM new_sig) b")
part("cand", "SELECT signal_id, symbol, profile, model_version, floor(conviction / 10) AS cv, CASE WHEN floor(conviction / 10) >= 40 THEN 'hold' ELSE 'exit' END AS st2, row_number() OVER (PARTITION BY symbol, profile ORDER BY as_of) AS rn FROM signals")
part("rec_hyst", """SELECT signal_id, symbol, profile, rn, cv AS lc, st2 AS ls, model_version AS lv, true AS issued FROM cand WHERE rn = 1
    UNION ALL SELECT c.signal_id, c.symbol, c.profile, c.rn, CASE WHEN c.st2 = h.ls AND c.model_version = h.lv AND abs(c.cv - h.lc) <= 8 THEN h.lc ELSE c.cv END, CASE WHEN c.st2 = h.ls AND c.model_version = h.lv AND abs(c.cv - h.lc) <= 8 THEN h.ls ELSE c.st2 END,
      CASE WHEN c.st2 = h.ls AND c.model_version = h.lv AND abs(c.cv - h.lc) <= 8 THEN h.lv ELSE c.model_version END, NOT (c.st2 = h.ls AND c.model_version = h.lv AND abs(c.cv - h.lc) <= 8)
    FROM rec_hyst h JOIN cand c ON c.symbol = h.symbol AND c.profile = h.profile AND c.rn = h.rn + 1""")
oracle("hysteresis_replay", "SELECT signal_id, symbol, profile, issued FROM rec_hyst")
oracle("latest_scores_pivot", "SELECT symbol, max(CASE WHEN agent = 'a3' THEN score END) AS a3, max(CASE WHEN agent = 'a4' THEN score END) AS a4, max(CASE WHEN agent = 'a5' THEN score END) AS a5, max(CASE WHEN agent = 'a6' THEN score END) AS a6 FROM (SELECT DISTINCT ON (symbol, agent) * FROM stored_scores ORDER BY symbol, agent, as_of DESC, score_id DESC) GROUP BY symbol")
oracle("issue_universe", "SELECT symbol, count(DISTINCT agent) AS families FROM stored_scores WHERE agent IN ('a3', 'a4', 'a5') GROUP BY 1 HAVING count(DISTINCT agent) >= 2")

# ---------------------------------------------------------------- backtest

part("rebal", "SELECT n.trade_date AS d, n.i, n.idx_ret63, f.ret_1w AS i1, f.ret_4w AS i4, f.ret_12w AS i12 FROM index_n n JOIN idx_fwd f ON f.trade_date = n.trade_date WHERE n.n >= 120 AND n.i >= 80 AND n.i < n.n - 60")
part("long_bars", "SELECT i.*, f.ret_1w, f.ret_4w, f.ret_12w FROM ind2 i JOIN fwd f ON f.symbol = i.symbol AND f.trade_date = i.trade_date WHERE i.rn >= 60 AND i.symbol IN (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 120)")
part("grid0", "SELECT s.symbol, r.* FROM (SELECT DISTINCT symbol FROM cons) s, rebal r")
part("grid1", "SELECT b.*, g.d, g.i AS gi, g.idx_ret63, g.i1, g.i4, g.i12 FROM grid0 g ASOF JOIN long_bars b ON g.symbol = b.symbol AND g.d >= b.trade_date WHERE b.median_turnover >= 10 AND b.close >= 5")
part("grid_t", tech("grid1"))
part("grid_f", "SELECT g.*, f.score AS fs, f.confidence AS fc FROM grid_t g ASOF LEFT JOIN fund_states f ON g.symbol = f.symbol AND g.d >= f.st")
part("grid_e", f"""SELECT symbol, d, greatest(0e0, least(100e0, 50e0 + sum(push))) AS es, least(1e0, max(confidence)) AS ec FROM (
    SELECT e.symbol, r.d, e.confidence, 50e0 * pow(0.5e0, {_AGE('e.event_at', 'cast(r.d as timestamp)')} / 10e0) * (e.materiality / 10e0) * e.confidence * e.sentiment AS push, row_number() OVER (PARTITION BY e.symbol, r.d ORDER BY e.materiality DESC, e.filing_id) AS r
    FROM ev_rows e JOIN rebal r ON e.event_at <= r.d AND e.event_at >= r.d - INTERVAL 30 DAY) WHERE r <= 10 GROUP BY 1, 2""")


def observe(profile: str, step: int) -> str:
    f, t, _, e = K.PROFILES[profile][:4]
    has = lambda s, x: f"(CASE WHEN {s} IS NOT NULL THEN {x} ELSE 0e0 END)"
    base = f"""SELECT g.symbol, g.d, g.ret_1w, g.ret_4w, g.ret_12w, g.i1, g.i4, g.i12, {has('g.fs', f'{f}e0')} + {t}e0 + {has('e.es', f'{e}e0')} AS tw,
        {has('g.fs', f'{f}e0 * g.fs / 100e0')} + {t}e0 * g.score / 100e0 + {has('e.es', f'{e}e0 * e.es / 100e0')} AS acc, ({has('g.fs', f'{f}e0 * g.fc')} + {t}e0 * g.confidence + {has('e.es', f'{e}e0 * e.ec')}) / 100e0 AS raw_c
        FROM grid_f g LEFT JOIN grid_e e ON e.symbol = g.symbol AND e.d = g.d AND e.ec > 0 WHERE (g.gi - 80) % {step} = 0"""
    scored = f"SELECT *, {pyr('rv', 1)} AS conviction, {pyr('raw_c', 2)} AS confidence FROM (SELECT *, acc * 100e0 / tw AS rv FROM ({base}) WHERE tw >= 40)"
    return f"""SELECT symbol, d, CASE WHEN conviction >= 70 THEN 'buy' WHEN conviction >= 60 THEN 'accumulate' WHEN conviction >= 40 THEN 'hold' WHEN conviction >= 25 THEN 'reduce' ELSE 'exit' END AS stance, conviction, confidence,
        CASE WHEN i1 IS NOT NULL THEN ret_1w END AS ret_1w, CASE WHEN i4 IS NOT NULL THEN ret_4w END AS ret_4w, CASE WHEN i12 IS NOT NULL THEN ret_12w END AS ret_12w, ret_1w - i1 AS excess_1w, ret_4w - i4 AS excess_4w, ret_12w - i12 AS excess_12w FROM ({scored})"""


part("obs_default", observe("default", 5))
part("obs_momentum", observe("momentum", 5))
oracle("walk_forward", f"SELECT symbol, d, stance, conviction, confidence, {r6('ret_1w', 'ret_4w', 'ret_12w', 'excess_1w', 'excess_4w', 'excess_12w')} FROM obs_default")
oracle("walk_forward_summary", f"SELECT stance, \"window\", observations, {r6('avg_excess', 'hit_rate', 'avg_ret')} FROM (" + " UNION ALL ".join(
    f"SELECT stance, '{k}' AS \"window\", count(*) AS observations, 100 * avg(excess_{k}) AS avg_excess, 100 * avg(CASE WHEN excess_{k} > 0 THEN 1e0 WHEN excess_{k} <= 0 THEN 0e0 END) AS hit_rate, 100 * avg(ret_{k}) AS avg_ret FROM obs_momentum GROUP BY 1" for k in K.FORWARD_WINDOWS) + ")")

# ---------------------------------------------------------------- rules and evaluation

_HAS = lambda p: f"regexp_matches(x, '(?i){p}')"


def _codes() -> str:
    out = []
    for i, (p, cat, m, _, _) in enumerate(K.SIGNAL_PATTERNS):
        code = str(m * 100 - i)
        cond = _HAS(p)
        if cat == "auditor_resignation":
            code = f"CASE WHEN {_HAS(K.NON_STATUTORY_AUDITOR)} AND NOT {_HAS(K.STATUTORY_AUDITOR)} THEN {300 - i} ELSE {m * 100 - i} END"
        if cat == "regulatory_action":
            cond = f"{cond} AND NOT ({_HAS(K.REGULATION_CITATION)} AND NOT {_HAS(K.ENFORCEMENT_MARKER)})"
        out.append(f"CASE WHEN {cond} THEN {code} ELSE -1 END")
    return f"greatest({', '.join(out)})"


def _hit_table() -> str:
    rows = []
    for i, (p, cat, m, s, c) in enumerate(K.SIGNAL_PATTERNS):
        rows.append((f"s{m * 100 - i}", cat, m, s, c, False, f"pattern:{p[:40]}"))
        if cat == "auditor_resignation":
            rows.append((f"s{300 - i}", "management_change", 3, -0.1, c, False, f"pattern:{p[:40]}|non_statutory_auditor"))
    for n, _ in K.ROUTINE_PATTERNS:
        rows.append((f"r{n}", "other", 1, 0.0, 0.9, True, f"routine:{n}"))
    for f, (cat, m, s, c, r) in K.FEED_PRIORS.items():
        rows.append((f"a{f}", cat, m, s, c, r, f"feed_authoritative:{f}"))
        rows.append((f"f{f}", cat, m, s, c, r, f"feed:{f}"))
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{cat}', {m}, {s}e0, {c}e0, {str(r).lower()}, '{rule}')" for k, cat, m, s, c, r, rule in rows) + ") AS h(code, category, materiality, sentiment, confidence, routine, rule)"


part("hits", _hit_table())
part("rule_text", "SELECT filing_id, feed, coalesce(concat_ws(' ', nullif(subject, ''), nullif(description, '')), '') AS x FROM filings")
_ROUT = "CASE " + " ".join(f"WHEN {_HAS(p)} THEN 'r{n}'" for n, p in K.ROUTINE_PATTERNS) + " END"
_AUTH = "CASE WHEN feed IN (" + ", ".join(f"'{f}'" for f in K.AUTHORITATIVE_FEEDS) + ") THEN 'a' || feed END"
_PRIOR = "CASE WHEN feed IN (" + ", ".join(f"'{f}'" for f in K.FEED_PRIORS) + ") THEN 'f' || feed END"
part("rule_code", f"SELECT filing_id, coalesce({_ROUT}, {_AUTH}, nullif('s' || cast({_codes()} as string), 's-1'), {_PRIOR}) AS code FROM rule_text")
part("ruled", "SELECT c.filing_id, h.category, h.materiality, h.sentiment, h.confidence, h.routine, h.rule FROM rule_code c LEFT JOIN hits h ON h.code = c.code")
_FLOOR = lambda cat, m: f"greatest({m}, CASE {cat} " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in K.MATERIALITY_FLOORS.items()) + " ELSE 0 END)"
oracle("classify_rules", "SELECT filing_id, category, cast(materiality as bigint) AS materiality, sentiment, confidence, routine, rule FROM ruled")


def _final(suffix: str) -> str:
    return f"""SELECT filing_id, coalesce(category, 'other') AS category, CASE WHEN rule IS NULL THEN 2 ELSE {_FLOOR('category', 'materiality')} END AS materiality, coalesce(sentiment, 0e0) AS sentiment,
        CASE WHEN rule IS NULL THEN 0.2e0 WHEN routine OR confidence >= 0.75e0 THEN confidence ELSE confidence * 0.8e0 END AS confidence, coalesce(routine, false) AS routine,
        CASE WHEN rule IS NULL THEN 'no_rule|{suffix}' WHEN routine OR confidence >= 0.75e0 THEN rule ELSE rule || '|{suffix}' END AS rule_trace FROM ruled"""


part("final_backlog", _final("backlog_no_llm"))
part("final_absent", _final("llm_unavailable"))
oracle("classify_finality", f"SELECT filing_id, category, cast(materiality as bigint) AS materiality, sentiment, {r6('confidence')}, routine, rule_trace FROM final_backlog")
part("mj", "SELECT filing_id, nullif(regexp_extract(raw, '(?s)\\{.*\\}'), '') AS j FROM model_raw")
_JT = lambda k: f"json_type(j, '$.{k}')"
_JN = lambda k: f"try_cast(json_extract_string(j, '$.{k}') as double)"


def _num_check(k: str, lo: int, hi: int) -> str:
    return f"WHEN {_JT(k)} IS NULL THEN 'missing key: {k}' WHEN {_JT(k)} NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN '{k}: expected number' WHEN {_JN(k)} < {lo} THEN '{k}: below {lo}' WHEN {_JN(k)} > {hi} THEN '{k}: above {hi}'"


_CATS = ", ".join(f"'{c}'" for c in K.CATEGORIES)
part("mv", f"""SELECT filing_id, j, CASE WHEN j IS NULL OR NOT json_valid(j) THEN 'no json object'
    WHEN {_JT('category')} IS NULL THEN 'missing key: category' WHEN {_JT('category')} <> 'VARCHAR' THEN 'category: expected string' WHEN json_extract_string(j, '$.category') NOT IN ({_CATS}) THEN 'category: not in allowed values'
    {_num_check('materiality', 0, 10)} {_num_check('sentiment', -1, 1)} {_num_check('confidence', 0, 1)}
    WHEN {_JT('summary')} IS NULL THEN 'missing key: summary' WHEN {_JT('summary')} <> 'VARCHAR' THEN 'summary: expected string' WHEN {_JT('entities')} IS NULL THEN 'missing key: entities' WHEN {_JT('entities')} <> 'OBJECT' THEN 'entities: expected object' END AS error FROM mj""")
part("mo", f"SELECT filing_id, error, CASE WHEN error IS NULL THEN json_extract_string(j, '$.category') END AS m_category, CASE WHEN error IS NULL THEN {_JN('materiality')} END AS m_materiality, CASE WHEN error IS NULL THEN {_JN('sentiment')} END AS m_sentiment, CASE WHEN error IS NULL THEN {_JN('confidence')} END AS m_confidence, CASE WHEN error IS NULL THEN json_extract_string(j, '$.summary') END AS m_summary FROM mv")
oracle("validate_model_json", f"SELECT filing_id, error, m_category, {r6('m_materiality', 'm_sentiment', 'm_confidence')}, m_summary FROM mo")
part("mm0", f"SELECT r.*, m.m_category, m.m_sentiment, m.m_confidence, m.m_summary, cast({pyr('m.m_materiality', 0)} as int) AS mi, coalesce(r.rule IS NOT NULL AND r.confidence > m.m_confidence, false) AS lead_rule, m.m_category IS NOT NULL AND NOT coalesce(r.routine OR r.confidence >= 0.75e0, false) AS use_m FROM ruled r LEFT JOIN mo m ON m.filing_id = r.filing_id")
part("mm1", "SELECT *, CASE WHEN lead_rule THEN category ELSE m_category END AS mc, CASE WHEN lead_rule THEN greatest(mi, materiality) ELSE mi END AS mx FROM mm0")
oracle("merge_model_output", f"""SELECT m.filing_id, CASE WHEN use_m THEN mc ELSE f.category END AS category, cast(CASE WHEN use_m THEN {_FLOOR('mc', 'mx')} ELSE f.materiality END as bigint) AS materiality, floor((CASE WHEN use_m THEN m_sentiment ELSE f.sentiment END) * 1e6 + 0.5e0) / 1e6 AS sentiment,
    floor((CASE WHEN use_m THEN m_confidence ELSE f.confidence END) * 1e6 + 0.5e0) / 1e6 AS confidence, CASE WHEN use_m THEN false ELSE f.routine END AS routine, CASE WHEN use_m THEN 'model' ELSE 'rules' END AS engine, CASE WHEN use_m THEN m.rule ELSE f.rule_trace END AS rule_trace, CASE WHEN use_m THEN nullif(m_summary, '') END AS summary FROM mm1 m JOIN final_absent f ON f.filing_id = m.filing_id""")
part("ev_pred", f"SELECT l.*, coalesce(c.category, 'UNCLASSIFIED') AS predicted, c.materiality AS pm FROM label_rows l LEFT JOIN (SELECT * FROM classifications WHERE model_version = '{V5}') c ON c.filing_id = l.filing_id")
part("ev_rank", "SELECT rank() OVER (ORDER BY pm) + (count(*) OVER (PARTITION BY pm) - 1) / 2e0 AS rx, rank() OVER (ORDER BY label_materiality) + (count(*) OVER (PARTITION BY label_materiality) - 1) / 2e0 AS ry FROM ev_pred WHERE pm IS NOT NULL")
oracle("eval_accuracy_spearman", "SELECT labelled, floor((acc) * 1e6 + 0.5e0) / 1e6 AS accuracy, floor((rho) * 1e6 + 0.5e0) / 1e6 AS spearman, CASE WHEN acc >= 0.85 AND rho >= 0.7 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT count(*) AS labelled, avg(CASE WHEN predicted = label_category THEN 1e0 ELSE 0e0 END) AS acc FROM ev_pred), (SELECT corr(rx, ry) AS rho FROM ev_rank)")
oracle("eval_misses", "SELECT filing_id, predicted, label_category FROM ev_pred WHERE predicted <> label_category")
part("strat", f"SELECT f.filing_id, f.feed, f.subject, c.routine, c.engine, c.rule_trace FROM filings f JOIN classifications c ON c.filing_id = f.filing_id WHERE c.model_version = '{V5}'")
_ST = {"routine": "routine", "rules": "NOT routine AND engine = 'rules' AND rule_trace NOT LIKE '%no_llm%' AND rule_trace NOT LIKE '%llm_unavailable%'", "model": "engine IN ('local', 'online', 'model')"}
oracle("stratified_sample", " UNION ALL ".join(f"(SELECT '{n}' AS stratum, filing_id, feed, subject, rn FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY filing_id % {p}, filing_id) AS rn FROM strat WHERE {_ST[n]}) ORDER BY rn, feed LIMIT {k})" for n, p, k in K.SAMPLE_STRATA))
oracle("coverage_diff", "SELECT cast(event_at as date) AS day, count(*) AS expected, count(*) FILTER (source = 'rss') AS held, floor((100 * avg(CASE WHEN source = 'rss' THEN 1e0 ELSE 0e0 END)) * 1e6 + 0.5e0) / 1e6 AS coverage_pct FROM filings WHERE feed = 'announcements' GROUP BY 1")
part("rc_basis", "SELECT DISTINCT ON (symbol) symbol, basis FROM (SELECT symbol, basis, count(*) AS n FROM quarters GROUP BY 1, 2 HAVING count(*) >= 4) ORDER BY symbol, CASE WHEN basis = 'consolidated' THEN 0 ELSE 1 END, n DESC, basis")
part("rc_own", "SELECT * FROM (SELECT q.*, row_number() OVER (PARTITION BY q.symbol ORDER BY q.period_end DESC) AS r FROM quarters q JOIN rc_basis b ON b.symbol = q.symbol AND b.basis = q.basis) WHERE r <= 8")
part("rc_vals", "SELECT o.symbol, o.basis, o.revenue / 1e7 AS a, t.revenue_cr AS b FROM rc_own o JOIN theirs t ON t.symbol = o.symbol AND t.period_end = o.period_end UNION ALL SELECT o.symbol, o.basis, o.pat / 1e7, t.pat_cr FROM rc_own o JOIN theirs t ON t.symbol = o.symbol AND t.period_end = o.period_end")
part("rc", "SELECT symbol, basis, count(*) AS compared, count(*) FILTER (abs(a - b) > greatest(0.02e0 * abs(b), 1e0)) AS outside FROM rc_vals GROUP BY 1, 2")
oracle("reconcile_tolerance", "SELECT symbol, basis, compared, outside FROM rc")
oracle("reconcile_gate", "SELECT count(*) AS symbols, floor((100 * avg(CASE WHEN outside = 0 THEN 1e0 ELSE 0e0 END)) * 1e6 + 0.5e0) / 1e6 AS within_pct, CASE WHEN 100 * avg(CASE WHEN outside = 0 THEN 1e0 ELSE 0e0 END) >= 95 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM rc")

# ---------------------------------------------------------------- calendar

part("seed_days", "SELECT * FROM (VALUES " + ", ".join(f"(DATE '{d}', '{n}')" for d, n in K.SEED_HOLIDAYS) + ") AS s(day, name)")
part("learned_days", "SELECT day, 'learned ' || cast(n as string) AS name FROM (SELECT cast(o_orderdate as date) AS day, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT cast(ts as date), count(*) FROM events GROUP BY 1) WHERE n % 11 = 0")
part("holiday_days", "SELECT * FROM learned_days UNION ALL SELECT * FROM seed_days WHERE day NOT IN (SELECT day FROM learned_days)")
oracle("holiday_overlay", "SELECT day, name FROM holiday_days")
part("cal_days", "SELECT cast(unnest(generate_series(DATE '1995-01-01', DATE '2026-12-31', INTERVAL 1 DAY)) as date) AS day")
part("cal_flag", "SELECT c.day, h.name AS holiday, isodow(c.day) < 6 AND h.name IS NULL AS is_trading FROM cal_days c LEFT JOIN holiday_days h ON h.day = c.day")
oracle("trading_calendar", "SELECT day, holiday, is_trading, min(CASE WHEN is_trading THEN day END) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_trading_day, max(CASE WHEN is_trading THEN day END) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_trading_day FROM cal_flag")
oracle("session_state", "SELECT e.event_id, CASE WHEN isodow(e.l) >= 6 OR h.day IS NOT NULL THEN 'closed' WHEN cast(e.l as time) >= TIME '09:00' AND cast(e.l as time) < TIME '09:15' THEN 'pre_open' WHEN cast(e.l as time) >= TIME '09:15' AND cast(e.l as time) < TIME '15:30' THEN 'open' WHEN cast(e.l as time) >= TIME '15:30' AND cast(e.l as time) < TIME '16:00' THEN 'post_close' ELSE 'closed' END AS session_state FROM (SELECT event_id, ts + INTERVAL 330 MINUTE AS l FROM events) e LEFT JOIN holiday_days h ON h.day = cast(e.l as date)")

# ---------------------------------------------------------------- views

part("feed_dim", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{p}')" for f, p in K.FEEDS) + ") AS f(feed, priority)")
part("feed_more", "SELECT * FROM feed_dim UNION ALL SELECT 'pilot_feed', 'P1'")
part("poll_state", """SELECT feed, max(moment) AS last_polled_at, max(CASE WHEN status = 'ok' AND new > 0 THEN moment END) AS last_changed_at, arg_max(status, (moment, poll_id)) AS last_status, cast(sum(CASE WHEN status = 'ok' THEN seen ELSE 0 END) as bigint) AS entries_seen, cast(sum(CASE WHEN status = 'ok' THEN new ELSE 0 END) as bigint) AS entries_new,
    count(*) FILTER (status = 'error' AND since_ok = 0) AS consecutive_errors FROM (SELECT *, count(*) FILTER (status = 'ok') OVER (PARTITION BY feed ORDER BY moment DESC, poll_id DESC) AS since_ok FROM polls) GROUP BY feed""")
oracle("feed_state", f"SELECT feed, {ts('last_polled_at')}, {ts('last_changed_at')}, last_status, entries_seen, entries_new, consecutive_errors FROM poll_state")
oracle("view_feeds", "SELECT d.feed, d.priority, coalesce(s.last_status, 'never') AS last_status, s.entries_seen FROM feed_more d LEFT JOIN poll_state s ON s.feed = d.feed")
part("ages", f"SELECT d.feed, d.priority, s.last_polled_at, s.consecutive_errors, floor((epoch_us({POLL_NOW}) - epoch_us(s.last_polled_at)) / 1e6) AS age FROM feed_more d LEFT JOIN poll_state s ON s.feed = d.feed")
oracle("view_health", "SELECT feed, 'never polled' AS problem FROM ages WHERE last_polled_at IS NULL UNION ALL SELECT feed, 'last poll ' || cast(cast(age as bigint) as string) || 's ago' FROM ages WHERE age > CASE priority WHEN 'P0' THEN 300 WHEN 'P1' THEN 1800 ELSE 7200 END UNION ALL SELECT feed, cast(consecutive_errors as string) || ' consecutive errors' FROM ages WHERE consecutive_errors >= 3")
oracle("view_filings", f"SELECT f.filing_id, f.symbol, f.feed, f.subject, c.category, cast(c.materiality as bigint) AS materiality, {ts('f.event_at', 'event_at')} FROM live_f f LEFT JOIN (SELECT * FROM classifications WHERE model_version = '{V5}') c ON c.filing_id = f.filing_id WHERE f.event_at >= TIMESTAMP '2001-01-01'")
oracle("view_pulse", f"SELECT f.filing_id, f.symbol, c.category, cast(c.materiality as bigint) AS materiality, c.sentiment, c.confidence, coalesce(c.summary, f.subject) AS summary, c.engine, {ts('f.event_at', 'event_at')} FROM live_f f JOIN live_c c ON c.filing_id = f.filing_id WHERE c.model_version = '{V5}' AND c.materiality >= 5 AND NOT c.routine AND f.event_at >= TIMESTAMP '2001-07-01'")
part("news", f"SELECT DISTINCT ON (f.symbol) f.symbol, c.category AS news_category, cast(c.materiality as bigint) AS news_materiality, cast(floor((epoch_us({NOW}) - epoch_us(c.observed_at)) / 86400e6) as bigint) AS news_days_ago FROM live_f f JOIN live_c c ON c.filing_id = f.filing_id WHERE f.symbol IS NOT NULL AND c.model_version = '{V5}' AND c.observed_at >= {NOW} - INTERVAL 7 DAY AND c.materiality >= 7 AND c.sentiment <= -0.3e0 ORDER BY f.symbol, c.materiality DESC, f.filing_id")
_RECO = "CASE WHEN stance = 'suppressed' THEN 'AVOID' WHEN news_category IS NOT NULL AND stance IN ('buy', 'accumulate') THEN 'CAUTION' WHEN news_category IS NOT NULL AND stance = 'hold' THEN 'SELL RISK' ELSE CASE stance WHEN 'buy' THEN 'BUY' WHEN 'accumulate' THEN 'ADD' WHEN 'hold' THEN 'HOLD' WHEN 'reduce' THEN 'REDUCE' WHEN 'exit' THEN 'SELL' END END"
part("sig_latest", f"SELECT s.*, n.news_category, n.news_materiality, n.news_days_ago, 100e0 * (s.target_low / s.entry_high - 1e0) AS up FROM (SELECT DISTINCT ON (symbol) * FROM signals WHERE as_of <= {NOW} AND profile = 'default' ORDER BY symbol, as_of DESC, signal_id DESC) s LEFT JOIN news n ON n.symbol = s.symbol WHERE s.conviction >= 20")
part("sig_rank", "SELECT *, row_number() OVER (ORDER BY conviction DESC, symbol) AS rk FROM sig_latest")
oracle("view_signals", f"SELECT symbol, signal_id, stance, conviction, {pyr('up', 1)} AS upside_pct, {_RECO} AS reco, news_category, news_materiality, news_days_ago FROM sig_rank WHERE rk <= 25 OR news_category IS NOT NULL")
part("sig_any", f"SELECT s.*, n.news_category FROM (SELECT DISTINCT ON (symbol) * FROM signals WHERE as_of <= {NOW} ORDER BY symbol, as_of DESC, signal_id DESC) s LEFT JOIN news n ON n.symbol = s.symbol")
oracle("view_signals_any_profile", f"SELECT symbol, signal_id, profile, {_RECO} AS reco, cast(CASE stance WHEN 'suppressed' THEN 0 WHEN 'exit' THEN 1 WHEN 'reduce' THEN 2 WHEN 'hold' THEN 3 WHEN 'accumulate' THEN 4 WHEN 'buy' THEN 5 END as bigint) AS stance_key FROM (SELECT *, row_number() OVER (ORDER BY conviction DESC, symbol) AS rk FROM sig_any)")
part("px260", f"SELECT symbol, arg_max(close, trade_date) AS price, max(close) AS high_52w, min(close) AS low_52w FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back FROM bars WHERE trade_date <= {TODAY}) WHERE back <= 260 GROUP BY 1")
part("ttm", "SELECT symbol, CASE WHEN count(*) FILTER (eps_basic <> 0) = 4 THEN sum(eps_basic) END AS eps_ttm, arg_max(paidup, period_end) AS pu, arg_max(face, period_end) AS fv FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS back FROM quarters_live WHERE basis = 'consolidated') WHERE back <= 4 GROUP BY 1")
oracle("view_company", f"SELECT symbol, {r6('price', 'high_52w', 'low_52w', 'eps_ttm', 'pe_ttm', 'mcap_cr')} FROM (SELECT p.*, t.eps_ttm, p.price / nullif(t.eps_ttm, 0) AS pe_ttm, t.pu / t.fv * p.price / 1e7 AS mcap_cr FROM px260 p LEFT JOIN ttm t ON t.symbol = p.symbol)")
part("hold_lag", "SELECT *, pct - lead(pct) OVER (PARTITION BY symbol ORDER BY event_at DESC, filing_id DESC) AS dl FROM holdings")
oracle("shareholding_series", f"SELECT symbol, filing_id, strftime(event_at, '%Y-%m-%d') AS as_on, floor((pct) * 1e6 + 0.5e0) / 1e6 AS promoter_pct, floor((pub) * 1e6 + 0.5e0) / 1e6 AS public_pct, {pyr('dl', 2)} AS promoter_delta FROM hold_lag WHERE r <= 8")
part("qs", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC, basis) AS back FROM quarters_live q WHERE basis = 'consolidated' OR NOT EXISTS (SELECT 1 FROM quarters_live c WHERE c.symbol = q.symbol AND c.basis = 'consolidated')")
_QS = lambda m, e: f"SELECT symbol, '{m}' AS metric, " + ", ".join(f"floor((max(CASE WHEN back = {i} THEN {e} END)) * 1e6 + 0.5e0) / 1e6 AS q{i}" for i in range(1, 9)) + " FROM qs GROUP BY symbol"
oracle("quarter_sheet", " UNION ALL ".join(_QS(m, e) for m, e in (("revenue_cr", "revenue / 1e7"), ("pat_cr", "pat / 1e7"), ("eps", "eps_basic"))))
part("board", f"SELECT s.symbol AS peer, s.industry, t.score AS a4, f.score AS a3, g.stance, g.conviction FROM securities s LEFT JOIN tech_live t ON t.symbol = s.symbol LEFT JOIN fund_live f ON f.symbol = s.symbol LEFT JOIN (SELECT DISTINCT ON (symbol) * FROM signals WHERE as_of <= {NOW} AND profile = 'default' ORDER BY symbol, as_of DESC, signal_id DESC) g ON g.symbol = s.symbol WHERE s.industry IS NOT NULL AND coalesce(t.score, f.score, g.conviction) IS NOT NULL")
oracle("peer_board", "SELECT symbol, peer, industry, a4, a3, stance, conviction FROM (SELECT s.symbol, b.*, row_number() OVER (PARTITION BY s.symbol ORDER BY coalesce(b.conviction, 0) DESC, b.peer) AS r FROM securities s JOIN board b ON b.industry = s.industry AND b.peer <> s.symbol) WHERE r <= 8")
oracle("view_stats", "SELECT 'filings' AS name, '' AS label, cast(count(*) as double) AS value FROM filings UNION ALL SELECT 'resolved_pct', '', round(100e0 * count(security_id) / greatest(count(*), 1), 1) FROM filings UNION ALL SELECT 'filings_by_source', source, count(*) FROM filings GROUP BY 2 UNION ALL SELECT 'events', '', count(*) FROM outbox UNION ALL SELECT 'documents', fetch_status, count(*) FROM doc_states GROUP BY 2")
part("hist", "SELECT coalesce(cast(status as string), 'transport_error') AS status, count(*) AS n FROM audit WHERE observed_at > TIMESTAMP '2024-01-30 23:59:00' - INTERVAL 1 HOUR AND observed_at <= TIMESTAMP '2024-01-30 23:59:00' GROUP BY 1")
oracle("audit_histogram", "SELECT status, n FROM hist")
_TAG = "'feed=\"' || s.feed || '\",priority=\"' || d.priority || '\"'"
oracle("view_metrics", f"""SELECT 'filings_total' AS name, '' AS labels, cast(count(*) as double) AS value FROM filings UNION ALL SELECT 'outbox_events_total', '', count(*) FROM outbox
    UNION ALL SELECT 'feed_poll_age_seconds', {_TAG}, floor((epoch_us({POLL_NOW}) - epoch_us(s.last_polled_at)) / 1e6) FROM poll_state s JOIN feed_dim d ON d.feed = s.feed
    UNION ALL SELECT 'feed_entries_new_total', {_TAG}, s.entries_new FROM poll_state s JOIN feed_dim d ON d.feed = s.feed UNION ALL SELECT 'feed_consecutive_errors', {_TAG}, s.consecutive_errors FROM poll_state s JOIN feed_dim d ON d.feed = s.feed
    UNION ALL SELECT 'http_requests_last_hour', 'status="' || coalesce(cast(status as string), 'transport_error') || '"', count(*) FROM audit WHERE observed_at > {POLL_NOW} - INTERVAL 1 HOUR AND observed_at <= {POLL_NOW} GROUP BY 2
    UNION ALL SELECT 'classifications_total', 'engine="' || engine || '"', count(*) FROM classifications GROUP BY 2
    UNION ALL SELECT 'consumer_lag_events', '', (SELECT max(id) FROM outbox WHERE topic = 'filing.received') - floor((SELECT max(id) FROM outbox WHERE topic = 'filing.received' AND id % 2 = 0) / 2)""")
oracle("view_alerts", f"SELECT alert_id, severity, category, symbol, message, {ts('observed_at')} FROM alert_log WHERE severity = 'high' ORDER BY observed_at DESC, alert_id DESC LIMIT 50")
oracle("alert_routing", "SELECT filing_id AS ref, category, CASE WHEN materiality >= 8 THEN 'high' ELSE 'medium' END AS severity FROM classifications WHERE materiality >= 6 AND NOT routine UNION ALL SELECT signal_id, 'signal_' || stance, 'medium' FROM signals WHERE stance IN ('buy', 'exit', 'suppressed')")
part("dg", "SELECT * FROM alert_log WHERE observed_at >= TIMESTAMP '2024-01-04 12:00:00' - INTERVAL 20 HOUR AND observed_at <= TIMESTAMP '2024-01-04 12:00:00'")
_DG = lambda cond, width: f"(SELECT count(*) AS n, string_agg('  ' || coalesce(symbol, '?') || ': ' || substr(message, 1, {width}), chr(10) ORDER BY r) FILTER (r <= 8) AS body FROM (SELECT *, row_number() OVER (ORDER BY observed_at DESC, alert_id DESC) AS r FROM dg WHERE {cond}) WHERE r <= 15)"
oracle("alert_digest", f"""SELECT 'post_close' AS kind, h.n AS highs, s.n AS stances, 'post_close digest' || (CASE WHEN h.n > 0 THEN chr(10) || 'High-materiality events (' || h.n || '):' || chr(10) || h.body ELSE '' END) || (CASE WHEN s.n > 0 THEN chr(10) || 'Stance changes (' || s.n || '):' || chr(10) || s.body ELSE '' END)
    || (CASE WHEN h.n + s.n = 0 THEN chr(10) || 'quiet window — no high-materiality events, no stance changes' ELSE '' END) AS text FROM {_DG("severity = 'high' AND category <> 'digest'", 80)} h, {_DG("category LIKE 'signal_%'", 70)} s""")
part("hi_n", "SELECT alert_id, epoch_us(observed_at) AS us, row_number() OVER (ORDER BY observed_at, alert_id) AS rn FROM alert_log WHERE severity = 'high'")
part("rec_sent", """SELECT alert_id, rn, true AS sent, [us] AS live FROM hi_n WHERE rn = 1
    UNION ALL SELECT h.alert_id, h.rn, len(list_filter(r.live, lambda x: x >= h.us - 3600000000)) < 12,
      CASE WHEN len(list_filter(r.live, lambda x: x >= h.us - 3600000000)) < 12 THEN list_append(list_filter(r.live, lambda x: x >= h.us - 3600000000), h.us) ELSE list_filter(r.live, lambda x: x >= h.us - 3600000000) END
    FROM rec_sent r JOIN hi_n h ON h.rn = r.rn + 1""")
oracle("alert_rate_limit", "SELECT alert_id, sent FROM rec_sent")

# ---------------------------------------------------------------- streams

oracle("stream_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
part("half_hours", "SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM events")
oracle("stream_sliding", "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM (SELECT event_type, b AS w FROM half_hours UNION ALL SELECT event_type, b - INTERVAL 30 MINUTE FROM half_hours) GROUP BY 1, 2")
part("gaps", "SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS g FROM events")
part("islands", "SELECT user_id, ts, sum(g) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM gaps")
oracle("stream_sessions", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM islands GROUP BY user_id, island")
oracle("stream_dedup", "SELECT filing_id, feed, content_hash FROM unique_all")
part("st_final", "SELECT f.*, s.symbol AS sym FROM final_backlog f JOIN filings s ON s.filing_id = f.filing_id WHERE f.filing_id % 97 <> 0 AND f.filing_id % 89 <> 1")
oracle("stream_classify_alert", "SELECT filing_id AS alert_id, CASE WHEN materiality >= 8 THEN 'high' ELSE 'medium' END AS severity, category, sym AS symbol, 'materiality ' || cast(materiality as string) || ' filing (' || category || '), sentiment ' || cast(sentiment as string) AS message FROM st_final WHERE materiality >= 6 AND NOT routine")
oracle("stream_dead_letter", "SELECT event_id AS id, 'filing.received' AS topic, CASE WHEN event_id % 97 = 0 THEN 'malformed payload' ELSE 'missing field' END AS error FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 1")
oracle("stream_alert_budget", "SELECT alert_id, sent FROM rec_sent")
oracle("stream_bounded_drain", """SELECT topic, cycle, count(*) AS n, min(id) AS first_id, max(id) AS last_id
    FROM (SELECT topic, id, cast(floor((row_number() OVER (ORDER BY id) - 1) / 500) as bigint) AS cycle FROM outbox WHERE topic = 'filing.received') GROUP BY 1, 2""")
oracle("stream_replay", "SELECT id, topic FROM outbox WHERE topic = 'filing.received' AND id > 100")
oracle("stream_redelivery", "SELECT filing_id, cast(1 as bigint) AS classified, cast(CASE WHEN materiality >= 6 AND NOT routine THEN 1 ELSE 0 END as bigint) AS alerts FROM final_backlog")
oracle("stream_hysteresis", f"SELECT h.symbol, h.profile, {ts('s.as_of', 'as_of')} FROM rec_hyst h JOIN signals s ON s.signal_id = h.signal_id WHERE h.issued")
