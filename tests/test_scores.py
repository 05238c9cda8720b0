"""Fundamental, flow, risk and fusion behaviour on small books."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeloom import constants as K
from tapeloom.plans import flow, fundamental, fusion, risk

NOW = dt.datetime(2026, 8, 8, 12, tzinfo=dt.timezone.utc)
QUARTER = (
    "symbol string, period_end date, basis string, revenue double, other_income double, expenses double, finance_costs double,"
    " depreciation double, pbt double, tax double, pat double, exceptional double, eps_basic double, paidup double, face double,"
    " filing_id bigint, event_at timestamp"
)
BAR = "symbol string, trade_date date, series string, high double, low double, close double, turnover double"


def now():
    return F.lit(NOW)


FIELDS = ("other_income", "expenses", "finance_costs", "depreciation", "pbt", "tax", "pat", "exceptional", "eps_basic", "paidup", "face", "filing_id", "event_at")


def quarter(i, rev, symbol="X", basis="consolidated", **kw):
    """Quarter ``i`` of a plain book: a third of revenue is profit before tax, a quarter of that is tax."""
    q = dict.fromkeys(FIELDS) | dict(expenses=rev * 2 / 3, pbt=rev / 3, tax=rev / 12, pat=rev / 4, filing_id=i) | kw
    end = dt.date(2023 + i // 4, (i % 4) * 3 + 3, 28)
    return (symbol, end, basis, float(rev), *[q[c] for c in FIELDS])


def funda(spark, rows):
    return fundamental.fundamental_scores(spark.createDataFrame(rows, QUARTER)).collect()


def plain_fundamental(book):
    """Points, score, confidence, label and number of flags of one book of dicts, oldest quarter first."""
    last, n = book[-1], len(book)
    ago = lambda k: book[-1 - k] if n > k else None

    def rise(field):
        for old in (ago(4), ago(1)):
            if old and old[field] > 0:
                return (last[field] - old[field]) / old[field]

    sides = [rise("revenue"), rise("pat")]
    growth = None if sides == [None, None] else sum(10 if g is None else min(20, max(0, 10 + 40 * g)) for g in sides)
    margins = [(q["revenue"] - q["expenses"] + q["finance_costs"] + q["depreciation"]) / q["revenue"] for q in book if q["revenue"] > 0]
    if len(margins) >= 3:
        drift = 10 if margins[-1] > margins[-3] else 2
    elif len(margins) == 2:
        drift = 8 if margins[1] > margins[0] else 3
    else:
        drift = 5
    margin = min(25, min(15, max(0, 60 * margins[-1])) + drift) if margins else None
    lost = flags = 0
    for bad, points in (
        (last["pbt"] > 0 and last["other_income"] > last["pbt"] / 2, 12),
        (last["pbt"] > 0 and 0.3 * last["pbt"] < last["other_income"] <= last["pbt"] / 2, 6),
        (last["pbt"] > 0 and not 0.1 <= last["tax"] / last["pbt"] <= 0.45, 8),
        (last["pbt"] != 0 and abs(last["exceptional"]) > abs(last["pbt"]) / 4, 8),
        (last["revenue"] > 0 and last["finance_costs"] > 0.15 * last["revenue"], 7),
        (last["pat"] < 0, 10),
    ):
        flags, lost = flags + bad, lost + points * bad
    quality = max(0, 35 - lost)
    weight = 35 + 40 * (growth is not None) + 25 * (margin is not None)
    score = min(100, ((growth or 0) + (margin or 0) + quality) * 100 / weight)
    return growth, margin, quality, weight, score, min(1, n / 8) * weight / 100, ("clean", "watch", "flagged")[min(flags, 2)], flags


def test_fundamental_score_follows_the_formula(spark):
    import random

    rng = random.Random(12)
    books = {}
    for k in range(160):
        rev, book = rng.uniform(40, 9000), []
        for _ in range(rng.choice((1, 2, 3, 4, 5, 7, 8, 11))):
            rev *= rng.uniform(0.7, 1.4)
            pbt = rev * rng.uniform(-0.2, 0.5)
            book.append(dict(
                revenue=rev, expenses=rev * rng.uniform(0.5, 1.1), finance_costs=rev * rng.uniform(0, 0.3), depreciation=rev * rng.uniform(0, 0.1), pbt=pbt,
                other_income=abs(pbt) * rng.uniform(0, 0.7), tax=pbt * rng.uniform(0, 0.6), pat=pbt * rng.uniform(0.3, 1.2), exceptional=pbt * rng.uniform(-0.5, 0.5)))
        books[f"B{k}"] = book
    rows = [quarter(i, q["revenue"], symbol=s, **{f: v for f, v in q.items() if f != "revenue"}) for s, b in books.items() for i, q in enumerate(b)]
    got = {r["symbol"]: r for r in funda(spark, rows)}
    assert {plain_fundamental(b)[6] for b in books.values()} == {"clean", "watch", "flagged"}
    for s, b in books.items():
        growth, margin, quality, weight, score, confidence, label, flags = plain_fundamental(b)
        r = got[s]
        assert (r["growth_pts"], r["margin_pts"], r["quality_pts"]) == (growth if growth is None else pytest.approx(growth), pytest.approx(margin), quality)
        assert (r["weight_covered"], r["label"], len(r["flags"])) == (weight, label, flags)
        assert r["score"] == pytest.approx(score, abs=0.0501) and r["confidence"] == pytest.approx(confidence, abs=0.00501)


@pytest.mark.parametrize("before", [0.0, -37.5])
def test_no_growth_from_a_base_that_is_not_positive(spark, before):
    r = funda(spark, [quarter(3, 640, pat=before), quarter(4, 800, pat=52.0)])[0]
    assert r["pat_qoq"] is None and r["rev_qoq"] == 0.25 and r["growth_pts"] == 30.0  # 10 for the unknown side, 10 + 40 * 0.25


def test_consolidated_wins_and_bases_never_mix(spark):
    rows = [quarter(0, 10), quarter(0, 999, basis="standalone"), quarter(1, 999, basis="standalone")]
    r = funda(spark, rows)[0]
    assert r["basis"] == "consolidated" and r["n_quarters"] == 1


def test_states_only_see_visible_quarters(spark):
    late = quarter(0, 1000, event_at=dt.datetime(2024, 6, 1))
    rows = fundamental.fundamental_states(spark.createDataFrame([late, quarter(1, 1100)], QUARTER)).orderBy("visible_on").collect()
    assert [(r["visible_on"], r["n_quarters"]) for r in rows] == [(dt.date(2023, 8, 12), 1), (dt.date(2024, 6, 1), 2)]


# ---------------------------------------------------------------- flow

def flow_of(spark, *, deals=(), turnover=0.0, surv=(), holding=(), insiders=0):
    """The flow row of one symbol; ``turnover`` in lakh on one recent day, ``holding`` in percent from the oldest on."""
    at = lambda days: NOW - dt.timedelta(days=days)
    bars = spark.createDataFrame([("X", at(3).date(), "EQ", 1.0, 1.0, 1.0, turnover)], BAR)
    d = spark.createDataFrame([(at(2).date(), "X", side, qty, price) for side, qty, price in deals], "day date, symbol string, side string, qty double, price double")
    s = spark.createDataFrame([(NOW.date(), "X", f, "1") for f in surv], "as_of date, symbol string, framework string, stage string")
    rows = [(i, "shareholding_pattern", "X", f"PR_AND_PRGRP: {p} | rest", None, at(200 - 90 * i), at(190 - 90 * i)) for i, p in enumerate(holding)]
    rows += [(100 + i, "insider_trading", "X", "trade", None, at(9), at(9)) for i in range(insiders)]
    f = spark.createDataFrame(rows, "filing_id bigint, feed string, symbol string, subject string, description string, event_at timestamp, observed_at timestamp")
    found = flow.flow_scores(bars, d, f, s, now()).collect()
    return found[0] if found else None


def plain_flow(net=None, turnover=0.0, delta=None, insiders=0, worst=25.0):
    """Score, confidence and label from the net value of deals, turnover (both in rupees), change of holding, insider filings and list points."""
    deal = None if net is None or not turnover else 17.5 + 35 * max(-0.5, min(0.5, net / turnover))
    held = None if delta is None else max(0, min(25, 12.5 + 5 * delta))
    weight = 40 + 35 * (deal is not None) + 25 * (held is not None)
    score = min(100, ((deal or 0) + (held or 0) + (min(15, 7.5 + 0.75 * insiders) if insiders else 7.5) + worst) * 100 / weight)
    label = "surveillance" if worst <= 10 else "accumulation" if round(score, 1) >= 65 else "distribution" if round(score, 1) <= 35 else "neutral"
    return score, weight / 100, label


@pytest.mark.parametrize("given,known", [
    (dict(deals=[("BUY", 300.0, 41.0)], turnover=2.0), dict(net=12300.0, turnover=2e5)),
    (dict(deals=[("SELL", 700.0, 90.0), ("BUY", 100.0, 88.0)], turnover=1.5), dict(net=-54200.0, turnover=1.5e5)),
    (dict(deals=[("SELL", 9000.0, 90.0)], turnover=1.0), dict(net=-810000.0, turnover=1e5)),
    (dict(surv=["asm_st", "gsm"]), dict(worst=0.0)),
    (dict(surv=["asm_lt", "asm_st"], deals=[("BUY", 10.0, 30.0)], turnover=1.0), dict(worst=5.0, net=300.0, turnover=1e5)),
    (dict(holding=("48.10", "47.35")), dict(delta=-0.75)),
    (dict(holding=("61.20", "62.95"), deals=[("BUY", 500.0, 77.0)], turnover=3.0), dict(delta=1.75, net=38500.0, turnover=3e5)),
    (dict(holding=("33.00", "33.40"), surv=["asm_st"]), dict(delta=0.4, worst=10.0)),
])
def test_flow_score_follows_the_formula(spark, given, known):
    score, confidence, label = plain_flow(**known)
    r = flow_of(spark, **given)
    assert r["score"] == pytest.approx(score, abs=0.0501) and r["confidence"] == pytest.approx(confidence) and r["label"] == label
    assert r["promoter_delta"] == (pytest.approx(known["delta"]) if "delta" in known else None)


def test_nothing_known_gives_no_row(spark):
    assert flow_of(spark) is None


def test_deal_window_begins_at_market_midnight(spark):
    at = dt.datetime(2026, 8, 8, 12, tzinfo=dt.timezone.utc)
    day = lambda back: (at - dt.timedelta(days=back)).date()
    deals = spark.createDataFrame([(day(28), "OLD", "BUY", 1.0, 1.0), (day(27), "IN", "BUY", 1.0, 1.0), (day(-1), "LATER", "BUY", 1.0, 1.0)], "day date, symbol string, side string, qty double, price double")
    assert [r["symbol"] for r in flow.net_deals(deals, F.lit(at)).collect()] == ["IN"]


def test_a_replay_sees_no_later_members(spark):
    surv = spark.createDataFrame([(NOW.date(), "A", "gsm", "1"), ((NOW + dt.timedelta(days=3)).date(), "B", "gsm", "1")], "as_of date, symbol string, framework string, stage string")
    scores = spark.createDataFrame([], "symbol string, agent string, observed_at timestamp")
    assert [r["symbol"] for r in risk.risk_universe(scores, surv, now()).collect()] == ["A"]
    bars = spark.createDataFrame([], BAR)
    deals = spark.createDataFrame([((NOW + dt.timedelta(days=3)).date(), "C", "BUY", 1.0, 1.0)], "day date, symbol string, side string, qty double, price double")
    filings = spark.createDataFrame([], "filing_id bigint, feed string, symbol string, subject string, description string, event_at timestamp, observed_at timestamp")
    market = spark.createDataFrame([(NOW.date(), "FII", 5.0), ((NOW - dt.timedelta(days=1)).date(), "FII", 4.0), ((NOW + dt.timedelta(days=2)).date(), "FII", 9.0), (NOW.date(), "DII", -2.0)], "day date, category string, net_value double")
    rows = flow.flow_scores(bars, deals, filings, surv, now(), market).collect()
    assert [r["symbol"] for r in rows] == ["A"] and rows[0]["market_context"] == {"FII": 5.0, "DII": -2.0}


# ---------------------------------------------------------------- risk

def verdict(spark, *, n=60, close=100.0, turnover=1000.0, locked=0, series="EQ", surv=(), enc=0, pledge=None, auditor=0):
    bars = spark.createDataFrame(
        [("X", (NOW - dt.timedelta(days=i)).date(), series, close if i < locked else close + 2, close if i < locked else close - 2, close, turnover) for i in range(n)], BAR)
    s = spark.createDataFrame([(NOW.date(), "X", f, st) for f, st in surv], "as_of date, symbol string, framework string, stage string")
    fs = "filing_id bigint, feed string, symbol string, observed_at timestamp"
    f = spark.createDataFrame([(i, "encumbrance", "X", NOW - dt.timedelta(days=5)) for i in range(enc)] + [(99, "announcements", "X", NOW)], fs)
    c = spark.createDataFrame([(99, "auditor_resignation", 9, NOW)] if auditor else [], "filing_id bigint, category string, materiality int, observed_at timestamp")
    p = spark.createDataFrame([("X", "R", 50.0, pledge, NOW)] if pledge is not None else [], "symbol string, record_id string, promoter_pct double, encumbered_pct double, observed_at timestamp")
    q = spark.createDataFrame([], QUARTER)
    u = spark.createDataFrame([("X",)], "symbol string")
    return risk.risk_verdicts(u, bars, f, c, s, p, q, now()).first()


def test_clean_symbol(spark):
    r = verdict(spark)
    assert (r["verdict"], r["score"]) == ("clear", 100.0) and len(r["unavailable"]) == 4


@pytest.mark.parametrize("name,limit,worse", [
    ("turnover", K.MIN_MEDIAN_TURNOVER_LAKH, -1), ("close", K.PENNY_CLOSE, -1), ("pledge", K.PLEDGE_HARD_PCT, 1),
])
def test_hard_limits_bind_only_beyond_their_border(spark, name, limit, worse):
    at, beyond = (verdict(spark, **{name: float(x)}) for x in (limit, limit + worse * 0.25))
    assert at["verdict"] != "hard_block" and (beyond["verdict"], beyond["score"], len(beyond["hard_blocks"])) == ("hard_block", 0.0, 1)


def test_locked_sessions_bind_beyond_their_share(spark):
    n = 40
    most = int(K.LOCK_RATIO_HARD * n)
    assert verdict(spark, n=n, locked=most)["verdict"] == "clear"
    r = verdict(spark, n=n, locked=most + 1)
    assert r["verdict"] == "hard_block" and f"{(most + 1) / n:.0%}" in r["hard_blocks"][0]


@pytest.mark.parametrize("kw,hard,soft", [
    (dict(auditor=1, surv=[("gsm", "Stage 3")]), 2, 0), (dict(surv=[("asm_lt", "Stage III")], turnover=1.0, pledge=90.0), 3, 0),
    (dict(series="BZ"), 0, 1), (dict(pledge=14.2, enc=2), 0, 2), (dict(surv=[("asm_st", "Stage II")], series="BZ", enc=3, pledge=K.PLEDGE_PENALTY_PCT + 0.5), 0, 4),
    (dict(series="BE", close=2.0), 1, 1),
])
def test_blocks_and_penalties_add_up(spark, kw, hard, soft):
    """Each penalty costs fifteen points; a block takes them all."""
    r = verdict(spark, **kw)
    assert (len(r["hard_blocks"]), len(r["penalties"])) == (hard, soft)
    assert r["score"] == (0 if hard else 100 - 15 * soft) and r["verdict"] == ("hard_block" if hard else "penalty")
    assert len(r["unavailable"]) == 4 - ("pledge" in kw)


# ---------------------------------------------------------------- fusion

def inputs(spark, *, f=80.0, t=75.0, w=70.0, risk_label="clear", atr=5.0):
    axis = "symbol string, score double, label string, confidence double, as_of timestamp"
    mk = lambda s, extra, schema: spark.createDataFrame([("X", s, "l", 0.9, NOW, *extra)] if s is not None else [], axis + schema)
    fd = mk(f, (0.1, ["flag a"], 8, "consolidated"), ", rev_yoy double, flags array<string>, n_quarters int, basis string")
    td = mk(t, (100.0, atr, 95.0, 61.0), ", close double, atr double, sma200 double, rsi double")
    wd = mk(w, (0.1, 1.5), ", deal_ratio double, promoter_delta double")
    r = spark.createDataFrame([("X", risk_label, ["blocked because"] if risk_label == "hard_block" else [], ["soft"] if risk_label == "penalty" else [], NOW)],
                              "symbol string, verdict string, hard_blocks array<string>, penalties array<string>, as_of timestamp")
    ev = spark.createDataFrame([], f"symbol string, event_score double, event_conf double, evidence {fusion.EVIDENCE}")
    return fusion.fusion_inputs(fd, td, wd, r, ev, now())


def fused(spark, **kw):
    rows = fusion.with_thesis(fusion.fuse(inputs(spark, **kw), fusion.profile_table(spark))).collect()
    return {r["profile"]: r for r in rows}


@pytest.mark.parametrize("atr", [1.7, 4.4])
def test_levels_follow_each_profile(spark, atr):
    """The close of the fixture is 100; stop, targets and size come from the profile's own geometry."""
    got = fused(spark, atr=atr)
    for name, r in got.items():
        _, _, _, _, _, stop, low, high = K.PROFILES[name]
        assert r["invalidation"] == pytest.approx(100 - stop * atr, abs=0.0051)
        if r["stance"] in ("buy", "accumulate"):
            assert r["target_low"] == pytest.approx(100 + low * stop * atr, abs=0.021) and r["target_high"] == pytest.approx(100 + high * stop * atr, abs=0.031)
            assert r["entry_low"] == pytest.approx(100 - atr / 2, abs=0.0051) and r["size_pct"] == pytest.approx(min(10, 100 / (stop * atr)), abs=0.0501)
    assert set(got) == {p for p, v in K.PROFILES.items()} and any(r["stance"] in ("buy", "accumulate") for r in got.values())


def test_a_profile_gives_no_reason_from_an_axis_without_weight(spark):
    r = fused(spark)
    assert not any("fundamentals" in x for x in r["short"]["thesis_for"] + r["short"]["thesis_against"])
    assert any("fundamentals" in x for x in r["value"]["thesis_for"])


def test_hard_block_suppresses(spark):
    r = fused(spark, risk_label="hard_block")["default"]
    assert (r["stance"], r["conviction"], r["size_pct"], r["invalidation"]) == ("suppressed", 0.0, None, None)
    assert "blocked because" in r["view_changer"]


def test_penalty_caps_and_keeps_only_the_stop(spark):
    r = fused(spark, risk_label="penalty")["default"]
    assert r["conviction"] == 55.0 and r["stance"] == "hold" and r["entry_low"] is None and r["invalidation"] is not None


def test_too_little_weight_gives_no_row(spark):
    assert fused(spark, f=None, w=None) == {}
    assert "default" in fused(spark, w=None)


def test_profile_weights_are_checked(spark):
    with pytest.raises(ValueError):
        fusion.profile_table(spark, {"x": (50, 10, 10, 10, "h", 1.0, 1.0, 1.0)})


EV = "filing_id bigint, symbol string, subject string, event_at timestamp, category string, materiality int, sentiment double, confidence double, classified_at timestamp"


def test_event_score_reads_the_current_version_only(spark):
    """Three filings in several versions: the newest fixed version of each counts, older ones never add to it."""
    f = spark.createDataFrame([(i, "X", f"subject {i}", NOW) for i in (4, 5, 6)], "filing_id bigint, symbol string, subject string, event_at timestamp")
    known = {4: (6, -0.4, 0.7), 5: (9, 0.5, 0.95), 6: (7, 0.1, 0.6)}
    rows = [(i, "capex", m, s, c, False, K.CLASSIFIER_VERSION, NOW) for i, (m, s, c) in known.items()]
    rows += [(i, "litigation", 10, -1.0, 1.0, False, "rules-v2", NOW) for i in (4, 6)]
    c = spark.createDataFrame(rows, "filing_id bigint, category string, materiality int, sentiment double, confidence double, routine boolean, model_version string, observed_at timestamp")
    r = fusion.event_scores(fusion.classified_events(f, c), now()).first()
    assert sorted(e["filing_id"] for e in r["evidence"]) == [4, 5, 6]
    assert len({e["filing_id"] for e in r["evidence"]}) == len(r["evidence"])
    alone = fusion.event_scores(fusion.classified_events(f, c.where(F.col("model_version") == K.CLASSIFIER_VERSION)), now()).first()
    assert r["event_score"] == alone["event_score"]


def test_peer_events_reach_the_industry_only(spark):
    sec = spark.createDataFrame([("A", "steel"), ("B", "steel"), ("C", "pharma")], "symbol string, industry string")
    ev = spark.createDataFrame([(1, "A", "s", NOW, "fire_accident", 8, -0.8, 0.9, NOW)], EV)
    rows = {r["symbol"]: r for r in fusion.peer_event_scores(ev, sec, now()).collect()}
    assert set(rows) == {"B"} and rows["B"]["peer_score"] < 50 and rows["B"]["peer_evidence"][0]["peer"] == "A"


def test_peer_pool_equals_all_pairs(spark):
    """The bounded pool gives what joining every pair would give."""
    import random

    rng = random.Random(1)
    sec = [(f"S{i}", f"I{i % 3}") for i in range(24)]
    ev = [(i, f"S{rng.choice([0, 0, 0, rng.randrange(24)])}", "s", NOW, "ma", rng.randrange(5, 11), rng.uniform(-1, 1), 0.5, NOW) for i in range(400)]
    got = {r["symbol"]: [e["filing_id"] for e in r["peer_evidence"]] for r in
           fusion.peer_event_scores(spark.createDataFrame(ev, EV), spark.createDataFrame(sec, "symbol string, industry string"), now()).collect()}
    ind = dict(sec)
    for s, i in sec:
        rows = sorted([e for e in ev if ind[e[1]] == i and e[1] != s and e[5] >= 7], key=lambda e: (-e[5], e[0]))[:8]
        assert sorted(got.get(s, [])) == sorted(e[0] for e in rows)


def test_hysteresis(spark):
    cand = spark.createDataFrame([("A", "default", "buy", 75.0), ("B", "default", "buy", 75.0), ("C", "default", "hold", 50.0)], "symbol string, profile string, stance string, conviction double")
    old = spark.createDataFrame(
        [(1, "A", "default", "buy", 70.0, K.FUSION_VERSION, NOW), (2, "B", "default", "buy", 60.0, K.FUSION_VERSION, NOW), (3, "C", "default", "hold", 50.0, "older", NOW)],
        "signal_id bigint, symbol string, profile string, stance string, conviction double, model_version string, as_of timestamp")
    assert sorted(r["symbol"] for r in fusion.issue(cand, old).collect()) == ["B", "C"]


def test_hysteresis_replay_compares_with_last_issued(spark):
    rows = [("A", "d", "hold", c, "v", NOW + dt.timedelta(days=i)) for i, c in enumerate([50.0, 55.0, 59.0, 60.0, 67.0])]
    df = spark.createDataFrame(rows, "symbol string, profile string, stance string, conviction double, model_version string, as_of timestamp")
    assert [r["issued"] for r in fusion.replay_hysteresis(df).orderBy("as_of").collect()] == [True, False, True, False, False]
