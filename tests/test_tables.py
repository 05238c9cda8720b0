"""Point-in-time reads, deduplication, resolution, measurement, calendar and registers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapeloom import schemas
from tapeloom.functions import calendar as cal
from tapeloom.operators import asof, keyed, pit, ranks, resolve
from tapeloom.plans import alerts, evaluate, master, performance, views
from tapeloom.streaming import stateful

NOW = dt.datetime(2026, 8, 8, 12, tzinfo=dt.timezone.utc)
DAY = dt.timedelta(days=1)


def test_every_fact_table_is_bitemporal(spark):
    assert schemas.bitemporal_violations() == []
    assert schemas.empty(spark, "filings").count() == 0
    assert all(set(k) <= set(schemas.schema(t).names) for t, k in schemas.KEYS.items())


def test_pit_needs_a_zone_and_hides_the_future(spark):
    df = spark.createDataFrame([(1, "X", "f", NOW - 2 * DAY, NOW + 30 * DAY)], "filing_id bigint, symbol string, feed string, event_at timestamp, observed_at timestamp")
    with pytest.raises(ValueError):
        pit.pit(df, NOW.replace(tzinfo=None))
    assert pit.pit_filings(df, NOW).count() == 0
    assert pit.pit_filings(df, NOW + 31 * DAY, symbol="x").count() == 1


ENTRY = "filing_id bigint, feed string, dedup_key string, content_hash string, observed_at timestamp"


def test_dedup_is_idempotent_and_keyless_rows_only_face_the_hash(spark):
    rows = [(1, "f", "u1", "h1", NOW), (2, "f", "u1", "h2", NOW + DAY), (3, "g", "u1", "h3", NOW), (4, "f", None, "h4", NOW),
            (5, "f", None, "h5", NOW), (6, "f", None, "h4", NOW + DAY)]
    df = spark.createDataFrame(rows, ENTRY)
    once = keyed.dedup_filings(df)
    assert sorted(r["filing_id"] for r in once.collect()) == [1, 3, 4, 5]
    assert keyed.dedup_filings(df, once).count() == 0
    assert keyed.uniqueness_violations(once, ["content_hash"]).count() == 0


def test_upsert_and_first_wins(spark):
    old = spark.createDataFrame([("a", 1.0, 7.0), ("b", 2.0, 7.0)], "k string, v double, w double")
    new = spark.createDataFrame([("b", 3.0, 9.0), ("b", 4.0, 9.0), ("c", 5.0, 9.0)], "k string, v double, w double")
    got = {r["k"]: (r["v"], r["w"]) for r in keyed.upsert_last_wins(old, new, ["k"], ["v"], update=["v"]).collect()}
    assert got == {"a": (1.0, 7.0), "b": (4.0, 7.0), "c": (5.0, 9.0)}
    assert [r["v"] for r in keyed.insert_first_wins(new, ["k"], ["v"], old).collect()] == [5.0]


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    plan = keyed.top_per_key(df, ["k"], [F.col("v").desc()], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_resolution_tiers(spark):
    sec = spark.createDataFrame([(1, "ACME", "INE000000001", "Acme Ltd"), (2, "BETA", "INE000000002", "Beta Ltd")], "security_id bigint, symbol string, isin string, company_name string")
    ali = spark.createDataFrame([(2, "oldbeta", "old_symbol"), (1, "Acme Old Ltd", "old_name")], "security_id bigint, alias string, alias_type string")
    t = spark.createDataFrame([(" acme ",), ("INE000000002",), ("OLDBETA",), ("nobody",), (None,), ("",)], "t string")
    got = {r["t"]: r["security_id"] for r in resolve.resolve_token(t, "t", sec, ali).collect()}
    assert got == {" acme ": 1, "INE000000002": 2, "OLDBETA": 2, "nobody": None, None: None, "": None}
    n = spark.createDataFrame([("acme  LTD",), ("Beta Ltd - Ex-Date: 1",), ("ACME OLD LTD",), ("oldbeta",), (None,)], "n string")
    got = {r["n"]: r["security_id"] for r in resolve.resolve_name(n, "n", sec, ali).collect()}
    assert got == {"acme  LTD": 1, "Beta Ltd - Ex-Date: 1": 2, "ACME OLD LTD": 1, "oldbeta": None, None: None}


def test_asof_both_directions(spark):
    d = dt.date(2020, 1, 1)
    bars = spark.createDataFrame([("X", d, 1.0), ("X", d + 3 * DAY, 2.0)], "symbol string, trade_date date, close double")
    left = spark.createDataFrame([(i, "X", d + i * DAY) for i in (-1, 0, 1, 3, 4)] + [(9, "Y", d)], "i int, symbol string, day date")
    for unique in (False, True):
        back = {r["i"]: r["close"] for r in asof.asof_backward(left, bars, "day", ["close"], unique=unique).collect()}
        fwd = {r["i"]: r["close"] for r in asof.asof_forward(left, bars, "day", ["close"], unique=unique).collect()}
        assert back == {-1: None, 0: 1.0, 1: 1.0, 3: 2.0, 4: 2.0, 9: None}
        assert fwd == {-1: 1.0, 0: 1.0, 1: 2.0, 3: 2.0, 4: None, 9: None}


def test_performance_measures_elapsed_windows_once(spark):
    start = (NOW - 34 * DAY).date()
    bar = "symbol string, trade_date date, close double"
    bars = spark.createDataFrame([("P", start + i * DAY, 100.0 + i) for i in range(35)], bar)
    idx = spark.createDataFrame([("IDX", start + i * DAY, 1000.0 + i) for i in range(35)], bar)
    sig = spark.createDataFrame([(1, "P", "buy", "default", 70.0, "v", NOW - 30 * DAY)], "signal_id bigint, symbol string, stance string, profile string, conviction double, model_version string, as_of timestamp")
    first = performance.measure(sig, bars, idx)
    got = {r["window"]: r for r in first.collect()}
    assert set(got) == {"1w", "4w"}
    assert got["1w"]["entry_price"] == 105.0 and got["1w"]["exit_price"] == 110.0
    assert got["1w"]["excess"] == pytest.approx(110 / 105 - 1010 / 1005)
    assert performance.measure(sig, bars, idx, first).count() == 0
    s = performance.rounded(performance.summarize(first, "v")).where("window = '1w'").first()
    assert s["n"] == 1 and s["hit_rate_pct"] == 100.0


def test_average_ranks_against_python(spark):
    rng = random.Random(2)
    v = [float(rng.randrange(40)) for _ in range(500)]
    got = {r["v"]: r["r"] for r in ranks.value_ranks(spark.createDataFrame([(x,) for x in v], "v double"), "v", "r", buckets=8).collect()}
    s = sorted(v)
    for x in set(v):
        assert got[x] == s.index(x) + 1 + (v.count(x) - 1) / 2
    same = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double")
    assert ranks.spearman(same, "x", "y").first()[0] == 0.0
    line = spark.createDataFrame([(float(i), float(i * i)) for i in range(9)], "x double, y double")
    assert ranks.spearman(line, "x", "y").first()[0] == pytest.approx(1.0)


def test_calendar(spark):
    seed = cal.seed_holidays(spark)
    days = {r["day"]: r for r in cal.trading_days(spark, "2026-01-01", "2026-02-28", seed).collect()}
    assert days[dt.date(2026, 1, 23)]["next_trading_day"] == dt.date(2026, 1, 27)
    assert not days[dt.date(2026, 1, 26)]["is_trading"] and not days[dt.date(2026, 1, 24)]["is_trading"]
    at = lambda h, m: dt.datetime(2026, 8, 5, h, m) - dt.timedelta(minutes=330)
    ts = spark.createDataFrame([(i, at(h, m)) for i, (h, m) in enumerate([(8, 59), (9, 0), (9, 14), (9, 15), (15, 29), (15, 30), (15, 59), (16, 0)])], "i int, ts timestamp")
    got = [r["session_state"] for r in cal.session_state(ts, "ts", seed).orderBy("i").collect()]
    assert got == ["closed", "pre_open", "pre_open", "open", "open", "post_close", "post_close", "closed"]
    learned = spark.createDataFrame([(dt.date(2026, 1, 26), "renamed"), (dt.date(2026, 1, 15), "election")], "day date, name string")
    both = {r["day"]: r["name"] for r in cal.overlay_holidays(seed, learned).collect()}
    assert both[dt.date(2026, 1, 26)] == "renamed" and both[dt.date(2026, 1, 15)] == "election" and len(both) == 48
    with pytest.raises(Exception, match="empty holiday table"):
        cal.overlay_holidays(seed, learned.limit(0)).collect()
    assert spark.range(1).select(cal.muhurat_date(F.lit(2025))).first()[0] == dt.date(2025, 10, 21)


def states(spark, *outcomes):
    rows = [(1, i, NOW + dt.timedelta(hours=i), o) for i, o in enumerate(outcomes)]
    a = spark.createDataFrame(rows, "doc_id bigint, attempt_id bigint, moment timestamp, outcome string")
    r = master.document_state(spark.createDataFrame([(1,)], "doc_id bigint"), a).first()
    return r["fetch_status"], r["attempts"], r["next_attempt_at"]


def test_document_ladder(spark):
    at = lambda h, m: (NOW + dt.timedelta(hours=h, minutes=m)).replace(tzinfo=None)
    u = "unavailable"
    assert states(spark) == ("pending", 0, None)
    assert states(spark, "deferred") == ("pending", 0, None)
    assert states(spark, u) == ("pending", 1, at(0, 5))
    assert states(spark, u, u) == ("pending", 2, at(1, 15))
    assert states(spark, u, u, u) == ("pending", 3, at(2, 45))
    assert states(spark, u, u, u, u, "ok")[:2] == ("failed", 4)
    assert states(spark, u, "ok", u)[:2] == ("fetched", 1)
    assert states(spark, "error", "ok")[:2] == ("failed", 0)


ALERT = "alert_id bigint, severity string, observed_at timestamp"


def sent_flags(spark, offsets, severity="high", **kw):
    rows = [(i, severity, NOW + dt.timedelta(seconds=s)) for i, s in enumerate(offsets)]
    return [r["sent"] for r in stateful.limit_alerts(spark.createDataFrame(rows, ALERT).repartition(3), **kw).orderBy("alert_id").collect()]


def test_alert_budget(spark):
    assert sent_flags(spark, range(15)) == [True] * 12 + [False] * 3
    assert sent_flags(spark, [0] * 15) == [True] * 12 + [False] * 3
    assert sent_flags(spark, [*range(12), 3600, 3601.5, 7300]) == [True] * 12 + [False, True, True]


@pytest.mark.parametrize("span,block_rows", [(30_000, 1_000_000), (9_000, 60), (30_000, 40), (300_000, 40)])
def test_alert_budget_matches_a_plain_loop(spark, span, block_rows):
    """Overload without a pause, mixed, and mostly quiet; blocks longer and much shorter than the hour."""
    rng = random.Random(4)
    offsets = sorted(rng.choice([rng.uniform(0, span), float(rng.randrange(40) * 500)]) for _ in range(600))
    sent, expect = [], []
    for s in offsets:
        live = [x for x in sent if x >= round(s * 1e6) - 3_600_000_000]
        expect.append(len(live) < 12)
        if expect[-1]:
            sent.append(round(s * 1e6))
    assert sent_flags(spark, offsets, block_rows=block_rows) == expect


def test_alert_budget_of_no_alerts(spark):
    assert sent_flags(spark, []) == [] and sent_flags(spark, [1, 2], severity="low") == []


def test_feed_state_streak_and_health(spark):
    rows = [("a", i, NOW - dt.timedelta(minutes=9 - i), s, 2, i % 2) for i, s in enumerate(["error", "ok", "error", "error", "error"])]
    rows += [("b", 9, NOW - 2 * DAY, "ok", 1, 1), ("b", 8, NOW - 2 * DAY, "not_modified", 1, 0)]
    polls = spark.createDataFrame(rows, "feed string, poll_id int, moment timestamp, status string, seen int, new int")
    state = views.feed_state(polls)
    got = {r["feed"]: r for r in state.collect()}
    # a failed poll changes nothing, and of two polls at one moment the later id stands
    assert got["a"]["last_changed_at"] == (NOW - dt.timedelta(minutes=8)).replace(tzinfo=None) and got["b"]["last_status"] == "ok"
    assert got["a"]["consecutive_errors"] == 3 and got["a"]["entries_seen"] == 2 and got["b"]["consecutive_errors"] == 0
    feeds = spark.createDataFrame([("a", "P0"), ("b", "P1"), ("c", "P2")], "feed string, priority string")
    problems = sorted((r["feed"], r["problem"]) for r in views.health(feeds, state, F.lit(NOW)).collect())
    assert problems == [("a", "3 consecutive errors"), ("a", "last poll 300s ago"), ("b", "last poll 172800s ago"), ("c", "never polled")] or \
        problems == [("a", "3 consecutive errors"), ("b", "last poll 172800s ago"), ("c", "never polled")]


def test_signal_view_keeps_flagged_rows_beyond_the_cut(spark):
    sig = spark.createDataFrame(
        [(i, f"S{i}", "default", "hold" if i == 9 else "buy", 90.0 - i, 100.0, 120.0, NOW) for i in range(10)],
        "signal_id bigint, symbol string, profile string, stance string, conviction double, entry_high double, target_low double, as_of timestamp")
    news = spark.createDataFrame([("S9", "litigation", 8, -0.7, 1)], "symbol string, news_category string, news_materiality int, news_sentiment double, news_days_ago int")
    got = {r["symbol"]: r for r in views.signals_view(sig, news, limit=3).collect()}
    assert set(got) == {"S0", "S1", "S2", "S9"}
    assert got["S9"]["reco"] == "SELL RISK" and got["S0"]["reco"] == "BUY" and got["S0"]["upside_pct"] == 20.0


def test_reconcile_tolerance(spark):
    own = spark.createDataFrame([("X", dt.date(2025, 3 * q, 28), "consolidated", 1e9, 1e8) for q in range(1, 5)], "symbol string, period_end date, basis string, revenue double, pat double")
    good = own.select("symbol", "period_end", F.lit(101.5).alias("revenue_cr"), F.lit(10.9).alias("pat_cr"))
    assert evaluate.reconcile(own, good).first()["outside"] == 0
    bad = good.withColumn("pat_cr", F.lit(12.0))
    assert evaluate.reconcile_report(evaluate.reconcile(own, bad)).first()["verdict"] == "FAIL"


def test_alert_text(spark):
    routed = spark.createDataFrame([(7, "X", "litigation", 8, -0.7, "A & B < C", "high")], "filing_id bigint, symbol string, category string, materiality int, sentiment double, summary string, severity string")
    standing = spark.createDataFrame([("X", "buy", 71.0, 0.5, 92.5)], "symbol string, stance string, conviction double, confidence double, invalidation double")
    names = spark.createDataFrame([("X", "Ex Ltd")], "symbol string, company_name string")
    text = alerts.render_event_alerts(routed, standing, names).first()["message"]
    assert "🔴 <b>X</b> · Ex Ltd" in text and "A &amp; B &lt; C" in text and "Adverse news against a long stance" in text and "<b>Stop:</b> 92.5" in text
    quiet = alerts.digest(spark.createDataFrame([], "alert_id bigint, severity string, category string, symbol string, message string, observed_at timestamp"), F.lit(NOW), "pre_open").first()
    assert quiet["text"].startswith("pre_open digest\nquiet window")


def test_master_merge(spark):
    cols = "security_id bigint, symbol string, isin string, company_name string, series string, is_sme boolean, face_value double"
    old = spark.createDataFrame([(1, "OLD", "I1", "One", "EQ", False, 10.0), (2, "TWO", None, "Two", "EQ", False, 10.0)], cols)
    snap = spark.createDataFrame([("NEW", "I1", "One", "EQ", False, 10.0, 1), ("TWO", "I2", "Two", "EQ", False, None, 2), ("THREE", "I3", "Three", "EQ", True, 1.0, 3), ("", "I4", "x", "EQ", True, 1.0, 4)],
                                 "symbol string, isin string, company_name string, series string, is_sme boolean, face_value double, line_no bigint")
    merged = master.merge_snapshot(old, snap)
    got = {r["symbol"]: r for r in merged.collect()}
    assert got["NEW"]["outcome"] == "update" and got["NEW"]["old_symbol"] == "OLD" and got["NEW"]["security_id"] == 1
    assert got["TWO"]["outcome"] == "update" and got["TWO"]["face_value"] == 10.0 and got["THREE"]["outcome"] == "insert" and len(got) == 3
    assert [tuple(r) for r in master.alias_rows(merged).collect()] == [(1, "OLD", "old_symbol")]


def test_ranges_of_days_equal_the_lookup(spark):
    """Bars without a day, before, between and after the days asked for, several on a day's eve, and a group without a symbol."""
    d, rng = dt.date(2020, 1, 1), random.Random(2)
    rows = [(s, d + i * DAY, float(i)) for s in ("X", "Y", None) for i in range(-3, 40) if rng.random() < 0.4] + [("X", None, -9.0), ("Z", d + 60 * DAY, 1.0)]
    bars = spark.createDataFrame(rows, "symbol string, trade_date date, close double")
    days = spark.createDataFrame([(d + i * DAY,) for i in (0, 5, 6, 11, 30, 30)], "day date")
    grid = bars.select("symbol").distinct().crossJoin(days.distinct())
    want = asof.asof_backward(grid, bars, "day", ["close"], unique=True).where("close IS NOT NULL")
    numbered = asof.number_days(days, "day")
    got = asof.with_first_day(bars, numbered, "day").withColumn("_until", asof.until_next()).where("_until > _from")
    got = got.select("symbol", "close", F.explode(F.sequence(F.col("_from"), F.col("_until") - 1)).alias("_at")).join(numbered, "_at")
    as_rows = lambda df: sorted(map(str, df.select("symbol", "day", "close").collect()))
    assert as_rows(got) == as_rows(want) and len(as_rows(want)) >= 14
    none = asof.with_first_day(bars, numbered.where("_at < 0"), "day").withColumn("_until", asof.until_next())
    assert none.count() == len(rows) and none.where("_until > _from").count() == 0
