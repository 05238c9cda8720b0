"""Indicator maths against a plain Python fold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import indicators as ind
from tapeloom.operators.asof import number_bars
from tapeloom.plans import technical

DAY = dt.date(2020, 1, 1)
BAR = "symbol string, trade_date date, open double, high double, low double, close double, volume double, turnover double, delivery_pct double, series string"


def bars(spark, closes, symbol="X", spread=2.0, volume=None, turnover=1000.0, delivery=50.0):
    rows = [
        (symbol, DAY + dt.timedelta(days=i), c, c + spread, c - spread, c, float(volume[i]) if volume else 100.0, turnover, delivery, "EQ")
        for i, c in enumerate(map(float, closes))
    ]
    return spark.createDataFrame(rows, BAR)


def last(df, *cols):
    return df.orderBy(F.col("trade_date").desc()).select(*cols).first()


def fold_rsi(c, n=14):
    g = [max(b - a, 0) for a, b in zip(c, c[1:])]
    l = [max(a - b, 0) for a, b in zip(c, c[1:])]
    ag, al = sum(g[:n]) / n, sum(l[:n]) / n
    for x, y in zip(g[n:], l[n:]):
        ag, al = (ag * (n - 1) + x) / n, (al * (n - 1) + y) / n
    return 100.0 if al == 0 else 100 - 100 / (1 + ag / al)


def test_sma_and_short_series(spark):
    df = bars(spark, range(1, 31))
    w = ind.by_date()
    out = df.select("trade_date", ind.sma(F.col("close"), 20, w).alias("s"), ind.sma(F.col("close"), 50, w).alias("t"))
    assert last(out, "s", "t") == (20.5, None)


def wave(n, start=240.0):
    """A series that drifts in a sawtooth: seven bars up by 1.5 %, four down by 2 %."""
    closes = [start]
    for i in range(n - 1):
        closes.append(closes[-1] * (1.015 if i % 11 < 7 else 0.98))
    return closes


def fold_wilder(x, n, average=True):
    """The recursion itself from the n-th value on."""
    out, state = [], 0.0
    for i, v in enumerate(x, 1):
        state = state + v if i <= n else state - state / n + v
        out.append(None if i < n else state / n if average else state)
    return out


@pytest.mark.parametrize("n", [15, 16, 47, 300])
def test_rsi_follows_the_recursion(spark, n):
    closes = wave(n)
    assert last(ind.with_rsi(number_bars(bars(spark, closes))), "rsi")[0] == pytest.approx(fold_rsi(closes), rel=1e-11)


def test_rsi_without_losses_is_full(spark):
    closes = [75.0 * 1.01**i for i in range(33)]
    assert last(ind.with_rsi(number_bars(bars(spark, closes))), "rsi")[0] == 100.0


def test_rsi_needs_fifteen_bars(spark):
    out = ind.with_rsi(number_bars(bars(spark, range(20)))).orderBy("trade_date").select("rsi").collect()
    assert [r[0] is None for r in out] == [True] * 14 + [False] * 6


def test_atr_follows_the_recursion(spark):
    closes = wave(140)
    ranges = [max(2 * 1.75, abs(c + 1.75 - p), abs(c - 1.75 - p)) for p, c in zip(closes, closes[1:])]
    got = ind.with_atr(number_bars(bars(spark, closes, spread=1.75))).orderBy("trade_date").select("atr").collect()
    want = [None] + fold_wilder(ranges, 14)
    assert all((r[0] is None) == (w is None) and (w is None or r[0] == pytest.approx(w, rel=1e-11)) for r, w in zip(got, want))


def test_adx_trend(spark):
    closes = [100 + 3 * i for i in range(60)]
    adx, plus, minus = last(ind.with_adx(number_bars(bars(spark, closes))), "adx", "plus_di", "minus_di")
    assert adx > 25 and plus > minus


def test_adx_needs_twenty_nine_bars(spark):
    out = ind.with_adx(number_bars(bars(spark, range(100, 130)))).orderBy("trade_date").select("adx").collect()
    assert [r[0] is None for r in out] == [True] * 28 + [False] * 2


def test_rsi_equals_fold_on_long_series(spark):
    rng = random.Random(5)
    closes = [1000.0]
    for _ in range(3000):
        closes.append(closes[-1] * (1 + rng.uniform(-0.03, 0.03)))
    got = last(ind.with_rsi(number_bars(bars(spark, closes))), "rsi")[0]
    assert got == pytest.approx(fold_rsi(closes), abs=1e-9)


def test_zscore_flat_and_spike(spark):
    w = ind.by_date()
    z = lambda vol: last(bars(spark, [10] * 21, volume=vol).select("trade_date", ind.zscore(F.col("volume"), 20, w).alias("z")), "z")[0]
    assert z([10] * 21) == 0.0
    assert z([10] * 20 + [20]) == 5.0
    assert z([10] * 20 + [5]) == -5.0


def test_upper_median(spark):
    df = bars(spark, range(1, 21)).withColumn("turnover", F.col("close"))
    assert last(ind.with_upper_median(df, "turnover", 20, "m"), "m")[0] == 11.0


def test_delivery_trend(spark):
    df = bars(spark, range(1, 21)).withColumn("delivery_pct", F.col("close"))
    pts = lambda d: last(ind.with_delivery_points(d, "delivery_pct", 20, "p"), "p")[0]
    assert pts(df) == 5.0
    assert pts(df.withColumn("delivery_pct", F.when(F.col("close") > 9, F.col("close")).otherwise(0.0))) == 5.0
    assert pts(df.withColumn("delivery_pct", F.when(F.col("close") > 11, F.col("close")).otherwise(0.0))) == 0.0


def score(spark, closes, **kw):
    idx = bars(spark, [100.0] * 300, symbol="IDX:ALL")
    return technical.technical_scores(bars(spark, closes, **kw), idx, latest_only=False).collect()


def test_score_orders_regimes(spark):
    up = score(spark, [100 * 1.003**i for i in range(250)])[0]
    down = score(spark, [100 * 0.997**i for i in range(250)])[0]
    assert up["score"] > 65 > down["score"]
    assert up["confidence"] == 1.0


def test_short_and_thin_series_are_absent(spark):
    assert score(spark, [100.0] * 59) == []
    assert score(spark, [100.0] * 90, turnover=2.0) == []


def test_latest_only_gate(spark):
    old = bars(spark, [100.0 + i for i in range(80)], symbol="OLD")
    new = bars(spark, [100.0 + i for i in range(90)], symbol="NEW")
    both = old.unionByName(new)
    names = lambda flag: {r["symbol"] for r in technical.technical_scores(both, bars(spark, [1.0] * 90, symbol="IDX"), latest_only=flag).collect()}
    assert names(True) == {"NEW"} and names(False) == {"OLD", "NEW"}


def long_bars(spark, n):
    rng = random.Random(5)
    c, rows = 1000.0, []
    for i in range(n):
        c = max(5.0, c + rng.uniform(-3, 3))
        rows.append(("X", dt.date(1901, 1, 1) + dt.timedelta(days=i), c, c + rng.uniform(0, 3), c - rng.uniform(0, 3), c, 1.0, 1.0, 1.0, "EQ"))
    return spark.createDataFrame(rows, BAR), [r[5] for r in rows]


def fold_adx(rows, n=14):
    """(adx, plus, minus) of each bar of (high, low, close)."""
    tr, up, down = [], [], []
    for (_, l0, c0), (h, l, _) in zip(rows, rows[1:]):
        h0 = rows[len(tr)][0]
        tr.append(max(h - l, abs(h - c0), abs(l - c0)))
        u, d = h - h0, l0 - l
        up.append(u if u > d and u > 0 else 0.0), down.append(d if d > u and d > 0 else 0.0)
    t, p, m = (fold_wilder(x, n, average=False) for x in (tr, up, down))
    plus = [100 * a / b if b else 0.0 for a, b in zip(p[n:], t[n:])]
    minus = [100 * a / b if b else 0.0 for a, b in zip(m[n:], t[n:])]
    dx = [100 * abs(a - b) / (a + b) if a + b else 0.0 for a, b in zip(plus, minus)]
    return [(a, p, m) for a, p, m in zip(fold_wilder(dx, n), plus, minus)]


def test_averages_follow_the_recursion_at_every_bar(spark):
    df, _ = long_bars(spark, 600)
    rows = [(r["high"], r["low"], r["close"]) for r in df.orderBy("trade_date").collect()]
    got = ind.with_adx(number_bars(df)).orderBy("trade_date").select("adx", "plus_di", "minus_di").collect()
    want = fold_adx(rows)
    for g, w in zip(got[-len(want):], want):
        assert (g[0] is None) == (w[0] is None) and (g[0] is None or tuple(g) == pytest.approx(w, rel=1e-9))


def test_series_of_any_length(spark):
    df, closes = long_bars(spark, 40_000)
    assert last(ind.with_rsi(number_bars(df)), "rsi")[0] == pytest.approx(fold_rsi(closes), rel=1e-9)
    ranges = ind.with_true_range(number_bars(df)).orderBy("trade_date").select("_tr").collect()
    assert last(ind.with_atr(number_bars(df)), "atr")[0] == pytest.approx(fold_wilder([r[0] for r in ranges[1:]], 14)[-1], rel=1e-9)


def test_rebalance_dates_skip_index_bars_without_a_close(spark):
    from tapeloom.plans import backtest

    day = lambda i: DAY + dt.timedelta(days=i)
    full = [("IDX:ALL", day(i), 100.0 + i) for i in range(260)]
    gaps = full + [("IDX:ALL", day(1000 + i), None) for i in range(5)]
    schema = "symbol string, trade_date date, close double"
    a, b = (sorted(tuple(r) for r in backtest.rebalances(spark.createDataFrame(rows, schema)).collect()) for rows in (full, gaps))
    assert a == b and len(a) == 24


def test_indicators_at_the_last_bar_equal_those_of_every_bar(spark):
    """Histories of several lengths with gaps, also at their end, and one without any close."""
    rng, rows = random.Random(4), []
    for symbol, n in (("A", 300), ("B", 260), ("C", 40), ("D", 19), ("E", 1), ("F", 60), ("G", 251), (None, 30)):
        for i in range(n):
            gap = i >= n - 3 if symbol in ("B", "F") else rng.random() < 0.1
            close = rng.choice([None, 0.0]) if gap or (symbol == "E") else (7.0 if symbol == "G" else rng.uniform(50, 90))
            some = lambda x: rng.choice([x, x, x, None, 0.0])
            rows.append((symbol, dt.date(2024, 1, 1) + dt.timedelta(days=i), some(95.0), some(45.0), close, some(rng.uniform(1, 9)), some(rng.uniform(1, 9)), some(rng.uniform(1, 99))))
    bars = spark.createDataFrame(rows, "symbol string, trade_date date, high double, low double, close double, volume double, turnover double, delivery_pct double")
    every = technical.bar_indicators(bars)
    want = every.withColumn("_next", F.lead("bar_no").over(ind.by_date())).where("_next IS NULL").drop("_next")
    last = technical.last_indicators(bars)
    columns = sorted(want.columns)
    assert sorted(last.columns) == columns and last.count() == 7
    assert want.select(columns).exceptAll(last.select(columns)).count() == 0
    # no frame of many rows is walked at each bar
    plan = technical.technical_scores(bars, bars.where("symbol = 'A'"))._jdf.queryExecution().toString()
    assert "RowFrame, -249" not in plan and "RowFrame, -199" not in plan


def test_range_of_parts_equals_the_range_of_one_frame(spark):
    rows = spark.range(700).select((F.col("id") % 3).cast("string").alias("symbol"), F.col("id").alias("trade_date"), F.when(F.col("id") % 11 != 0, F.rand(3)).alias("x"))
    w = ind.by_date()
    for n in (20, 33, 250):
        frame = w.rowsBetween(-(n - 1), 0)
        got = ind.with_range(rows, "x", n, "hi", "lo", w).withColumns({"h": F.max("x").over(frame), "l": F.min("x").over(frame)})
        assert got.where("NOT (hi <=> h AND lo <=> l)").count() == 0


def test_bars_are_walked_in_few_passes(spark):
    """The passes of every bar hold each aggregate once, and what they give equals the operators one by one."""
    rng, rows = random.Random(9), []
    for symbol, n in (("A", 280), ("B", 70), ("C", 25), ("D", 1), (None, 30)):
        for i in range(n):
            some = lambda x: rng.choice([x, x, x, None, 0.0])
            close = 7.1 if symbol == "B" else some(rng.uniform(50, 90))
            rows.append((symbol, DAY + dt.timedelta(days=i), some(95.0), some(45.0), close, some(float(rng.randrange(3))), some(rng.uniform(1, 9)), some(rng.uniform(1, 99))))
    bars = spark.createDataFrame(rows, "symbol string, trade_date date, high double, low double, close double, volume double, turnover double, delivery_pct double")
    w = ind.by_date()
    one = technical._prices(ind.with_upper_median(bars, "turnover", 20, "median_turnover"))
    one = ind.with_adx(ind.with_atr(ind.with_rsi(ind.with_delivery_points(one, "delivery_pct", 20, "delivery_pts"))))
    one = one.withColumns({f"sma{n}": ind.sma(F.col("close"), n, w) for n in (20, 50, 200)})
    one = one.withColumns({"vol_z": ind.zscore(F.col("volume"), 20, w), "ret63": F.col("close") / F.lag("close", 63).over(w) - 1})
    one = ind.with_range(one, "close", 250, "hi52", "lo52", w)
    every = technical.bar_indicators(bars)
    assert sorted(every.columns) == sorted(one.columns) and every.count() == one.count()
    assert one.exceptAll(every.select(one.columns)).count() == 0
    third = technical.bar_indicators(bars, F.col("_next") % 3 == 0, {"_next": F.lead("bar_no").over(w)}).drop("_next")
    want = one.withColumn("_next", F.lead("bar_no").over(w)).where("_next % 3 = 0").drop("_next")
    assert want.exceptAll(third.select(one.columns)).count() == 0 and want.count() == third.count()
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 7 and plan.count("min(volume") == 1
