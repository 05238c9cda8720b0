"""Walk-forward backtest as one job over the (symbol, rebalance date) grid.

Indicators run once per bar, fundamental states once per broadcast day, and the grid samples
both as of each rebalance date; no prefix of a series is ever computed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom import constants as K
from tapeloom.operators.asof import forward_returns, number_days, until_next, with_first_day
from tapeloom.operators.indicators import by_date
from tapeloom.plans import fundamental, fusion, technical

_BAR = ["trade_date", "close", "bar_no", "median_turnover", "rsi", "atr", "adx", "plus_di", "minus_di", "sma20",
        "sma50", "sma200", "vol_z", "delivery_pts", "hi52", "lo52", "ret63"]


def rebalances(index_bars: DataFrame, step: int = 5) -> DataFrame:
    """Every ``step``-th index bar with a close from position 80, leaving the longest window measurable.

    Carries the index's own 63-bar return and forward returns of that date. Bars without a close
    count for no position and no return.
    """
    tail = max(K.FORWARD_WINDOWS.values())
    idx = forward_returns(index_bars.where(F.col("close").isNotNull()), K.FORWARD_WINDOWS)
    w = Window.partitionBy("symbol").orderBy("trade_date")
    idx = idx.withColumns(
        {
            "_i": F.row_number().over(w) - 1,
            "_n": F.count(F.lit(1)).over(Window.partitionBy("symbol")),
            "idx_ret63": F.col("close") / F.nullif(F.lag("close", K.RS_BARS).over(w), F.lit(0.0)) - 1,
        }
    )
    keep = (F.col("_n") >= 120) & (F.col("_i") >= 80) & (F.col("_i") < F.col("_n") - tail) & ((F.col("_i") - 80) % step == 0)
    return idx.where(keep).select(
        F.col("trade_date").alias("d"), "idx_ret63", *[F.col(f"ret_{k}").alias(f"idx_{k}") for k in K.FORWARD_WINDOWS]
    )


def _key() -> Column:
    """The symbol as a key that joins like a group: no symbol is one as well."""
    return F.coalesce(F.concat(F.lit("="), F.col("symbol")), F.lit(""))


def _unkeyed() -> Column:
    return F.when(F.col("symbol") != "", F.expr("substring(symbol, 2)"))


def observations(
    bars: DataFrame, index_bars: DataFrame, quarters: DataFrame, events: DataFrame, profile: str = "default", step: int = 5
) -> DataFrame:
    """One row per tradable symbol and rebalance date with stance and forward excess returns."""
    weights = dict(zip(fusion.AXES, K.PROFILES[profile][:4]))
    dates = rebalances(index_bars, step)
    numbered = number_days(dates, "d")
    rets = [f"ret_{k}" for k in K.FORWARD_WINDOWS]
    bars, quarters = bars.withColumn("symbol", _key()), quarters.withColumn("symbol", _key())
    events = events.where(F.col("symbol").isNotNull()).withColumn("symbol", _key())

    symbols = quarters.where(F.col("basis") == "consolidated").select("symbol").distinct()
    bars = bars.join(symbols, "symbol", "left_semi")
    whole = by_date().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = forward_returns(bars.withColumn("_rows", F.count(F.lit(1)).over(whole)), K.FORWARD_WINDOWS)
    tested = with_first_day(counted, numbered, "d").where(F.col("_rows") >= 120)
    # a bar answers the dates from its day to the next bar's; most bars of a step answer none
    asked = (F.col("bar_no") >= K.MIN_BARS) & (F.col("_until") > F.col("_from"))
    per_bar = technical.bar_indicators(tested, asked, {"_until": until_next()})
    per_bar = per_bar.where((F.col("median_turnover") >= K.MIN_MEDIAN_TURNOVER_LAKH) & (F.col("close") >= K.PENNY_CLOSE))

    # one row per index bar step: bounded by the calendar
    at = F.explode(F.sequence(F.col("_from"), F.col("_until") - 1)).alias("_at")
    grid = per_bar.select("symbol", *_BAR, *rets, at).join(F.broadcast(dates.join(numbered, "d")), "_at")
    grid = technical.score_bars(grid).select(
        "symbol", "d", "_at", F.col("score").alias("technical_score"), F.col("confidence").alias("technical_conf"),
        *rets, *[f"idx_{k}" for k in K.FORWARD_WINDOWS],
    )
    states = fundamental.fundamental_states(quarters).select(
        F.col("symbol").alias("_symbol"), "visible_on",
        F.col("score").alias("fundamental_score"), F.col("confidence").alias("fundamental_conf"),
    )
    book = with_first_day(states, numbered, "d", "visible_on").withColumn("_until", until_next("_symbol", "visible_on"))
    book = book.where(F.col("_until") > F.col("_from")).drop("visible_on", "_count")
    held = (F.col("symbol") == F.col("_symbol")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_until"))
    grid = grid.join(book, held, "left").drop("_symbol", "_from", "_until", "_at")

    # each date looks back 30 days; the day table is bounded by the calendar and joins by equality
    now = F.col("d").cast("timestamp")
    days = F.explode(F.sequence(F.date_sub("d", K.EVENT_WINDOW_DAYS), F.col("d")))
    lookback = dates.select("d", days.alias("_event_day"))
    visible = (
        events.withColumn("_event_day", F.col("event_at").cast("date"))
        .join(F.broadcast(lookback), "_event_day")
        .where((F.col("event_at") <= now) & (F.col("event_at") >= now - F.expr(f"INTERVAL {K.EVENT_WINDOW_DAYS} DAYS")))
    )
    ev = fusion.event_scores(visible, now, keys=("symbol", "d"), visibility="event").drop("evidence")
    grid = grid.join(ev, ["symbol", "d"], "left").withColumns(
        {
            "event_score": F.when(F.col("event_conf") > 0, F.col("event_score")),
            "flow_score": F.lit(None).cast("double"),
            "flow_conf": F.lit(None).cast("double"),
            **{f"w_{a}": F.lit(float(w)) for a, w in weights.items()},
        }
    )
    out = fusion.weighted_fusion(grid).withColumn("stance", fusion.stance_of(F.col("conviction"), F.lit("clear")))
    both = lambda k: F.col(f"ret_{k}").isNotNull() & F.col(f"idx_{k}").isNotNull()
    return out.select(
        _unkeyed().alias("symbol"), "d", "stance", "conviction", "confidence",
        *[F.when(both(k), F.col(f"ret_{k}")).alias(f"ret_{k}") for k in K.FORWARD_WINDOWS],
        *[F.when(both(k), F.col(f"ret_{k}") - F.col(f"idx_{k}")).alias(f"excess_{k}") for k in K.FORWARD_WINDOWS],
    )


def summarize(obs: DataFrame) -> DataFrame:
    """By stance and window: observations, mean excess, hit rate and mean return in percent."""
    w = F.explode(
        F.array(
            *[F.struct(F.lit(k).alias("window"), F.col(f"ret_{k}").alias("ret"), F.col(f"excess_{k}").alias("excess")) for k in K.FORWARD_WINDOWS]
        )
    )
    return (
        obs.select("stance", w.alias("w")).groupBy("stance", F.col("w.window").alias("window")).agg(
            F.count(F.lit(1)).alias("observations"),
            (100.0 * F.avg("w.excess")).alias("avg_excess"),
            (100.0 * F.avg((F.col("w.excess") > 0).cast("double"))).alias("hit_rate"),
            (100.0 * F.avg("w.ret")).alias("avg_ret"),
        )
    )


def buy_and_hold(index_bars: DataFrame) -> DataFrame:
    """Index return in percent from position 80 to its last bar."""
    w = by_date()
    i = index_bars.withColumn("_i", F.row_number().over(w) - 1)
    start = F.max(F.when(F.col("_i") == 80, F.col("close")))
    end = F.max_by("close", "trade_date")
    return i.agg((100.0 * (end / F.nullif(start, F.lit(0.0)) - 1)).alias("buy_hold_pct"))
