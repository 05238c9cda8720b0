"""Technical score: one pass of windows per symbol, shared by live scoring and backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom import constants as K
from tapeloom.functions.numeric import clamp, truthy, with_rounded
from tapeloom.operators import indicators as ind
from tapeloom.operators.asof import number_bars


def _prices(df: DataFrame) -> DataFrame:
    """The bars with a close, numbered, without gaps in high, low and volume."""
    df = df.where(truthy(F.col("close")).isNotNull()).withColumns(
        {
            "high": F.coalesce(truthy(F.col("high")), F.col("close")),
            "low": F.coalesce(truthy(F.col("low")), F.col("close")),
            "volume": F.coalesce("volume", F.lit(0.0)),
        }
    )
    return number_bars(df)


_SMA = {"sma20": ("close", 20), "sma50": ("close", 50), "sma200": ("close", 200)}
_Z = {"vol_z": ("volume", 20)}


def _frames(w) -> dict[str, Column]:
    c = F.col("close")
    return {**ind.frame_sums(_SMA, _Z, w), "ret63": c / F.lag(c, K.RS_BARS).over(ind.by_date()) - 1}


def bar_indicators(bars: DataFrame, wanted: Column | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """Every indicator at every bar that has a close, or at the ``wanted`` ones of these.

    The turnover median looks at all rows; the other series skip rows without a close. ``wanted`` may
    read ``more``, columns over the bars with a close. What a bar needs of its neighbours' prices
    is one pass of frames; arrays are sorted and folded only where they are wanted.
    """
    w = ind.by_date()
    values = lambda x: ind.over(F.collect_list, F.coalesce(F.col(x), F.lit(0.0)), w, -19, 0)
    df = _prices(bars.withColumn("_turnovers", values("turnover")))
    df = df.withColumns({**ind.before(w), **_frames(w), "_deliveries": values("delivery_pct"), **(more or {})})
    if wanted is not None:
        df = df.withColumn("_wanted", wanted)
        df = df.withColumns({a: F.when(F.col("_wanted"), F.col(a)) for a in ("_turnovers", "_deliveries")})
    df = df.withColumn("median_turnover", ind.upper_median(F.col("_turnovers"))).drop("_turnovers")
    df = ind.with_frame_points(df, "_deliveries", "delivery_pts")
    df = ind.with_oscillators(ind.with_averages(df, _SMA, _Z))
    df = ind.with_range(df, "close", K.RANGE_BARS, "hi52", "lo52", w)
    return df if wanted is None else df.where("_wanted").drop("_wanted")


def last_indicators(bars: DataFrame) -> DataFrame:
    """The indicators of :func:`bar_indicators` at the last bar of each symbol that has a close.

    Wilder averages run over all bars. What looks back a fixed number of bars is evaluated once a symbol.
    """
    whole = Window.partitionBy("symbol")
    closed = F.when(truthy(F.col("close")).isNotNull(), F.col("_row"))
    df = bars.withColumn("_row", F.row_number().over(ind.by_date()))
    # the turnover median looks at all rows up to the last close
    df = df.withColumn("_left", F.max(closed).over(whole) - F.col("_row"))
    values = lambda x, w: ind.over(F.collect_list, F.coalesce(F.col(x), F.lit(0.0)), w, -19, 0)
    df = df.withColumn("_turnovers", values("turnover", ind.AtLast(F.col("_left"))))
    df = ind.with_adx(ind.with_atr(ind.with_rsi(_prices(df))))
    df = df.withColumn("_left", F.count(F.lit(1)).over(whole) - F.col("bar_no"))
    w = ind.AtLast(F.col("_left"))
    df = ind.with_averages(df.withColumns({**_frames(w), "_deliveries": values("delivery_pct", w)}), _SMA, _Z)
    last = ind.with_range(df, "close", K.RANGE_BARS, "hi52", "lo52", w).where(F.col("_left") == 0)
    last = last.withColumn("median_turnover", ind.upper_median(F.col("_turnovers")))
    return ind.with_frame_points(last, "_deliveries", "delivery_pts").drop("_row", "_left", "_turnovers")


def index_returns(index_bars: DataFrame) -> DataFrame:
    """(trade_date, idx_close, idx_ret63) of one index; its bars are bounded by the calendar."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    return index_bars.where(truthy(F.col("close")).isNotNull()).select(
        "trade_date", F.col("close").alias("idx_close"),
        (F.col("close") / F.lag("close", K.RS_BARS).over(w) - 1).alias("idx_ret63"),
    )


def trend_label(score: Column) -> Column:
    return (
        F.when(score >= 75, "strong_uptrend").when(score >= 60, "uptrend")
        .when(score >= 40, "range").when(score >= 25, "downtrend").otherwise("strong_downtrend")
    )


def score_bars(df: DataFrame) -> DataFrame:
    """Score columns from the indicators of a bar and ``idx_ret63`` of its market."""
    c = F.col("close")
    yes = lambda cond: F.when(cond, 6.0).otherwise(0.0)
    s20, s50, s200 = (F.col(n) for n in ("sma20", "sma50", "sma200"))
    trend = yes(c > s20) + yes(c > s50) + yes(c > s200) + yes(s20 > s50) + yes(s50 > s200)
    mom = F.when(
        F.col("rsi").isNotNull(),
        10.0 * F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("rsi") - 60.0) / 40.0),
    ).otherwise(0.0) + F.when(
        F.col("adx") > 20, F.when(F.col("plus_di") > F.col("minus_di"), 10.0).otherwise(2.0)
    ).otherwise(0.0)
    excess = F.col("ret63") - F.col("idx_ret63")
    rs = F.coalesce(clamp(0.0, 20.0, 10.0 + 100.0 * excess), F.lit(10.0))
    vd = F.least(
        F.lit(15.0),
        F.coalesce(clamp(0.0, 10.0, 5.0 + 2.5 * F.col("vol_z")), F.lit(7.5)) + F.col("delivery_pts"),
    )
    width = F.col("hi52") - F.col("lo52")
    pos = F.when(width != 0, (c - F.col("lo52")) / F.nullif(width, F.lit(0.0))).otherwise(0.5)
    df = df.withColumns(
        {
            "trend": trend, "momentum": mom, "rs_excess": excess, "rel_strength": rs,
            "vol_delivery": vd, "range_pos": 15.0 * pos,
            "pct_off_52w_high": 100.0 * (c / F.col("hi52") - 1.0),
            "atr_stop": c - 2.0 * truthy(F.col("atr")),
        }
    )
    total = F.col("trend") + F.col("momentum") + F.col("rel_strength") + F.col("vol_delivery") + F.col("range_pos")
    df = with_rounded(df, {"score": (total, 1)})
    return df.withColumns(
        {
            "label": trend_label(F.col("score")),
            "confidence": F.least(F.lit(1.0), F.col("bar_no") / float(K.FULL_CONFIDENCE_BARS)),
        }
    )


def technical_scores(
    bars: DataFrame, index_bars: DataFrame, *, latest_only: bool = True,
    min_turnover: float = K.MIN_MEDIAN_TURNOVER_LAKH,
) -> DataFrame:
    """One score per symbol on its last bar.

    ``latest_only`` keeps symbols that traded on the newest bar date of the whole market.
    """
    last = last_indicators(bars)
    idx = index_returns(index_bars).agg(F.max_by("idx_ret63", "trade_date").alias("idx_ret63"))
    last = last.where((F.col("bar_no") >= K.MIN_BARS) & (F.col("median_turnover") >= min_turnover))
    if latest_only:
        market = bars.agg(F.max("trade_date").alias("_market_date"))
        last = last.crossJoin(F.broadcast(market)).where(F.col("trade_date") == F.col("_market_date")).drop("_market_date")
    # one-row sides: an aggregate without grouping
    return score_bars(last.crossJoin(F.broadcast(idx))).withColumn("as_of", F.col("trade_date"))
