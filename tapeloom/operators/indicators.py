"""Series indicators at every bar, as windows over (symbol, trade_date).

All columns share one partitioning and one order, so a chain of them costs one shuffle and
one sort. Wilder averages are a first-order recursion ``a = q*a + x/n`` with ``q = (n-1)/n``. Spark's
exponentially weighted window function is that recursion with another seed; the seed's difference fades
by ``q`` a bar, so both are evaluated incrementally, in the plan, for series of any length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.internal import InternalFunction


def by_date(symbol: str = "symbol", time: str = "trade_date"):
    return Window.partitionBy(symbol).orderBy(time)


@dataclass(frozen=True)
class AtLast:
    """Stands for :func:`by_date` where only the last row of each symbol is wanted.

    ``left`` is the number of rows after a row. A frame before the last row is then one aggregate of
    the symbol, in the same order, and not one for each row.
    """

    left: Column
    symbol: str = "symbol"

    def held(self, start: int, end: int) -> Column:
        return (self.left <= -start) & (self.left >= -end)


def over(aggregate: Callable[[Column], Column], x: Column, w, start: int, end: int) -> Column:
    """``aggregate`` of the rows from ``start`` to ``end`` around a row, or around the last one."""
    if isinstance(w, AtLast):
        return aggregate(F.when(w.held(start, end), x)).over(Window.partitionBy(w.symbol))
    return aggregate(x).over(w.rowsBetween(start, end))


def rows_until(w) -> Column:
    """The number of rows of a symbol up to a row, or of all of them."""
    return F.count(F.lit(1)).over(Window.partitionBy(w.symbol)) if isinstance(w, AtLast) else F.row_number().over(w)


def sma(x: Column, n: int, w) -> Column:
    return F.when(rows_until(w) >= n, over(F.avg, x, w, -(n - 1), 0))


def _distance(x: Column, mean: Column, lo: Column, hi: Column, sd: Column) -> Column:
    flat = F.when(x == lo, 0.0).when(x > lo, 5.0).otherwise(-5.0)
    return F.when(lo == hi, flat).otherwise((x - mean) / sd)


def zscore(x: Column, n: int, w) -> Column:
    """Distance from the previous ``n`` values in population sds; a flat window gives 0 or ±5."""
    return F.when(rows_until(w) > n, _distance(x, *(over(f, x, w, -n, -1) for f in (F.avg, F.min, F.max, F.stddev_pop))))


def frame_sums(averages: dict[str, tuple[str, int]], scores: dict[str, tuple[str, int]], w) -> dict[str, Column]:
    """What :func:`with_averages` needs of the frames, each aggregate once."""
    parts = {"_mean": F.avg, "_lo": F.min, "_hi": F.max, "_sd": F.stddev_pop}
    return {
        **{f"_sum_{k}": over(F.sum, F.col(x), w, -(n - 1), 0) for k, (x, n) in averages.items()},
        **{f"{p}_{k}": over(f, F.col(x), w, -n, -1) for k, (x, n) in scores.items() for p, f in parts.items()},
    }


def with_averages(df: DataFrame, averages: dict[str, tuple[str, int]], scores: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds :func:`sma` and :func:`zscore` columns of series without nulls from :func:`frame_sums`; needs ``bar_no``."""
    at = F.col("bar_no")
    z = lambda k, x: _distance(F.col(x), *[F.col(f"{p}_{k}") for p in ("_mean", "_lo", "_hi", "_sd")])
    df = df.withColumns({
        **{k: F.when(at >= n, F.col(f"_sum_{k}") / F.lit(float(n))) for k, (_, n) in averages.items()},
        **{k: F.when(at > n, z(k, x)) for k, (x, n) in scores.items()},
    })
    return df.drop(*[f"_sum_{k}" for k in averages], *[f"{p}_{k}" for k in scores for p in ("_mean", "_lo", "_hi", "_sd")])


def with_range(df: DataFrame, x: str, n: int, high: str, low: str, w, part: int = 16) -> DataFrame:
    """Adds the largest and the least of the last ``n`` values.

    At every row these are the extremes of frames of ``part`` rows that together cover the ``n`` rows,
    so that a row costs ``part + n / part`` steps.
    """
    if isinstance(w, AtLast):
        return df.withColumns({high: over(F.max, F.col(x), w, -(n - 1), 0), low: over(F.min, F.col(x), w, -(n - 1), 0)})
    df = df.withColumns({"_high": over(F.max, F.col(x), w, -(part - 1), 0), "_low": over(F.min, F.col(x), w, -(part - 1), 0)})
    back = sorted({*range(0, n - part, part), n - part})
    df = df.withColumns({high: F.greatest(*[F.lag("_high", k).over(w) for k in back]), low: F.least(*[F.lag("_low", k).over(w) for k in back])})
    return df.drop("_high", "_low")


def wilder_factors(rows: Column, i: Column, n: int) -> tuple[Column, Column]:
    """What :func:`wilder` multiplies by: the weights of all rows so far, and ``q**(i - n)``."""
    q = (n - 1) / n
    return (1.0 - F.pow(F.lit(q), rows)) / (1.0 - q), F.pow(F.lit(q), i - n)


def wilder(
    x: Column, i: Column, n: int, w, average: bool = True, factors: tuple[Column, Column] | None = None
) -> Column:
    """Wilder smoothing of ``x`` numbered ``i`` = 1, 2, …; null before ``i = n``.

    ``average=True`` smooths means (seed: mean of the first n); otherwise sums
    (seed: sum of the first n, then ``s - s/n + x``). Null values count as nothing.
    ``factors`` are those of :func:`wilder_factors`, if columns hold them.
    """
    q = (n - 1) / n
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(i >= 1, F.coalesce(F.nanvl(x, F.lit(None)), F.lit(0.0))).otherwise(0.0).cast("double")
    # Spark's weighted mean of all rows so far, times its weights: the sum of x * q**age
    weights, fade = factors or wilder_factors(F.row_number().over(w), i, n)
    decayed = InternalFunction.ewm(value, 1.0 - q, False).over(frame) * weights
    # the first n values count in full at i = n
    missing = F.sum(F.when(i <= n, value * (1.0 - F.pow(F.lit(q), n - i)))).over(frame)
    total = decayed + missing * fade
    return F.when(i >= n, total / (n if average else 1))


def smoothed(df: DataFrame, averages: dict[str, tuple[Column, Column]], n: int, symbol: str, average: bool = True) -> DataFrame:
    """Adds Wilder averages, each of (values, their number)."""
    w = by_date(symbol)
    return df.withColumns({name: wilder(x, i, n, w, average) for name, (x, i) in averages.items()})


def with_rsi(df: DataFrame, n: int = 14, symbol: str = "symbol") -> DataFrame:
    """Adds ``rsi``; needs ``bar_no``, ``close``."""
    w = by_date(symbol)
    df = df.withColumn("_move", F.col("close") - F.lag("close").over(w))
    i = F.col("bar_no") - 1
    df = smoothed(df, {k: (x, i) for k, x in _rsi_series().items()}, n, symbol)
    return df.withColumn("rsi", _rsi()).drop("_move", "_gain", "_loss")


def _rsi_series() -> dict[str, Column]:
    return {"_gain": F.greatest(F.col("_move"), F.lit(0.0)), "_loss": F.greatest(-F.col("_move"), F.lit(0.0))}


def _rsi() -> Column:
    rsi = F.when(F.col("_loss") == 0, 100.0).otherwise(
        100.0 - 100.0 / (1.0 + F.col("_gain") / F.nullif(F.col("_loss"), F.lit(0.0)))
    )
    return F.when(F.col("_loss").isNotNull(), rsi)


def _true_range(pc: Column) -> Column:
    hi, lo = F.col("high"), F.col("low")
    return F.when(pc.isNotNull(), F.greatest(hi - lo, F.abs(hi - pc), F.abs(lo - pc)))


def with_true_range(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    return df.withColumn("_tr", _true_range(F.lag("close").over(by_date(symbol))))


def with_atr(df: DataFrame, n: int = 14, symbol: str = "symbol") -> DataFrame:
    df = with_true_range(df, symbol)
    return smoothed(df, {"atr": (F.col("_tr"), F.col("bar_no") - 1)}, n, symbol).drop("_tr")


def _adx_series() -> dict[str, Column]:
    plus = F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0)
    minus = F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0)
    return {"_trs": F.col("_tr"), "_ps": plus, "_ms": minus}


def _with_dx(df: DataFrame, n: int) -> DataFrame:
    i = F.col("bar_no") - 1
    di = lambda s: F.when(F.col("_trs") != 0, 100.0 * F.col(s) / F.nullif(F.col("_trs"), F.lit(0.0))).otherwise(0.0)
    df = df.withColumns({"_pdi": F.when(i > n, di("_ps")), "_mdi": F.when(i > n, di("_ms"))})
    both = F.col("_pdi") + F.col("_mdi")
    dx = F.when(both == 0, 0.0).otherwise(100.0 * F.abs(F.col("_pdi") - F.col("_mdi")) / F.nullif(both, F.lit(0.0)))
    return df.withColumn("_dx", dx)


def _with_di(df: DataFrame) -> DataFrame:
    ready = F.col("adx").isNotNull()
    return df.withColumns(
        {"plus_di": F.when(ready, F.col("_pdi")), "minus_di": F.when(ready, F.col("_mdi"))}
    ).drop("_tr", "_up", "_down", "_trs", "_ps", "_ms", "_pdi", "_mdi", "_dx")


def with_adx(df: DataFrame, n: int = 14, symbol: str = "symbol") -> DataFrame:
    """Adds ``adx``, ``plus_di``, ``minus_di``; null below 2n+1 bars."""
    w = by_date(symbol)
    up = F.col("high") - F.lag("high").over(w)
    down = F.lag("low").over(w) - F.col("low")
    df = with_true_range(df, symbol).withColumns({"_up": up, "_down": down})
    i = F.col("bar_no") - 1
    df = _with_dx(smoothed(df, {k: (x, i) for k, x in _adx_series().items()}, n, symbol, average=False), n)
    return _with_di(smoothed(df, {"adx": (F.col("_dx"), F.col("bar_no") - 1 - n)}, n, symbol))


def before(w) -> dict[str, Column]:
    """The prices of the bar before, for :func:`with_oscillators`."""
    return {f"_last_{c}": F.lag(c).over(w) for c in ("close", "high", "low")}


def with_oscillators(df: DataFrame, n: int = 14, symbol: str = "symbol") -> DataFrame:
    """:func:`with_rsi`, :func:`with_atr` and :func:`with_adx` together, from :func:`before` on.

    All averages of prices are one pass over the bars and the average of those another; ``bar_no`` counts every row.
    """
    w, at = by_date(symbol), F.col("bar_no")
    weights, fade = wilder_factors(at, at - 1, n)
    df = df.withColumns({
        "_weights": weights, "_fade": fade, "_move": F.col("close") - F.col("_last_close"), "_tr": _true_range(F.col("_last_close")),
        "_up": F.col("high") - F.col("_last_high"), "_down": F.col("_last_low") - F.col("low"),
    }).drop(*before(w))
    smooth = lambda x, average=True: wilder(x, at - 1, n, w, average, (F.col("_weights"), F.col("_fade")))
    means = {**_rsi_series(), "atr": F.col("_tr")}
    df = df.withColumns({**{k: smooth(x) for k, x in means.items()}, **{k: smooth(x, False) for k, x in _adx_series().items()}})
    df = _with_dx(df.withColumn("rsi", _rsi()).drop("_move", "_gain", "_loss"), n)
    late = F.col("_weights"), wilder_factors(at, at - 1 - n, n)[1]
    return _with_di(df.withColumn("adx", wilder(F.col("_dx"), at - 1 - n, n, w, factors=late)).drop("_weights", "_fade"))


def upper_median(frame: Column) -> Column:
    """Element ``size // 2`` of the sorted values."""
    return F.element_at(F.sort_array(frame), (F.floor(F.size(frame) / 2) + 1).cast("int"))


def with_upper_median(df: DataFrame, x: str, n: int, out: str, symbol: str = "symbol") -> DataFrame:
    """Adds element ``size // 2`` of the sorted last ``n`` values (null read as 0).

    The frame is collected once into a column; at most ``n`` values per row.
    """
    frame = by_date(symbol).rowsBetween(-(n - 1), 0)
    df = df.withColumn("_frame", F.collect_list(F.coalesce(F.col(x), F.lit(0.0))).over(frame))
    return df.withColumn(out, upper_median(F.col("_frame"))).drop("_frame")


def with_delivery_points(df: DataFrame, x: str, n: int, out: str, symbol: str = "symbol") -> DataFrame:
    """Adds 5 where the later half of the last ``n`` non-zero deliveries averages above the earlier."""
    frame = by_date(symbol).rowsBetween(-(n - 1), 0)
    df = df.withColumn("_frame", F.collect_list(F.coalesce(F.col(x), F.lit(0.0))).over(frame))
    return with_frame_points(df, "_frame", out)


def with_frame_points(df: DataFrame, frame: str, out: str) -> DataFrame:
    """The points of :func:`with_delivery_points` from a column with the last values, which goes."""
    df = df.withColumn("_kept", F.filter(frame, lambda v: v != 0)).drop(frame)
    size = F.size("_kept")
    half = F.floor(size / 2).cast("int")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    rising = mean(F.slice("_kept", half + 1, F.greatest(size, F.lit(1)))) > mean(F.slice("_kept", F.lit(1), half))
    return df.withColumn(out, F.when((size >= 10) & rising, 5.0).otherwise(0.0)).drop("_kept")
