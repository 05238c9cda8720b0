"""As-of and positional lookups on daily bars.

Bars are one row per (symbol, trade_date), so a symbol's history is bounded by the calendar.
Lookups run on the distinct (symbol, day) pairs asked for, which are bounded the same way;
rows that share a day reuse the answer through an equi-join on (symbol, day). A hot symbol is
therefore spread over its days and never sits in one task.

Where the same days are asked of every symbol, a bar answers a range of these days: from the first
on or after its own to the one before its successor's. Ranges need neither a union nor another sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def number_bars(bars: DataFrame, by: str = "symbol", time: str = "trade_date") -> DataFrame:
    """Adds ``bar_no`` (1-based position) per symbol."""
    w = Window.partitionBy(by).orderBy(time)
    return bars.withColumn("bar_no", F.row_number().over(w))


def forward_prices(bars: DataFrame, windows: dict[str, int], by: str = "symbol") -> DataFrame:
    """Adds ``close_<name>``: the close ``n`` bars ahead, null off the end."""
    w = Window.partitionBy(by).orderBy("trade_date")
    return bars.withColumns({f"close_{k}": F.lead("close", n).over(w) for k, n in windows.items()})


def forward_returns(bars: DataFrame, windows: dict[str, int], by: str = "symbol") -> DataFrame:
    """``ret_<name>`` = close n bars ahead over close, minus one; null where either is 0."""
    ahead = forward_prices(bars, windows, by)
    base = F.nullif(F.col("close"), F.lit(0.0))
    return ahead.withColumns(
        {f"ret_{k}": F.nullif(F.col(f"close_{k}"), F.lit(0.0)) / base - 1 for k in windows}
    )


def _lookup(left: DataFrame, bars: DataFrame, by: str, day: str, cols: list[str], forward: bool) -> DataFrame:
    """Rows of ``left`` with the bar columns, through one union and one window."""
    carried = [c for c in left.columns if c not in (by, day)]
    bar = F.struct(*[F.col(c) for c in cols]).alias("_bar")
    rest = F.struct(*[F.col(c) for c in carried]) if carried else F.struct(F.lit(1).alias("_one"))
    none = lambda name: F.lit(None).alias(name)
    both = bars.select(by, F.col("trade_date").alias(day), F.lit(0).alias("_kind"), bar, none("_rest")).unionByName(
        left.select(by, day, F.lit(1).alias("_kind"), none("_bar"), rest.alias("_rest"))
    )
    # both directions read from the far end towards the question: a growing frame is O(n)
    day_order = F.col(day).desc() if forward else F.col(day).asc()
    w = Window.partitionBy(by).orderBy(day_order, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = both.withColumn("_hit", F.last("_bar", ignorenulls=True).over(w)).where(F.col("_kind") == 1)
    return hit.select(
        by, day, *[F.col(f"_rest.{c}").alias(c) for c in carried], *[F.col(f"_hit.{c}").alias(c) for c in cols]
    )


def _asof(left: DataFrame, bars: DataFrame, day: str, cols: list[str], by: str, forward: bool, unique: bool) -> DataFrame:
    if unique:
        return _lookup(left, bars, by, day, cols, forward)
    pairs = left.select(by, day).distinct()
    return left.join(_lookup(pairs, bars, by, day, cols, forward), [by, day], "left")


def asof_backward(
    left: DataFrame, bars: DataFrame, day: str, cols: list[str], by: str = "symbol", *, unique: bool = False
) -> DataFrame:
    """Last bar on or before ``left[day]``; unmatched rows keep nulls.

    ``unique`` states that ``left`` has one row per (by, day), a grid; its rows then pass
    through the lookup themselves and the join back is saved.
    """
    return _asof(left, bars, day, cols, by, False, unique)


def asof_forward(
    left: DataFrame, bars: DataFrame, day: str, cols: list[str], by: str = "symbol", *, unique: bool = False
) -> DataFrame:
    """First bar on or after ``left[day]``; unmatched rows keep nulls."""
    return _asof(left, bars, day, cols, by, True, unique)


def number_days(days: DataFrame, day: str) -> DataFrame:
    """(``day``, _at): the distinct days in order, numbered from 0; bounded by the calendar."""
    one = days.select(day).where(F.col(day).isNotNull()).distinct()
    return one.withColumn("_at", F.row_number().over(Window.orderBy(day)) - 1)


def with_first_day(rows: DataFrame, numbered: DataFrame, day: str, time: str = "trade_date") -> DataFrame:
    """Adds ``_from``: the number of the first of the days on or after a row's, or how many they are.

    A row without a day comes before all days.
    """
    back = F.coalesce(F.date_add(F.lag(day).over(Window.orderBy(day)), 1), F.col(day))
    calendar = numbered.withColumn("_back", back).select("_at", F.explode(F.sequence("_back", day)).alias("_day"))
    ends = numbered.agg(F.min(day).alias("_first"), F.count(F.lit(1)).cast("int").alias("_count"))
    df = rows.join(F.broadcast(calendar), F.col(time) == F.col("_day"), "left").crossJoin(F.broadcast(ends))
    early = F.col(time).isNull() | (F.col(time) <= F.col("_first"))
    at = F.when(early & (F.col("_count") > 0), 0).otherwise(F.coalesce("_at", "_count"))
    return df.withColumn("_from", at).drop("_at", "_day", "_first")


def until_next(by: str = "symbol", time: str = "trade_date") -> "F.Column":
    """The number of the first day that a later row than this answers; with ``_from``, the days it answers."""
    w = Window.partitionBy(by).orderBy(time)
    return F.coalesce(F.lead("_from").over(w), F.col("_count"))


def day_on_or_after(ts) -> "F.Column":
    """First day whose midnight bar is at or after the instant."""
    d = ts.cast("date")
    return F.when(ts > d.cast("timestamp"), F.date_add(d, 1)).otherwise(d)
