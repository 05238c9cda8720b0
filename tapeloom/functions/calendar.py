"""Trading calendar as data: a small table of days, joined like any other dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tapeloom.constants import MARKET_ZONE, MUHURAT_DATES, SEED_HOLIDAYS, SESSION_MINUTES


def seed_holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_HOLIDAYS, "day string, name string").withColumn(
        "day", F.col("day").cast("date")
    )


def overlay_holidays(seed: DataFrame, learned: DataFrame) -> DataFrame:
    """Seed and learned holidays together; a learned name replaces the seed's.

    The result fails when it is computed if ``learned`` is empty: an empty table is a broken
    download, not a year without holidays.
    """
    both = seed.select("day", "name", F.lit(1).alias("tier")).unionByName(
        learned.select("day", "name", F.lit(0).alias("tier"))
    )
    book = both.groupBy("day").agg(F.min_by("name", "tier").alias("name"), F.min("tier").alias("_tier"))
    # as many rows as the calendar has holidays
    known = F.count_if(F.col("_tier") == 0).over(Window.partitionBy(F.lit(0)))
    checked = book.withColumn("_ok", F.when(known > 0, True).otherwise(F.raise_error(F.lit("refusing to overlay an empty holiday table")).cast("boolean")))
    return checked.where("_ok").select("day", "name")


def trading_days(spark: SparkSession, start: str, end: str, holidays: DataFrame) -> DataFrame:
    """Every calendar day in [start, end] with its trading flag and neighbours.

    The table has one row per calendar day, so its windows are bounded by the calendar.
    """
    days = spark.sql(
        "SELECT explode(sequence(DATE'%s', DATE'%s', INTERVAL 1 DAY)) AS day" % (start, end)
    )
    flagged = (
        days.join(F.broadcast(holidays.select("day", "name")), "day", "left")
        .withColumn("is_trading", (F.weekday("day") < 5) & F.col("name").isNull())
    )
    trading = F.when(F.col("is_trading"), F.col("day"))
    nearest = lambda order: F.last(trading, ignorenulls=True).over(
        Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return flagged.select(
        "day",
        F.col("name").alias("holiday"),
        "is_trading",
        nearest(F.col("day").desc()).alias("next_trading_day"),
        nearest(F.col("day")).alias("prev_trading_day"),
    )


def market_clock(ts: Column) -> tuple[Column, Column]:
    """Market date and minute of day of an instant (session time zone UTC)."""
    local = F.from_utc_timestamp(ts, MARKET_ZONE)
    return local.cast("date"), F.hour(local) * 60 + F.minute(local)


def session_state(df: DataFrame, ts: str, holidays: DataFrame) -> DataFrame:
    """Adds ``session_state``: closed, pre_open, open or post_close at the instant."""
    day, minute = market_clock(F.col(ts))
    flagged = df.withColumn("_day", day).join(
        F.broadcast(holidays.select(F.col("day").alias("_day"), F.lit(True).alias("_holiday"))),
        "_day",
        "left",
    )
    shut = (F.weekday("_day") >= 5) | F.col("_holiday").isNotNull()
    state = F.when(shut, "closed")
    for name, (start, end) in SESSION_MINUTES.items():
        state = state.when((minute >= start) & (minute < end), name)
    return flagged.withColumn("session_state", state.otherwise("closed")).drop("_day", "_holiday")


def muhurat_date(year: Column) -> Column:
    out = F.lit(None).cast("date")
    for y, d in MUHURAT_DATES.items():
        out = F.when(year == y, F.lit(d).cast("date")).otherwise(out)
    return out


def adjacent_trading_days(days: DataFrame, day: str, holidays: DataFrame, reach: int = 30) -> DataFrame:
    """(day, next_trading_day, prev_trading_day) for any dates, inside the calendar table or not.

    ``reach`` is longer than any closure of the market. It works on the distinct dates, with
    ``2 * reach`` candidates for each.
    """
    asked = days.select(F.col(day).cast("date").alias("day")).where(F.col("day").isNotNull()).distinct()
    near = asked.select("day", F.explode(F.sequence(F.date_sub("day", reach), F.date_add("day", reach))).alias("near")).where("near <> day")
    open_days = near.where(F.weekday("near") < 5).join(F.broadcast(holidays.select(F.col("day").alias("near"))), "near", "left_anti")
    return asked.join(
        open_days.groupBy("day").agg(
            F.min(F.when(F.col("near") > F.col("day"), F.col("near"))).alias("next_trading_day"), F.max(F.when(F.col("near") < F.col("day"), F.col("near"))).alias("prev_trading_day")),
        "day", "left")
