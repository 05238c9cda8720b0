"""Observed forward returns of issued signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeloom import constants as K
from tapeloom.functions.numeric import py_round
from tapeloom.operators.asof import asof_forward, day_on_or_after, forward_prices


def measure(signals: DataFrame, bars: DataFrame, index_bars: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """One row per signal and elapsed window: entry, exit, return, index return and excess.

    Entry is the first bar on or after the signal. Windows not elapsed yet give no row, and
    (signal_id, window) pairs in ``done`` are left out, so a second run adds nothing.
    """
    names = [f"close_{k}" for k in K.FORWARD_WINDOWS]
    held = bars.where(F.col("close").isNotNull())
    ahead = forward_prices(held, K.FORWARD_WINDOWS).select("symbol", "trade_date", "close", *names)
    market = forward_prices(index_bars.where(F.col("close").isNotNull()), K.FORWARD_WINDOWS).select(
        F.lit(0).alias("_m"), "trade_date", "close", *names
    )
    df = signals.withColumn("_day", day_on_or_after(F.col("as_of")))
    df = asof_forward(df, ahead, "_day", ["close", *names])
    days = df.select("_day").distinct().withColumn("_m", F.lit(0))
    idx = asof_forward(days, market, "_day", ["close", *names], by="_m", unique=True).select(
        "_day", *[F.col(c).alias(f"idx_{c}") for c in ("close", *names)]
    )
    df = df.join(idx, "_day", "left")
    windows = F.array(
        *[
            F.struct(F.lit(k).alias("window"), F.col(f"close_{k}").alias("exit"), F.col(f"idx_close_{k}").alias("idx_exit"))
            for k in K.FORWARD_WINDOWS
        ]
    )
    df = df.withColumn("_w", F.explode(windows)).where(F.col("_w.exit").isNotNull() & (F.col("close") != 0))
    ret = F.col("_w.exit") / F.nullif(F.col("close"), F.lit(0.0)) - 1
    idx_ret = F.col("_w.idx_exit") / F.nullif(F.col("idx_close"), F.lit(0.0)) - 1
    out = df.select(
        "signal_id", "symbol", "stance", "profile", "conviction", "model_version", F.col("_w.window").alias("window"),
        F.col("close").alias("entry_price"), F.col("_w.exit").alias("exit_price"),
        ret.alias("ret"), idx_ret.alias("index_ret"), (ret - idx_ret).alias("excess"),
    )
    return out if done is None else out.join(done.select("signal_id", "window"), ["signal_id", "window"], "left_anti")


def summarize(measured: DataFrame, version: str = K.FUSION_VERSION) -> DataFrame:
    """By stance and window, current version only; nulls do not count towards averages."""
    return (
        measured.where(F.col("model_version") == version)
        .groupBy("stance", "window")
        .agg(
            F.count(F.lit(1)).alias("n"),
            (100.0 * F.avg("excess")).alias("avg_excess_pct"),
            (100.0 * F.avg((F.col("excess") > 0).cast("double"))).alias("hit_rate_pct"),
        )
    )


def rounded(summary: DataFrame) -> DataFrame:
    return summary.withColumns(
        {
            "avg_excess_pct": py_round(F.col("avg_excess_pct"), 2),
            "hit_rate_pct": py_round(F.col("hit_rate_pct"), 1),
        }
    )
