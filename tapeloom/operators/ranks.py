"""Average ranks and rank correlation without a single-task global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def value_ranks(df: DataFrame, value: str, out: str, buckets: int = 256) -> DataFrame:
    """(value, rank) of every distinct value: 1-based, ties sharing their mean rank.

    Values are counted first. Counts are then ordered in two levels: a bounded list of
    quantile cuts splits the distinct values into ranges, each range is cumulated on its own,
    and range totals (at most ``buckets + 1`` rows) give the offsets.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(counts.approxQuantile(value, probs, 1.0 / (4 * buckets)) or []))
    below = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(value))) if cuts else F.lit(0)
    counts = counts.withColumn("_b", below)
    totals = counts.groupBy("_b").agg(F.sum("_n").alias("_t"))
    order = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(order), F.lit(0))).drop("_t")
    inside = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_b")
        .select(value, (F.col("_off") + F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    )


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Rows of ``df`` with the average rank of ``value``; null values are left out."""
    return df.join(value_ranks(df, value, out), value)


def spearman(df: DataFrame, x: str, y: str, out: str = "rho") -> DataFrame:
    """One row: rank correlation with average ranks, 0 where a side is constant."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    cells = pairs.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_w"))
    # ranks come from the full pairs; the correlation runs on weighted cells
    rx = value_ranks(pairs.select("_x"), "_x", "_rx")
    ry = value_ranks(pairs.select("_y"), "_y", "_ry")
    ranked = cells.join(rx, "_x").join(ry, "_y")
    s = lambda e: F.sum(F.col("_w") * e)
    stats = ranked.agg(
        F.sum("_w").alias("n"), s(F.col("_rx")).alias("sx"), s(F.col("_ry")).alias("sy"),
        s(F.col("_rx") * F.col("_rx")).alias("sxx"), s(F.col("_ry") * F.col("_ry")).alias("syy"),
        s(F.col("_rx") * F.col("_ry")).alias("sxy"),
    )
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    den = F.sqrt(vx * vy)
    return stats.select(
        F.when((F.col("n") > 2) & (den != 0), cov / F.nullif(den, F.lit(0.0))).otherwise(0.0).alias(out)
    )
