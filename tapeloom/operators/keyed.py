"""Per-key selection, deduplication and upserts.

All of them are ``row_number() <= k`` over a total order. Spark turns that filter into a
group limit that runs before the shuffle, so a hot key sends at most ``k`` rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def latest_per_key(df: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    return top_per_key(df, keys, [F.col(time).desc_nulls_last(), F.col(tie).desc()])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return top_per_key(df, keys, [F.col(c).asc_nulls_last() for c in order])


def insert_first_wins(
    new: DataFrame, keys: Sequence[str], order: Sequence[str], stored: DataFrame | None = None
) -> DataFrame:
    """Rows to append: first of each key, keys already stored left out."""
    out = first_per_key(new, keys, order)
    return out if stored is None else out.join(stored.select(*keys), list(keys), "left_anti")


def upsert_last_wins(
    stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str],
    update: Sequence[str] | None = None,
) -> DataFrame:
    """Full state after the upsert: the last new row of a key replaces the stored row.

    With ``update`` only those columns are taken from the new row; the rest keep their
    stored value where the key was already there.
    """
    last = top_per_key(new, keys, [F.col(c).desc_nulls_last() for c in order])
    values = [c for c in stored.columns if c not in keys]
    joined = stored.withColumn("_old", F.lit(True)).alias("o").join(
        last.withColumn("_new", F.lit(True)).alias("n"), list(keys), "full_outer"
    )
    take_new = lambda c: F.col("_old").isNull() | (
        F.col("_new").isNotNull() & F.lit(update is None or c in update)
    )
    return joined.select(
        *keys, *[F.when(take_new(c), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values]
    )


def dedup_filings(
    entries: DataFrame, stored: DataFrame | None = None, natural: str | None = None, mixed: str | None = None
) -> DataFrame:
    """Two layers: one row per content hash, then one per (feed, dedup_key).

    Rows without a natural key only face the first layer. The content hash covers feed and
    link, so equal hashes have equal natural keys and the layers may run one after the other.

    ``natural`` names a column that stands for the key of the second layer, and ``mixed`` one that marks
    the rows whose equal hashes may have different natural keys. Then only these face the first layer:
    the second finds the copies of all others by itself, so a row is shuffled once.
    """
    order = ["observed_at", "filing_id"]
    out = first_per_key(entries if mixed is None else entries.where(F.col(mixed)), ["content_hash"], order)
    if mixed is not None:
        out = out.unionByName(entries.where(~F.col(mixed)))
    if natural is None or stored is not None:
        out = out.withColumn("_natural", F.coalesce(F.col("dedup_key"), F.concat(F.lit("\x1f"), F.col("content_hash"))))
    out = first_per_key(out, ["feed", "_natural"] if natural is None else [natural], order)
    if stored is not None:
        held = stored.where(F.col("dedup_key").isNotNull()).select("feed", F.col("dedup_key").alias("_natural"))
        out = out.join(stored.select("content_hash"), "content_hash", "left_anti").join(
            held, ["feed", "_natural"], "left_anti"
        )
    return out.drop("_natural")


def uniqueness_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row; empty when the constraint holds."""
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def priority_worklist(tiers: Sequence[DataFrame], key: str, limit: int | None) -> DataFrame:
    """First tier of every key wins; ordered by tier then key and cut there, or all without a limit."""
    ranked = [t.select(key).distinct().withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)]
    both = ranked[0]
    for r in ranked[1:]:
        both = both.unionByName(r)
    first = both.groupBy(key).agg(F.min("tier").alias("tier"))
    return first if limit is None else first.orderBy("tier", key).limit(limit)
