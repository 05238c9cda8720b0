"""Securities master, industry map and document retrieval state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom import constants as K
from tapeloom.operators.keyed import priority_worklist, top_per_key

_ATTRS = ("series", "isin", "is_sme", "face_value")


def merge_snapshot(stored: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Listing snapshot against stored securities: one row per snapshot security.

    ISIN identifies a security; (symbol, series) does where the ISIN is unknown. ``outcome``
    is insert, update or skip; ``old_symbol`` and ``old_name`` are filled for renames. A
    security listed twice in one snapshot counts with its last line.
    """
    snap = snapshot.where((F.coalesce("symbol", F.lit("")) != "") & (F.coalesce("company_name", F.lit("")) != ""))
    snap = snap.withColumn("_key", F.coalesce("isin", F.concat_ws("\x1f", "symbol", F.coalesce("series", F.lit("")))))
    snap = top_per_key(snap, ["_key"], [F.col("line_no").desc()])
    old = stored.select("security_id", *[F.col(c).alias(f"o_{c}") for c in ("symbol", "company_name", *_ATTRS)])
    # listings without an ISIN skip the ISIN join instead of meeting there under one null key
    by_isin = snap.where(F.col("isin").isNotNull()).join(old, F.col("isin") == F.col("o_isin"), "left")
    found = by_isin.where(F.col("security_id").isNotNull())
    rest = by_isin.where(F.col("security_id").isNull()).select(*snap.columns).unionByName(snap.where(F.col("isin").isNull()))
    rest = rest.join(
        old, (F.col("symbol") == F.col("o_symbol")) & F.col("series").eqNullSafe(F.col("o_series")), "left"
    )
    df = found.unionByName(rest)
    known = F.col("security_id").isNotNull()
    renamed = known & (F.col("symbol") != F.col("o_symbol"))
    retitled = known & (F.col("company_name") != F.col("o_company_name"))
    moved = F.lit(False)
    for c in _ATTRS:
        moved = moved | (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"o_{c}")))
    return df.select(
        "security_id", "symbol", "company_name",
        *[F.coalesce(F.col(c), F.col(f"o_{c}")).alias(c) for c in _ATTRS],
        F.when(~known, "insert").when(renamed | retitled | moved, "update").otherwise("skip").alias("outcome"),
        F.when(renamed, F.col("o_symbol")).alias("old_symbol"),
        F.when(retitled, F.col("o_company_name")).alias("old_name"),
    )


def alias_rows(merged: DataFrame) -> DataFrame:
    """Alias rows for every rename found by the merge."""
    pairs = F.array(
        F.struct(F.col("old_symbol").alias("alias"), F.lit("old_symbol").alias("alias_type")),
        F.struct(F.col("old_name").alias("alias"), F.lit("old_name").alias("alias_type")),
    )
    return merged.select("security_id", F.explode(pairs).alias("a")).where(F.col("a.alias").isNotNull()).select(
        "security_id", F.col("a.alias").alias("alias"), F.col("a.alias_type").alias("alias_type")
    )


def accrete_industry(securities: DataFrame, stated: DataFrame) -> DataFrame:
    """Securities whose industry changes to the newest stated one."""
    return securities.join(stated.withColumnRenamed("industry", "_new"), "symbol").where(
        F.coalesce("industry", F.lit("")) != F.col("_new")
    ).select("security_id", "symbol", F.col("industry").alias("old_industry"), F.col("_new").alias("industry"))


def document_state(documents: DataFrame, attempts: DataFrame) -> DataFrame:
    """Retrieval state per document from its attempt log.

    Attempts carry ``outcome``: ok, unavailable, error or deferred. A document ends at its
    first success, its first hard error, or its fourth unavailable answer; until then the
    ladder sets the next attempt. Only the first four unavailable rows of a document can
    matter, so no group is ever collected.
    """
    key = "doc_id"
    soft = attempts.where(F.col("outcome") == "unavailable")
    soft = top_per_key(soft, [key], [F.col("moment"), F.col("attempt_id")], K.MAX_ATTEMPTS)
    step = F.struct("moment", "attempt_id")
    ends = attempts.where(F.col("outcome").isin("ok", "error")).groupBy(key).agg(
        F.min_by("outcome", step).alias("_end"), F.min(step).alias("_end_at")
    )
    counted = soft.join(ends, key, "left").where(F.col("_end_at").isNull() | (F.struct("moment", "attempt_id") < F.col("_end_at")))
    ladder = counted.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("moment").alias("_last"))
    df = documents.select(key).join(ends, key, "left").join(ladder, key, "left")
    n = F.coalesce("_n", F.lit(0))
    dead = n >= K.MAX_ATTEMPTS
    status = (
        F.when(dead, "failed").when(F.col("_end") == "ok", "fetched").when(F.col("_end") == "error", "failed").otherwise("pending")
    )
    wait = F.lit(0)
    for i, minutes in enumerate(K.RETRY_DELAYS_MIN, start=1):
        wait = F.when(n == i, minutes).otherwise(wait)
    nxt = F.col("_last") + F.make_dt_interval(mins=wait)
    return df.select(
        key, status.alias("fetch_status"), n.cast("int").alias("attempts"),
        F.when((status == "pending") & (n > 0), nxt).alias("next_attempt_at"),
    )


def due_documents(state: DataFrame, now: Column, limit: int | None) -> DataFrame:
    """Documents whose next attempt is due; the first ``limit`` by id, or all."""
    due = (F.col("fetch_status") == "pending") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    return state.where(due) if limit is None else state.where(due).orderBy("doc_id").limit(limit)


def pledge_worklist(filings: DataFrame, pledge: DataFrame, scores: DataFrame, limit: int | None) -> DataFrame:
    """Symbols needing a pledge fetch: activity, then fresh shareholding, then scored ones."""
    held = pledge.groupBy("symbol").agg(F.max("observed_at").alias("_held"))
    named = filings.where(F.col("symbol").isNotNull())
    active = named.where(F.col("feed").isin("encumbrance", "sast_reg31")).join(held, "symbol", "left_anti")
    fresh = (
        named.where(F.col("feed") == "shareholding_pattern").groupBy("symbol").agg(F.max("observed_at").alias("_t"))
        .join(held, "symbol", "left").where(F.col("_held").isNull() | (F.col("_t") > F.col("_held")))
    )
    scored = scores.where(F.col("agent").isin("a3", "a4", "a5")).join(held, "symbol", "left_anti")
    return priority_worklist([active, fresh, scored], "symbol", limit)
