"""Point-in-time reads: the only way analytics look at bitemporal facts.

Every fact row carries ``event_at`` (when it happened, may be null) and ``observed_at`` (when
we learned of it). A read states an ``as_of`` instant and never sees a later observation.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F


def instant(as_of: datetime | Column) -> Column:
    """Accepts a time-zone-aware datetime or a timestamp column."""
    if isinstance(as_of, Column):
        return as_of
    if as_of.tzinfo is None:
        raise ValueError("as_of must be time-zone aware")
    return F.lit(as_of)


def pit(df: DataFrame, as_of: datetime | Column) -> DataFrame:
    return df.where(F.col("observed_at") <= instant(as_of))


def pit_filings(
    filings: DataFrame,
    as_of: datetime,
    *,
    symbol: str | None = None,
    feed: str | None = None,
    since: datetime | None = None,
    limit: int | None = 100,
) -> DataFrame:
    """Filings visible at ``as_of``, newest event first; ``limit=None`` keeps all."""
    out = pit(filings, as_of)
    if symbol is not None:
        out = out.where(F.col("symbol") == symbol.upper())
    if feed is not None:
        out = out.where(F.col("feed") == feed)
    if since is not None:
        out = out.where(F.col("event_at") >= instant(since))
    if limit is None:
        return out
    return out.orderBy(F.col("event_at").desc_nulls_last(), "filing_id").limit(limit)


def pit_classified(
    filings: DataFrame,
    classifications: DataFrame,
    as_of: datetime,
    *,
    model_version: str,
    min_materiality: int = 0,
    symbol: str | None = None,
    since: datetime | None = None,
    exclude_routine: bool = True,
    limit: int | None = 100,
) -> DataFrame:
    """Filings with their classification, both sides visible at ``as_of``."""
    c = pit(classifications, as_of).where(
        (F.col("model_version") == model_version) & (F.col("materiality") >= min_materiality)
    )
    if exclude_routine:
        c = c.where(~F.col("routine"))
    c = c.drop("event_at").withColumnRenamed("observed_at", "classified_at")
    f = pit_filings(filings, as_of, symbol=symbol, since=since, limit=None)
    out = f.join(c, "filing_id")
    if limit is None:
        return out
    return out.orderBy(
        F.col("materiality").desc(), F.col("event_at").desc_nulls_last(), "filing_id"
    ).limit(limit)


def trailing(ts: Column, as_of: Column | datetime | date, interval: str) -> Column:
    """``as_of - interval <= ts <= as_of``; both bounds, so replays cannot see ahead."""
    end = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return (ts >= end - F.expr(f"INTERVAL {interval}")) & (ts <= end)
