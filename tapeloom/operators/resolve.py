"""Entity resolution by exact keys only: never fuzzy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.functions.text import collapse_spaces
from tapeloom.operators.keyed import top_per_key


def _aliases(aliases: DataFrame, old_names_only: bool) -> DataFrame:
    """Upper-cased alias to security; the lowest security id wins a shared alias."""
    a = aliases.where(F.col("alias_type") == "old_name") if old_names_only else aliases
    return a.groupBy(F.upper("alias").alias("_key")).agg(F.min("security_id").alias("_alias_id"))


def resolve_token(df: DataFrame, token: str, securities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``security_id``: exact symbol, then ISIN, then alias.

    The join sides are unique per key, so no row multiplies; Spark broadcasts them by their
    measured size.
    """
    by_symbol = securities.groupBy(F.col("symbol").alias("_token")).agg(F.min("security_id").alias("_by_symbol"))
    by_isin = securities.where(F.col("isin").isNotNull()).groupBy(F.col("isin").alias("_isin")).agg(
        F.min("security_id").alias("_by_isin")
    )
    by_alias = _aliases(aliases, False).withColumnRenamed("_alias_id", "_by_alias")
    t = F.nullif(F.upper(F.trim(F.col(token))), F.lit(""))
    df = df.withColumn("_token", t)
    # rows without a token can match nothing; they stay out of the joins, where one null key
    # would gather them in a single task. Tokens that cannot be an ISIN keep a key of their own.
    blank = df.where(F.col("_token").isNull()).withColumn("security_id", F.lit(None).cast("bigint"))
    isin_like = (F.length("_token") == 12) & F.col("_token").rlike(r"^[A-Za-z]{2}")
    out = (
        df.where(F.col("_token").isNotNull())
        .withColumn("_isin", F.when(isin_like, F.col("_token")).otherwise(F.concat(F.lit("\x1f"), F.col("_token"))))
        .join(by_symbol, "_token", "left")
        .join(by_isin, "_isin", "left")
        .join(by_alias.withColumnRenamed("_key", "_token"), "_token", "left")
        .withColumn("security_id", F.coalesce("_by_symbol", "_by_isin", "_by_alias"))
        .drop("_isin", "_by_symbol", "_by_isin", "_by_alias")
    )
    return out.unionByName(blank).drop("_token")


def resolve_name(df: DataFrame, name: str, securities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``security_id``: full name, then the part before ' - '; current name, then old name."""
    names = securities.groupBy(F.upper("company_name").alias("_key")).agg(F.min("security_id").alias("_name_id"))
    olds = _aliases(aliases, True)
    full = F.upper(collapse_spaces(F.col(name)))
    head = F.trim(F.substring_index(full, " - ", 1))
    # without a head part the full name is asked twice: same answer, and no shared null key
    out = df.withColumns({"_full": full, "_head": F.when(full.contains(" - "), head).otherwise(full)})
    for i, key in enumerate(("_full", "_head")):
        out = out.join(names.toDF(key, f"_n{i}"), key, "left").join(olds.toDF(key, f"_o{i}"), key, "left")
    return out.withColumn("security_id", F.coalesce("_n0", "_o0", "_n1", "_o1")).drop(
        "_full", "_head", "_n0", "_o0", "_n1", "_o1"
    )


def industry_by_symbol(filings: DataFrame, industry: Column) -> DataFrame:
    """Newest stated industry per symbol; '-' and null are not statements."""
    stated = filings.withColumn("_industry", industry).where(
        F.col("_industry").isNotNull() & (F.col("_industry") != "-") & F.col("symbol").isNotNull()
    )
    return top_per_key(
        stated, ["symbol"], [F.col("observed_at").desc(), F.col("filing_id").desc()]
    ).select("symbol", F.col("_industry").alias("industry"))
