"""Listing, rename-history and holiday files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.functions.numeric import clean_number
from tapeloom.functions.text import blank_to_null, listing_date
from tapeloom.sources.prices import read_text_csv


def listing_snapshot(rows: DataFrame, is_sme: bool) -> DataFrame:
    have = lambda *names: F.coalesce(*[blank_to_null(F.col(f"`{n}`")) for n in names if n in rows.columns], F.lit(None).cast("string"))
    return rows.select(
        F.col("SYMBOL").alias("symbol"), have("ISIN NUMBER", "ISIN").alias("isin"),
        have("NAME OF COMPANY", "COMPANY NAME").alias("company_name"), have("SERIES").alias("series"),
        F.lit(is_sme).alias("is_sme"), listing_date(have("DATE OF LISTING")).alias("listing_date"),
        F.nullif(clean_number(have("FACE VALUE")), F.lit(0.0)).alias("face_value"),
        F.monotonically_increasing_id().alias("line_no"),
    )


def first_accepted(spark: SparkSession, paths: Sequence[str], minimum: int = 10) -> DataFrame | None:
    """First candidate file with a SYMBOL column and more than ``minimum`` rows."""
    for path in paths:
        try:
            rows = read_text_csv(spark, path)
        except Exception as error:  # a missing candidate is expected; anything else is not
            if "PATH_NOT_FOUND" in str(error):
                continue
            raise
        if "SYMBOL" in rows.columns and len(rows.select("SYMBOL").take(minimum + 1)) > minimum:
            return rows
    return None


def symbol_changes(spark: SparkSession, path: str) -> DataFrame:
    """Headerless (name, old, new, effective) file to (old, new, effective) rows."""
    raw = spark.read.csv(path, header=False, schema="name string, old string, new string, effective string")
    return raw.select(
        F.trim("old").alias("old"), F.trim("new").alias("symbol"), listing_date(F.col("effective")).alias("effective")
    ).where((F.col("old") != "") & (F.col("symbol") != "") & (F.col("old") != F.col("symbol")))


def name_changes(spark: SparkSession, path: str) -> DataFrame:
    rows = read_text_csv(spark, path)
    have = lambda *names: F.coalesce(*[blank_to_null(F.col(f"`{n}`")) for n in names if n in rows.columns])
    return rows.select(have("NCH SYMBOL", "SYMBOL").alias("symbol"), have("NCH PREV NAME", "PREVIOUS NAME").alias("old")).where(
        F.col("symbol").isNotNull() & F.col("old").isNotNull()
    )


def change_aliases(changes: DataFrame, securities: DataFrame, alias_type: str, stored: DataFrame) -> DataFrame:
    """Alias rows for renames of known securities that are not stored yet."""
    rows = changes.join(securities.select("security_id", "symbol"), "symbol").select(
        "security_id", F.col("old").alias("alias"), F.lit(alias_type).alias("alias_type")
    ).distinct()
    return rows.join(stored.select("security_id", "alias", "alias_type"), ["security_id", "alias", "alias_type"], "left_anti")


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """Trading holidays of the cash segment; rows without a valid date are skipped."""
    schema = "CM array<struct<tradingDate:string,description:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("CM").alias("h"))
    day = F.try_to_timestamp(F.initcap(F.trim("h.tradingDate")), F.lit("d-MMM-yyyy")).cast("date")
    return rows.select(day.alias("day"), F.coalesce(blank_to_null(F.col("h.description")), F.lit("holiday")).alias("name")).where(
        F.col("day").isNotNull()
    )
