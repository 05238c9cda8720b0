"""End-of-day price and index files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeloom.constants import KEEP_INDICES, KEEP_SERIES
from tapeloom.functions.numeric import clean_number


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV as trimmed strings under trimmed, upper-case, space-separated names."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip().upper().replace("_", " ")) for c in df.columns if c])


def _num(name: str, columns: list[str]) -> Column:
    return clean_number(F.nullif(F.col(f"`{name}`"), F.lit("-"))) if name in columns else F.lit(None).cast("double")


def equity_bars(rows: DataFrame, day: Column) -> DataFrame:
    """Equity price file rows to daily bars; only the traded series are kept."""
    n = lambda c: _num(c, rows.columns)
    return rows.where(F.col("SERIES").isin(KEEP_SERIES) & (F.coalesce("SYMBOL", F.lit("")) != "")).select(
        F.col("SYMBOL").alias("symbol"), day.alias("trade_date"), F.col("SERIES").alias("series"),
        n("OPEN PRICE").alias("open"), n("HIGH PRICE").alias("high"), n("LOW PRICE").alias("low"),
        n("CLOSE PRICE").alias("close"), n("PREV CLOSE").alias("prev_close"), n("AVG PRICE").alias("vwap"),
        n("TTL TRD QNTY").alias("volume"), n("TURNOVER LACS").alias("turnover"), n("NO OF TRADES").alias("trades"),
        n("DELIV QTY").alias("delivery_qty"), n("DELIV PER").alias("delivery_pct"), F.lit("bhavcopy").alias("source"),
    )


def index_bars(rows: DataFrame, day: Column) -> DataFrame:
    """Index file rows to bars under ``IDX:<name>``; the previous close is not carried."""
    n = lambda c: _num(c, rows.columns)
    return rows.where(F.col("INDEX NAME").isin(KEEP_INDICES)).select(
        F.concat(F.lit("IDX:"), F.col("INDEX NAME")).alias("symbol"), day.alias("trade_date"),
        n("OPEN INDEX VALUE").alias("open"), n("HIGH INDEX VALUE").alias("high"), n("LOW INDEX VALUE").alias("low"),
        n("CLOSING INDEX VALUE").alias("close"), F.lit(None).cast("double").alias("prev_close"),
        n("VOLUME").alias("volume"), n("TURNOVER (RS. CR.)").alias("turnover"), F.lit("index").alias("source"),
    )
