"""Content-addressed document catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.constants import MAX_DOCUMENT_BYTES


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), "content")


def catalogue(files: DataFrame, cap: int = MAX_DOCUMENT_BYTES) -> DataFrame:
    """One row per distinct content: hash, size, storage path, number of copies, status and error.

    A file above the cap is not hashed and not stored: it keeps a row of its own, with status
    ``failed`` and its size as the reason. Copies collapse in a mergeable aggregate, so a content
    with very many copies costs one row per task.
    """
    ext = F.lower(F.regexp_extract(F.substring_index("url", "?", 1), r"\.([A-Za-z0-9]{1,5})$", 1))
    size = F.octet_length("content")
    rows = files.select(
        F.when(size <= cap, F.sha2("content", 256)).alias("sha256"), size.alias("bytes"), "url",
        F.when(ext == "", "bin").otherwise(ext).alias("ext"), F.when(size <= cap, F.lit(None)).otherwise(F.col("url")).alias("_alone"),
    )
    return rows.groupBy("sha256", "_alone").agg(
        F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("url", "ext")).alias("_first")
    ).select(
        "sha256", "bytes", "copies", F.col("_first.url").alias("url"),
        F.concat(F.substring("sha256", 1, 2), F.lit("/"), F.col("sha256"), F.lit("."), F.col("_first.ext")).alias("path"),
        F.when(F.col("sha256").isNull(), "failed").otherwise("fetched").alias("fetch_status"),
        F.when(F.col("sha256").isNull(), F.concat(F.lit("too large: "), F.col("bytes").cast("string"), F.lit(" bytes"))).alias("fetch_error"),
    )
