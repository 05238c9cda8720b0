"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.llm import decontaminate, linededup, neardup, pieces, quality, simhash
from tapeloom.llm.common import table
from tapeloom.sources.sinks import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out failing lines and the documents that the rules reject."""
    judged = quality.quality(docs.select(*COLUMNS), COLUMNS, with_text=True).where("kept")
    text = F.when(F.col("n_failed_lines") > 0, F.col("cleaned")).otherwise(F.col("text"))
    return judged.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes lines that stand in an earlier document; documents that lose all of theirs go."""
    found = linededup.line_dedup(docs.select(*COLUMNS))
    kept = found.where((F.col("n_removed") == 0) | (F.col("text") != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near-duplicates.

    Links are those of the SimHash operator, and those of sets of five-word shingles that share 0.8.
    """
    return neardup.first_of_group(docs.select(*COLUMNS), radius=simhash.RADIUS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.clean_only(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text with the digests of ids and decoded text."""
    return pieces.digests(docs, carry=["doc_id", "lang", "source"], with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", encode),
]

#: The stages are Python parsers and models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
