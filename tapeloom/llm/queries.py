"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.llm import centroids, decontaminate, filteraudit, htmltext, langid, linededup, lm, pieces, pii, quality, simhash, subword, toxicity
from tapeloom.llm.common import remainder_is, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder_is("doc_id", 5, 0))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), remainder_is("doc_id", 4, 2))


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"), "text")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"), remainder_is("doc_id", 5, 1))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("n_failed_lines")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_subwordquality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder_is("doc_id", 4, 2))


def op13_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_pii, op3_html, op4_sentencepiece, op5_langid, op6_linededup, op7_lm, op8_simhash, op9_quality, op10_decontaminate, op11_centroids, op12_subwordquality, op13_filteraudit)
}
ORACLES: dict[str, str] = {"op11_centroids": centroids.cluster_sql(), "op13_filteraudit": filteraudit.audit_sql()}
