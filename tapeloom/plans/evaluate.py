"""Quality gates: classifier evaluation, reconciliation, coverage, sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tapeloom import constants as K
from tapeloom.functions.numeric import within_tolerance
from tapeloom.operators.keyed import top_per_key
from tapeloom.operators.ranks import spearman


def predictions(labels: DataFrame, classifications: DataFrame) -> DataFrame:
    """Labels with their prediction; ``UNCLASSIFIED`` where there is none."""
    c = classifications.select("filing_id", F.col("category").alias("_pred"), F.col("materiality").alias("pred_materiality"))
    return (
        labels.where(F.trim("label_category") != "")
        .join(c, "filing_id", "left")
        .withColumn("predicted", F.coalesce("_pred", F.lit("UNCLASSIFIED")))
        .withColumn("hit", F.col("predicted") == F.trim("label_category"))
        .drop("_pred")
    )


def classifier_report(pred: DataFrame) -> DataFrame:
    """One row: labelled rows, accuracy, rank correlation of materiality, gate verdict."""
    acc = pred.agg(F.count(F.lit(1)).alias("labelled"), F.avg(F.col("hit").cast("double")).alias("accuracy"))
    rho = spearman(pred.where(F.col("predicted") != "UNCLASSIFIED"), "pred_materiality", "label_materiality", "spearman")
    return acc.crossJoin(F.broadcast(rho)).withColumn(
        "verdict", F.when((F.col("accuracy") >= K.GATE_ACCURACY) & (F.col("spearman") >= K.GATE_SPEARMAN), "PASS").otherwise("FAIL")
    )


def misses(pred: DataFrame) -> DataFrame:
    return pred.where(~F.col("hit")).select("filing_id", "predicted", "label_category")


def stratified_sample(classified: DataFrame, strata: list | None = None) -> DataFrame:
    """Feed-interleaved sample: rank inside each feed, then rank-major order, per stratum.

    Rows beyond the stratum's size within one feed can never be taken, so each feed keeps at
    most that many rows before the final ordering.
    """
    degraded = F.col("rule_trace").contains("no_llm") | F.col("rule_trace").contains("llm_unavailable")
    member = {
        "routine": F.col("routine"),
        "rules": ~F.col("routine") & (F.col("engine") == "rules") & ~F.coalesce(degraded, F.lit(False)),
        "model": F.col("engine").isin("local", "online", "model"),
    }
    parts = []
    for name, p, n in strata or K.SAMPLE_STRATA:
        w = Window.partitionBy("feed").orderBy(F.col("filing_id") % p, "filing_id")
        ranked = classified.where(member[name]).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
        parts.append(ranked.orderBy("rn", "feed").limit(n).withColumn("stratum", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def coverage(held: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows with ``held``; duplicates on the held side do not multiply."""
    have = held.select(*keys).distinct().withColumn("held", F.lit(True))
    return expected.join(have, keys, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def coverage_report(covered: DataFrame, by: list[str]) -> DataFrame:
    return covered.groupBy(*by).agg(
        F.count(F.lit(1)).alias("expected"), F.count_if("held").alias("held"),
        (100.0 * F.avg(F.col("held").cast("double"))).alias("coverage_pct"),
    )


def preferred_basis(quarters: DataFrame, minimum: int = K.RECONCILE_MIN_QUARTERS) -> DataFrame:
    """(symbol, basis) with enough quarters; consolidated before standalone."""
    ok = (
        quarters.where(F.col("revenue").isNotNull()).groupBy("symbol", "basis").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= minimum)
    )
    return top_per_key(ok, ["symbol"], [(F.col("basis") != "consolidated").cast("int"), F.col("n").desc(), F.col("basis")])


def reconcile(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Per symbol: values compared and values outside tolerance, in crore.

    ``theirs`` carries symbol, period_end, revenue_cr, pat_cr; the last eight own quarters count.
    """
    own = ours.where(F.col("revenue").isNotNull()).join(preferred_basis(ours).select("symbol", "basis"), ["symbol", "basis"])
    own = top_per_key(own, ["symbol"], [F.col("period_end").desc()], 8)
    pairs = own.join(theirs, ["symbol", "period_end"])
    values = F.explode(
        F.array(
            F.struct((F.col("revenue") / K.CRORE).alias("ours"), F.col("revenue_cr").alias("theirs")),
            F.struct((F.col("pat") / K.CRORE).alias("ours"), F.col("pat_cr").alias("theirs")),
        )
    )
    v = pairs.select("symbol", "basis", values.alias("v")).where(F.col("v.ours").isNotNull() & F.col("v.theirs").isNotNull())
    bad = ~within_tolerance(F.col("v.ours"), F.col("v.theirs"), K.RECONCILE_PCT, K.RECONCILE_ABS_CRORE)
    return v.groupBy("symbol", "basis").agg(F.count(F.lit(1)).alias("compared"), F.count_if(bad).alias("outside"))


def reconcile_report(rows: DataFrame) -> DataFrame:
    pct = 100.0 * F.avg((F.col("outside") == 0).cast("double"))
    return rows.agg(F.count(F.lit(1)).alias("symbols"), pct.alias("within_pct")).withColumn(
        "verdict", F.when(F.col("within_pct") >= K.GATE_RECONCILE_PCT, "PASS").otherwise("FAIL")
    )


def liquid_universe(bars: DataFrame, n: int) -> DataFrame:
    """Symbols by exact continuous median turnover; a symbol's bars are bounded by the calendar."""
    med = bars.where(F.col("turnover").isNotNull()).groupBy("symbol").agg(F.percentile("turnover", F.lit(0.5)).alias("median_turnover"))
    return med.orderBy(F.col("median_turnover").desc(), "symbol").limit(n)
