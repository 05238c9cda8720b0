"""Fundamental score over quarterly results.

(symbol, period_end, basis) is unique, so a symbol's quarters are bounded by the calendar
and travel as one short array. The same array expression scores the latest state and every
past state of the book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom import constants as K
from tapeloom.functions.numeric import clamp, with_rounded
from tapeloom.functions.text import fixed

QUARTER_COLUMNS = [
    "period_end", "visible_on", "basis", "revenue", "other_income", "expenses", "finance_costs",
    "depreciation", "pbt", "tax", "pat", "exceptional", "filing_id",
]


def with_visibility(quarters: DataFrame) -> DataFrame:
    return quarters.withColumn(
        "visible_on", F.coalesce(F.col("event_at").cast("date"), F.date_add("period_end", K.RESULT_LAG_DAYS))
    )


def quarter_arrays(quarters: DataFrame) -> DataFrame:
    """(symbol, quarters[]) in period order, consolidated rows if there are any."""
    cells = F.struct(*[F.col(c) for c in QUARTER_COLUMNS])
    df = with_visibility(quarters).groupBy("symbol").agg(F.array_sort(F.collect_list(cells)).alias("all"))
    of = lambda b: F.filter("all", lambda q: q["basis"] == b)
    return df.select(
        "symbol",
        F.when(F.size(of("consolidated")) > 0, of("consolidated")).otherwise(of("standalone")).alias("quarters"),
    ).where(F.size("quarters") > 0)


def growth(new: Column, old: Column) -> Column:
    """Relative change; null unless the base is positive."""
    return F.when(old > 0, (new - old) / F.nullif(old, F.lit(0.0)))


def operating_margin(q: Column) -> Column:
    costs = q["expenses"] - F.coalesce(q["finance_costs"], F.lit(0.0)) - F.coalesce(q["depreciation"], F.lit(0.0))
    return F.when(q["revenue"] > 0, (q["revenue"] - costs) / F.nullif(q["revenue"], F.lit(0.0)))


def score_quarters(df: DataFrame) -> DataFrame:
    """Adds every growth, margin, quality and score column from ``quarters``."""
    n = F.size("quarters")
    back = lambda k: F.get("quarters", n - 1 - k)
    df = df.withColumns({"n_quarters": n, "_q": back(0), "_qoq": back(1), "_yoy": back(4)})
    q, qoq, yoy = F.col("_q"), F.col("_qoq"), F.col("_yoy")
    df = df.withColumns(
        {
            "rev_yoy": growth(q["revenue"], yoy["revenue"]),
            "pat_yoy": growth(q["pat"], yoy["pat"]),
            "rev_qoq": growth(q["revenue"], qoq["revenue"]),
            "pat_qoq": growth(q["pat"], qoq["pat"]),
            "_margins": F.filter(F.transform("quarters", operating_margin), lambda m: m.isNotNull()),
        }
    )
    rev, pat = F.coalesce("rev_yoy", "rev_qoq"), F.coalesce("pat_yoy", "pat_qoq")
    side = lambda g: F.coalesce(clamp(0.0, 20.0, 10.0 + 40.0 * g), F.lit(10.0))
    growth_pts = F.when(rev.isNotNull() | pat.isNotNull(), side(rev) + side(pat))

    m = F.size("_margins")
    nth = lambda k: F.get("_margins", m - k)
    drift = (
        F.when(m >= 3, F.when(nth(1) > nth(3), 10.0).otherwise(2.0))
        .when(m == 2, F.when(nth(1) > nth(2), 8.0).otherwise(3.0))
        .otherwise(5.0)
    )
    margin_pts = F.when(m > 0, F.least(F.lit(25.0), clamp(0.0, 15.0, 15.0 * nth(1) / 0.25) + drift))

    positive = q["pbt"] > 0
    oi = F.when(positive & (q["other_income"] != 0), q["other_income"] / F.nullif(q["pbt"], F.lit(0.0)))
    rate = F.when(positive, q["tax"] / F.nullif(q["pbt"], F.lit(0.0)))
    burden = F.when(q["revenue"] > 0, q["finance_costs"] / F.nullif(q["revenue"], F.lit(0.0)))
    unusual = (q["pbt"] != 0) & (F.abs(q["exceptional"]) > 0.25 * F.abs(q["pbt"]))
    odd_tax = (rate < 0.10) | (rate > 0.45)
    pct = lambda x: F.concat(fixed(x * 100.0, 0), F.lit("%"))
    flags = F.array_compact(
        F.array(
            F.when(oi > 0.5, F.concat(F.lit("other_income "), pct(oi), F.lit(" of PBT")))
            .when(oi > 0.3, F.concat(F.lit("other_income "), pct(oi), F.lit(" of PBT (mild)"))),
            F.when(odd_tax, F.concat(F.lit("tax rate anomaly "), pct(rate))),
            F.when(unusual, F.lit("exceptional items >25% of PBT")),
            F.when(burden > 0.15, F.concat(F.lit("finance costs "), pct(burden), F.lit(" of revenue"))),
            F.when(q["pat"] < 0, F.lit("loss-making quarter")),
        )
    )
    take = lambda cond, pts: F.when(cond, pts).otherwise(0.0)
    lost = (
        F.when(oi > 0.5, 12.0).when(oi > 0.3, 6.0).otherwise(0.0)
        + take(odd_tax, 8.0) + take(unusual, 8.0) + take(burden > 0.15, 7.0) + take(q["pat"] < 0, 10.0)
    )
    df = df.withColumns(
        {
            "growth_pts": growth_pts, "margin_pts": margin_pts, "op_margin": F.when(m > 0, nth(1)),
            "quality_pts": F.greatest(F.lit(0.0), 35.0 - lost), "flags": flags,
        }
    )
    covered = (
        F.when(F.col("growth_pts").isNotNull(), 40.0).otherwise(0.0)
        + F.when(F.col("margin_pts").isNotNull(), 25.0).otherwise(0.0)
        + 35.0
    )
    df = df.withColumn("weight_covered", covered)
    points = F.coalesce("growth_pts", F.lit(0.0)) + F.coalesce("margin_pts", F.lit(0.0)) + F.col("quality_pts")
    df = with_rounded(
        df,
        {
            "score": (points * (100.0 / F.col("weight_covered")), 1),
            "confidence": (F.least(F.lit(1.0), F.col("n_quarters") / 8.0) * (F.col("weight_covered") / 100.0), 2),
        },
    )
    flagged = F.size("flags")
    return df.withColumns(
        {
            "score": F.least(F.lit(100.0), F.col("score")),
            "label": F.when(flagged >= 2, "flagged").when(flagged == 0, "clean").otherwise("watch"),
            "as_of": q["period_end"],
            "basis": q["basis"],
        }
    ).drop("_q", "_qoq", "_yoy", "_margins")


def fundamental_scores(quarters: DataFrame) -> DataFrame:
    return score_quarters(quarter_arrays(quarters))


def fundamental_states(quarters: DataFrame) -> DataFrame:
    """Score of the consolidated book as it stood from each broadcast day on.

    A state per (symbol, visible_on): only quarters visible by that day, in period order.
    """
    cons = quarters.where(F.col("basis") == "consolidated")
    df = quarter_arrays(cons)
    days = F.array_distinct(F.transform("quarters", lambda q: q["visible_on"]))
    df = df.select("symbol", F.col("quarters").alias("book"), F.explode(days).alias("visible_on"))
    df = df.withColumn("quarters", F.filter("book", lambda q: q["visible_on"] <= F.col("visible_on"))).drop("book")
    return score_quarters(df).drop("quarters")
