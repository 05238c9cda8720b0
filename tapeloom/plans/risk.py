"""Risk verdict: hard blocks, penalties and the named reason for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom import constants as K
from tapeloom.functions.text import fixed, shortest
from tapeloom.operators.keyed import top_per_key
from tapeloom.operators.pit import trailing


def price_checks(bars: DataFrame) -> DataFrame:
    """Per symbol over its last 60 bars: turnover median of the last 20, close, lock ratio."""
    last = bars.select("symbol", "trade_date", "close", "series", "turnover", "high", "low")
    w = Window.partitionBy("symbol").orderBy(F.col("trade_date").desc())
    last = last.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 60)
    turnover = F.array_sort(F.collect_list(F.when(F.col("_rn") <= 20, F.coalesce("turnover", F.lit(0.0)))))
    agg = last.groupBy("symbol").agg(
        turnover.alias("_t"),
        F.max(F.when(F.col("_rn") == 1, F.col("close"))).alias("close"),
        F.max(F.when(F.col("_rn") == 1, F.col("series"))).alias("series"),
        F.avg(F.when(F.col("high") == F.col("low"), 1.0).otherwise(0.0)).alias("lock_ratio"),
    )
    mid = (F.floor(F.size("_t") / 2) + 1).cast("int")
    return agg.withColumn("median_turnover", F.element_at("_t", mid)).drop("_t")


def surveillance_tags(surveillance: DataFrame, as_of: Column, *, snapshot: str = "history") -> DataFrame:
    """Distinct (framework, stage) tags per symbol; ``snapshot='latest'`` keeps the newest day."""
    rows = surveillance.where(F.col("as_of") <= as_of.cast("date"))
    if snapshot == "latest":
        day = rows.agg(F.max("as_of").alias("_day"))
        rows = rows.crossJoin(F.broadcast(day)).where(F.col("as_of") == F.col("_day")).drop("_day")
    tags = rows.select("symbol", "framework", "stage").distinct()
    gsm, long_term = F.col("framework") == "gsm", (F.col("framework") == "asm_lt") & (F.col("stage") != "Stage I")
    text = (
        F.when(gsm, F.concat(F.lit("GSM surveillance ("), F.col("stage"), F.lit(")")))
        .when(long_term, F.concat(F.lit("ASM long-term "), F.col("stage")))
        .otherwise(F.concat(F.lit("surveillance "), F.col("framework"), F.lit(":"), F.col("stage")))
    )
    hard = gsm | long_term
    # three frameworks with a handful of stages: the tag set of a symbol is bounded
    return tags.groupBy("symbol").agg(
        F.array_sort(F.collect_set(F.when(hard, text))).alias("surv_hard"),
        F.array_sort(F.collect_set(F.when(~hard, text))).alias("surv_soft"),
    )


def governance_counts(filings: DataFrame, classifications: DataFrame, as_of: Column) -> DataFrame:
    """Conditional counts per symbol in one pass over classified filings, plus encumbrances."""
    joined = classifications.where(
        trailing(F.col("observed_at"), as_of, "365 DAYS")
        & F.col("category").isin("auditor_resignation", "regulatory_action")
    ).select("filing_id", "category", "materiality", F.col("observed_at").alias("_at"))
    named = filings.where(F.col("symbol").isNotNull())
    counts = (
        named.select("filing_id", "symbol").join(joined, "filing_id").groupBy("symbol").agg(
            F.count_if((F.col("category") == "auditor_resignation") & (F.col("materiality") >= 9)).alias("auditor_n"),
            F.count_if(
                (F.col("category") == "regulatory_action") & trailing(F.col("_at"), as_of, "180 DAYS")
            ).alias("regulatory_n"),
        )
    )
    enc = (
        named.where((F.col("feed") == "encumbrance") & trailing(F.col("observed_at"), as_of, "180 DAYS"))
        .groupBy("symbol").agg(F.count(F.lit(1)).alias("encumbrance_n"))
    )
    return counts.join(enc, "symbol", "full_outer")


def latest_pledge(pledge: DataFrame, as_of: Column) -> DataFrame:
    known = pledge.where(F.col("encumbered_pct").isNotNull() & (F.col("observed_at") <= as_of))
    shp = (F.col("shp_date") if "shp_date" in pledge.columns else F.lit(None)).cast("date").alias("shp_date")
    return top_per_key(known, ["symbol"], [F.col("observed_at").desc(), F.col("record_id").desc()]).select(
        "symbol", "promoter_pct", "encumbered_pct", shp
    )


def market_cap_crore(paidup: Column, face: Column, close: Column) -> Column:
    return F.when((paidup > 0) & (face > 0), paidup / F.nullif(face, F.lit(0.0)) * close / K.CRORE)


def risk_universe(scores: DataFrame, surveillance: DataFrame, as_of: Column) -> DataFrame:
    """Recently scored symbols and every surveillance member known at ``as_of``."""
    recent = scores.where(F.col("agent").isin("a3", "a4", "a5") & trailing(F.col("observed_at"), as_of, "2 DAYS"))
    return recent.select("symbol").union(surveillance.where(F.col("as_of") <= as_of.cast("date")).select("symbol")).distinct()


def risk_verdicts(
    universe: DataFrame, bars: DataFrame, filings: DataFrame, classifications: DataFrame,
    surveillance: DataFrame, pledge: DataFrame, quarters: DataFrame, as_of: Column,
    *, snapshot: str = "history",
) -> DataFrame:
    newest_quarter = top_per_key(
        quarters, ["symbol"], [F.col("period_end").desc(), F.col("basis")]
    ).select("symbol", "paidup", "face")
    df = universe.select("symbol")
    for side in (
        price_checks(bars.where(F.col("trade_date") <= as_of.cast("date"))),
        surveillance_tags(surveillance, as_of, snapshot=snapshot),
        governance_counts(filings, classifications, as_of),
        latest_pledge(pledge, as_of),
        newest_quarter,
    ):
        df = df.join(side, "symbol", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    say = lambda fmt, *cols: F.format_string(fmt, *cols)
    empty = F.array().cast("array<string>")
    enc, pro = F.col("encumbered_pct"), F.coalesce("promoter_pct", F.lit(0.0))
    heavy = (pro > 0) & (enc > K.PLEDGE_HARD_PCT)
    df = df.withColumn("mcap_cr", F.when(F.col("close") != 0, market_cap_crore(F.col("paidup"), F.col("face"), F.col("close"))))
    hard = F.concat(
        F.coalesce("surv_hard", empty),
        F.array_compact(
            F.array(
                F.when(F.col("median_turnover") < K.MIN_MEDIAN_TURNOVER_LAKH,
                       say("illiquid (median 20d turnover ₹%sL < ₹10L)", fixed(F.col("median_turnover"), 0))),
                F.when(F.col("close") < K.PENNY_CLOSE, say("penny stock (close ₹%s)", shortest(F.col("close")))),
                F.when(F.col("lock_ratio") > K.LOCK_RATIO_HARD,
                       say("circuit-locked %s%% of last 60 sessions", fixed(F.col("lock_ratio") * 100.0, 0))),
                F.when(n("auditor_n") > 0,
                       say("statutory auditor resignation in last 12m (%d filing(s))", n("auditor_n"))),
                F.when(heavy, say("promoter pledge %s%% of promoter holding (> 25%%, SHP %s)", fixed(enc, 1), F.coalesce(F.col("shp_date").cast("string"), F.lit("None")))),
            )
        ),
    )
    soft = F.concat(
        F.coalesce("surv_soft", empty),
        F.array_compact(
            F.array(
                F.when(F.col("series").isin("BE", "BZ"), say("trade-for-trade series (%s)", F.col("series"))),
                F.when(n("regulatory_n") > 0, say("regulatory action filings in last 180d (%d)", n("regulatory_n"))),
                F.when(~F.coalesce(heavy, F.lit(False)) & (enc > K.PLEDGE_PENALTY_PCT),
                       say("promoter pledge %s%% of promoter holding", fixed(enc, 1))),
                F.when(n("encumbrance_n") > 0,
                       say("pledge/encumbrance activity in last 180d (%d)%s", n("encumbrance_n"),
                           F.when(enc.isNull(), F.lit("; pledge % unavailable")).otherwise(F.lit("")))),
                F.when(F.col("mcap_cr") < K.MICROCAP_CRORE, say("microcap (₹%s Cr)", fixed(F.col("mcap_cr"), 0))),
            )
        ),
    )
    df = df.withColumns({"hard_blocks": hard, "penalties": soft})
    blocked = F.size("hard_blocks") > 0
    always = F.array(*[F.lit(u) for u in K.RISK_UNAVAILABLE])
    return df.withColumns(
        {
            "verdict": F.when(blocked, "hard_block").when(F.size("penalties") > 0, "penalty").otherwise("clear"),
            "score": F.when(blocked, 0.0).otherwise(F.greatest(F.lit(0.0), 100.0 - 15.0 * F.size("penalties"))),
            "unavailable": F.when(enc.isNull(), F.concat(always, F.array(F.lit(K.RISK_UNAVAILABLE_PLEDGE)))).otherwise(always),
            "as_of": as_of,
        }
    )
