"""Flow score: large deals, promoter holding, insider activity and surveillance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom import constants as K
from tapeloom.functions.numeric import clamp, with_rounded
from tapeloom.functions.text import labelled_number
from tapeloom.operators.keyed import top_per_key
from tapeloom.operators.pit import trailing


def market_midnight(day: Column) -> Column:
    """The instant at which a trading day begins in the market's zone."""
    return F.to_utc_timestamp(day.cast("timestamp"), K.MARKET_ZONE)


def recent_days(day: Column, as_of: Column, days: int) -> Column:
    """Days whose market midnight lies in the trailing ``days`` before the instant."""
    return trailing(market_midnight(day), as_of, f"{days} DAYS")


def net_deals(deals: DataFrame, as_of: Column, days: int = 28) -> DataFrame:
    """(symbol, net_rs): buys minus sells over the trailing days, in rupees."""
    value = F.col("qty") * F.col("price")
    signed = F.when(F.col("side") == "BUY", value).otherwise(-value)
    return (
        deals.where(recent_days(F.col("day"), as_of, days))
        .groupBy("symbol")
        .agg(F.coalesce(F.sum(signed), F.lit(0.0)).alias("net_rs"))
    )


def holding_text() -> Column:
    return F.concat_ws(" ", F.col("subject"), F.col("description"))


def promoter_delta(filings: DataFrame, as_of: Column) -> DataFrame:
    """(symbol, promoter_pct, promoter_delta) from the two newest shareholding filings."""
    pct = F.coalesce(labelled_number(F.col("subject"), "PR_AND_PRGRP"), labelled_number(F.col("description"), "PR_AND_PRGRP"))
    rows = (
        filings.where((F.col("feed") == "shareholding_pattern") & F.col("symbol").isNotNull())
        .where(F.col("event_at").isNotNull() & (F.col("observed_at") <= as_of))
        .select("symbol", "event_at", "filing_id", pct.alias("pct"))
        .where(F.col("pct").isNotNull())
    )
    two = top_per_key(rows, ["symbol"], [F.col("event_at").desc(), F.col("filing_id").desc()], 2)
    newest_first = F.struct("event_at", "filing_id", "pct")
    ends = two.groupBy("symbol").agg(
        F.max(newest_first).alias("hi"), F.min(newest_first).alias("lo"), F.count(F.lit(1)).alias("n")
    )
    return ends.select(
        "symbol", F.col("hi.pct").alias("promoter_pct"),
        F.when(F.col("n") == 2, F.col("hi.pct") - F.col("lo.pct")).alias("promoter_delta"),
    )


def surveillance_points(surveillance: DataFrame, as_of: Column, *, snapshot: str = "last3") -> DataFrame:
    """(symbol, surv_pts): worst framework among the three newest rows, or the newest day."""
    rows = surveillance.where(F.col("as_of") <= as_of.cast("date"))
    if snapshot == "latest":
        day = rows.agg(F.max("as_of").alias("_day"))
        rows = rows.crossJoin(F.broadcast(day)).where(F.col("as_of") == F.col("_day")).drop("_day")
    else:
        rows = top_per_key(rows, ["symbol"], [F.col("as_of").desc(), F.col("framework")], 3)
    pts = F.when(F.col("framework") == "gsm", 0.0).when(F.col("framework") == "asm_lt", 5.0).otherwise(10.0)
    return rows.groupBy("symbol").agg(F.min(pts).alias("surv_pts"))


def market_context(market_flow: DataFrame, as_of: Column) -> DataFrame:
    """One row with ``market_context``: the net value of the newest row of each category.

    There are as many categories as the exchange has kinds of investors, so the map is small.
    """
    known = market_flow.where(market_midnight(F.col("day")) <= as_of)
    newest = top_per_key(known, ["category"], [F.col("day").desc(), F.col("net_value").desc()])
    return newest.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "net_value")))).alias("market_context"))


def flow_scores(
    bars: DataFrame, deals: DataFrame, filings: DataFrame, surveillance: DataFrame, as_of: Column,
    market_flow: DataFrame | None = None,
) -> DataFrame:
    """Scores for symbols with deals, surveillance or a shareholding filing known at ``as_of``.

    With ``market_flow`` every row also carries ``market_context``, the newest net value of each
    category as known then; it does not enter the score.
    """
    universe = reduce(
        DataFrame.unionByName,
        [
            deals.where(market_midnight(F.col("day")) <= as_of).select("symbol"),
            surveillance.where(market_midnight(F.col("as_of")) <= as_of).select("symbol"),
            filings.where((F.col("feed") == "shareholding_pattern") & F.col("symbol").isNotNull() & (F.col("observed_at") <= as_of)).select("symbol"),
        ],
    ).distinct()
    turnover = (
        bars.where(recent_days(F.col("trade_date"), as_of, 28))
        .groupBy("symbol").agg((F.sum("turnover") * K.LAKH).alias("turnover_rs"))
    )
    insider = (
        filings.where(F.col("feed").isin("insider_trading", "sast_reg29"))
        .where(trailing(F.col("observed_at"), as_of, "30 DAYS"))
        .groupBy("symbol").agg(F.count(F.lit(1)).alias("insider_n"))
    )
    df = universe
    for side in (net_deals(deals, as_of), turnover, promoter_delta(filings, as_of), insider,
                 surveillance_points(surveillance, as_of)):
        df = df.join(side, "symbol", "left")
    n = F.coalesce("insider_n", F.lit(0))
    ratio = F.when(F.col("turnover_rs") > 0, clamp(-0.5, 0.5, F.col("net_rs") / F.nullif("turnover_rs", F.lit(0.0))))
    df = df.withColumns(
        {
            "insider_n": n,
            "deal_ratio": ratio,
            "promoter_pts": clamp(0.0, 25.0, 12.5 + 5.0 * F.col("promoter_delta")),
            "insider_pts": F.when(n == 0, 7.5).otherwise(F.least(F.lit(15.0), 7.5 + n * 0.75)),
            "surv_pts": F.coalesce("surv_pts", F.lit(25.0)),
        }
    ).withColumn("deal_pts", 17.5 + 35.0 * F.col("deal_ratio"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    has = lambda c, wgt: F.when(F.col(c).isNotNull(), wgt).otherwise(0.0)
    df = df.withColumn("weight_covered", has("deal_pts", 35.0) + has("promoter_pts", 25.0) + 40.0)
    points = zero("deal_pts") + zero("promoter_pts") + F.col("insider_pts") + F.col("surv_pts")
    df = with_rounded(
        df.where(F.col("weight_covered") >= K.WEIGHT_FLOOR),
        {"score": (points * 100.0 / F.col("weight_covered"), 1), "confidence": (F.col("weight_covered") / 100.0, 2)},
    ).withColumn("score", F.least(F.lit(100.0), F.col("score")))
    if market_flow is not None:
        df = df.crossJoin(F.broadcast(market_context(market_flow, as_of)))
    return df.withColumns(
        {
            "label": F.when(F.col("surv_pts") <= 10.0, "surveillance")
            .when(F.col("score") >= 65, "accumulation")
            .when(F.col("score") <= 35, "distribution")
            .otherwise("neutral"),
            "as_of": as_of,
        }
    )
