"""Fusion of the score families and disclosure events into stances with levels and reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType

from tapeloom import constants as K
from tapeloom.functions.numeric import clamp, days_between, decay, py_round, with_rounded
from tapeloom.functions.text import fixed, shortest
from tapeloom.operators.fold import ordered_fold
from tapeloom.operators.keyed import latest_per_key, top_per_key

AXES = ("fundamental", "technical", "flow", "event")
EVIDENCE = "array<struct<materiality:int,filing_id:bigint,category:string,sentiment:double,peer:string,industry:string,subject:string>>"


def profile_table(spark: SparkSession, profiles: dict | None = None) -> DataFrame:
    """One row per weight profile; weights must sum to 100."""
    rows = []
    for name, (f, t, fl, e, horizon, stop, lo, hi) in (profiles or K.PROFILES).items():
        if f + t + fl + e != 100:
            raise ValueError(f"weights of profile {name} must sum to 100")
        rows.append((name, float(f), float(t), float(fl), float(e), horizon, stop, lo, hi))
    return spark.createDataFrame(
        rows,
        "profile string, w_fundamental double, w_technical double, w_flow double, w_event double,"
        " horizon string, stop_atr double, t_low double, t_high double",
    )


# ---------------------------------------------------------------- events

def classified_events(filings: DataFrame, classifications: DataFrame, version: str = K.CLASSIFIER_VERSION) -> DataFrame:
    """Non-routine classified filings of one model version, m >= 3."""
    c = classifications.where(
        (F.col("model_version") == version) & ~F.col("routine") & (F.col("materiality") >= K.EVENT_MIN_MATERIALITY)
    ).select("filing_id", "category", "materiality", "sentiment", "confidence", F.col("observed_at").alias("classified_at"))
    f = filings.where(F.col("symbol").isNotNull()).select("filing_id", "symbol", "subject", "event_at")
    return f.join(c, "filing_id")


def _push(now: Column, ts: Column) -> Column:
    w = decay(days_between(now, ts), K.HALF_LIFE_DAYS["event"]) * (F.col("materiality") / 10.0) * F.col("confidence")
    return 50.0 * w * F.col("sentiment")


def _evidence(peer: Column, industry: Column, width: int = 80) -> Column:
    item = F.struct(
        F.col("materiality"), F.col("filing_id"), F.col("category"), F.col("sentiment"),
        peer.cast("string").alias("peer"), industry.cast("string").alias("industry"), F.substring(F.coalesce("subject", F.lit("")), 1, width).alias("subject"),
    )
    # at most EVENT_TOP_K items reach this aggregate
    return F.reverse(F.array_sort(F.collect_list(item)))


def event_scores(
    events: DataFrame, now: Column, *, keys: Sequence[str] = ("symbol",), visibility: str = "observed"
) -> DataFrame:
    """(keys, event_score, event_conf, evidence) from the ten weightiest events of 30 days.

    ``visibility='event'`` dates a filing by its event time, for reconstructed replays.
    """
    seen = F.col("classified_at") if visibility == "observed" else F.col("event_at")
    age_from = seen if visibility == "observed" else F.coalesce("event_at", "classified_at")
    window = (seen >= now - F.expr(f"INTERVAL {K.EVENT_WINDOW_DAYS} DAYS")) & (seen <= now)
    top = top_per_key(
        events.where(window), list(keys), [F.col("materiality").desc(), F.col("filing_id")], K.EVENT_TOP_K
    )
    agg = top.groupBy(*keys).agg(
        F.sum(_push(now, age_from)).alias("_push"), F.max("confidence").alias("_conf"),
        _evidence(F.lit(None), F.lit(None)).alias("evidence"),
    )
    return agg.select(
        *keys, clamp(0.0, 100.0, 50.0 + F.col("_push")).alias("event_score"),
        F.least(F.lit(1.0), F.col("_conf")).alias("event_conf"), "evidence",
    )


def peer_event_scores(events: DataFrame, securities: DataFrame, now: Column, *, visibility: str = "observed") -> DataFrame:
    """(symbol, peer_score, peer_conf, peer_evidence): same-industry events, damped.

    A symbol needs the eight weightiest events of its industry that are not its own. A symbol
    owns at most eight rows of a list capped at eight per symbol, so the first sixteen rows
    of that list always contain them: the join fans out by sixteen, never by all pairs.
    """
    seen = F.col("classified_at") if visibility == "observed" else F.col("event_at")
    heavy = events.where(
        (F.col("materiality") >= K.PEER_MIN_MATERIALITY)
        & (seen >= now - F.expr(f"INTERVAL {K.EVENT_WINDOW_DAYS} DAYS")) & (seen <= now)
    )
    order = [F.col("materiality").desc(), F.col("filing_id")]
    homes = securities.where(F.col("industry").isNotNull() & (F.col("industry") != "")).select("symbol", "industry")
    capped = top_per_key(heavy, ["symbol"], order, K.PEER_TOP_K).join(homes, "symbol")
    pool = top_per_key(capped, ["industry"], order, 2 * K.PEER_TOP_K).withColumnRenamed("symbol", "peer")
    pairs = homes.join(pool, "industry").where(F.col("symbol") != F.col("peer"))
    top = top_per_key(pairs, ["symbol"], order, K.PEER_TOP_K)
    agg = top.groupBy("symbol").agg(
        F.sum(_push(now, F.col("classified_at")) * K.PEER_DAMPING).alias("_push"), F.max("confidence").alias("_conf"),
        _evidence(F.col("peer"), F.col("industry"), 70).alias("peer_evidence"),
    )
    return agg.select(
        "symbol", clamp(0.0, 100.0, 50.0 + F.col("_push")).alias("peer_score"),
        (F.least(F.lit(1.0), F.col("_conf")) * K.PEER_DAMPING).alias("peer_conf"), "peer_evidence",
    )


def fold_peers(own: DataFrame, peers: DataFrame) -> DataFrame:
    """Event axis of every symbol with own or peer events."""
    df = own.join(peers, "symbol", "full_outer")
    base, conf = F.coalesce("event_score", F.lit(50.0)), F.coalesce("event_conf", F.lit(0.0))
    has_peer = F.coalesce("peer_conf", F.lit(0.0)) > 0
    none = F.array().cast(EVIDENCE)
    return df.select(
        "symbol",
        F.when(has_peer, clamp(0.0, 100.0, base + (F.col("peer_score") - 50.0))).otherwise(base).alias("event_score"),
        F.when(has_peer, F.greatest(conf, F.col("peer_conf"))).otherwise(conf).alias("event_conf"),
        F.when(has_peer, F.concat(F.coalesce("evidence", none), F.col("peer_evidence")))
        .otherwise(F.coalesce("evidence", none)).alias("evidence"),
    )


# ---------------------------------------------------------------- fusion core

def weighted_fusion(df: DataFrame, floor: float = K.WEIGHT_FLOOR) -> DataFrame:
    """Adds conviction, confidence and weight_covered; drops rows covering too little weight.

    Reads ``<axis>_score``, ``<axis>_conf`` and ``w_<axis>``; an axis with a null score is absent.
    """
    total = conviction = conf = F.lit(0.0)
    for a in AXES:
        here, w = F.col(f"{a}_score").isNotNull(), F.col(f"w_{a}")
        conviction = conviction + F.when(here, w * F.col(f"{a}_score") / 100.0).otherwise(0.0)
        conf = conf + F.when(here, w * F.col(f"{a}_conf")).otherwise(0.0)
        total = total + F.when(here, w).otherwise(0.0)
    covered = df.withColumn("weight_covered", total).where(F.col("weight_covered") >= floor)
    return with_rounded(
        covered, {"conviction": (conviction * 100.0 / F.col("weight_covered"), 1), "confidence": (conf / 100.0, 2)}
    )


def stance_of(conviction: Column, verdict: Column) -> Column:
    return (
        F.when(verdict == "hard_block", "suppressed")
        .when(conviction >= 70, "buy").when(conviction >= 60, "accumulate")
        .when(conviction >= 40, "hold").when(conviction >= 25, "reduce").otherwise("exit")
    )


def with_levels(df: DataFrame) -> DataFrame:
    """Entry, target, stop and size by stance; reads close, atr14 and the profile geometry."""
    close, atr = F.nullif(F.col("close"), F.lit(0.0)), F.nullif(F.col("atr14"), F.lit(0.0))
    ok = close.isNotNull() & atr.isNotNull()
    df = with_rounded(df, {"_stop": (close - F.col("stop_atr") * atr, 2)})
    risk = close - F.col("_stop")
    size = F.least(F.lit(10.0), 1.0 / (F.col("stop_atr") * atr / close))
    levels = {
        "entry_low": (close - 0.5 * atr, 2),
        "entry_high": (close + 0.25 * atr, 2),
        "target_low": (close + F.col("t_low") * risk, 2),
        "target_high": (close + F.col("t_high") * risk, 2),
        "size_pct": (F.when(F.col("risk_verdict") == "penalty", size / 2.0).otherwise(size), 1),
    }
    df = with_rounded(df, levels)
    long_side = ok & F.col("stance").isin("buy", "accumulate")
    keeps_stop = ok & F.col("stance").isin("buy", "accumulate", "reduce", "hold")
    return df.withColumns(
        {**{n: F.when(long_side, F.col(n)) for n in levels}, "invalidation": F.when(keeps_stop, F.col("_stop"))}
    ).drop("_stop")


def fusion_inputs(
    fundamental: DataFrame, technical: DataFrame, flow: DataFrame, risk: DataFrame, events: DataFrame, now: Column
) -> DataFrame:
    """One wide row per symbol with at least two score families.

    Every side is unique per symbol. Axis confidence decays with the age of the score; a
    stored confidence of zero or null counts as one half.
    """
    def axis(df: DataFrame, name: str, extra: Sequence[Column] = ()) -> DataFrame:
        age = days_between(now, F.col("as_of").cast("timestamp"))
        stored = F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5))
        return df.select(
            "symbol", F.col("score").alias(f"{name}_score"),
            (stored * decay(age, K.HALF_LIFE_DAYS[name])).alias(f"{name}_conf"),
            F.col("label").alias(f"{name}_label"),
            F.xxhash64(F.lit(name), "symbol", "as_of").alias(f"{name}_score_id"), *extra,
        )

    f = axis(fundamental, "fundamental", [F.col("rev_yoy"), F.col("flags"), F.col("n_quarters"), F.col("basis")])
    technical = with_rounded(technical, {"atr14": (F.col("atr"), 2), "rsi14": (F.col("rsi"), 1)})
    t = axis(technical, "technical", [F.col("close"), F.col("atr14"), F.col("sma200"), F.col("rsi14")])
    fl = axis(flow, "flow", [F.col("deal_ratio"), F.col("promoter_delta")])
    df = f.join(t, "symbol", "full_outer").join(fl, "symbol", "full_outer")
    families = sum((F.when(F.col(f"{a}_score").isNotNull(), 1).otherwise(0) for a in AXES[:3]), F.lit(0))
    df = df.where(families >= 2)
    df = df.join(events, "symbol", "left")
    present = F.coalesce("event_conf", F.lit(0.0)) > 0
    df = df.withColumns(
        {
            "event_axis": F.coalesce("event_score", F.lit(50.0)),
            "event_score": F.when(present, F.col("event_score")),
            "event_conf": F.when(present, F.col("event_conf")),
            "evidence": F.coalesce("evidence", F.array().cast(EVIDENCE)),
        }
    )
    r = risk.select("symbol", "verdict", "hard_blocks", "penalties",
                    F.xxhash64(F.lit("risk"), "symbol", "as_of").alias("risk_score_id"))
    return df.join(r, "symbol", "left").withColumn("risk_verdict", F.coalesce("verdict", F.lit("unassessed"))).drop("verdict")


def fuse(inputs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(symbol, profile) rows with stance, conviction, confidence, levels and size.

    The profile table is a handful of rows, so the cross join is a bounded fan-out.
    """
    df = weighted_fusion(inputs.crossJoin(F.broadcast(profiles)))
    verdict = F.col("risk_verdict")
    capped = (
        F.when(verdict == "hard_block", 0.0)
        .when(verdict == "penalty", F.least(F.col("conviction"), F.lit(K.PENALTY_CAP)))
        .otherwise(F.col("conviction"))
    )
    df = df.withColumn("conviction", capped)
    return with_levels(df.withColumn("stance", stance_of(F.col("conviction"), verdict)))


# ---------------------------------------------------------------- reasons

def with_thesis(df: DataFrame) -> DataFrame:
    """Reasons for and against (three each), the view changer and the evidence ids.

    Every line is built from stored numbers; an axis without weight is not cited.
    """
    counts = lambda a: F.col(f"{a}_score").isNotNull() & (F.col(f"w_{a}") > 0)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    number = lambda c: F.coalesce(shortest(c), F.lit("None"))
    say = F.format_string
    tech = say("technical %s/100 (%s); close %s vs SMA200 %s, RSI %s [score#%s]", fixed(F.col("technical_score"), 0),
               F.col("technical_label"), number(F.col("close")), number(py_round(F.col("sma200"), 1)), number(F.col("rsi14")),
               text(F.col("technical_score_id")))
    yoy = F.coalesce(F.concat(fixed(F.col("rev_yoy") * 100.0, 0), F.lit("%")), F.lit("n/a"))
    fund = say("fundamentals %s/100 over %sq (%s); rev YoY %s [score#%s]", fixed(F.col("fundamental_score"), 0),
               text(F.col("n_quarters")), text(F.col("basis")), yoy, text(F.col("fundamental_score_id")))
    flow = F.concat(
        say("flow %s/100 (%s) [score#%s]", fixed(F.col("flow_score"), 0), F.col("flow_label"), text(F.col("flow_score_id"))),
        F.coalesce(F.concat(F.lit("; 20d large-deal net ratio "), fixed(py_round(F.col("deal_ratio"), 4) * 100.0, 1, plus=True), F.lit("%")), F.lit("")),
        F.coalesce(F.concat(F.lit("; promoter Δ "), fixed(py_round(F.col("promoter_delta"), 2), 2, plus=True), F.lit("pp")), F.lit("")),
    )
    one = lambda cond, line: F.array_compact(F.array(F.when(cond, line)))
    # columns of their own, so that each text is made once
    df = df.withColumns({"_technical": tech, "_fundamental": fund, "_flow": flow})
    tech, fund, flow = F.col("_technical"), F.col("_fundamental"), F.col("_flow")
    lines = {"technical": tech, "fundamental": fund, "flow": flow}
    none = F.array().cast("array<string>")
    flags = F.when(
        counts("fundamental"),
        F.transform(F.slice(F.coalesce("flags", none), 1, 2),
                    lambda x: F.concat(F.lit("forensic flag: "), x, F.lit(" [score#"), text(F.col("fundamental_score_id")), F.lit("]"))),
    ).otherwise(none)
    event_line = lambda e: F.concat(
        F.when(e["peer"].isNotNull(), F.concat(F.lit("peer event ("), e["peer"], F.lit(", "), F.coalesce(e["industry"], F.lit("")), F.lit("): "))).otherwise(""),
        e["category"], F.lit(" m"), e["materiality"].cast("string"), F.lit(" ("), e["subject"],
        F.lit(") [filing#"), e["filing_id"].cast("string"), F.lit("]"),
    )
    cited = F.slice("evidence", 1, 3)
    good = F.transform(F.filter(cited, lambda e: e["sentiment"] > 0), event_line)
    bad = F.transform(F.filter(cited, lambda e: e["sentiment"] <= 0), event_line)
    risk_lines = lambda col, word: F.transform(
        F.slice(F.coalesce(col, none), 1, 3),
        lambda x: F.concat(F.lit(f"A6 {word}: "), x, F.lit(" [score#"), text(F.col("risk_score_id")), F.lit("]")),
    )
    pro = F.concat(*[one(counts(a) & (F.col(f"{a}_score") >= 55), l) for a, l in lines.items()], good)
    con = F.concat(
        one(counts("technical") & (F.col("technical_score") < 55), tech),
        one(counts("fundamental") & (F.col("fundamental_score") < 55), fund), flags,
        one(counts("flow") & (F.col("flow_score") < 55), flow), bad,
        risk_lines("hard_blocks", "block"), risk_lines("penalties", "penalty"),
    )
    blocks = F.coalesce("hard_blocks", none)
    changer = (
        F.when(F.size(blocks) > 0, F.concat(F.lit("A6 clearing its block would restore scoring (currently: "), F.get(blocks, F.lit(0)), F.lit(")")))
        .when(counts("technical") & F.col("invalidation").isNotNull(),
              F.concat(F.lit("a close below "), shortest(F.col("invalidation")), F.lit(" (this profile's ATR stop) invalidates the technical basis")))
        .when(counts("fundamental"), "next quarterly result reversing the fundamental trend")
        .otherwise("any high-materiality filing (event coverage is the only input)")
    )
    return df.withColumns(
        {
            "thesis_for": F.slice(pro, 1, 3), "thesis_against": F.slice(con, 1, 3), "view_changer": changer,
            "event_filings": F.transform("evidence", lambda e: e["filing_id"]),
        }
    ).drop("_technical", "_fundamental", "_flow")


# ---------------------------------------------------------------- issuing

def reissue(prev_stance: Column, prev_conviction: Column, prev_version: Column, version: Column) -> Column:
    """True when a candidate differs enough from the previous issue."""
    same = (
        (prev_stance == F.col("stance"))
        & (F.abs(prev_conviction - F.col("conviction")) <= K.HYSTERESIS)
        & (prev_version == version)
    )
    return ~F.coalesce(same, F.lit(False))


def issue(candidates: DataFrame, issued: DataFrame, version: str = K.FUSION_VERSION) -> DataFrame:
    """Candidates that pass hysteresis against the newest issued row of (symbol, profile)."""
    prev = latest_per_key(issued, ["symbol", "profile"], "as_of", "signal_id").select(
        "symbol", "profile", F.col("stance").alias("_stance"), F.col("conviction").alias("_conviction"),
        F.col("model_version").alias("_version"),
    )
    joined = candidates.join(prev, ["symbol", "profile"], "left")
    return joined.where(reissue(F.col("_stance"), F.col("_conviction"), F.col("_version"), F.lit(version))).drop(
        "_stance", "_conviction", "_version"
    ).withColumn("model_version", F.lit(version))


def replay_hysteresis(candidates: DataFrame) -> DataFrame:
    """Adds ``issued`` to a history of candidates; each decision looks at the last issued row.

    One candidate per (symbol, profile) and pass, streamed in time order with one row of state.
    """
    def step(last, stance, conviction, version):
        hold = (
            last is not None and last[0] == stance and last[2] == version
            and abs(last[1] - conviction) <= K.HYSTERESIS
        )
        return (last, False) if hold else ((stance, conviction, version), True)

    return ordered_fold(
        candidates, ["symbol", "profile"], ["as_of"], ["stance", "conviction", "model_version"],
        lambda: None, step, "issued", BooleanType(),
    )


def issue_stats(candidates: DataFrame, issued: DataFrame) -> DataFrame:
    c = candidates.agg(F.count(F.lit(1)).alias("considered"))
    i = issued.agg(F.count(F.lit(1)).alias("issued"), F.count_if(F.col("stance") == "suppressed").alias("suppressed"))
    return c.crossJoin(F.broadcast(i)).withColumn("held_by_hysteresis", F.col("considered") - F.col("issued"))


def latest_scores(scores: DataFrame) -> DataFrame:
    """Newest score per (symbol, agent), agents as columns."""
    last = latest_per_key(scores, ["symbol", "agent"], "as_of", "score_id")
    return last.groupBy("symbol").pivot("agent", ["a3", "a4", "a5", "a6"]).agg(F.first("score"))
