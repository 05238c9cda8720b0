"""Rule classifier: a rule pack turned into one column expression.

Tiers, in order: routine text, feeds that decide on their own, best signal pattern, feed
prior, nothing. The pack is data; the expression built from it stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom import constants as K
from tapeloom.functions.numeric import py_round

# (?d): only a newline ends a line, so '.' spans the same text in every engine
_FLAGS = "(?id)"

# Lower-case literals of which every match of the pattern holds at least one. Searching them
# is far cheaper than the pattern, so long texts meet only the few patterns that can match.
# A pattern without an entry is always searched.
ROUTINE_ANCHORS = {
    "nav_declaration": ["declaration of nav", "net asset value"],
    "trading_window": ["trading window", "window closure"],
    "newspaper_ad": ["newspaper"],
    "reg74_certificate": ["(5)"],
    "investor_meet": ["meet", "call", "investor presentation"],
    "share_certificate": ["share certificate", "issue of duplicate"],
    "board_meeting_intimation": ["board meeting"],
    "compliance_routine": ["compliance"],
    "monitoring_agency": ["monitoring agency report"],
    "disclosure_routine": ["spdi", "large corporate", "initial disclosure", "annual disclosure"],
}
SIGNAL_ANCHORS = [
    ["auditor"],
    ["order", "penalt", "search", "raid", "show", "investigation", "prohibit", "debar"],
    ["insolvency", "cirp", "liquidation order"],
    ["shut", "suspension", "halt", "closure"],
    ["fire", "accident", "explosion", "mishap"],
    ["rating"],
    ["rating"],
    ["rating", "icra", "crisil"],
    ["received", "award", "bagg", "secured", "won", "worth"],
    ["capacity expansion", "capacity addition", "new plant", "new facility", "new unit", "greenfield", "brownfield"],
    ["capex", "capital expenditure"],
    ["amalgamation", "merger", "acquisition", "acquire", "takeover", "slump sale"],
    ["demerger", "de-merger", "spin", "scheme of arrangement"],
    ["qip", "qualified institutional", "preferential ", "rights issue", "warrant", "fund"],
    ["ncd", "debenture", "commercial paper", "cp-", "bond issue", "debt"],
    ["buy"],
    ["dividend", "bonus ", "stock split", "division of"],
    ["financial results", "statement of "],
    ["guidance", "outlook "],
    ["director", "md", "ceo", "cfo", "chairman", "key managerial"],
    ["litigation", "arbitra", "legal proceedings", "court ", "writ petition"],
    ["clarification"],
    ["insider trading", "sast", "substantial acquisition", "disclosure under regulation", "trading plan"],
    ["pledge", "encumbrance"],
]

_HIT = "struct<materiality:int,order:int,category:string,sentiment:double,confidence:double,routine:boolean,rule:string>"


@dataclass(frozen=True)
class RulePack:
    routine: list = field(default_factory=lambda: K.ROUTINE_PATTERNS)
    signals: list = field(default_factory=lambda: K.SIGNAL_PATTERNS)
    priors: dict = field(default_factory=lambda: K.FEED_PRIORS)
    authoritative: list = field(default_factory=lambda: K.AUTHORITATIVE_FEEDS)
    floors: dict = field(default_factory=lambda: K.MATERIALITY_FLOORS)
    version: str = K.CLASSIFIER_VERSION

    def anchors(self) -> dict[str, list[str]]:
        """Literals by pattern, for the patterns of the built-in pack that are still in use."""
        known = {p: ROUTINE_ANCHORS[n] for n, p in K.ROUTINE_PATTERNS}
        known.update({row[0]: a for row, a in zip(K.SIGNAL_PATTERNS, SIGNAL_ANCHORS)})
        return known


def _hit(materiality, order, category, sentiment, confidence, routine, rule) -> Column:
    as_col = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    return F.struct(
        as_col(materiality, "int").alias("materiality"),
        as_col(order, "int").alias("order"),
        as_col(category, "string").alias("category"),
        as_col(sentiment, "double").alias("sentiment"),
        as_col(confidence, "double").alias("confidence"),
        as_col(routine, "boolean").alias("routine"),
        as_col(rule, "string").alias("rule"),
    )


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(_FLAGS + pattern)


def rule_hit(feed: Column, text: Column, lowered: Column, pack: RulePack | None = None) -> Column:
    """Struct of the winning rule, or null when no tier applies; ``lowered`` is lower(text)."""
    pack = pack or RulePack()
    none = F.lit(None).cast(_HIT)
    anchors = pack.anchors()

    def matches(pattern: str) -> Column:
        found = _has(text, pattern)
        if pattern not in anchors:
            return found
        return reduce(lambda a, b: a | b, [lowered.contains(x) for x in anchors[pattern]]) & found

    routine = none
    for name, pattern in reversed(pack.routine):
        routine = F.when(
            matches(pattern), _hit(1, 0, "other", 0.0, 0.9, True, f"routine:{name}")
        ).otherwise(routine)

    def prior(prefix: str, feeds) -> Column:
        out = none
        for name in feeds:
            c, m, s, conf, r = pack.priors[name]
            out = F.when(feed == name, _hit(m, 0, c, s, conf, r, f"{prefix}:{name}")).otherwise(out)
        return out

    internal = _has(text, K.NON_STATUTORY_AUDITOR) & ~_has(text, K.STATUTORY_AUDITOR)
    cited = _has(text, K.REGULATION_CITATION) & ~_has(text, K.ENFORCEMENT_MARKER)
    hits = []
    for i, (pattern, category, mat, sent, conf) in enumerate(pack.signals):
        found, rule = matches(pattern), f"pattern:{pattern[:40]}"
        hit = _hit(mat, -i, category, sent, conf, False, rule)
        if category == "auditor_resignation":
            softer = _hit(3, -i, "management_change", -0.1, conf, False, rule + "|non_statutory_auditor")
            hit = F.when(internal, softer).otherwise(hit)
        if category == "regulatory_action":
            found = found & ~cited
        hits.append(F.when(found, hit))
    # struct order: highest materiality, then the earliest rule
    signal = F.array_max(F.array_compact(F.array(*hits)))

    return F.coalesce(
        routine,
        prior("feed_authoritative", [f for f in pack.authoritative if f in pack.priors]),
        signal,
        prior("feed", pack.priors),
    )


def filing_text() -> Column:
    return F.concat_ws(" ", F.nullif(F.col("subject"), F.lit("")), F.nullif(F.col("description"), F.lit("")))


def floor_materiality(category: Column, materiality: Column, floors: dict | None = None) -> Column:
    floor = F.lit(0)
    for name, value in (floors or K.MATERIALITY_FLOORS).items():
        floor = F.when(category == name, value).otherwise(floor)
    return F.greatest(materiality, floor)


def classify(filings: DataFrame, pack: RulePack | None = None) -> DataFrame:
    """Adds the raw rule columns; ``rule`` is null where no rule fired."""
    df = filings.withColumn("_text", filing_text()).withColumn("_lowered", F.lower("_text"))
    return df.withColumn("_hit", rule_hit(F.col("feed"), F.col("_text"), F.col("_lowered"), pack)).select(
        *filings.columns,
        *[F.col(f"_hit.{c}").alias(c) for c in ("category", "materiality", "sentiment", "confidence", "routine", "rule")],
    )


def is_final() -> Column:
    return F.col("rule").isNotNull() & (F.col("routine") | (F.col("confidence") >= K.RULE_FINAL_CONFIDENCE))


def finalize(ruled: DataFrame, *, suffix: str = "backlog_no_llm", pack: RulePack | None = None) -> DataFrame:
    """Classification rows when rules must decide alone: weak hits lose confidence."""
    pack = pack or RulePack()
    none, final = F.col("rule").isNull(), is_final()
    return ruled.select(
        *[c for c in ruled.columns if c not in ("category", "materiality", "sentiment", "confidence", "routine", "rule")],
        F.coalesce("category", F.lit("other")).alias("category"),
        F.when(none, 2).otherwise(floor_materiality(F.col("category"), F.col("materiality"), pack.floors)).alias("materiality"),
        F.coalesce("sentiment", F.lit(0.0)).alias("sentiment"),
        F.when(none, 0.2).when(final, F.col("confidence")).otherwise(F.col("confidence") * K.DEGRADED_FACTOR).alias("confidence"),
        F.coalesce("routine", F.lit(False)).alias("routine"),
        F.lit("rules").alias("engine"),
        F.when(none, f"no_rule|{suffix}").when(final, F.col("rule")).otherwise(F.concat("rule", F.lit(f"|{suffix}"))).alias("rule_trace"),
        F.lit(pack.version).alias("model_version"),
    )


def validate_model_output(df: DataFrame, raw: str) -> DataFrame:
    """Parses the outermost JSON object in ``raw`` and checks it strictly.

    Adds ``error`` (null when valid) and the typed fields ``m_category``, ``m_materiality``,
    ``m_sentiment``, ``m_confidence``, ``m_summary``, ``m_entities``.
    """
    slice_ = F.nullif(F.regexp_extract(F.coalesce(F.col(raw), F.lit("")), r"(?s)(\{.*\})", 1), F.lit(""))
    v = F.try_parse_json(slice_)
    df = df.withColumn("_v", v)
    field_ = lambda k: F.try_variant_get("_v", f"$.{k}", "variant")
    kind = lambda k: F.schema_of_variant(field_(k))
    number = lambda k: F.try_variant_get("_v", f"$.{k}", "double")
    string = lambda k: F.try_variant_get("_v", f"$.{k}", "string")
    is_number = lambda k: kind(k).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
    error = F.when(F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT"), F.lit("no json object"))

    def check(key, *tests):
        nonlocal error
        error = error.when(field_(key).isNull(), f"missing key: {key}")
        for bad, message in tests:
            error = error.when(bad, f"{key}: {message}")

    check("category", (kind("category") != "STRING", "expected string"),
          (~string("category").isin(K.CATEGORIES), "not in allowed values"))
    for key, lo, hi in (("materiality", 0, 10), ("sentiment", -1, 1), ("confidence", 0, 1)):
        check(key, (~is_number(key), "expected number"), (number(key) < lo, f"below {lo}"), (number(key) > hi, f"above {hi}"))
    words = F.size(F.filter(F.split(F.trim(string("summary")), r"\s+"), lambda x: x != ""))
    check("summary", (kind("summary") != "STRING", "expected string"), (words > 40, "over 40 words"))
    check("entities", (~kind("entities").startswith("OBJECT"), "expected object"))
    df = df.withColumn("error", error)
    ok = F.col("error").isNull()
    return df.withColumns(
        {
            "m_category": F.when(ok, string("category")),
            "m_materiality": F.when(ok, number("materiality")),
            "m_sentiment": F.when(ok, number("sentiment")),
            "m_confidence": F.when(ok, number("confidence")),
            "m_summary": F.when(ok, string("summary")),
            "m_entities": F.when(ok, F.to_json(field_("entities"))),
        }
    ).drop("_v")


def merge_model_output(ruled: DataFrame, pack: RulePack | None = None) -> DataFrame:
    """Classification rows where a checked model row exists beside the rule hit.

    Final rules stand. Otherwise the model row leads, a more confident rule keeps its
    category, and floors always survive. Rows without a model row degrade like the backlog.
    """
    pack = pack or RulePack()
    final = is_final()
    has_model = F.col("m_category").isNotNull()
    rule_leads = F.col("rule").isNotNull() & (F.col("confidence") > F.col("m_confidence"))
    m = py_round(F.col("m_materiality"), 0).cast("int")
    category = F.when(rule_leads, F.col("category")).otherwise(F.col("m_category"))
    merged_m = F.when(rule_leads, F.greatest(m, F.col("materiality"))).otherwise(m)
    use = has_model & ~final
    keep = [c for c in ruled.columns if c not in ("category", "materiality", "sentiment", "confidence", "routine", "rule")]
    merged = ruled.select(
        *keep,
        F.struct(
            category.alias("category"),
            floor_materiality(category, merged_m, pack.floors).alias("materiality"),
            F.col("m_sentiment").alias("sentiment"),
            F.col("m_confidence").alias("confidence"),
            F.lit(False).alias("routine"),
            F.lit("model").alias("engine"),
            F.col("rule").alias("rule_trace"),
        ).alias("_model"),
        F.coalesce(use, F.lit(False)).alias("_use"),
        *[F.col(c) for c in ("category", "materiality", "sentiment", "confidence", "routine", "rule")],
    )
    names = ("category", "materiality", "sentiment", "confidence", "routine", "engine", "rule_trace")
    decided = finalize(merged, suffix="llm_unavailable", pack=pack)
    return decided.select(
        *keep,
        *[F.when(F.col("_use"), F.col(f"_model.{n}")).otherwise(F.col(n)).alias(n) for n in names],
        F.when(F.col("_use"), F.nullif(F.substring("m_summary", 1, 500), F.lit(""))).alias("summary"),
        F.when(F.col("_use"), F.col("m_entities")).alias("entities"),
        "model_version",
    )


def fresh(observed_at: Column, now: Column) -> Column:
    """Live rows may wait for a model; older ones are decided by rules alone."""
    return observed_at >= now - F.expr(f"INTERVAL {K.FRESH_HOURS} HOURS")
