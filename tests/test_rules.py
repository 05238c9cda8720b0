import json

import pytest
from pyspark.sql import functions as F

from tapeloom import constants as K
from tapeloom.plans import rules


def classify(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, feed string, subject string, description string")
    return [r.asDict() for r in rules.classify(df).orderBy("i").collect()]


CASES = [
    # feed, subject, description, category, check
    ("announcements", "Declaration of NAV", None, "other", lambda r: r["routine"] and r["materiality"] <= 1),
    ("announcements", "Trading Window closure", None, "other", lambda r: r["routine"]),
    ("announcements", "Resignation of Statutory Auditor", None, "auditor_resignation", lambda r: r["materiality"] == 9),
    ("announcements", "Resignation of internal auditor", None, "management_change", lambda r: r["materiality"] == 3),
    ("announcements", "Change in secretarial auditor: auditor resigned", None, "management_change", lambda r: r["materiality"] <= 4),
    ("announcements", "Resignation of statutory auditor and internal auditor", None, "auditor_resignation", lambda r: r["materiality"] == 9),
    ("announcements", "Board meeting intimation", "to consider financial results", "other", lambda r: r["routine"]),
    ("announcements", "Outcome of board meeting", "audited financial results", "results", lambda r: r["materiality"] == 5),
    ("announcements", "Credit rating downgrade", None, "credit_rating_change", lambda r: r["sentiment"] < 0 and r["materiality"] == 7),
    ("announcements", "Credit rating upgrade", None, "credit_rating_change", lambda r: r["sentiment"] > 0),
    ("sast_reg29", "substantial acquisition of shares", None, "insider_trade", lambda r: r["rule"] == "feed_authoritative:sast_reg29"),
    ("board_meetings", "Financial Results", None, "other", lambda r: r["routine"]),
    ("announcements", "corporate insolvency resolution", "audited financial results", "litigation", lambda r: r["materiality"] == 7),
    ("announcements", "Update under SEBI (LODR) on order received", None, "order_win", lambda r: r["sentiment"] > 0),
    ("announcements", "SEBI final order against the company", None, "regulatory_action", lambda r: r["materiality"] == 7),
    ("announcements", "Issue of commercial paper", None, "debt_raise", lambda r: r["materiality"] == 3),
    ("offer_documents", "prospectus of the company", None, "fundraise", lambda r: r["rule"] == "feed:offer_documents"),
    ("announcements", "plain words", None, None, lambda r: True),
    ("announcements", None, None, None, lambda r: True),
    ("announcements", "Record date for dividend", None, "dividend_bonus_split_buyback", lambda r: not r["routine"]),
]


def test_rule_cases(spark):
    got = classify(spark, *[c[:3] for c in CASES])
    for case, row in zip(CASES, got):
        assert row["category"] == case[3], (case, row)
        assert case[4](row), (case, row)


def test_earlier_rule_wins_equal_materiality(spark):
    row = classify(spark, ("announcements", "scheme of amalgamation and demerger", None))[0]
    assert row["category"] == "ma"


def test_finality_and_floor(spark):
    df = spark.createDataFrame(
        [("announcements", "fire at the plant", None), ("announcements", "plain", None), ("announcements", "buyback of shares", None)],
        "feed string, subject string, description string",
    )
    rows = {r["subject"]: r for r in rules.finalize(rules.classify(df)).collect()}
    assert rows["fire at the plant"]["confidence"] == pytest.approx(0.56)
    assert rows["fire at the plant"]["rule_trace"].endswith("|backlog_no_llm")
    assert (rows["plain"]["category"], rows["plain"]["materiality"], rows["plain"]["confidence"]) == ("other", 2, 0.2)
    assert rows["buyback of shares"]["confidence"] == 0.85
    floors = spark.createDataFrame([("order_win", 1), ("results", 1)], "c string, m int").select(rules.floor_materiality(F.col("c"), F.col("m"))).collect()
    assert [r[0] for r in floors] == [4, 1]


GOOD = {"category": "results", "materiality": 5, "sentiment": 0.1, "confidence": 0.9, "summary": "ok", "entities": {}}


def errors(spark, *raws):
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    return [r["error"] for r in rules.validate_model_output(df, "raw").orderBy("i").collect()]


def test_model_output_validation(spark):
    bad = lambda **kw: json.dumps({**GOOD, **kw})
    missing = {k: v for k, v in GOOD.items() if k != "summary"}
    got = errors(
        spark, f"text {json.dumps(GOOD)} text", "nothing", "{not json}", json.dumps(missing), bad(materiality=11), bad(materiality="5"),
        bad(materiality=True), bad(sentiment=-2), bad(category="gossip"), bad(summary=" ".join(["w"] * 41)), bad(entities=[1]), bad(category=5), None,
    )
    assert got == [
        None, "no json object", "no json object", "missing key: summary", "materiality: above 10", "materiality: expected number",
        "materiality: expected number", "sentiment: below -1", "category: not in allowed values", "summary: over 40 words",
        "entities: expected object", "category: expected string", "no json object",
    ]


def test_merge_prefers_confident_rule_and_keeps_floor(spark):
    df = spark.createDataFrame(
        [(1, "announcements", "fire at works", json.dumps({**GOOD, "confidence": 0.5, "materiality": 2})),
         (2, "announcements", "plain", json.dumps({**GOOD, "category": "ma", "materiality": 2})),
         (3, "announcements", "fire at works", json.dumps({**GOOD, "confidence": 0.95, "materiality": 8.5})),
         (4, "announcements", "fire at works", "broken")],
        "id int, feed string, subject string, raw string",
    ).withColumn("description", F.lit(None).cast("string"))
    checked = rules.validate_model_output(df, "raw")
    rows = {r["id"]: r for r in rules.merge_model_output(rules.classify(checked)).collect()}
    assert (rows[1]["category"], rows[1]["materiality"]) == ("fire_accident", 6)
    assert (rows[2]["category"], rows[2]["materiality"]) == ("ma", 6)
    assert (rows[3]["category"], rows[3]["materiality"]) == ("results", 8)
    assert rows[4]["rule_trace"].endswith("|llm_unavailable") and rows[4]["engine"] == "rules"


def test_vocabulary_is_closed():
    used = {c for _, c, *_ in K.SIGNAL_PATTERNS} | {v[0] for v in K.FEED_PRIORS.values()} | set(K.MATERIALITY_FLOORS)
    assert used <= set(K.CATEGORIES) and len(K.CATEGORIES) == 21 and len(K.FEEDS) == 23
