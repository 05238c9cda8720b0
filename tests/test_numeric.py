import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tapeloom.functions import numeric as N, text as X


def test_py_round_matches_python(spark):
    rng = random.Random(3)
    values = [2.675, 1.005, 0.15, 0.25, 0.35, 67.25, 67.35, -2.675, -0.05, 0.0, 1e9 + 0.05]
    values += [rng.uniform(-1000, 1000) for _ in range(3000)] + [round(rng.uniform(0, 100), 3) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 4):
        for x, y in df.select("x", N.py_round(F.col("x"), digits)).collect():
            assert y == round(x, digits), (x, digits, y)


def test_clamp_keeps_null(spark):
    row = spark.sql("SELECT cast(null as double) a, 7.0D b").select(N.clamp(0, 5, F.col("a")), N.clamp(0, 5, F.col("b"))).first()
    assert tuple(row) == (None, 5.0)


def test_clean_number(spark):
    df = spark.createDataFrame([("1,234.5",), ("-",), (" ",), (None,), ("x",), (" 7 ",)], "t string")
    assert [r[0] for r in df.select(N.clean_number("t")).collect()] == [1234.5, None, None, None, None, 7.0]


def fields(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(X.summary_fields(F.col("t"))).first()[0]


def test_summary_fields(spark):
    assert fields(spark, "A: x |SUBJECT: y") == {"A": "x", "SUBJECT": "y"}
    assert fields(spark, "free words |SUBJECT: y") == {"_text": "free words", "SUBJECT": "y"}
    assert fields(spark, "K: 1 | K: 2") == {"K": "2"}
    assert fields(spark, "") == {} and fields(spark, None) == {}
    assert fields(spark, "one | two: " + "x") == {"_text": "one", "TWO": "x"}
    assert fields(spark, "note (a_b): z") == {"_text": "note (a_b): z"}
    assert fields(spark, "URL: http://a:1/b") == {"URL": "http://a:1/b"}


def one(spark, column, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return row.select(column).first()[0]


def test_links(spark):
    link = "https://f.example/corporate/BHARTIARTL_05082026000335_x.pdf"
    assert one(spark, X.symbol_from_link(F.col("l")), l=link) == "BHARTIARTL"
    assert one(spark, X.symbol_from_link(F.col("l")), l="https://f.example/corporate/M&M_01082026120000_x.pdf") == "M&M"
    assert one(spark, X.symbol_from_link(F.col("l")), l="https://f.example/corporate/BAJAJ-AUTO_01082026120000.pdf") == "BAJAJ-AUTO"
    assert one(spark, X.symbol_from_link(F.col("l")), l="https://f.example/corporate/xbrl/INDAS_121277_1705282_30072026051753.xml") is None
    at = F.date_format(X.time_from_link(F.col("l")), "yyyy-MM-dd HH:mm:ss")
    assert one(spark, at, l="x/BRSR_1_20260804_233837946.xml") == "2026-08-04 18:08:37"
    assert one(spark, at, l="x/AR_10030945_04082026232241.pdf") == "2026-08-04 17:52:41"
    assert one(spark, at, l="x/none.pdf") is None
    assert one(spark, X.attachment_url(F.col("l")), l="http://x/A.PDF") == "http://x/A.PDF"
    assert one(spark, X.attachment_url(F.col("l")), l="http://x/a.html") is None


def test_published_at(spark):
    at = F.date_format(X.published_at(F.col("p")), "yyyy-MM-dd HH:mm:ss")
    assert one(spark, at, p="05-Aug-2026 00:03:49") == "2026-08-04 18:33:49"
    assert one(spark, at, p="05-AUG-2026 10:30") == "2026-08-05 05:00:00"
    assert one(spark, at, p="05-Aug-2026") == "2026-08-04 18:30:00"
    assert one(spark, at, p="soon") is None and one(spark, at, p="") is None


def test_general_format(spark):
    for value, text in ((100.0, "100"), (92.5, "92.5"), (1234.567, "1234.57"), (0.5, "0.5"), (123456.0, "123456")):
        df = spark.createDataFrame([(value,)], "x double")
        assert df.select(X.general(F.col("x"))).first()[0] == text == f"{value:g}"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=40))
def test_py_round_property(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[1] == round(r[0], 2) for r in df.select("x", N.py_round(F.col("x"), 2)).collect()] == [True] * len(values)


def test_number_texts_equal_plain_formatting(spark):
    from tapeloom.functions import text as X

    rng = random.Random(11)
    values = [0.0, 62.5, 63.5, 0.5, 1.5, 2.675, -0.2, 1e6, 999999.5, 999999.4, 9.999995, 12345678.9, 1234567.0, 0.0001234567, 0.001, 100.0, 1e-5, -4.25, 0.15, 99.95]
    values += [round(rng.uniform(-2000, 2000), rng.randrange(0, 5)) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select("x", X.fixed(F.col("x"), 0).alias("f0"), X.fixed(F.col("x"), 1, plus=True).alias("f1"), X.general(F.col("x")).alias("g"), X.shortest(F.col("x")).alias("s")).collect()
    for r in rows:
        assert (r.f0, r.f1, r.g) == (f"{r.x:.0f}", f"{r.x:+.1f}", f"{r.x:g}"), r
        assert r.s == repr(r.x) or abs(r.x) < 1e-4
    assert spark.range(1).select(X.fixed(F.lit(None).cast("double"), 1).alias("n")).first().n is None
