"""Proximity matches of benchmark windows."""

from tapeloom.llm import decontaminate


def test_case_and_absent_words(spark):
    docs = spark.createDataFrame([(1, "Delta and then ALPHA gamma"), (2, "gamma delta"), (3, "alpha gamma"), (4, "Kappa of the Iota"), (5, "kappa alone")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta delta"), (2, "iota kappa of"), (3, "nowhere gamma"), (4, "kappa")], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert {i: r.n_near for i, r in found.items()} == {1: 1, 2: 0, 3: 0, 4: 1, 5: 0}
    assert {i for i, r in found.items() if r.contaminated} == {4, 5}


def test_large_term_tables_give_the_same(spark, monkeypatch):
    """Without any broadcast: the same rows, and no exchange of word arrays by token."""
    from pyspark.sql import functions as F

    rows = [(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(60)), "s") for i in range(40)] + [(None, "w1 w2 w3", "s"), (3, None, "s"), (5, "Alpha beta gamma", "s"), (5, "Alpha beta gamma", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, " ".join(f"w{j}" for j in range(20, 33))), (2, "alpha beta gamma"), (3, "w1 w2"), (4, "w5 absent w7 w8 w9 w10 w11 w12 w13 w14")], "item_id long, text string")
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(decontaminate.decontaminate(df, items).collect(), key=key)
    monkeypatch.setattr(decontaminate, "BROADCAST_MB", -1)
    found = decontaminate.decontaminate(df, items)
    assert sorted(found.collect(), key=key) == want and sum(r.contaminated for r in want) > 2
    docs = decontaminate.keyed(df, "doc_id", "text")
    spark.createDataFrame([("w1",), ("alpha",)], "term string").createOrReplaceTempView("anchor_terms")
    text = decontaminate.postings(docs, spark.table("anchor_terms").select(F.col("term")), 10)._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in text.split("\n") if "Generate posexplode" in line)
    assert "Generate posexplode(w" in generate and ", [" in generate  # the array itself is not carried beside the places
