"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

import corpus_pipeline
from tapeloom.llm import components, decontaminate, htmltext, langid, linededup, lm, pieces, pii, quality, simhash, toxicity
from tapeloom.llm.common import remainder_is
from tests.llm import brute

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()),
                   StructField("score", StringType()), StructField("fp", StringType()), StructField("n_removed", StringType()), StructField("version", StringType()), StructField("kept", StringType())])
LABELS = StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()), StructField("toxic", IntegerType())])
ITEMS = StructType([StructField("item_id", LongType()), StructField("text", StringType())])
PAGES = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("html", StringType())])
LONG = " ".join(f"wort{i % 977}" for i in range(60_000))
GOOD = " ".join(f"good{i} words" for i in range(40)) + "."


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "src0", len(t or ""), "x", "y", "z", "v", "k") for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, [(1, None, "en"), (2, "", None), (3, "   \n\t", "en"), (4, LONG, "de"), (5, "one", "fr"), (6, "one", "fr"), (6, "one", "fr"), (None, "no id here at all", None),
                        (7, GOOD, "en"), (8, GOOD, "en"), (9, "123 !!! 456", "en"), (10, "a\x00b ퟿ ünï", "de")])


def ids(rows):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in rows)


def test_each_row_gets_a_row(spark, odd):
    labels = spark.createDataFrame([(7, 1, 1), (7, 1, 0), (8, 1, 0), (None, 0, 1), (99, 1, 1), (5, 1, None)], LABELS)
    items = spark.createDataFrame([(1, "one"), (2, None), (3, ""), (4, GOOD), (None, "x y z")], ITEMS)
    want = ids(odd.collect())
    held = remainder_is("doc_id", 5, 1)
    for found in (
        toxicity.toxicity(odd, labels, held), pii.pii(odd), pieces.digests(odd), pieces.encode(odd), langid.identify(odd, held), linededup.line_dedup(odd),
        lm.lm_scores(odd, held), simhash.near_duplicates(odd), quality.quality(odd), decontaminate.decontaminate(odd, items),
    ):
        assert ids(found.collect()) == want


def test_empty_tables(spark):
    none, items, labels, pages = docs(spark, []), spark.createDataFrame([], ITEMS), spark.createDataFrame([], LABELS), spark.createDataFrame([], PAGES)
    held = remainder_is("doc_id", 5, 1)
    for found in (
        toxicity.toxicity(none, labels, held), pii.pii(none), pieces.digests(none), langid.identify(none, held), linededup.line_dedup(none), lm.lm_scores(none, held),
        simhash.near_duplicates(none), quality.quality(none), decontaminate.decontaminate(none, items), htmltext.main_text(pages),
    ):
        assert found.collect() == []
    one = docs(spark, [(1, "a text", "en")])
    assert not decontaminate.decontaminate(one, items).first().contaminated
    assert toxicity.toxicity(one, labels, held).first().predicted == 0


def test_nothing_to_learn_from(spark):
    one = docs(spark, [(1, "a text", None), (2, None, None)])
    every = remainder_is("doc_id", 1, 0)
    assert {r.lang_pred for r in langid.identify(one, every).collect()} == {"und"}
    rows = lm.lm_scores(one, every).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == pytest.approx(0) for r in rows)


def test_undetermined_language(spark, odd):
    found = {r.doc_id: r for r in langid.identify(odd, remainder_is("doc_id", 1, 1)).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1, 2, 3, 9)) and found[5].lang_pred == "fr"


def test_contamination_of_short_items_overlaps_and_versions(spark):
    rows = [(1, "x A b c y a B c", "en"), (1, "nothing", "en"), (2, "A-b/c", "en"), (3, "É b", "en"), (4, "é b", "en"), (5, " ".join(map(str, range(30))), "en")]
    items = [(7, "a b c"), (10, "a b c"), (8, "É b"), (9, " ".join(map(str, range(5, 20)))), (11, "b c y a b c a b c y a")]
    found = decontaminate.decontaminate(docs(spark, rows), spark.createDataFrame(items, ITEMS)).collect()
    for k, (d, t, _) in enumerate(rows):
        n, hit, n_items, sha, bad = brute.contamination([(d, t)], items)[d]
        assert any((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (d, n, hit, n_items, sha, bad) for r in found)
    left = decontaminate.clean_only(docs(spark, rows), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, "nothing"), (4, "é b")]


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], ITEMS)
    near = docs(spark, [(1, "beta alpha gamma delta epsilon zeta eta theta iota kappa", "en"), (2, "alpha only", "en")])
    found = {r.doc_id: r for r in decontaminate.decontaminate(near, items).collect()}
    assert not found[1].contaminated and found[1].n_near == 1 and found[2].n_near == 0


def test_hot_groups_of_copies(spark):
    base = "\n".join(" ".join(f"l{k}w{i}" for i in range(12)) for k in range(6))
    rows = [(i, base, "en") for i in range(300)] + [(1000 + i, base + f"\nown{i} line of this one document number {i}", "en") for i in range(300)]
    df = docs(spark, rows)
    want = brute.line_removals([(d, t) for d, t, _ in rows])
    got = {r.doc_id: list(r.removed) for r in linededup.line_dedup(df).collect() if r.n_removed}
    assert got == want
    prints = [(d, brute.fingerprint(t)) for d, t, _ in rows]
    label = {d: c for d, _, c in brute.components(prints)}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == label
    kept = [r.doc_id for r in simhash.first_of_group(df).collect()]
    assert sorted(kept) == sorted(set(label.values()))


def test_repeated_rows_of_a_head_stay_once(spark):
    df = docs(spark, [(1, GOOD, "en"), (1, GOOD, "en"), (2, GOOD, "en"), (None, GOOD, "en")])
    kept = simhash.first_of_group(df).collect()
    assert ids(kept) == [(False, 1), (True, 0)] and kept[0].asDict().keys() == set(df.columns)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 101)], "a long, b long")
    found = {r.node: r.root for r in components.components(edges, "a", "b").collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_components_of_edges_that_change_when_computed_again(spark):
    # a star around a random member: each evaluation gives other edges of the same component
    def star(batches):
        import random

        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            hub = random.choice(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([hub] * len(ids))], names=["a", "b"])

    for _ in range(3):
        edges = spark.range(0, 40, 1, 1).mapInArrow(star, "a long, b long")
        assert {r.root for r in components.components(edges, "a", "b").collect()} == {0}


def test_line_dedup_keeps_short_and_first_lines(spark):
    passage = "this passage of many words stands in several documents and goes from the later ones"
    rows = [(1, f"first\n{passage}\nend", "en"), (2, f"second\n{passage}\nend of it", "en"), (3, "yes\nown words of three", "en"), (4, "yes\nother words of four", "en"), (5, passage, "en")]
    found = {r.doc_id: r for r in linededup.line_dedup(docs(spark, rows)).collect()}
    assert found[1].n_removed == 0 and found[2].text == "second\nend of it" and found[4].n_removed == 0 and found[5].text == ""


def test_pages_without_main_markup(spark):
    menu, foot = "Home News Sport Weather Contact", "All about our site and its makers"
    rows = [(i, f"http://h.example/{i}", f"<div>{menu}</div><div>unique{i} text{i} of{i} page{i} number{i}</div><div>{foot}</div>") for i in range(5)]
    rows += [(20, "http://k.example/1", "<div>only one page here</div>"), (21, None, None), (22, "x", ""), (23, None, "<p>a</p>"), (23, None, "<p>a</p>")]
    found = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(found[i] == f"unique{i} text{i} of{i} page{i} number{i}" for i in range(5))
    assert found[20] == "only one page here" and found[21] == found[22] == "" and found[23] == "a"


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, odd, stage, tmp_path):
    spark.createDataFrame([(1, GOOD)], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    name, function = corpus_pipeline.STAGES[stage]
    rows = function(spark, odd, str(tmp_path)).collect()
    empty = function(spark, docs(spark, []), str(tmp_path))
    assert empty.collect() == []
    if stage < 4:
        assert empty.columns == corpus_pipeline.COLUMNS
    kept = {r.doc_id for r in rows}
    assert {0: 7 in kept and 1 not in kept, 1: 7 in kept and 8 not in kept, 2: 7 in kept and 8 not in kept, 3: 7 not in kept and 5 in kept, 4: len(rows) == odd.count()}[stage]


def passage(holders):
    """A passage of fifteen four-word lines in ``holders`` documents with lines of their own around it."""
    block = "\n".join(f"line{k} of the passage" for k in range(15))
    return [(i, f"own{i} first words here {i}\n{block}\nown{i} last words here {i}", "en") for i in range(1, holders + 1)]


@pytest.mark.parametrize("holders", [2, 16, 17, 60])
def test_line_dedup_is_the_same_for_any_number_of_holders(spark, holders):
    found = {r.doc_id: r.n_removed for r in linededup.line_dedup(docs(spark, passage(holders))).collect()}
    assert found == {i: 15 * (i > 1) for i in range(1, holders + 1)}


def test_line_dedup_finds_blocks_of_any_earlier_document(spark):
    """B and C share a block whose lines have three other owners; repeated, moved and interleaved blocks."""
    import random

    rng = random.Random(3)
    pool = [" ".join(f"w{k}{j}" for j in range(rng.randrange(1, 5))) for k in range(30)]
    rows = [(1, "a b", "en"), (2, "c d", "en"), (3, "e f", "en"), (4, "x y z q r s\na b\nc d\ne f", "en"), (5, "a b\nc d\ne f", "en")]
    for i in range(6, 60):
        rows.append((i, "\n".join(rng.choice(pool + ["", "  "]) for _ in range(rng.randrange(1, 14))), "en"))
    want = brute.line_removals([(d, t) for d, t, _ in rows])
    for rare in (0, 2, 16):
        got = {r.doc_id: list(r.removed) for r in linededup.line_dedup(docs(spark, rows), rare=rare).collect() if r.n_removed}
        assert got == want
    assert want[5] == [0, 1, 2]


def test_aligned_blocks_are_among_the_shared_runs():
    import random

    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randrange(1, 12) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        sizes = [1 + x % 3 for x in b]
        assert set(linededup.common_blocks(a, b, sizes)) <= brute.shared_lines(a, b, sizes, 5)


def test_line_dedup_of_very_many_lines(spark):
    import time

    long = "\n".join(f"line number {i} of a very long text" for i in range(160_000))
    start = time.perf_counter()
    found = {r.doc_id: r for r in linededup.line_dedup(docs(spark, [(1, long, "en"), (2, long, "en"), (3, long + "\nand one line of its own", "en")])).collect()}
    assert found[2].text == "" and found[2].n_removed == 160_000 and found[3].text == "and one line of its own"
    assert time.perf_counter() - start < 120
