"""The registered queries over whole tables, against plain versions or on rows not learnt from."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from tapeloom.llm import linededup, pieces, quality
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SF10 = "/root/testdata/sf0.01"
SF100 = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def docs(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def run(spark, name, sf=SF):
    return entry.queries()[name](spark, sf).collect()


def test_all_operators_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


def test_toxicity_on_rows_not_learnt_from(spark):
    # the smaller table holds 64 clean labelled rows of this kind, too few to tell shares of some percent
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF100}/labels.parquet").collect()}
    rows = run(spark, "op1_toxicity", SF100)
    assert len(rows) == spark.read.parquet(f"{SF100}/documents.parquet").count()
    held = [(label[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in label]
    assert all(r.held_out == brute.held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    c = Counter(held)
    assert c[0, 0] / (c[0, 0] + c[0, 1]) > 0.97 and c[1, 1] / max(1, c[1, 0] + c[1, 1]) > 0.8


def test_pii(spark):
    text = dict(docs(spark))
    for r in run(spark, "op2_pii"):
        counts, spans = brute.base_pii(text[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == brute.sha(",".join(spans))
        assert set(spans) <= set(r.spans.split(","))  or not spans


def test_html(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = run(spark, "op3_html")
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == brute.article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_sentencepiece(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    text = dict(docs(spark))
    for r in run(spark, "op4_sentencepiece"):
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == brute.pieces(model, text[r.doc_id])


def test_language_on_rows_not_learnt_from(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF10}/documents.parquet").select("doc_id", "lang").collect()}
    rows = run(spark, "op5_langid", SF10)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == len(lang) and sum(held) / len(held) > 0.97 and all(r.held_out == brute.held(r.doc_id, 4, 2) for r in rows)


def test_line_dedup(spark):
    given = docs(spark)
    want = brute.line_removals(given)
    text = dict(given)
    for r in run(spark, "op6_linededup"):
        places = want.get(r.doc_id, [])
        assert r.removed == ",".join(map(str, places)) and r.n_removed == len(places)
        assert r.text == (brute.without(text[r.doc_id], places) if places else text[r.doc_id])


def test_language_model(spark):
    want = brute.unigram(docs(spark))
    rows = run(spark, "op7_lm")
    assert len(rows) == len(want)
    for r in rows:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # classes tell more than words alone


def test_simhash(spark):
    want = Counter(brute.components([(d, brute.fingerprint(t)) for d, t in docs(spark)]))
    assert Counter(tuple(r) for r in run(spark, "op8_simhash")) == want


def test_quality(spark):
    text = dict(docs(spark))
    for r in run(spark, "op9_quality"):
        want = brute.base_quality(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)


def test_quality_agrees_with_labels(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF10}/labels.parquet").collect()}
    rows = [r for r in run(spark, "op9_quality", SF10) if r.doc_id in label and not r.base_failed]
    assert sum(r.kept == bool(label[r.doc_id]) for r in rows) / len(rows) > 0.98


def test_decontamination(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute.contamination(docs(spark), items)
    rows = run(spark, "op10_decontaminate")
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id]


def test_decontamination_is_native(spark):
    text = entry.queries()["op10_decontaminate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in text for w in ("Python", "Pandas", "Arrow", "Cartesian"))


@pytest.mark.parametrize("sf", [SF, SF10])
def test_pipeline(spark, sf):
    import sentencepiece

    given = docs(spark, sf)
    rules = quality.Rules()
    rows = []
    for d, t in given:
        j = quality.judge(t or "", rules)
        if j[6]:
            rows.append((d, j[8] if j[7] else t))
    gone = brute.line_removals(rows)
    rows = [(d, brute.without(t, gone[d]) if d in gone else t) for d, t in rows]
    rows = [(d, t) for d, t in rows if d not in gone or t]
    head = brute.similar_groups(rows)
    rows = [(d, t) for d, t in rows if head[d] == d]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = brute.contamination(rows, items)
    rows = [(d, t) for d, t in rows if not bad[d][4]]
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = {(d, *brute.pieces(model, t)) for d, t in rows}
    got = run(spark, "pipeline", sf)
    assert len(got) == len(want) and {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
    assert all(len(r.ids) == r.n_tokens for r in got)
