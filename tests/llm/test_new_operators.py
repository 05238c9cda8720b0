"""Centroid clustering, the subword quality classifier and the filter audit, against plain versions."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

import __spark_entry__ as entry
from tapeloom.llm import centroids, filteraudit, subword
from tapeloom.llm.common import remainder_is
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SF10 = "/root/testdata/sf0.01"
SF100 = "/root/testdata/sf0.1"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


# ---------------------------------------------------------------- centroids

def plain_clusters(rows, dims=64, k=8, rounds=10):
    """vec_id -> (cluster, distance) and the final centroids, by comparing everything with everything."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    own = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(own))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(own)):
            mine = [v for (_, v), c in zip(kept, of) if c == n]
            if mine:
                own[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, *near(v)[::-1]) for i, v in kept], own


def check_clusters(rows, found):
    want, own = plain_clusters(rows)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in found) == Counter(want)
    per = Counter()
    for _, c, d in want:
        per[c] += d
    for r in found:
        assert r.cluster_inertia == per[r.cluster] and r.inertia == sum(per.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, own[r.cluster])).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, cluster string, distance string, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], VECTORS).repartition(3)


def test_clusters_of_odd_vectors(spark):
    rng = random.Random(2)
    near = lambda c: [c + rng.choice((-0.02, 0.0, 0.015)) for _ in range(64)]
    rows = [(i, near(rng.choice((-0.5, 0.1, 0.7)))) for i in range(60)]
    hot = near(0.3)
    rows += [(100 + i, hot) for i in range(80)]  # one vector in many rows
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, near(0.1))]  # repeated rows, a null id
    rows += [(201, None), (202, []), (203, near(0.1)[:63]), (204, near(0.1) + [0.1]), (205, near(0.1)[:63] + [None]), (206, near(0.1)[:63] + [float("nan")]), (207, near(0.1)[:63] + [float("inf")])]
    check_clusters(rows, centroids.cluster(vectors(spark, rows)).collect())


def test_few_and_no_vectors(spark):
    assert centroids.cluster(vectors(spark, [])).collect() == []
    assert centroids.cluster(vectors(spark, [(1, [0.5] * 63)])).collect() == []
    rows = [(i, [0.25] * 64) for i in range(3)]
    check_clusters(rows, centroids.cluster(vectors(spark, rows)).collect())


def test_a_component_that_fits_no_distance_is_an_error(spark):
    with pytest.raises(Exception, match="could exceed a long"):
        centroids.cluster(vectors(spark, [(1, [3e30] * 64)])).collect()


@pytest.mark.parametrize("k", [1, 2, 3, 8, 40])
def test_tree_search_equals_comparing_all(k):
    """Small integers, so that distances tie often; the smaller number has to win."""
    rng = np.random.default_rng(k)
    own = rng.integers(-2, 3, (k, 4))
    rows = rng.integers(-3, 4, (500, 4))
    number, squared = centroids.nearest(rows, own, centroids.build_tree(own))
    all_ = ((rows[:, None] - own[None]) ** 2).sum(axis=2)
    assert (squared == all_.min(axis=1)).all() and (number == all_.argmin(axis=1)).all()


@tables
def test_clusters_of_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_clusters(rows, entry.queries()["op11_centroids"](spark, SF).collect())


# ---------------------------------------------------------------- filter audit

def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def plain_audit(docs, labels):
    """Every order, every row, one after the other. docs: (id, text, lang), labels: (id, quality, toxic)."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    judged = [(lang or "", {f for f, bad in {**fails(t or ""), "E": i is not None and i > least[t or ""]}.items() if bad}, i in good, i in toxic) for i, t, lang in docs]
    out, shapley = {}, Counter()
    for part in {p for p, *_ in judged}:
        for order in permutations("ABCDE"):
            rows = [r for r in judged if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in rows if f in r[1]]
                earlier = sum(f in r[1] for r in judged if r[0] == part) - len(gone)
                rows = [r for r in rows if f not in r[1]]
                only = sum(r[1] == {f} for r in judged if r[0] == part)
                out[part, "".join(order), step] = [len(rows), len(gone), earlier, only, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] += len(gone)
    return {(p, o, s): tuple(v + [shapley[p, o[s - 1]]]) for (p, o, s), v in out.items()}


def audited(rows):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in filteraudit.FIGURES) for r in rows}


DOCS = "doc_id long, text string, lang string, mask string, n string, digest string, part string"
LABELS = "doc_id long, quality int, toxic int"


def test_audit_of_odd_rows(spark):
    rng = random.Random(6)
    bits = [" ".join(f"w{rng.randrange(400)}" for _ in range(130)), "w " * 120, "SHOUTING TEXT " * 3, "a | b", "", None, "ünï cödé", "x" * 5000]
    texts = bits + [a + " " + b for a in bits[:4] for b in bits[:4]]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(150)]
    docs += [(i, bits[0], "en") for i in range(1000, 1100)]  # one text in many rows
    docs += [(1003, bits[0], "de"), (1003, bits[0], "en"), (1000, bits[0], "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(70)] + [(1003, 0, 1), (1003, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*d, "m", "n", "g", "p") for d in docs], DOCS).repartition(4)
    found = filteraudit.filter_audit(df, spark.createDataFrame(labels, LABELS)).collect()
    assert audited(found) == plain_audit(docs, labels) and len(found) == 600 * 3
    empty = filteraudit.filter_audit(df.limit(0), spark.createDataFrame(labels, LABELS))
    assert empty.collect() == [] and empty.columns == ["part", "filter_order", "step", *filteraudit.FIGURES]


def test_ranks_are_the_first_failing_filter():
    orders = list(permutations(range(4)))
    ranks = filteraudit.removal_ranks(4, orders)
    for m in range(16):
        for o, order in enumerate(orders):
            assert ranks[m, o] == next((s for s, f in enumerate(order) if m >> f & 1), 4)


@tables
def test_audit_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert audited(entry.queries()["op13_filteraudit"](spark, SF).collect()) == plain_audit(docs, labels)


# ---------------------------------------------------------------- subword quality

def plain_score(text, values, bias):
    """Softmax of the averaged features, one word after the other."""
    words = []
    for w in (text or "").split():
        words += [w[i : i + 64] for i in range(0, len(w), 64)]
    total, n, last = values[subword.ANY], 1, None
    for w in words:
        if w == last:
            total, n = total + values[subword.AGAIN], n + 1
            continue
        last = w
        marked = f"<{w}>"
        own = ["=" + w] + [marked[i : i + k] for k in (3, 4, 5) for i in range(len(marked) - k + 1)]
        total, n = total + sum(values[zlib.crc32(g.encode()) % subword.BUCKETS] for g in own) / len(own), n + 1
    return 1 / (1 + math.exp(-(bias + total / n)))


TEXTS = [(1, None), (2, ""), (3, "one"), (4, "one one one two two"), (5, "x" * 1000 + " y"), (6, "ünï cödé ßß"), (6, "again"), (None, "no id"), (7, "word " * 50_000), (7, "word " * 50_000)]


def test_scores_follow_the_model(spark):
    df = spark.createDataFrame([(i, t, "s", "p") for i, t in TEXTS], "doc_id long, text string, score string, predicted string")
    rng = np.random.default_rng(1)
    learnt = (rng.normal(0, 3, subword.BUCKETS + 2), 0.25)
    found = subword.score(df.select("doc_id", "text"), learnt, ["doc_id", "text"]).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        assert r.score == pytest.approx(plain_score(r.text, *learnt), rel=1e-9) and r.predicted == int(r.score >= 0.7)


def test_nothing_to_learn_quality_from(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    none = spark.createDataFrame([], LABELS)
    every = remainder_is("doc_id", 1, 1)
    assert {r.score for r in subword.quality_scores(df, none, every).collect()} == {0.5}
    only_bad = spark.createDataFrame([(3, 0, 0), (4, 0, 1), (5, None, 0)], LABELS)
    assert {r.predicted for r in subword.quality_scores(df, only_bad, every).collect()} == {0}
    assert subword.quality_scores(df.limit(0), only_bad, every).collect() == []


def test_labels_of_held_out_rows_are_never_read(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} v{i % 5} " * 20) for i in range(60)], "doc_id long, text string")
    held = remainder_is("doc_id", 4, 2)
    labels = [(i, i % 2, 0) for i in range(60)]
    turned = [(i, 1 - y if brute.held(i, 4, 2) else y, t) for i, y, t in labels]
    a, b = (sorted(subword.quality_scores(docs, spark.createDataFrame(x, LABELS), held).collect()) for x in (labels, turned))
    assert a == b


@tables
@pytest.mark.parametrize("sf,right", [(SF10, 0.95), (SF100, 0.98)])
def test_quality_on_rows_not_learnt_from(spark, sf, right):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = entry.queries()["op12_subwordquality"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == brute.held(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(label[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in label]
    assert sum(a == b for a, b in held) / len(held) >= right
    good = [p for y, p in held if y == 1]
    assert sum(good) / len(good) > 0.98
