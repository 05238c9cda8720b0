"""Toxicity by a counterfactual-regularised classifier.

A linear model over hashed word and word-beginning features scores sentences; the score of a document
is that of its worst sentence. It is fitted to labelled documents with a penalty on the change of a
sentence's score when the identity terms in it are swapped for others, so that a mention of a group
does not raise the score by itself.

Fitting uses a bounded sample of the labelled rows: ``SAMPLE`` documents of each label at most
(chosen by a hash of the id), and the ``FEATURES`` buckets that tell the labels apart best, by counts
over the whole sample. Scoring covers every whole text.

Null and empty texts get the score of a sentence without features. Several labels of one id count as
toxic if one does. Without toxic labels all scores are low. Repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType

from tapeloom.llm.common import Memo, per_row, portions, schema, ship_package
from tapeloom.sources.sinks import stage

SAMPLE = 10_000
FEATURES = 512
BUCKETS = 1 << 20
SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"\w+")
LOW = -4.0  # the score's logit when nothing was learnt

#: Neutral terms for groups of people, by language; each list is one swap set.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"),
    ("black", "white", "asian", "african", "european", "american", "latino", "arab", "indigenous"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young", "old"),
    ("immigrant", "refugee", "foreigner", "native", "citizen"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("ausländer", "einwanderer", "flüchtlinge", "bürger"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
)


def bucket(feature: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(feature) & (BUCKETS - 1)


def word_features(word: str) -> list[int]:
    """Buckets of the word and of its beginnings of three to seven letters."""
    return [bucket("=" + word)] + [bucket(word[:n]) for n in range(3, min(7, len(word)) + 1)]


def sentences(text: str) -> list[list[str]]:
    """Distinct lower-case words of each sentence."""
    found = (sorted(set(WORD.findall(s))) for s in SENTENCE.split(text.lower()))
    return [s for s in found if s]


def swaps() -> dict[str, str]:
    """Each identity term and the next one of its set."""
    return {t: group[(i + 1) % len(group)] for group in IDENTITY for i, t in enumerate(group)}


def counterfactual(words: list[str], table: dict[str, str]) -> list[str] | None:
    """The sentence with every identity term swapped, or None if it holds none."""
    return [table.get(w, w) for w in words] if any(w in table for w in words) else None


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, size: int) -> DataFrame:
    """(id, text, label) of at most about ``size`` labelled documents of each label."""
    votes = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("__y"))
    )
    # labels of other documents, held-out ones among them, count for nothing
    votes = votes.join(docs.select(F.col(id_col).alias("__id")).distinct(), "__id", "left_semi")
    n = {r["__y"]: r["n"] for r in votes.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = votes.where(place < F.when(F.col("__y") == 1, size / max(size, n.get(1, 0))).otherwise(size / max(size, n.get(0, 0))))
    # the sample holds about 2 * size ids at most, so it can be sent to every executor
    sample = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id"))
    return sample.select("__id", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"), "__y")


def count_features(sample: DataFrame) -> DataFrame:
    """Documents of either label that hold a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), dtype=np.int64)
        memo = Memo(word_features, 200_000)
        for batch in portions(batches, 0):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                there = {b for w in set(WORD.findall(text.lower())) for b in memo[w]}
                counts[y, np.fromiter(there, dtype=np.int64, count=len(there))] += 1
        seen = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[0, seen]), pa.array(counts[1, seen])], names=["bucket", "clean", "toxic"])

    parts = sample.select("__text", "__y").mapInArrow(run, schema(("bucket", LongType()), ("clean", LongType()), ("toxic", LongType())))
    return parts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def informative(counts: DataFrame, n_clean: int, n_toxic: int, k: int) -> list[int]:
    """The ``k`` buckets whose share of documents differs most between the labels."""
    p, q = F.col("toxic") / max(1, n_toxic), F.col("clean") / max(1, n_clean)
    spread = F.sqrt((p + q) * (2 - p - q)) + 1e-3
    top = counts.where(F.col("toxic") + F.col("clean") > 1).orderBy(F.desc(F.abs(p - q) / spread), "bucket").limit(k)
    return sorted(r["bucket"] for r in top.select("bucket").collect())


def sentence_rows(sample: DataFrame, buckets: list[int]) -> DataFrame:
    """A row per sentence with a chosen feature, and per document at least one: features as they stand and swapped."""
    place = {b: i for i, b in enumerate(buckets)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda w: [place[b] for b in word_features(w) if b in place], 200_000)
        table = swaps()
        for batch in portions(batches, 1):
            ids, ys, own, other, nth = [], [], [], [], []
            for i, text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = [([], None)]
                for words in sentences(text):
                    features = [f for w in words for f in memo[w]]
                    swapped = counterfactual(words, table)
                    if features or swapped:
                        found.append((features, [f for w in swapped for f in memo[w]] if swapped else None))
                for n, (a, b) in enumerate(found):
                    ids.append(i), ys.append(y), own.append(a), other.append(b), nth.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, sample_id), pa.array(ys, pa.int32()), pa.array(nth, pa.int32()), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))],
                names=["id", "y", "nth", "own", "other"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = sample.schema["__id"].dataType
    sample_id = to_arrow_type(kind)
    ints = ArrayType(IntegerType())
    return sample.select("__id", "__text", "__y").mapInArrow(run, schema(("id", kind), ("y", IntegerType()), ("nth", IntegerType()), ("own", ints), ("other", ints)))


def packed(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All features one after the other, and the sentence of each; null lists have none."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lists)), sizes)


def fit(rows: pa.Table, n_features: int, penalty: float = 1.0, ridge: float = 3e-4, rounds: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias: loss of the worst sentence of each document + penalty * squared score change under swaps.

    ``rows`` are those of :func:`sentence_rows`, in any order.
    """
    rows = rows.take(pc.sort_indices(rows, [("id", "ascending"), ("nth", "ascending")])).combine_chunks()
    own, other = (rows.column(c).chunk(0) if rows.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("own", "other"))
    flat, of = packed(own)
    pairs = np.flatnonzero(pc.is_valid(other).to_numpy(zero_copy_only=False))
    swap_flat, swap_of = packed(other.filter(pc.is_valid(other)))
    nth = rows.column("nth").to_numpy()
    first = np.flatnonzero(nth == 0)
    labels = rows.column("y").to_numpy()
    y = labels[first].astype(float)
    if not y.sum():
        return np.zeros(n_features), LOW
    doc = np.repeat(np.arange(first.size), np.diff(np.append(first, len(nth))))
    balance = np.where(y == 1, max(1.0, math.sqrt((y == 0).sum() / y.sum())), 1.0)
    balance /= balance.sum()
    w, b = np.zeros(n_features), LOW / 2
    # the first step favours features of toxic documents, so that the worst sentence is a sensible one
    np.add.at(w, flat, (y[doc[of]] * 2 - 1) * balance[doc[of]])
    w *= 2 / max(np.abs(w).max(), 1e-12)
    m, v, steps = np.zeros(n_features + 1), np.zeros(n_features + 1), 0
    for _ in range(rounds):
        s = b + np.bincount(of, w[flat], len(nth))
        worst = np.maximum.reduceat(s, first)
        at = np.flatnonzero(s == worst[doc])
        at = at[np.concatenate(([True], doc[at][1:] != doc[at][:-1]))]  # the first of equals
        error = balance * (1 / (1 + np.exp(-np.clip(worst, -30, 30))) - y)
        pull = np.zeros(len(nth))
        pull[at] = error
        grad = np.bincount(flat, pull[of], n_features) + ridge * w
        if pairs.size:
            change = s[pairs] - b - np.bincount(swap_of, w[swap_flat], pairs.size)
            step = 2 * penalty * change / pairs.size
            back = np.zeros(len(nth))
            back[pairs] = step
            grad += np.bincount(flat, back[of], n_features) - np.bincount(swap_flat, step[swap_of], n_features)
        grad = np.append(grad, error.sum())
        steps += 1
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", size: int = SAMPLE, features: int = FEATURES):
    """(bucket -> weight, bias)."""
    ship_package(docs.sparkSession)
    sample = stage(labelled_sample(docs, labels, id_col, text_col, label_col, size), "toxicity-sample")
    n = {r["__y"]: r["n"] for r in sample.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        return {}, LOW
    buckets = informative(count_features(sample), n.get(0, 0), n[1], features)
    # a few features for each sentence of the bounded sample
    w, b = fit(sentence_rows(sample, buckets).toArrow(), len(buckets))
    return {k: float(x) for k, x in zip(buckets, w) if x}, b


def score(docs: DataFrame, model, carry: list[str], text_col: str = "text") -> DataFrame:
    """Carried columns, score of every whole text and the prediction."""
    weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        table = sent.value
        memo = Memo(lambda word: sum(table.get(b, 0.0) for b in word_features(word)), 300_000)
        rest = 1 / (1 + math.exp(-bias))

        def one(text: str):
            words = set(WORD.findall(text.lower()))
            worst = bias
            if any([memo[w] > 0 for w in words]):
                worst = max([bias] + [bias + sum([memo[w] for w in s]) for s in sentences(text)])
            value = rest if worst == bias else 1 / (1 + math.exp(-max(-30.0, min(30.0, worst))))
            return value, int(value >= 0.5)

        return one

    return per_row(docs, text_col, carry, make, [("score", DoubleType()), ("predicted", IntegerType())])


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from labelled rows that are not held out and scores every row."""
    rows = docs.select(F.col(id_col), F.col(text_col), held_out.alias("held_out"))
    model = train(rows.where(~F.col("held_out")), labels, id_col, text_col)
    return score(rows, model, [id_col, "held_out"], text_col)
