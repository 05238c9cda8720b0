"""Quality classifier by supervised subword embeddings.

Every word gives a feature for itself and one for each of its character n-grams, with marks at its
ends; a word that repeats the one before it is read as a back reference instead, the one word bigram
that means the same for every word. Features are hashed to ``BUCKETS`` vectors of ``DIM`` numbers. A word is the
mean of its features, a text the mean of its words, and a softmax layer gives the share of good quality. Vectors and layer are
learnt together by stochastic gradient descent in numpy with a step size per number.

Learning uses a bounded sample of the labelled rows, about ``SAMPLE`` documents of each label, chosen by
a hash of the id. Its feature counts are a table in ``PARTS`` parts. In every round each part runs descent
over its minibatches in a task of its own, and the driver averages the models of the parts: it holds
``PARTS`` models of ``BUCKETS`` x ``DIM`` numbers, whatever the number and length of the documents. A
document has ``BUCKETS`` + 2 counts at most.

Scoring covers every whole text: softmax of an average is a sum of one number for each feature, so the
executors get one number a bucket, and a word's sum is computed once per task.

Null and empty texts have the features of no word and get the score of such a text; so do repeated rows
alike. Several labels of one id count as good only if all are. If the rows to learn from lack one of the
labels, every score is the share of good rows among them (0.5 without any). Words of more than 64 characters
are read as pieces of 64. Further input columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType

from tapeloom.llm.common import Memo, per_row, portions, schema, ship_package
from tapeloom.sources.sinks import stage

SAMPLE = 4_000
BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4, 5)
PARTS = 4
ROUNDS = 6
BATCH = 32
#: Minibatches of a part in a round; a part with fewer goes through its own again.
STEPS = 25
RATE = 0.2
SEED = 17
LONG_WORD = 64
AGAIN, ANY = BUCKETS, BUCKETS + 1  # the back reference, and a feature of every text
GOOD = 0.7


def words_of(text: str) -> tuple[list[str], int]:
    """The words that differ from the one before, and the number of those that don't."""
    words = text.split()
    if any(len(w) > LONG_WORD for w in words):
        words = [w[i : i + LONG_WORD] for w in words for i in range(0, len(w), LONG_WORD)]
    n = len(words)
    if any(map(eq, words, words[1:])):
        words = words[:1] + [w for v, w in zip(words, words[1:]) if v != w]
    again = n - len(words)
    return words, again


def word_features(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams."""
    marked = f"<{word}>"
    whole = marked.encode("utf-8", "surrogatepass")
    size = len(marked)
    if len(whole) == size:  # one byte a character
        grams = [whole[i : i + n] for n in GRAMS for i in range(size - n + 1)]
    else:
        grams = [marked[i : i + n].encode("utf-8", "surrogatepass") for n in GRAMS for i in range(size - n + 1)]
    return [h % BUCKETS for h in map(zlib.crc32, [b"=" + whole[1:-1], *grams])]


def text_features(text: str, memo: dict[str, list[int]]) -> dict[int, float]:
    """Weights of the features of a whole text: each word weighs one, shared by its features."""
    words, again = words_of(text)
    weights: defaultdict[int, float] = defaultdict(float)
    for word, n in Counter(words).items():
        found = memo[word]
        for f in found:
            weights[f] += n / len(found)
    if again:
        weights[AGAIN] = again
    weights[ANY] = 1
    return weights


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, size: int) -> tuple[DataFrame, dict[int, int]]:
    """(id, text, y) of about ``size`` labelled documents of each label at most, and the number of labelled ids by label."""
    votes = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(
        F.min((F.col(label_col) > 0).cast("int")).alias("__y"))
    # labels of other documents, held-out ones among them, count for nothing
    votes = votes.join(docs.select(F.col(id_col).alias("__id")).distinct(), "__id", "left_semi")
    n = {r["__y"]: r["n"] for r in votes.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("__y") == 1, size / max(size, n.get(1, 0))).otherwise(size / max(size, n.get(0, 0)))
    # about 2 * size ids at most, so they can be sent to every executor
    sample = docs.join(F.broadcast(votes.where(place < share)), F.col(id_col) == F.col("__id"))
    return sample.select("__id", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"), "__y"), n


def count_rows(sample: DataFrame) -> DataFrame:
    """(part, place, y, ids, shares): the averaged features of each document of the sample, in a fixed order."""
    ints, floats = ArrayType(IntegerType()), ArrayType(FloatType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_features, 200_000)
        for batch in portions(batches, 0):
            ids, shares = [], []
            for text in batch.column(0).to_pylist():
                counts = text_features(text, memo)
                values = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
                ids.append(np.fromiter(counts, dtype=np.int32, count=len(counts)))
                shares.append((values / values.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), batch.column(3), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                names=["y", "part", "place", "ids", "shares"])

    h = F.xxhash64("__id", F.lit(SEED))
    source = sample.select("__text", "__y", F.pmod(h, F.lit(PARTS)).cast("int").alias("part"), h.alias("place"))
    return source.mapInArrow(run, schema(("y", IntegerType()), ("part", IntegerType()), ("place", source.schema["place"].dataType), ("ids", ints), ("shares", floats)))


class Model:
    """Vectors, softmax layer and the squared gradients seen so far."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        # zero vectors: a feature that was never learnt says nothing
        self.vectors = np.zeros((BUCKETS + 2, DIM), dtype=np.float32)
        self.layer = rng.normal(0, 1, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, dtype=np.float32)
        self.seen = [np.zeros_like(a) for a in self.numbers()]

    def numbers(self) -> list[np.ndarray]:
        return [self.vectors, self.layer, self.bias]

    def step(self, ids: np.ndarray, shares: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One minibatch: documents are runs of ``ids`` from ``starts`` on."""
        hidden = np.add.reduceat(self.vectors[ids] * shares[:, None], starts, axis=0)
        out = hidden @ self.layer + self.bias
        out = np.exp(out - out.max(axis=1, keepdims=True))
        out /= out.sum(axis=1, keepdims=True)
        out[np.arange(y.size), y] -= 1
        error = out * (weight / y.size)[:, None]
        back = error @ self.layer.T
        doc = np.repeat(np.arange(y.size), np.diff(np.append(starts, ids.size)))
        touched, at = np.unique(ids, return_inverse=True)
        pull = np.stack([np.bincount(at, back[doc, d] * shares, touched.size) for d in range(DIM)], axis=1)
        for i, (where, grad) in enumerate(((touched, pull), (slice(None), hidden.T @ error), (slice(None), error.sum(axis=0)))):
            self.seen[i][where] += grad**2
            self.numbers()[i][where] -= RATE * grad / np.sqrt(self.seen[i][where] + 1e-12)

    def dump(self) -> bytes:
        return b"".join(a.astype(np.float32).tobytes() for a in self.numbers() + self.seen)

    @staticmethod
    def average(dumps: list[bytes], shares: list[float]) -> Model:
        """The mean of models, each weighted by the rows it has seen."""
        model = Model()
        flat = sum(np.frombuffer(d, dtype=np.float32).astype(np.float64) * s for d, s in zip(dumps, shares)) / sum(shares)
        for a in model.numbers() + model.seen:
            a[...] = flat[: a.size].reshape(a.shape)
            flat = flat[a.size :]
        return model


def round_of(rows: DataFrame, model: Model, weights: tuple[float, float]) -> Model:
    """One pass over every part, and the average of the parts' models."""
    sent = rows.sparkSession.sparkContext.broadcast(model.dump())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, n, waiting, held = None, None, 0, [], []
        balance = np.array(weights, dtype=np.float32)

        def learn() -> None:
            if waiting:
                sizes = [ids.size for _, ids, _ in waiting]
                y = np.array([w[0] for w in waiting])
                batch = np.concatenate([w[1] for w in waiting]), np.concatenate([w[2] for w in waiting]), np.cumsum([0] + sizes[:-1]), y, balance[y]
                own.step(*batch)
                held.append(batch if len(held) < STEPS else None)
                waiting.clear()

        def result() -> pa.RecordBatch:
            learn()
            for k in range(len(held), STEPS):
                own.step(*held[k % len(held)])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([own.dump()], pa.binary())], names=["part", "n", "model"])

        for batch in batches:
            for i in range(batch.num_rows):
                p = batch.column(0)[i].as_py()
                if p != part:
                    if own is not None:
                        yield result()
                    own, part, n = Model.average([sent.value], [1.0]), p, 0
                waiting.append((batch.column(1)[i].as_py(), batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy()))
                n += 1
                if len(waiting) == BATCH:
                    learn()
        if own is not None:
            yield result()

    # each part has a folder of its own, so no round moves the table
    parts = [rows.where(F.col("part") == p).coalesce(1).sortWithinPartitions("place").select("part", "y", "ids", "shares") for p in range(PARTS)]
    made = reduce(DataFrame.union, parts).mapInArrow(run, schema(("part", IntegerType()), ("n", IntegerType()), ("model", BinaryType()))).collect()  # PARTS models
    made.sort(key=lambda r: r["part"])
    sent.destroy()
    return Model.average([bytes(r["model"]) for r in made], [float(r["n"]) for r in made])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", size: int = SAMPLE, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(a number for each bucket, the softmax layer's bias), both as log odds of good quality."""
    ship_package(docs.sparkSession)
    sample, n = labelled_sample(docs, labels, id_col, text_col, label_col, size)
    rows = stage(count_rows(sample), "quality-features", by="part")
    there = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(there) < 2:
        share = {(): 0.5, (0,): 0.0, (1,): 1.0}[tuple(there)]
        share = min(max(share, 1e-3), 1 - 1e-3)
        return np.zeros(BUCKETS + 2), math.log(share / (1 - share))
    # the sample's labels weigh as those of all labelled rows
    total = sum(n.values())
    weights = tuple(n[y] / total * sum(there.values()) / there[y] for y in (0, 1))
    model = Model()
    for _ in range(rounds):
        model = round_of(rows, model, weights)
    side = (model.layer[:, 1] - model.layer[:, 0]).astype(np.float64)
    return model.vectors.astype(np.float64) @ side, float(model.bias[1] - model.bias[0])


def score(docs: DataFrame, learnt: tuple[np.ndarray, float], carry: list[str], text_col: str = "text") -> DataFrame:
    """Carried columns, score of every whole text and the prediction."""
    sent = docs.sparkSession.sparkContext.broadcast(learnt)

    def make():
        values, bias = sent.value
        table = values.tolist()

        def fill(word: str) -> float:
            found = word_features(word)
            return sum([table[f] for f in found]) / len(found)

        memo = Memo(fill, 300_000)

        def one(text: str) -> tuple[float, int]:
            words, again = words_of(text)
            total = sum([memo[w] for w in words]) + again * table[AGAIN] + table[ANY]
            odds = bias + total / (len(words) + again + 1)
            value = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            return value, int(value >= GOOD)

        return one

    return per_row(docs, text_col, carry, make, [("score", DoubleType()), ("predicted", IntegerType())])


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from labelled rows that are not held out and scores every row."""
    rows = docs.select(F.col(id_col), F.col(text_col), held_out.alias("held_out"))
    learnt = train(rows.where(~F.col("held_out")), labels, id_col, text_col)
    return score(rows, learnt, [id_col, "held_out"], text_col)
