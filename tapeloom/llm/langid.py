"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every training text into ``BUCKETS`` buckets per language, inside the
tasks, and Spark adds the partial counts up. The log-probability matrix (buckets x languages, its size
fixed by the parameters and the number of language labels) is broadcast, and numpy scores batches of
texts: n-gram buckets of all texts of a batch in one array, one sparse sum per language.

Upper and lower case are alike; every character that is no letter counts as one blank, and runs of
blanks as one. A text that is null or has no letter is ``und`` with score 0. Ties go to the language
that sorts first. With no training rows every text is ``und``. Repeated rows count as often as they
stand in the table, in training as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType, StructField

from tapeloom.llm.common import Memo, portions, schema, ship_package

UNDETERMINED = "und"
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: Code points of a batch that numpy works on at once; longer texts are cut into windows that overlap.
WINDOW = 1 << 20


def letters_only(text: str, memo: Memo) -> np.ndarray:
    """Lower-case code points with one blank for each run of other characters, blanks at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds, place = (points, None) if points.size < 64 else np.unique(points, return_inverse=True)
    letter = np.fromiter((memo[k] for k in kinds.tolist()), dtype=bool, count=kinds.size)
    letter = letter if place is None else letter[place]
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return points[keep]


def alphabet() -> Memo:
    return Memo(lambda p: chr(p).isalpha(), 1 << 17)


def grams(points: np.ndarray) -> np.ndarray:
    """Bucket of every n-gram; the single blank is none of them."""
    out = []
    state = np.zeros(points.size, dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        state = (state[: points.size - n + 1] + points[n - 1 :].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        state ^= state >> np.uint64(29)
        if n in ORDERS:
            found = state[points != 32] if n == 1 else state
            out.append(((found * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1))
        if points.size <= n:
            break
    return np.concatenate(out)


def windows(points: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of at most ``WINDOW`` code points; every n-gram of two or more characters lies in one.

    The overlap makes the few n-grams at a cut count twice at most, alike in training and scoring.
    """
    step = WINDOW - max(ORDERS)
    for start in range(0, max(1, points.size - max(ORDERS)), step):
        yield points[start : start + WINDOW]


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probabilities [languages x buckets], log-priors) from all rows with a language."""
    ship_package(df.sparkSession)
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    out = schema(("lang", StringType()), ("bucket", IntegerType()), ("n", LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        memo = alphabet()
        for batch in portions(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = counts.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
                own[BUCKETS] += 1
                points = letters_only(text, memo)
                if points.size > 1:
                    for piece in windows(points):
                        found = grams(piece)
                        if found.size > 4 * BUCKETS:
                            own[:BUCKETS] += np.bincount(found, minlength=BUCKETS)
                        else:
                            np.add.at(own, found, 1)
        for lang, own in counts.items():
            there = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * there.size, pa.string()), pa.array(there.astype(np.int32)), pa.array(own[there])], names=["lang", "bucket", "n"])

    found = rows.mapInArrow(run, out).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS + 1))
    counts[np.searchsorted(langs, found["lang"].to_numpy(dtype=object)) if langs else [], found["bucket"].to_numpy()] = found["n"].to_numpy()
    grams_of = counts[:, :BUCKETS] + 0.5
    docs = counts[:, BUCKETS]
    log_p = np.log(grams_of / grams_of.sum(axis=1, keepdims=True)) if langs else np.zeros((0, BUCKETS))
    return langs, log_p.astype(np.float32), np.log(docs / max(1.0, docs.sum())) if langs else np.zeros(0)


def predict(df: DataFrame, model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (posterior of the language, tempered by the number of n-grams)."""
    spark = df.sparkSession
    ship_package(spark)
    langs, log_p, priors = model
    sent = spark.sparkContext.broadcast((log_p, priors))
    source = df.select(*id_cols, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    out = StructType([source.schema[c] for c in id_cols] + [StructField("lang_pred", StringType(), True), StructField("score", DoubleType(), True)])
    width = len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        log_prob, prior = sent.value
        arrow = to_arrow_schema(out)
        memo = alphabet()
        for batch in portions(batches, width):
            texts = batch.column(width).to_pylist()
            total = np.zeros((len(texts), len(langs)))
            sizes = np.zeros(len(texts))
            lettered = np.zeros(len(texts), dtype=bool)
            waiting: list[tuple[int, np.ndarray]] = []

            def flush():
                if waiting:
                    idx = np.concatenate([g for _, g in waiting])
                    starts = np.cumsum([0] + [g.size for _, g in waiting[:-1]])
                    owners = np.array([i for i, _ in waiting])
                    for k in range(len(langs)):
                        np.add.at(total[:, k], owners, np.add.reduceat(log_prob[k][idx].astype(np.float64), starts))
                    waiting.clear()

            held = 0
            for i, text in enumerate(texts):
                points = letters_only(text, memo)
                lettered[i] = points.size > 1
                if lettered[i] and langs:
                    for piece in windows(points):
                        g = grams(piece)
                        waiting.append((i, g))
                        sizes[i] += g.size
                        held += g.size
                        if held >= WINDOW:
                            flush()
                            held = 0
            flush()
            if langs:
                best = (total + prior).argmax(axis=1)
                # n-grams of one text depend on each other: temper by the square root of their number
                mild = total / np.sqrt(np.maximum(sizes, 1))[:, None] + prior
                share = np.exp(mild - mild.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                pred = [langs[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)]
                score = np.where(lettered, share[np.arange(len(texts)), best], 0.0)
            else:
                pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            arrays = [batch.column(i).cast(arrow.field(i).type) for i in range(width)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(pred, pa.string()), pa.array(score)], schema=arrow)

    return source.mapInArrow(run, out)


def identify(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out and predicts every row."""
    rows = df.select(F.col(id_col), F.col(text_col), F.col(lang_col), held_out.alias("held_out"))
    model = train(rows.where(~F.col("held_out")), text_col, lang_col)
    return predict(rows, model, [id_col, "held_out"], text_col)
