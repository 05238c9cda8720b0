"""Filter interaction audit: what every order of a set of filters removes, and which filters overlap.

A row fails a subset of the filters; the subset is its mask. Under an order the row is removed by the
failing filter that stands first, so its removal rank is a min-plus product: the mask matrix (0 where
the row fails, infinite elsewhere) with the position matrix of the inverse permutations, combined by
minimum. Rows with the same mask share their ranks, so Spark counts rows by part and mask once, and
the ranks of the 2^k masks scatter these weights over the steps of all k! orders.

Nothing is gathered by text: rows become one count for each (id, text digest, part, mask), then one
for each (digest, part, mask, labels), so a text that a third of all rows hold is a few rows when its
least id is looked for. A part has 2^k counts at most.

Null texts are empty texts. Null parts are the empty string. Rows with a null id fail no copy filter
and have no labels; rows that share id and text are not copies of each other. Several labels of one id
count as 1 if one of them is 1. An empty table has no parts and gives no rows. Very long texts are
judged whole. Further input columns are not read, so their names cannot clash with the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from tapeloom.llm.common import schema, ship_package
from tapeloom.sources.sinks import stage

COPY = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions of one text, by filter letter; ``text`` holds no nulls."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], part: Column, text: Column, id_col: str, good: str, toxic: str) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the set of filters they fail; the copy filter is the last bit."""
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    # two digests of the whole text, 48 bytes for any length
    digest = F.struct(F.unhex(F.sha2(text, 256)).alias("a"), F.unhex(F.md5(text)).alias("b"))
    rows = docs.select(F.col(id_col).alias("id"), digest.alias("digest"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), bits.alias("mask"))
    rows = rows.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        *[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(k) for k, c in (("good", good), ("toxic", toxic))])
    flag = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    labelled = rows.join(marked, "id", "left").select("id", "digest", "part", "mask", "n", *flag)

    # by text: the rows of the least id of each group, and all rows with an id
    key = ["digest", "part", "mask", "good", "toxic"]
    first = F.min(F.when(F.col("id").isNotNull(), F.col("id")))
    same_id = labelled.groupBy(*key, "id").agg(F.sum("n").alias("n"))
    # two steps read it, the texts are judged once
    by_text = stage(same_id.groupBy(*key).agg(
        first.alias("least"), F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("head")), "counts-by-text")
    least = by_text.groupBy("digest").agg(F.min("least").alias("of_text"))
    heads = F.col("n_null") + F.when(F.col("least") == F.col("of_text"), F.col("head.n")).otherwise(0)
    counted = by_text.join(least, "digest").withColumn("heads", F.coalesce(heads, F.col("n_null")))
    copy = 1 << len(filters)
    split = counted.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("heads").alias("n")),
        F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("heads")).alias("n")))).alias("m"))
    n = F.col("m.n")
    return split.where(n > 0).groupBy("part", F.col("m.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def removal_ranks(k: int, orders: list[tuple[int, ...]]) -> np.ndarray:
    """(2^k, orders): the step at which a mask is removed under an order, from 0; k if it never is."""
    position = np.empty((k, len(orders)), dtype=np.int64)
    for o, order in enumerate(orders):
        position[list(order), o] = np.arange(k)  # the inverse permutation
    fails = np.array([[0 if m >> f & 1 else k for f in range(k)] for m in range(1 << k)], dtype=np.int64)
    ranks = np.full((1 << k, len(orders)), k, dtype=np.int64)
    for f in range(k):  # min-plus: no intermediate array of masks x filters x orders
        np.minimum(ranks, fails[:, f, None] + position[None, f, :], out=ranks)
    return ranks


def audit_part(weights: np.ndarray, ranks: np.ndarray, orders: list[tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Arrays of (orders, k) from (3, 2^k) weights: all rows, good rows, toxic rows."""
    k, n_orders = len(orders[0]), len(orders)
    removed = np.zeros((3, n_orders, k + 1), dtype=np.int64)
    at = np.broadcast_to(np.arange(n_orders), ranks.shape)
    for w, out in zip(weights, removed):
        np.add.at(out, (at, ranks), np.broadcast_to(w[:, None], ranks.shape))
    letter = np.array(orders)
    has = np.array([[m >> f & 1 for f in range(k)] for m in range(1 << k)], dtype=bool)
    # failing a step's filter but removed at an earlier step
    redundant = np.stack([np.where(has[:, letter[:, s]] & (ranks < s), weights[0][:, None], 0).sum(axis=0) for s in range(k)], axis=1)
    by_filter = np.zeros(k, dtype=np.int64)
    np.add.at(by_filter, letter, removed[0, :, :k])
    return {
        "kept": weights[0].sum() - np.cumsum(removed[0, :, :k], axis=1), "removed": removed[0, :, :k], "redundant": redundant,
        "unique_fails": weights[0][1 << letter], "good_lost": removed[1, :, :k], "toxic_lost": removed[2, :, :k], "shapley": by_filter[letter],
    }


FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """All orders and steps of each part of ``counts`` (part, mask, n, good, toxic); bit i of a mask is letter i."""
    ship_package(counts.sparkSession)
    k = len(letters)
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = list(permutations(range(k)))
        ranks = removal_ranks(k, orders)
        names = np.repeat(["".join(letters[f] for f in o) for o in orders], k)
        steps = np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                weights = np.zeros((3, 1 << k), dtype=np.int64)
                for r in found:
                    weights[:, r["mask"]] += (r["n"], r["good"], r["toxic"])
                out = audit_part(weights, ranks, orders)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(steps)), pa.array(names), pa.array(steps), *[pa.array(out[c].ravel()) for c in FIGURES]],
                    names=["part", "filter_order", "step", *FIGURES])

    return per_part.mapInArrow(run, schema(("part", StringType()), ("filter_order", StringType()), ("step", IntegerType()), *[(c, LongType()) for c in FIGURES]))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """The audit of :func:`text_filters` and the copy filter: an equal text has a smaller id, in any part."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    filters = text_filters(text)
    return audit(masks(docs, labels, filters, F.col(part_col), text, id_col, good, toxic), "".join(filters) + COPY)


def audit_sql() -> str:
    """The audit as DuckDB SQL over documents and labels."""
    return r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
worded AS (
  SELECT doc_id, t, part, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM base),
least AS (SELECT t, min(doc_id) AS first_id FROM base GROUP BY t),
marked AS (
  SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS tox
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(tox, 0) AS tox,
    (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN coalesce(worded.doc_id > first_id, false) THEN 16 ELSE 0 END) AS mask
  FROM worded JOIN least USING (t) LEFT JOIN marked ON worded.doc_id = marked.doc_id),
counted AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(tox) AS tox FROM judged GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.letter <> b.letter AND a.letter <> c.letter AND a.letter <> d.letter AND a.letter <> e.letter
    AND b.letter <> c.letter AND b.letter <> d.letter AND b.letter <> e.letter AND c.letter <> d.letter AND c.letter <> e.letter AND d.letter <> e.letter),
removed_at AS (
  SELECT mask, filter_order, min(instr(filter_order, letter)) AS rank
  FROM (SELECT DISTINCT mask FROM counted) m CROSS JOIN orders LEFT JOIN letters ON mask & bit <> 0 GROUP BY mask, filter_order),
steps AS (SELECT filter_order, s AS step, substr(filter_order, s, 1) AS letter FROM orders, range(1, 6) r(s)),
found AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN rank IS NULL OR rank > step THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN rank = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND rank < step THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN rank = step THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN rank = step THEN tox ELSE 0 END) AS toxic_lost
  FROM counted JOIN removed_at USING (mask) JOIN steps USING (filter_order) JOIN letters USING (letter)
  GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM found"""
