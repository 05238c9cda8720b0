"""Centroid clustering on integers with a vantage-point tree over the centroids.

Vectors become integers, floor(1024 * x) by component, and all distances and means are exact. Each
round builds a vantage-point tree over the centroids and broadcasts it; every vector searches it best
first: of the subtrees not yet excluded it opens the one with the smallest lower bound, compares its
vantage point by exact squared distance, and drops the subtrees whose lower bound exceeds the best
distance. The pruning radius is inclusive, so centroids at the same distance are all seen and the
smallest number wins. A batch of vectors searches together, each with bounds and choices of its own.

Tasks send one sum for each centroid and component; vectors are never shuffled, so groups of equal
vectors make no hot key. The driver holds ``k`` centroids and ``k`` counts, whatever the input.

Vectors of another length, null vectors and vectors with a null or non-finite component are left out.
Repeated rows are vectors of their own. Where hashes of ids tie, the smaller vector comes first; null
ids come last. Fewer vectors than ``k`` give fewer centroids; an empty table gives no rows. A component
of 2^27 or more after scaling is an error, since squared distances could then exceed a long. Further
input columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DecimalType, IntegerType, LongType, StringType

from tapeloom.llm.common import schema, ship_package
from tapeloom.sources.sinks import stage

DIMS = 64
SCALE = 1024
K = 8
ROUNDS = 10
SALT = "3"
LIMIT = 1 << 27
#: Relative slack of float bounds; bounds only ever open a subtree too many.
SLACK = 1e-9


def build_tree(centroids: np.ndarray) -> list[tuple[int, float, float, int, float, float, int]]:
    """Nodes (centroid, inner low, inner high, inner node, outer low, outer high, outer node).

    The first node is the root. A node's vantage point is one of the centroids; those nearer to it than
    the median are in the inner subtree, the others in the outer one, with the range of their distances
    to the vantage point. A node number of -1 is an empty subtree.
    """
    nodes: list = []

    def grow(members: list[int]) -> int:
        if not members:
            return -1
        place = len(nodes)
        nodes.append(None)
        vantage, rest = members[0], members[1:]
        if not rest:
            nodes[place] = (vantage, 0.0, 0.0, -1, 0.0, 0.0, -1)
            return place
        away = np.sqrt(((centroids[rest] - centroids[vantage]) ** 2).sum(axis=1).astype(float))
        order = np.argsort(away, kind="stable")
        half = len(rest) // 2
        inner, outer = order[:half], order[half:]
        span = [(float(away[p].min()), float(away[p].max())) if p.size else (0.0, 0.0) for p in (inner, outer)]
        below = [grow([rest[i] for i in p]) for p in (inner, outer)]
        nodes[place] = (vantage, *span[0], below[0], *span[1], below[1])
        return place

    grow(list(range(len(centroids))))
    return nodes


def nearest(vectors: np.ndarray, centroids: np.ndarray, tree: list) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row; ties go to the smaller number."""
    n = len(vectors)
    best = np.full(n, np.iinfo(np.int64).max, dtype=np.int64)
    number = np.full(n, len(centroids), dtype=np.int64)
    bound = np.full((n, len(tree)), np.inf)  # lower bound of each open subtree
    bound[:, 0] = 0.0
    alive = np.arange(n)
    while alive.size:
        own = bound[alive]
        node = own.argmin(axis=1)
        low = own[np.arange(alive.size), node]
        # inclusive: a subtree that may hold a centroid at the best distance is opened
        open_ = (low <= np.sqrt(best[alive].astype(float)) * (1 + SLACK)) & np.isfinite(low)
        alive, node, low = alive[open_], node[open_], low[open_]
        for t in np.unique(node):
            at = alive[node == t]
            vantage, in_low, in_high, inner, out_low, out_high, outer = tree[t]
            squared = ((vectors[at] - centroids[vantage]) ** 2).sum(axis=1)
            better = (squared < best[at]) | ((squared == best[at]) & (vantage < number[at]))
            best[at[better]], number[at[better]] = squared[better], vantage
            away = np.sqrt(squared.astype(float))
            floor = low[node == t]
            bound[at, t] = np.inf
            for below, near, far in ((inner, in_low, in_high), (outer, out_low, out_high)):
                if below >= 0:
                    slack = SLACK * (away + far)
                    bound[at, below] = np.maximum(floor, np.maximum(near - away, away - far) - slack)
    return number, best


def integers(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v): the vectors that count, as integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.values.to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
            offsets = lists.offsets.to_numpy()
            fits = np.flatnonzero((np.diff(offsets) == dims) & lists.is_valid().to_numpy(zero_copy_only=False))
            own = flat[offsets[fits][:, None] + np.arange(dims)] if fits.size else np.zeros((0, dims))
            good = np.isfinite(own).all(axis=1)
            own = np.floor(own[good] * scale)
            if own.size and np.abs(own).max() >= LIMIT:
                raise ValueError(f"a component is {LIMIT} or more after scaling; its squared distances could exceed a long")
            values = pa.array(own.astype(np.int64).ravel())
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * dims), values)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fits[good])), out], names=["id", "v"])

    source = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return source.mapInArrow(run, schema(("id", source.schema["id"].dataType), ("v", ArrayType(LongType()))))


def rows_of(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """Vectors of the ``k`` smallest hashes of salt and id, in the order of the hashes."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    top = vectors.select("v", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
    return np.array([r["v"] for r in top.collect()], dtype=np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dims = centroids.shape
    sent = vectors.sparkSession.sparkContext.broadcast((centroids, build_tree(centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tree = sent.value
        sums, counts = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            rows = rows_of(batch.column(0), dims)
            number, _ = nearest(rows, own, tree)
            counts += np.bincount(number, minlength=k)
            order = np.argsort(number, kind="stable")
            there, starts = np.unique(number[order], return_index=True)
            if there.size:
                sums[there] += np.add.reduceat(rows[order], starts, axis=0)
        held = np.flatnonzero(counts)
        # a task's sums fit a long: 2^36 vectors of components below 2^27
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(held, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), held.size)),
             pa.array(sums[held].ravel()), pa.array(np.repeat(counts[held], dims))], names=["cluster", "place", "total", "n"])

    parts = vectors.select("v").mapInArrow(run, schema(("cluster", IntegerType()), ("place", IntegerType()), ("total", LongType()), ("n", LongType())))
    exact = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast(DecimalType(38, 0))).alias("total"), F.sum("n").alias("n"))
    after = centroids.copy()
    for r in exact.collect():  # k * dims rows
        after[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    sent.destroy()
    return after


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    dims = centroids.shape[1]
    sent = vectors.sparkSession.sparkContext.broadcast((centroids, build_tree(centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tree = sent.value
        for batch in batches:
            number, squared = nearest(rows_of(batch.column(1), dims), own, tree)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(squared)], names=["id", "cluster", "distance"])

    return vectors.mapInArrow(run, schema(("id", vectors.schema["id"].dataType), ("cluster", IntegerType()), ("distance", LongType())))


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def as_long(total: int) -> int | None:
    """Null for a sum that no long holds."""
    return total if total < 1 << 63 else None


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts."""
    spark = df.sparkSession
    ship_package(spark)
    vectors = stage(integers(df, id_col, vec_col, dims, scale), "integer-vectors")
    centroids = first_centroids(vectors, k, salt)
    if not len(centroids):
        centroids = np.zeros((1, dims), dtype=np.int64)
    else:
        for _ in range(rounds):
            after = moved(vectors, centroids)
            if (after == centroids).all():  # the rounds left would change nothing
                break
            centroids = after
    found = stage(assigned(vectors, centroids), "assigned-vectors")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast(DecimalType(38, 0))).alias("s")).collect()}
    total = sum(inertia.values())
    figures = schema(("cluster", IntegerType()), ("cluster_inertia", LongType()), ("inertia", LongType()), ("centroid_sha256", StringType()))
    of = spark.createDataFrame([(c, as_long(s), as_long(total), digest(centroids[c])) for c, s in sorted(inertia.items())], figures)
    return found.join(F.broadcast(of), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT) -> str:
    """The same as DuckDB SQL over embeddings, each round a step of its own."""
    steps = [f"""
vectors AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
    row_number() OVER () AS row_no
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), v) - 1 AS c, v
  FROM vectors QUALIFY row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), v) <= {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT row_no, vec_id, x.v AS v, arg_min(c, d) AS c, min(d) AS d FROM (
    SELECT row_no, vec_id, x.v, c, [list_sum(list_transform(range(1, {dims + 1}), lambda j: (x.v[j] - y.v[j]) * (x.v[j] - y.v[j])))::BIGINT, c] AS d
    FROM vectors x CROSS JOIN c{i} y) x GROUP BY row_no, vec_id, x.v)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c AS c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT c, list(q ORDER BY j) AS v FROM (
      SELECT c, j, (sum(v[j])::HUGEINT - (((sum(v[j])::HUGEINT % count(*)) + count(*)) % count(*))) // count(*) AS q
      FROM a{i}, range(1, {dims + 1}) r(j) GROUP BY c, j) GROUP BY c) m USING (c))""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, d[1]::BIGINT AS distance, (sum(d[1]) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(d[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(k.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} k ON a.c = k.c"""
