"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint holds the majority bits of the hashes of a text's word shingles. Fingerprints within
``RADIUS`` differing bits are linked. The candidates come from a covering family: every bit position
gets a vector of ``RADIUS + 1`` bits, and each non-zero vector v gives the mask of the positions whose
vector has an odd product with v. For any set of at most ``RADIUS`` positions some v is orthogonal to
all of their vectors, so two fingerprints that differ there agree under that mask: no pair within the
radius is missed.

Only distinct fingerprints are compared; copies of a text are one fingerprint. A bucket gives a
spanning forest of its links, never all pairs. Inside a large bucket the pigeonhole principle splits
the bits that still vary, so that the work does not grow with the square of the bucket.

Null and empty texts have no shingle: their fingerprint is zero, linked like any other. Repeated rows
are copies of each other. Rows with a null id are kept and never name a component that has other ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from tapeloom.llm.common import per_row, schema, ship_package
from tapeloom.llm.components import components
from tapeloom.sources.sinks import stage

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Distinct fingerprints up to which all pairs of a bucket are compared at once.
DIRECT = 1024


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [h(b" ".join(words), SEED)]
    else:
        hashes = [h(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)))]
    ones = np.zeros(BITS, dtype=np.int64)
    values = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(values), 1 << 16):
        ones += np.unpackbits(values[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row."""
    return per_row(df, text_col, [id_col], lambda: lambda text: (fingerprint_of(text, shingle),), [("fp", LongType())], as_bytes=True)


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering masks, as signed 64-bit numbers.

    Position i has the vector i mod 2^(radius+1); with 64 positions and radius 3 every vector stands
    at four positions, so each mask keeps 32 bits.
    """
    vectors = [i % (1 << (radius + 1)) for i in range(bits)]
    found = []
    for v in range(1, 1 << (radius + 1)):
        mask = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        found.append(mask - (1 << 64) if mask >> 63 else mask)
    return found


def forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs that join the same distinct unsigned fingerprints as all links within ``radius`` do, without a circle."""
    parent = np.arange(values.size)
    edges: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((i, j))

    def compare(at: np.ndarray) -> None:
        own = values[at]
        near = np.bitwise_count(own[:, None] ^ own[None, :]) <= radius
        label = np.arange(at.size)
        while True:  # the least member that links reach
            reached = np.where(near, label[None, :], at.size).min(axis=1)
            if (reached == label).all():
                break
            label = reached
        for i in np.flatnonzero(label != np.arange(at.size)).tolist():
            link(int(at[i]), int(at[label[i]]))

    def split(at: np.ndarray) -> None:
        if at.size < 2:
            return
        if at.size <= DIRECT:
            compare(at)
            return
        own = values[at]
        varying = np.bitwise_or.reduce(own) & ~np.bitwise_and.reduce(own)
        positions = [b for b in range(BITS) if int(varying) >> b & 1]
        if len(positions) <= radius:  # all are within the radius
            for i in at[1:].tolist():
                link(int(at[0]), i)
            return
        # a pair within the radius agrees on one of radius + 1 disjoint groups of positions
        for group in range(radius + 1):
            mask = np.uint64(sum(1 << b for b in positions[group :: radius + 1]))
            keys = own & mask
            order = np.argsort(keys, kind="stable")
            cuts = np.flatnonzero(np.diff(keys[order])) + 1
            for part in np.split(at[order], cuts):
                split(part)

    split(np.arange(values.size))
    return edges


def bucket_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links that connect whatever the radius connects, from distinct fingerprints ``fp``."""
    ship_package(prints.sparkSession)
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))])).alias("k"))
    rows = keyed.select(F.col("k.t").cast("int").alias("t"), F.col("k.key").alias("key"), "fp")
    # sorted by fingerprint as well: whoever computes a bucket again gets the same forest
    sorted_rows = rows.repartition("t", "key").sortWithinPartitions("t", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.zeros(0, dtype=np.int32)
        key = fp = np.zeros(0, dtype=np.int64)

        def links(starts, ends):
            left, right = [], []
            for a, b in zip(starts, ends):
                own = fp[a:b]
                for i, j in forest(own.view(np.uint64), radius):
                    left.append(own[i]), right.append(own[j])
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"])

        def runs():
            cut = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0)) + 1
            return np.concatenate(([0], cut)), np.append(cut, t.size)

        for batch in batches:
            t = np.concatenate((t, batch.column(0).to_numpy()))
            key = np.concatenate((key, batch.column(1).to_numpy()))
            fp = np.concatenate((fp, batch.column(2).to_numpy()))
            if not t.size:
                continue
            starts, ends = runs()
            many = np.flatnonzero(ends[:-1] - starts[:-1] > 1)  # the last bucket may go on
            yield links(starts[many], ends[many])
            t, key, fp = t[starts[-1] :], key[starts[-1] :], fp[starts[-1] :]
        if t.size > 1:
            yield links([0], [t.size])

    return sorted_rows.mapInArrow(run, schema(("u", LongType()), ("v", LongType())))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the least id reachable over links."""
    prints = stage(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    roots = components(bucket_links(distinct.select("fp"), radius), "u", "v")
    placed = stage(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    label = placed.join(named, "root").select("fp", "component_id")
    return prints.join(label, "fp").select(id_col, "fp", "component_id")


def keep_first(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near-duplicates, ``found`` being (id, component_id) of each row with an id.

    Of each component the row with the least id stays. Rows that share an id are one document: they
    stay if one of them is the least of its component, and equal rows among them stay once. Rows with
    a null id have no place in the order of ids and all stay.
    """
    found = stage(found, "near-duplicates")
    ids = found.groupBy(id_col).agg(F.max("component_id").alias("component_id"), F.count("*").alias("n"))
    gone = ids.where(F.col(id_col) != F.col("component_id")).select(id_col)
    stays = df.join(gone, id_col, "left_anti")
    repeated = ids.where((F.col("n") > 1) & (F.col(id_col) == F.col("component_id"))).select(id_col)
    if not repeated.limit(1).count():
        return stays.select(*df.columns)
    again = stays.join(repeated, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return stays.join(repeated, id_col, "left_anti").select(*df.columns).unionByName(again.select(*df.columns))


def first_of_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``df`` without near-duplicates by fingerprint, see ``keep_first``."""
    return keep_first(df, near_duplicates(df.where(F.col(id_col).isNotNull()), id_col, text_col, radius), id_col, text_col)
