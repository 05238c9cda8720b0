"""Line dedup by pairwise alignment.

A block is a run of lines that follow each other in two documents and hold ``MIN_WORDS`` words or more.
The lines of each block that a document shares with an earlier one, whichever it is, are deleted from
the document. Earlier means the smaller id. Lines without a word stay, and lines are compared without
white space at their ends.

Blocks are found through windows: the shortest runs of ``MIN_WORDS`` words that begin or end at a line. Each
line of a block lies in a window of the block, so a line goes if and only if one of its windows stands in an
earlier document. Every window has an owner, its earliest holder. Documents that share a rare window
(``RARE`` documents at most) with its owner are aligned with patience diff, and the aligned blocks are
deleted; the windows themselves are deleted from all later holders by a join, for any number of holders,
so blocks that an alignment misses (repeated or moved ones, or those of documents with other owners) and
blocks of thousands of documents are found alike, and ``RARE`` has no say in the result.

There is one pair for a holder of a rare window, not all pairs of its holders. Exact copies of a document
are one document to all of this; the later copies lose all their lines.

Null and empty texts have no lines and are returned as they are. Rows that share id and text are one
document and stay alike; rows that share an id with different texts are documents of their own, in
the order of a hash of the text. Rows with a null id are left alone. Work grows with the lines of a text
and of its partners, never with their square; very long texts are read whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType

from tapeloom.llm.common import per_row, schema, ship_package
from tapeloom.sources.sinks import stage, staging

RARE = 16
MIN_WORDS = 5


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def windows_of(sizes: list[int], min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(first line, number of lines) of the shortest runs of ``min_words`` words from each line on and up to each line."""
    worded = [i for i, n in enumerate(sizes) if n]
    found = set()
    begin, words = 0, 0
    for i in worded:  # the shortest run that ends at i
        words += sizes[i]
        while words - sizes[worded[begin]] >= min_words:
            words -= sizes[worded[begin]]
            begin += 1
        if words >= min_words:
            found.add((worded[begin], i - worded[begin] + 1))
    end, words = 0, 0
    for i in worded:  # the shortest run that begins at i
        while words < min_words and end < len(worded):
            words += sizes[worded[end]]
            end += 1
        if words < min_words:
            break
        found.add((i, worded[end - 1] - i + 1))
        words -= sizes[i]
    return sorted(found)


def line_hashes(text: bytes, min_words: int = MIN_WORDS) -> tuple[list[int], list[int], list[int], list[int], list[int], list[bool]]:
    """Hash of every line, signed, and its words (0 and 0 for lines without one); hash, first line and lines of every window, and whether it stands there first."""
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    hashes, sizes = [], []
    for line in text.split(b"\n"):
        n = len(line.split())
        hashes.append(signed(xxhash.xxh64_intdigest(line.strip())) if n else 0)
        sizes.append(n)
    runs = windows_of(sizes, min_words)
    packed = np.array(hashes, dtype=np.int64).tobytes()
    keys = [hashes[i] if n == 1 else signed(xxhash.xxh64_intdigest(packed[8 * i : 8 * (i + n)])) for i, n in runs]
    seen: set[int] = set()
    first = [not (k in seen or seen.add(k)) for k in keys]
    return hashes, sizes, keys, [i for i, _ in runs], [n for _, n in runs], first


def anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of lines that stand once in both, as the longest series that rises in both."""
    once_a = {h: i for i, h in enumerate(a)}
    count_a, count_b = Counter(a), Counter(b)
    pairs = [(once_a[h], j) for j, h in enumerate(b) if h and count_b[h] == 1 and count_a.get(h) == 1]
    # patience sorting: the smallest last place of a rising series of each length
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (i, _) in enumerate(pairs):
        place = bisect_left(tops, i)
        back.append(at[place - 1] if place else -1)
        if place == len(tops):
            tops.append(i), at.append(k)
        else:
            tops[place], at[place] = i, k
    series, k = [], at[-1] if at else -1
    while k >= 0:
        series.append(pairs[k])
        k = back[k]
    return series[::-1]


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: equal lines at the matched places, between anchors found again within each gap."""
    matched: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        found = [(a0 + i, b0 + j) for i, j in anchors(a[a0:a1], b[b0:b1])]
        if not found:
            continue
        matched.extend(found)
        for (i, j), (p, q) in zip([(a0 - 1, b0 - 1)] + found, found + [(a1, b1)]):
            if i + 1 < p and j + 1 < q:
                gaps.append((i + 1, p, j + 1, q))
    return sorted(matched)


def common_blocks(a: list[int], b: list[int], sizes: list[int], min_words: int = MIN_WORDS) -> list[int]:
    """Places in ``b`` of the lines of aligned blocks of ``min_words`` words or more."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in aligned(a, b) + [(-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(sizes[k] for k in block) >= min_words:
                out.extend(k for k in block if sizes[k])
            block = []
        block.append(j)
        last = (i, j)
    return out


def listed(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, version, hashes, sizes, keys, begins, spans, first) of each row."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("version"), F.col(text_col).alias("text"))
    longs, ints = ArrayType(LongType()), ArrayType(IntegerType())
    fields = [("hashes", longs), ("sizes", ints), ("keys", longs), ("begins", ints), ("spans", ints), ("first", ArrayType(BooleanType()))]
    return per_row(rows, "text", ["id", "version"], lambda: lambda text: line_hashes(text, min_words), fields, as_bytes=True)


def align_pairs(sides: DataFrame, kind: DataType, min_words: int) -> DataFrame:
    """(id, version, begin, span): lines of aligned blocks, from (id, version, a, b, sizes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [common_blocks(a, b, n, min_words) for a, b, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int32()))], names=["id", "version", "places"])

    blocks = sides.mapInArrow(run, schema(("id", kind), ("version", LongType()), ("places", ArrayType(IntegerType()))))
    return blocks.select("id", "version", F.explode("places").alias("begin")).withColumn("span", F.lit(1))


def marked(lost: DataFrame, kind: DataType) -> DataFrame:
    """(id, version, removed, gone): places of the lines with a word inside the runs, and a flag for each line."""
    flags = ArrayType(BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, gone = [], []
            for begins, spans, sizes in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                edges = np.zeros(len(sizes) + 1, dtype=np.int64)
                np.add.at(edges, begins, 1)
                np.add.at(edges, np.add(begins, spans), -1)
                inside = (np.cumsum(edges[:-1]) > 0) & (np.array(sizes) > 0)
                removed.append(np.flatnonzero(inside).astype(np.int32))
                gone.append(inside)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.list_(pa.int32())), pa.array(gone, pa.list_(pa.bool_()))], names=["id", "version", "removed", "gone"])

    return lost.mapInArrow(run, schema(("id", kind), ("version", LongType()), ("removed", ArrayType(IntegerType())), ("gone", flags)))


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, version, removed, gone): places and flags of the lines to delete, for documents that lose any; flags are null if all go."""
    ship_package(df.sparkSession)
    docs = stage(listed(df, id_col, text_col, min_words).dropDuplicates(["id", "version"]), "lines")
    # exact copies: one version is one text; nothing is grouped in the stage of this join, so Spark can split a text with many copies
    first = stage(docs.groupBy("version").agg(F.min("id").alias("head")), "first-copies")
    placed = docs.select("id", "version", "sizes").join(first, "version")
    heads = docs.join(first, "version").where("id = head")
    doc = F.struct("id", "version").alias("doc")
    windows = stage(heads.select(doc, F.explode(F.arrays_zip("keys", "begins", "spans", "first")).alias("w")).select(
        "doc", F.col("w.keys").alias("key"), F.col("w.begins").alias("begin"), F.col("w.spans").alias("span"), F.col("w.first").alias("first")), "windows")
    shared = stage(windows.where("first").groupBy("key").agg(F.count("*").alias("docs"), F.min("doc").alias("owner")).where("docs > 1"), "shared-windows")
    later = stage(windows.join(shared, "key").where("doc <> owner").select("doc", "owner", "docs", "begin", "span"), "later-windows")

    pairs = later.where(F.col("docs") <= rare).select("doc", "owner").distinct()
    own = heads.select(doc, F.col("hashes").alias("b"), "sizes")
    other = heads.select(F.struct("id", "version").alias("owner"), F.col("hashes").alias("a"))
    kind = heads.schema["id"].dataType
    aligned_lines = align_pairs(pairs.join(own, "doc").join(other, "owner").select("doc.id", "doc.version", "a", "b", "sizes"), kind, min_words)

    # windows of any number of holders
    runs = later.select("doc.id", "doc.version", "begin", "span").union(aligned_lines)
    lost = runs.groupBy("id", "version").agg(F.collect_set(F.struct("begin", "span")).alias("r"))
    sides = lost.join(heads.select("id", "version", "sizes"), ["id", "version"])
    cut = marked(sides.select("id", "version", F.col("r.begin").alias("begins"), F.col("r.span").alias("spans"), "sizes"), kind)
    # later copies lose every line with a word
    copies = placed.where("id > head").select(
        "id", "version", F.filter(F.transform("sizes", lambda n, i: F.when(n > 0, i)), lambda i: i.isNotNull()).alias("removed"),
        F.lit(None).cast("array<boolean>").alias("gone")).where(F.size("removed") > 0)
    return cut.unionByName(copies)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` without the deleted lines, and the columns n_lines, n_removed and removed.

    A document that loses every line with a word keeps its row, with an empty text. ``df`` may hold
    further columns; if one is named as an added one, the added one takes its place.
    """
    with staging(df.sparkSession):
        gone = stage(removals(df, id_col, text_col, rare, min_words), "removed-lines", outlives=True)
    gone = gone.select(F.col("id").alias("__id"), F.col("version").alias("__version"), F.col("removed").alias("__removed"), F.col("gone").alias("__gone"))
    text = text_of(text_col)
    joined = df.join(gone, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text) == F.col("__version")), "left")
    lines = F.split(text, "\n")
    rest = F.array_join(F.filter(lines, lambda x, i: ~F.get(F.col("__gone"), i)), "\n")
    bare = F.when(F.col("__gone").isNull(), "").otherwise(F.regexp_replace(rest, r"^\s+$", ""))  # only lines without a word are left
    added = {"n_lines": F.when(text == "", 0).otherwise(F.size(lines)).cast("long"), "n_removed": F.coalesce(F.size("__removed"), F.lit(0)).cast("long"), "removed": F.coalesce("__removed", F.array().cast("array<int>"))}
    kept = [c for c in df.columns if c.lower() not in added and c != text_col]
    new_text = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(bare).alias(text_col)
    return joined.select(*kept, new_text, *[v.alias(k) for k, v in added.items()])
