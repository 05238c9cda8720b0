"""Near-duplicates by the share of common shingles: MinHash candidates, exact Jaccard check, and by fingerprints.

Texts are sets of five-word shingles; sets whose Jaccard similarity is ``SIMILAR`` or more are linked.
The candidates are sets that agree on one of ``BANDS`` bands of ``ROWS`` minima each. A pair at 0.8
exactly meets in none of the bands with a probability of (1 - 0.8^7)^45 = 2.5e-5, a closer pair with
less. Whether candidates are linked is decided by their sets alone.

Only distinct sets are compared; copies are one set. First every set is compared with one centre, the
busiest member of its buckets, which joins most groups of near copies at one comparison a set. What
buckets still hold in different components are mostly sets below the similarity; an exact join of these
over the rarest shingles of each set, with bounds on the place of the first common one, finds every link
that is left. No step writes the pairs of a bucket.

With a ``radius`` texts are also linked as :mod:`tapeloom.llm.simhash` links them, by fingerprints within
that many differing bits, which the covering masks find without a miss. Small edits all over a short text
take it below the similarity long before they move its fingerprint; long texts are the other way round.
These links come first, so the exact join is left with what neither fingerprints nor centres joined.

Null and empty texts have one set, the empty one. Texts below five words have one shingle. Very long
texts are read whole. Repeated rows and rows that share an id are judged by their own texts. Further
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from tapeloom.llm.common import per_row
from tapeloom.llm.components import components
from tapeloom.llm.simhash import bucket_links, fingerprint_of, keep_first
from tapeloom.sources.sinks import stage, staging

SIMILAR = 0.8
SHINGLE = 5
ROWS = 7
BANDS = 45
SEED = 42


def shingles_of(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z, and the six ASCII white-space characters
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        found = {h(b" ".join(words), SEED)}
    else:
        found = {h(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)))}
    return np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)))


def fp_of(found: np.ndarray) -> int:
    """One signed number for a set."""
    import xxhash

    h = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def sketcher():
    """Text to (number of the set, its size, a key for each band)."""
    import xxhash

    rng = np.random.default_rng(SEED)
    flips = rng.integers(0, 1 << 63, (ROWS * BANDS, 1), dtype=np.uint64)
    factors = rng.integers(0, 1 << 63, (ROWS * BANDS, 1), dtype=np.uint64) | np.uint64(1)

    def sketch(text: bytes) -> tuple[int, int, list[int]]:
        found = shingles_of(text)
        least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, found.size, 512):
            least = np.minimum(least, ((found[None, i : i + 512] ^ flips) * factors).min(axis=1))
        keys = [xxhash.xxh64_intdigest(band.tobytes(), t) for t, band in enumerate(least.reshape(BANDS, ROWS))]
        return fp_of(found), found.size, np.array(keys, dtype=np.uint64).view(np.int64).tolist()

    return sketch


def printer():
    """Text to (number of the set, its size, a key for each band, the fingerprint)."""
    sketch = sketcher()
    return lambda text: (*sketch(text), fingerprint_of(text))


def setter():
    """Text to (number of the set, the set)."""

    def own(text: bytes) -> tuple[int, list[int]]:
        found = shingles_of(text)
        return fp_of(found), found.view(np.int64).tolist()

    return own


def linked(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (u, v) whose sets are similar; ``u`` may be one set for many ``v``."""
    left = sets.select(F.col("fp").alias("u"), F.col("found").alias("a"))
    right = sets.select(F.col("fp").alias("v"), F.col("found").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    share = common / (F.size("a") + F.size("b") - common)
    # first the side that stands in one pair: its set moves once
    return pairs.join(right, "v").join(left, "u").where(share >= similar).select("u", "v")


def close_sizes(a: str | Column, b: str | Column, similar: float) -> Column:
    return F.least(a, b) / F.greatest(a, b) >= similar


def star_pairs(members: DataFrame, similar: float) -> DataFrame:
    """(u, v): each member with the busiest centre of its buckets, if their sizes allow a link; the busiest member of a bucket is its centre."""
    centres = members.groupBy("key").agg(F.max(F.struct("degree", "fp", "n")).alias("c"))
    near = members.join(centres, "key").where((F.col("fp") != F.col("c.fp")) & close_sizes("n", "c.n", similar))
    return near.groupBy(F.col("fp").alias("v")).agg(F.max("c").alias("c")).select(F.col("c.fp").alias("u"), "v")


def rare_pairs(rest: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(u, v): pairs of different components of ``rest`` (fp, n, root) that may be similar, by prefixes of rare shingles.

    In the order of rising frequency, two similar sets have their first common shingle so early in both
    that enough others may follow. What is not found here is not similar.
    """
    tokens = sets.join(rest, "fp").select("fp", "n", "root", F.explode("found").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("fp").orderBy("df", "token")) - 1
    early = tokens.join(often, "token").withColumn("place", place)
    prefix = stage(early.where((F.col("df") > 1) & (F.col("n") - F.col("place") >= F.ceil(similar * F.col("n") - 1e-9))).select("token", "fp", "n", "root", "place"), "rare-shingles")
    other = prefix.select("token", *[F.col(c).alias(f"{c}_") for c in ("fp", "n", "root", "place")])
    needed = F.ceil(similar / (1 + similar) * (F.col("n") + F.col("n_")) - 1e-9)
    near = (F.col("fp") < F.col("fp_")) & (F.col("root") != F.col("root_")) & close_sizes("n", "n_", similar)
    room = (F.col("n") - F.col("place") >= needed) & (F.col("n_") - F.col("place_") >= needed)
    return prefix.join(other, (prefix["token"] == other["token"]) & near & room).select(F.col("fp").alias("u"), F.col("fp_").alias("v")).distinct()


def print_links(prints: DataFrame, radius: int) -> DataFrame:
    """(u, v): links between sets (``fp``) that connect what fingerprints (``print``) within the radius connect."""
    first = stage(prints.groupBy("print").agg(F.min("fp").alias("first")), "fingerprints")
    same = prints.select("fp", "print").distinct().join(first, "print").select(F.col("first").alias("u"), F.col("fp").alias("v"))
    near = bucket_links(first.select(F.col("print").alias("fp")), radius)
    end = lambda c: first.select(F.col("print").alias(c), F.col("first").alias(f"{c}_first"))
    other = near.join(end("u"), "u").join(end("v"), "v").select(F.col("u_first").alias("u"), F.col("v_first").alias("v"))
    return same.unionByName(other).where("u <> v").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, radius: int | None = None) -> DataFrame:
    """(id, component_id) of every row; component_id is the least id reachable over links.

    With ``radius`` fingerprints that differ in that many bits at most are links as well.
    """
    with staging(df.sparkSession):
        return stage(labelled(df, id_col, text_col, similar, radius), "near-duplicates", outlives=True)


def labelled(df: DataFrame, id_col: str, text_col: str, similar: float, radius: int | None) -> DataFrame:
    keys = [("fp", LongType()), ("n", IntegerType()), ("bands", ArrayType(LongType()))]
    make = sketcher if radius is None else printer
    prints = stage(per_row(df, text_col, [id_col], make, keys if radius is None else [*keys, ("print", LongType())], as_bytes=True), "sketches")
    distinct = stage(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")), "distinct-sets")
    each = distinct.select("fp", "n", F.explode("bands").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    held = stage(each.join(shared, "key"), "shared-keys")
    degrees = held.groupBy("fp").agg(F.sum("members").alias("degree"))
    members = stage(held.select("key", "fp", "n").join(degrees, "fp"), "bucket-members")

    # the sets of what shares a bucket; an id may have several texts
    in_bucket = members.select("fp").distinct()
    ids = distinct.join(in_bucket, "fp").select(F.col("least").alias(id_col)).distinct()
    made = per_row(df.join(ids, id_col, "left_semi"), text_col, [], setter, [("fp", LongType()), ("found", ArrayType(LongType()))], as_bytes=True)
    sets = stage(made.join(in_bucket, "fp", "left_semi").dropDuplicates(["fp"]), "sets")

    stars = linked(star_pairs(members, similar), sets, similar)
    if radius is not None:
        stars = stars.unionByName(print_links(prints, radius))
    stars = stage(stars, "star-links")
    roots = components(stars, "u", "v").withColumnRenamed("node", "fp")
    placed = stage(members.drop("degree").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed-members")
    open_keys = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rest = stage(placed.join(open_keys, "key", "left_semi").select("fp", "n", "root").distinct(), "unsettled-sets")
    links = stars.unionByName(stage(linked(rare_pairs(rest, sets, similar), sets, similar), "rare-links"))

    roots = components(links, "u", "v")
    named = stage(distinct.select("fp", "least").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed-sets")
    label = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.select(id_col, "fp").join(label, "fp").select(id_col, "component_id")


def first_of_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, radius: int | None = None) -> DataFrame:
    """The rows of ``df`` without near-duplicates, see ``keep_first``."""
    return keep_first(df, near_duplicates(df.where(F.col(id_col).isNotNull()), id_col, text_col, similar, radius), id_col, text_col)
