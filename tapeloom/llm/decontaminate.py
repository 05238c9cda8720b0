"""Benchmark decontamination with a distributed positional inverted index.

Every test item gives windows of ``WIDTH`` consecutive words. The corpus is indexed for the terms that
matter: of each window the rarest term by corpus count, with every position of it in every document
and the words around that position. Windows then meet the posting lists of their rarest term; the
offset moves a posting to where the window would begin, the list is intersected with the second
rarest term at its own offset, and what is left is compared with the whole window. Windows without an
exact match whose two rarest terms stand close together are proximity matches; terms that the corpus
lacks are passed over there.

All steps are DataFrame operations. The terms and windows of the test items are broadcast where their
written size is small (``BROADCAST_MB``); beyond that Spark joins them by shuffle, with the same result.

Words are runs of digits, letters and all characters beyond ASCII; A-Z is lowered, nothing else. Null
and empty texts have no words, and are neither hit nor hit others. An item with fewer words than the
width is one window. Equal windows of several items count for all of them. Rows that share id and
text have equal results; rows that share an id with different texts are separate documents. An empty
test table leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.sources.sinks import stage, staging

WIDTH = 10
#: Words between the two rarest terms of a window up to which they are a proximity match.
NEAR = 10
BROADCAST_MB = 16
#: Borders between words in a text whose case was kept; A-Z are words as well.
BORDER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words of a text, case kept."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BORDER), "")


def lower(text: Column) -> Column:
    """A-Z lowered."""
    return F.translate(text, UPPER, UPPER.lower())


def is_small(df: DataFrame) -> bool:
    """Whether the files of a written table are small enough to send them to every executor."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= BROADCAST_MB << 20


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table, with a broadcast hint if its files are small."""
    return F.broadcast(df) if is_small(df) else df


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(window, terms, items): the distinct windows of the test items."""
    listed = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words(lower(F.col(text_col))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    cut = listed.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("terms"))
    return cut.groupBy("terms").agg(F.collect_set("item").alias("items")).select(F.array_join("terms", " ").alias("window"), "terms", "items")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, version, words): a document is an id with a text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), words(text).alias("w"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): corpus count of every test term; upper and lower case of any letter count together."""
    tokens = docs.select(F.explode("w").alias("word")).select(F.lower("word").alias("term"))
    return tokens.join(small(terms), "term").groupBy("term").agg(F.count("*").alias("n"))


def anchored(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows with their rarest and second rarest terms of the corpus and the offsets of these.

    Windows with a term that the corpus lacks can't occur as a whole, but their two rarest known terms
    may stand close together; with less than two they are left out."""
    places = wins.select("window", F.size("terms").alias("len"), F.posexplode("terms").alias("offset", "word"))
    known = places.join(small(counts), F.lower("word") == F.col("term"))
    ranked = known.groupBy("window", "len").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term", "word"))).alias("by"))
    second = F.try_element_at("by", F.lit(2))
    return ranked.where((F.size("by") == F.col("len")) | (F.size("by") > 1)).select(
        "window", "len", F.col("by")[0]["term"].alias("term"), F.col("by")[0]["offset"].alias("offset"),
        second["word"].alias("word2"), second["offset"].alias("offset2"))


def postings(docs: DataFrame, anchors: DataFrame, reach: int) -> DataFrame:
    """The positional index: (term, id, version, pos, first, around) for the anchor terms.

    ``around`` are the words from position ``first`` on, ``reach`` to either side of ``pos``.
    """
    first = F.greatest(F.lit(0), F.col("pos") - reach)
    around = F.slice("w", first + 1, F.col("pos") - first + reach + 1)
    if is_small(anchors):
        tokens = docs.select("id", "version", "w", F.posexplode("w").alias("pos", "token"))
        hits = tokens.withColumn("term", F.lower("token")).join(F.broadcast(anchors), "term")
        return hits.select("term", "id", "version", "pos", first.alias("first"), around.alias("around"))
    # places alone meet the terms by shuffle; the texts of the documents with a hit move once each
    places = docs.select("id", "version", F.posexplode("w").alias("pos", "token")).select("id", "version", "pos", F.lower("token").alias("term"))
    hits = places.join(anchors, "term").select("term", F.col("id").alias("hit_id"), F.col("version").alias("hit_version"), "pos").distinct()
    texts = docs.groupBy("id", "version").agg(F.first("w").alias("w"))
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("version") == F.col("hit_version"))
    return hits.join(texts, same).select("term", "id", "version", "pos", first.alias("first"), around.alias("around"))


def matches(index: DataFrame, anchors: DataFrame, wins: DataFrame) -> DataFrame:
    """(id, version, start, len, items, exact): exact phrases and proximity matches."""
    texts = wins.select("window", "items")
    met = index.join(small(anchors), "term")
    at = F.col("pos") - F.col("offset") - F.col("first")  # of the window's start, in ``around``
    # the second rarest list, moved by its offset; the slice is compared only where it agrees
    agrees = F.col("word2").isNull() | (lower(F.try_element_at("around", at + F.col("offset2") + 1)) == F.col("word2"))
    phrase = lower(F.array_join(F.slice("around", F.greatest(F.lit(1), at + 1), F.col("len")), " "))
    exact = F.coalesce((at >= 0) & agrees & (phrase == F.col("window")), F.lit(False))
    close = F.coalesce(F.exists("around", lambda w: lower(w) == F.col("word2")), F.lit(False))
    judged = met.select("id", "version", (F.col("pos") - F.col("offset")).alias("start"), "len", "window", exact.alias("exact"), close.alias("close"))
    return judged.where("exact or close").join(small(texts), "window")


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(documents with n_words, matches), both by (id, version)."""
    rows = keyed(docs, id_col, text_col)
    wins = stage(windows(items, item_id, item_text, width), "windows")
    terms = stage(wins.select(F.explode("terms").alias("word")).select(F.lower("word").alias("term")).distinct(), "terms")
    counts = stage(term_counts(rows, terms), "term-counts")
    anchors = stage(anchored(wins, counts), "anchors")
    index = stage(postings(rows, stage(anchors.select("term").distinct(), "anchor-terms"), max(width, NEAR)), "index")
    found = stage(matches(index, anchors, wins), "matches")
    return rows.select("id", "version", F.size("w").cast("long").alias("n_words")), found


def covered(found: DataFrame) -> DataFrame:
    """(id, version, n_hit): words inside any exact match, each counted once."""
    by = Window.partitionBy("id", "version").orderBy("start", "end")
    spans = found.where("exact").select("id", "version", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", before))
    return spans.select("id", "version", new.alias("new")).groupBy("id", "version").agg(F.sum("new").alias("n_hit"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: words, hit words, items met, their digest, the verdict, and windows met in proximity only."""
    rows, found = scan(docs, items, id_col, text_col, item_id, item_text, width)
    met = (
        found.where("exact").select("id", "version", F.explode("items").alias("item")).distinct()
        .groupBy("id", "version").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    )
    near = found.groupBy("id", "version", "window").agg(F.max("exact").alias("exact")).where("not exact").groupBy("id", "version").agg(F.count("*").alias("n_near"))
    facts = covered(found).join(met, ["id", "version"], "full").join(near, ["id", "version"], "full")
    marked = facts.select(F.col("id").alias("__id"), F.col("version").alias("__version"), "n_hit", "n_items", "items", "n_near")
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("version") == F.col("__version"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(marked, same, "left").select(
        F.col("id").alias(id_col), "n_words", zero("n_hit"), zero("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), zero("n_near"))


def clean_only(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that hold no window of a test item."""
    with staging(docs.sparkSession):
        _, found = scan(docs, items, id_col, text_col, width=width)
        bad = stage(found.where("exact").select(F.col("id").alias("__id"), F.col("version").alias("__version")).distinct(), "contaminated", outlives=True)
    version = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # two numbers for each contaminated document; the texts stay where they are if these are few
    return docs.join(small(bad), F.col(id_col).eqNullSafe(F.col("__id")) & (version == F.col("__version")), "left_anti")
