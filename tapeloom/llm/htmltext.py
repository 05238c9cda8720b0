"""Main text of web pages, with a host suffix array for what the markup leaves open.

A page is parsed into blocks of text. Markup settles most of them: what stands in ``article`` or
``main`` is main text; menus, headers, footers, sidebars, notices, adverts, forms and comments are
not. All blocks outside the main text go into their host's token stream. Each task sorts the suffixes
of the streams it holds (a suffix array by prefix doubling, up to ``RUN`` tokens), which groups equal
runs, and hands on each run once with the streams it stands in, and each block as a whole likewise;
Spark merges these groups over all tasks. A run or a whole block that stands in ``PAGES`` or more
distinct streams of the host is boilerplate. Since any longer repeat consists of repeated runs, what
these runs cover is what repeats of ``RUN`` tokens or more cover, and no host has to be gathered in
one place. Shorter repeats within blocks are ordinary phrases, which a large host has many of; words
that stand beside boilerplate on a few of its pages are no part of it.

Pages without main markup keep, of their open blocks, those that are no boilerplate as a whole, and of
these the tokens that no boilerplate run covers. If nothing is left, as for a page whose text is repeated as a whole, the open blocks stay. Copies of a
page have equal streams and count once, so they do not make each other boilerplate.

Null or empty html and pages without text give an empty text. A null url is a host of its own.
Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tapeloom.llm.common import portions, ship_package
from tapeloom.sources.sinks import stage

#: Tokens of the shortest repeat that counts as boilerplate within a block or across blocks.
RUN = 20
#: Distinct streams of a host that a boilerplate run or block stands in.
PAGES = 3

#: Element names and the words in class, id and role that mark page furniture.
RAW = frozenset("script style noscript template svg iframe object canvas textarea".split())
FURNITURE = frozenset("nav footer aside form menu dialog button select head title".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend "
    "li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = BLOCKS | frozenset("span a button select label b i em strong small".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
COMMENT_WORDS = frozenset("comment comments disqus replies responses discussion".split())
WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement advertising banner sidebar menu nav navbar navigation header masthead footer cookie cookies consent gdpr notice notices promo "
    "sponsor sponsored newsletter subscribe breadcrumb breadcrumbs share sharing social related popup modal widget complementary contentinfo search form alert".split())

#: Words that say nothing about what an element holds.
NEUTRAL = frozenset(
    "area bar block body bottom box button buttons column container content group holder icons inline inner item items left link links list mobile panel "
    "reader readers right row section signup slot small top unit user users wrap wrapper zone".split())

#: A quote opens a value only after an equals sign; one that nothing closes is an ordinary character. Only the
#: last quote of a page can lack its end, so the scan is linear however long a value is.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|=|[^>=]++)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://([^/?#]*)", re.I)


def marked(attr: str, words: frozenset, whole: bool = False) -> bool:
    """Whether class, id or role hold a name that begins or ends with one of the words; with ``whole``, one of nothing but such words."""
    for m in MARKS.finditer(attr):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = re.split(r"[-_]+", name)
            if whole:
                if any(p in words for p in parts) and all(p in words or p in NEUTRAL for p in parts):
                    return True
            elif parts[0] not in ("has", "no", "with", "without", "is") and (parts[0] in words or parts[-1] in words):
                return True
    return False


def zone_of(name: str, attr: str, above: str) -> str:
    """'main', 'furniture' or 'open' for what stands in an element, given the zone around it."""
    if above == "furniture" or name in FURNITURE or (attr and HIDDEN.search(attr)):
        return "furniture"
    if name in MAIN:
        return "furniture" if attr and marked(attr, COMMENT_WORDS) else "main"
    if name == "header":
        return "main" if above == "main" else "furniture"
    if name not in ("html", "body") and attr:
        # inside main text a name counts only if all of it speaks of furniture, and a header is the text's own
        if marked(attr, WORDS - {"header", "masthead", "form"}, whole=True) if above == "main" else marked(attr, WORDS):
            return "furniture"
    return above


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of every block with text, in page order."""
    found: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []
    zone, pos, n = "open", 0, len(page)

    def close():
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            found.append((zone, text))

    while pos < n:
        m = TAG.search(page, pos)
        if not m:
            held.append(page[pos:])
            break
        if m.start() > pos:
            held.append(page[pos : m.start()])
        pos = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        attr, ends = m["attr"] or "", bool(m["end"])
        if name in RAW:
            if not ends:
                after = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
                pos = after.end() if after else n
            continue
        if name == "br":
            held.append(" ")
        if name in BLOCKS:
            close()
        if name in VOID or name not in CONTAINERS:
            continue
        if ends:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if at >= 0:
                if zone != (stack[at - 1][1] if at else "open"):
                    close()
                del stack[at:]
        else:
            if name == "body":
                stack.clear()
            elif name in BLOCKS:
                # paragraphs and list items end where the next one begins
                while stack and (stack[-1][0] == "p" or stack[-1][0] == name == "li" or stack[-1][0] not in BLOCKS):
                    stack.pop()
            above = stack[-1][1] if stack else "open"
            inner = zone_of(name, attr, above)
            if inner != zone and held:
                close()
            if name in BLOCKS or inner != above:
                stack.append((name, inner))
        zone = stack[-1][1] if stack else "open"
    close()
    return found


def host_of(url: str | None) -> str:
    m = HOST.match((url or "").strip())
    return m[1].rpartition("@")[2].lower() if m else ""


def suffix_runs(streams: list[list[str]], run: int = RUN) -> list[np.ndarray]:
    """For each stream a number for the run that begins at each place; equal runs have equal numbers.

    The streams are concatenated with a border of its own after each, and the suffixes are sorted by
    their first ``run`` tokens by prefix doubling. Places from which no whole run fits have -1.
    """
    ids: dict[str, int] = {}
    flat: list[int] = []
    for s in streams:
        flat.extend(ids.setdefault(t, len(ids)) for t in s)
        flat.append(-1)
    tokens = np.array(flat, dtype=np.int64)
    border = np.flatnonzero(tokens < 0)
    tokens[border] = len(ids) + np.arange(border.size)
    rank, width = np.unique(tokens, return_inverse=True)[1], 1
    while width < run:
        step = min(width, run - width)
        shifted = np.append(rank[step:], np.full(min(step, rank.size), -1))
        # order of suffixes by twice the tokens, then their new ranks
        order = np.lexsort((shifted, rank))
        new = (np.diff(rank[order]) != 0) | (np.diff(shifted[order]) != 0)
        again = np.empty_like(rank)
        again[order] = np.concatenate(([0], np.cumsum(new)))
        rank, width = again, width + step
    out, start = [], 0
    for end in border.tolist():
        own = rank[start:end].copy()
        own[max(0, end - start - run + 1) :] = -1
        out.append(own)
        start = end + 1
    return out


def run_hash(tokens: list[str]) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest("\x00".join(tokens))
    return h - (1 << 64) if h >> 63 else h


def parse(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Per page: (row, id, url, host, text or null, open blocks if there is no main text, stream, run hashes, block hashes)."""
    ship_package(pages.sparkSession)
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    longs = ArrayType(LongType())
    out = StructType([
        StructField("row", LongType()), source.schema["id"], source.schema["url"], StructField("host", StringType()), StructField("text", StringType()),
        StructField("open", ArrayType(StringType())), StructField("stream", LongType()), StructField("runs", longs), StructField("whole", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        row = TaskContext.get().partitionId() << 33
        for batch in portions(batches, 2):
            texts, opens, streams, whole, hosts = [], [], [], [], []
            urls = batch.column(1).to_pylist()
            for url, page in zip(urls, batch.column(2).to_pylist()):
                found = blocks(page)
                main = [t for z, t in found if z == "main"]
                rest = [t for z, t in found if z == "open"]
                texts.append("\n".join(main) if main or not rest else None)
                opens.append(None if main or not rest else rest)
                # undecided pages are judged by their open blocks, the others give all that is not main text
                judged = [t.split(" ") for z, t in found if z == "open" or (main and z == "furniture")]
                streams.append([w for b in judged for w in b])
                whole.append([run_hash([""] + b) for b in judged])  # no token is empty, so no run has such a hash
                hosts.append(host_of(url))
            hashes: list = [None] * len(streams)
            for host in set(hosts):
                at = [i for i, h in enumerate(hosts) if h == host]
                known: dict[int, int] = {}
                for i, ranks in zip(at, suffix_runs([streams[i] for i in at])):
                    own = []
                    for place, r in enumerate(ranks.tolist()):
                        if r >= 0:
                            if r not in known:
                                known[r] = run_hash(streams[i][place : place + RUN])
                            own.append(known[r])
                    hashes[i] = own
            arrays = [pa.array(range(row, row + len(texts)), pa.int64()), batch.column(0).cast(arrow.field(1).type), batch.column(1).cast(arrow.field(2).type)]
            arrays += [pa.array(v, arrow.field(3 + k).type) for k, v in enumerate((hosts, texts, opens, [run_hash(s) for s in streams], hashes, whole))]
            row += len(texts)
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return source.mapInArrow(run, out)


def boilerplate(parsed: DataFrame, pages: int = PAGES) -> DataFrame:
    """(host, run, n): runs and whole blocks that stand in ``pages`` or more distinct streams of a host."""
    each = parsed.select("host", "stream", F.explode(F.array_union("runs", "whole")).alias("run")).distinct()
    return each.groupBy("host", "run").agg(F.count("*").alias("n")).where(F.col("n") >= pages)


def unique_runs(open_blocks: list[str], covered: list[tuple[int, int]]) -> str:
    """The open blocks without whole blocks and runs that are boilerplate.

    ``covered`` has (place, streams): a run of tokens begins at the place, or block k as a whole has
    the place -1 - k. A run that overlaps one of more than twice its streams is that one with words
    that happen to stand beside it on some pages; those words stay.
    """
    listed = [block.split(" ") for block in open_blocks]
    starts = [0]
    for words in listed:
        starts.append(starts[-1] + len(words))
    spans = [((p, p + RUN) if p >= 0 else (starts[-1 - p], starts[-p])) + (n, p < 0) for p, n in covered]
    peak, gone = np.zeros(starts[-1], dtype=np.int64), np.zeros(starts[-1], dtype=bool)
    for a, b, n, _ in spans:
        np.maximum(peak[a:b], n, out=peak[a:b])
    for a, b, n, whole in spans:
        if whole or 2 * n >= peak[a:b].max():
            gone[a:b] = True
    kept = []
    for words, a in zip(listed, starts):
        rest = [w for k, w in enumerate(words) if not gone[a + k]]
        if rest:
            kept.append(" ".join(rest))
    return "\n".join(kept or open_blocks)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    parsed = stage(parse(pages, id_col, url_col, html_col), "pages")
    decided = parsed.where(F.col("text").isNotNull()).select("id", "url", "text")
    undecided = parsed.where(F.col("text").isNull())
    runs = undecided.select("row", "host", F.posexplode("runs").alias("place", "run"))
    whole = undecided.select("row", "host", F.posexplode("whole").alias("block", "run"))
    places = runs.unionByName(whole.select("row", "host", (-1 - F.col("block")).alias("place"), "run"))
    covered = places.join(boilerplate(parsed), ["host", "run"]).groupBy("row").agg(F.collect_list(F.struct("place", "n")).alias("covered"))
    joined = undecided.select("row", "id", "url", "open").join(covered, "row", "left").select("id", "url", "open", "covered")
    out = StructType([joined.schema["id"], joined.schema["url"], StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            texts = [unique_runs(b, [(x["place"], x["n"]) for x in c or []]) for b, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), batch.column(1).cast(arrow.field(1).type), pa.array(texts, pa.string())], schema=arrow)

    every = decided.unionByName(joined.mapInArrow(run, out))
    return every.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
