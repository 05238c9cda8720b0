"""Streaming chains: classify filings, raise alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeloom.operators.keyed import dedup_filings
from tapeloom.plans import alerts, rules
from tapeloom.sources import feeds
from tapeloom.sources.sinks import stage, staging
from tapeloom.streaming import bus
from tapeloom.streaming.stateful import HOUR_US, limit_alerts

FILING = "filing_id bigint, feed string, symbol string, subject string, description string"
CLASSIFIED = "filing_id bigint, symbol string, category string, materiality int, sentiment double, confidence double, routine boolean"


def classify_events(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classified events and dead letters of a ``filing.received`` batch; a filing is classified once."""
    good, dead = bus.split_poison(batch, FILING, ["filing_id", "feed"])
    done = rules.finalize(rules.classify(good.dropDuplicates(["filing_id"])))
    body = F.to_json(F.struct(*[c.split(" ")[0] for c in CLASSIFIED.split(", ")]))
    events = done.select("id", F.lit("filing.classified").alias("topic"), body.alias("payload"), "created_at")
    return events, dead


def alert_events(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alerts and dead letters of a ``filing.classified`` batch."""
    good, dead = bus.split_poison(batch, CLASSIFIED, ["filing_id"])
    routed = alerts.route_classified(good)
    rows = routed.select(
        F.col("id").alias("alert_id"), "severity", "category", "symbol",
        alerts.classified_message(F.col("materiality"), F.col("category"), F.col("sentiment")).alias("message"),
        F.col("filing_id").cast("string").alias("evidence_ref"), F.col("created_at").alias("observed_at"),
    )
    return rows, dead


def run_classifier(spark: SparkSession, inbox: str, root: str) -> None:
    """inbox events -> root/classified and root/dead, one folder per micro-batch.

    The stream's state remembers the filings classified so far, so a filing that comes again under
    another event id, in this batch or any later one, gives nothing more. Poison events remember
    nothing but themselves: a good event of the same filing is still classified.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        with staging(spark):
            events, dead = classify_events(stage(batch, "classify-batch"))
            bus.write_batch(events, f"{root}/classified", batch_id)
            bus.write_batch(dead, f"{root}/dead", batch_id)

    events = bus.read_topic(spark, inbox, "filing.received")
    marked = bus.parsed_events(events, FILING, ["filing_id", "feed"])
    poison = F.concat(F.lit("event "), F.col("id"), F.lit(" "), F.coalesce(F.xxhash64("payload"), F.lit(0)))
    key = F.when(F.col("_bad"), poison).otherwise(F.concat(F.lit("filing "), F.col("_p.filing_id")))
    keyed = marked.select(*events.columns, key.alias("_key"))
    bus.consume(bus.first_seen(keyed, "_key").drop("_key"), "classify", f"{root}/_ck_classify", handle)


def run_alerts(spark: SparkSession, root: str) -> None:
    """root/classified events -> root/alerts and root/alerts_dead; an event alerts once, also when it comes again."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        with staging(spark):
            rows, dead = alert_events(stage(batch, "alert-batch"))
            bus.write_batch(rows, f"{root}/alerts", batch_id)
            bus.write_batch(dead, f"{root}/alerts_dead", batch_id)

    stream = bus.read_topic(spark, f"{root}/classified/*", "filing.classified")
    bus.consume(bus.first_seen(stream, "id"), "alerts", f"{root}/_ck_alerts", handle)


def filing_keys() -> dict[str, Column]:
    """Keys of a raw entry, as columns: ``_key`` stands for its natural key, or its content without one.

    Content and natural key are digests of different lengths, so they never meet. Equal content means
    an equal natural key, and the natural key is enough, unless the entry is ``_mixed``: without a feed, or with
    the separator of the content hash in its text. ``_content`` is what such an entry is known by besides.
    """
    parts = ["feed", "title", "link", "pub", "description"]
    mixed = (F.coalesce("feed", F.lit("")) == "") | F.concat_ws("", *parts).contains("\x1f")
    digest = feeds.entry_hash()
    content = F.unhex(F.when(mixed, F.concat(digest, F.lit("00"))).otherwise(digest))
    feed = F.concat_ws("\x1f", F.coalesce(F.length("feed").cast("string"), F.lit("")), F.coalesce("feed", F.lit("")))
    natural = F.unhex(F.sha2(F.concat(feed, F.lit("\x1f"), feeds.entry_link()), 224))
    return {"_key": F.coalesce(natural, content), "_mixed": mixed, "_content": F.when(mixed, content)}


def run_ingest(spark: SparkSession, entries: DataFrame, root: str, keep: list[str]) -> None:
    """Stream of raw entries -> root/filings, deduplicated against everything stored before.

    Every entry sends its key through the stream's state, and the keys that come out are those no
    earlier batch had; only they pass through the state, the entries go beside it. A backfill of any age
    meets its earlier copy, and of several new copies in one batch the earliest stays. Entries are typed
    when it is known that they stay. A micro-batch reads its files twice, so what makes ``entries`` of
    them must give the same rows again.
    """
    entries = entries.select(*dict.fromkeys([*keep, "feed", "title", "link", "pub", "description"]))
    keys = filing_keys()
    sent = entries.select(F.explode(F.array_compact(F.array(keys["_key"], keys["_content"]))).alias("_seen"))
    # both read the one source, so a micro-batch has the keys of its own entries
    both = bus.first_seen(sent, "_seen").unionByName(entries, allowMissingColumns=True)

    def handle(batch: DataFrame, batch_id: int) -> None:
        with staging(spark):
            # written once: the steps below read it side by side, and none takes the stream through its state again
            rows = stage(batch, "ingest-batch")
            new = rows.where("_seen IS NOT NULL").select("_seen")
            read = rows.where("_seen IS NULL").select(*entries.columns)
            read = read.withColumns(keys)
            # the content of a mixed entry must be new before it may stand for its natural key
            mixed = read.where("_mixed").join(new, F.col("_content") == F.col("_seen"), "left_semi")
            once = read.where("NOT _mixed").unionByName(mixed).withColumn("content_hash", feeds.entry_hash())
            fresh = dedup_filings(once, natural="_key", mixed="_mixed").join(new, F.col("_key") == F.col("_seen"), "left_semi")
            bus.write_batch(feeds.entries_to_filings(fresh, keep=keep), f"{root}/filings", batch_id)

    bus.consume(both, "ingest", f"{root}/_ck_ingest", handle, release=True)


def run_budget(spark: SparkSession, high: DataFrame, root: str) -> None:
    """Stream of alerts -> root/decisions (alert_id, observed_at, sent) under the hourly budget.

    Alerts sent in the hour before a batch join its fold: they were admitted once and are
    admitted again, so the batch starts from the right budget. An alert that arrives late, after
    later ones were sent, is decided by the alerts sent in the hour before its own time alone; what
    was sent stays sent, so an hour that contains it may end above the budget by late alerts.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        columns = ["alert_id", "severity", "observed_at"]
        rows = batch.select(*columns)
        stored = bus.written(spark, f"{root}/decisions", before=batch_id)
        first = rows.agg(F.min(F.unix_micros("observed_at")).alias("us")).first()["us"]
        if stored is not None and first is not None:
            # decisions lie in folders by hour: only those of the hour before are read
            recent = stored.where((F.col("hour") >= first // HOUR_US - 1) & F.col("sent") & (F.unix_micros("observed_at") >= first - HOUR_US)).select(*columns)
            decided = limit_alerts(rows.unionByName(recent)).join(recent.select("alert_id"), "alert_id", "left_anti")
        else:
            decided = limit_alerts(rows)
        bus.write_batch(decided.select(*columns, "sent", F.floor(F.unix_micros("observed_at") / HOUR_US).alias("hour")), f"{root}/decisions", batch_id, by="hour")

    bus.consume(high, "budget", f"{root}/_ck_budget", handle)
