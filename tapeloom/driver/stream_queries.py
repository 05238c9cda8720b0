"""Streaming queries: each drains a file stream of the given tables and returns its table."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapeloom.driver.queries import query, ts
from tapeloom.driver.tables import Tables
from tapeloom.sources.sinks import shared_dir
from tapeloom.streaming import bus, pipelines
from tapeloom.streaming.stateful import issue_stream


def scratch(t: Tables, name: str) -> str:
    """A folder of its own for one run, where every executor can write."""
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _waves(t: Tables, name: str) -> list[DataFrame]:
    """The events in three parts by time."""
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = [F.lit(c).cast("timestamp") for c in ("2024-01-10", "2024-01-20")]
    return [rows.where(F.col("ts") < cuts[0]), rows.where((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])), rows.where(F.col("ts") >= cuts[1])]


def _drain(t: Tables, root: str, waves: list[DataFrame], counts, name: str, mode: str) -> DataFrame:
    """Runs the aggregation once for each wave, each time from the checkpoint of the run before."""
    for wave in waves:
        wave.write.mode("append").parquet(f"{root}/in")
        stream = t.spark.readStream.schema(wave.schema).parquet(f"{root}/in")
        bus.collect_updates(counts(stream), name, root, mode)
    return t.spark.read.parquet(f"{root}/{name}")


def _counts(t: Tables, counts, name: str) -> DataFrame:
    rows = _drain(t, scratch(t, name), _waves(t, name), counts, name, "update")
    # a count only grows, so its last update is its largest
    return rows.groupBy("window_start", "window_end", "event_type").agg(F.max("n").alias("n"))


@query
def stream_windows(t):
    df = _counts(t, lambda s: bus.tumbling_counts(s, "ts", "event_type"), "tumbling")
    return df.select(ts("window_start"), "event_type", "n")


@query
def stream_sliding(t):
    df = _counts(t, lambda s: bus.tumbling_counts(s, "ts", "event_type", slide="30 minutes"), "sliding")
    return df.select(ts("window_start"), "event_type", "n")


@query
def stream_sessions(t):
    """Sessions leave the state when the watermark passes them; an event in the far future closes the last."""
    waves = _waves(t, "sessions")
    last = waves[0].limit(1).withColumns({"ts": F.lit("2124-01-01").cast("timestamp"), "user_id": F.lit(-1).cast(waves[0].schema["user_id"].dataType)})
    rows = _drain(t, scratch(t, "sessions"), [*waves, last], lambda s: bus.session_counts(s, "ts", "user_id"), "sessions", "append")
    return rows.where("user_id <> -1").select("user_id", ts("window_start"), "n")


@query
def stream_dedup(t):
    """Entries stream in two waves: the second repeats the first, which must add nothing."""
    root = scratch(t, "dedup")
    columns = ["filing_id", "feed", "title", "link", "pub", "description", "observed_at"]
    schema = t.raw_entries.select(*columns).schema
    for _ in range(2):
        # new files in place of those that the stream has read
        t.raw_entries.select(*columns).write.mode("overwrite").parquet(f"{root}/entries")
        stream = t.spark.readStream.schema(schema).parquet(f"{root}/entries")
        pipelines.run_ingest(t.spark, stream, root, ["filing_id", "observed_at"])
    return t.spark.read.parquet(f"{root}/filings").select("filing_id", "feed", "content_hash")


def _pipeline(t: Tables) -> str:
    root = scratch(t, "pipeline")
    f = t.filings
    body = F.to_json(F.struct("filing_id", "feed", "symbol", "subject", "description"))
    payload = F.when(F.col("filing_id") % 97 == 0, F.concat(F.lit("{broken "), F.col("filing_id"))).when(
        F.col("filing_id") % 89 == 1, F.to_json(F.struct("filing_id", "symbol"))
    ).otherwise(body)
    f.select(
        F.col("filing_id").alias("id"), F.lit("filing.received").alias("topic"), payload.alias("payload"), F.col("observed_at").alias("created_at")
    ).write.parquet(f"{root}/inbox")
    pipelines.run_classifier(t.spark, f"{root}/inbox", root)
    return root


@query
def stream_classify_alert(t):
    root = _pipeline(t)
    pipelines.run_alerts(t.spark, root)
    return t.spark.read.parquet(f"{root}/alerts").select("alert_id", "severity", "category", "symbol", "message")


@query
def stream_dead_letter(t):
    return t.spark.read.parquet(f"{_pipeline(t)}/dead").select("id", "topic", "error")


@query
def stream_alert_budget(t):
    """Two waves of alerts: the budget carries over from one micro-batch to the next."""
    root = scratch(t, "budget")
    rows = t.alert_log.select("alert_id", "severity", "observed_at").where(F.col("severity") == "high")
    cut = F.lit("2024-01-02 12:00:00").cast("timestamp")
    for wave in (rows.where(F.col("observed_at") < cut), rows.where(F.col("observed_at") >= cut)):
        wave.write.mode("append").parquet(f"{root}/alerts")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{root}/alerts")
        pipelines.run_budget(t.spark, stream, root)
    return t.spark.read.parquet(f"{root}/decisions").select("alert_id", "sent")


def _outbox(t: Tables, name: str, **options) -> str:
    root = scratch(t, name)
    bus.append_events(t.outbox.select("id", "topic", F.to_json(F.struct("id")).alias("payload"), "created_at"), f"{root}/inbox", **options)
    return root


@query
def stream_bounded_drain(t):
    """At most 500 events a cycle, in the order of their ids: every event once, and the sizes of the cycles."""
    root = _outbox(t, "bounded")
    handle = lambda events, batch_id, cycle: events.select(["id", "topic"]).append_column("cycle", pa.array([cycle] * events.num_rows, pa.int64()))
    bus.drain(bus.read_topic(t.spark, f"{root}/inbox", "filing.received", span=bus.EVENT_SPAN), "drain", f"{root}/_ck", handle, 500,
              into=f"{root}/seen", returns="id bigint, topic string, cycle bigint")
    return t.spark.read.parquet(f"{root}/seen").groupBy("topic", F.col("cycle").cast("bigint").alias("cycle")).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query
def stream_replay(t):
    """A consumer that starts after an offset and opens no folder before it."""
    root = _outbox(t, "replay", span=50)
    handle = lambda batch, batch_id: bus.write_batch(batch.select("id", "topic"), f"{root}/seen", batch_id)
    bus.consume(bus.read_topic(t.spark, f"{root}/inbox", "filing.received", after_id=100, span=50), "replay", f"{root}/_ck", handle)
    return t.spark.read.parquet(f"{root}/seen").select("id", "topic")


@query
def stream_redelivery(t):
    """Every filing arrives in two micro-batches under two event ids and is classified and alerted once."""
    root = scratch(t, "redelivery")
    body = F.to_json(F.struct("filing_id", "feed", "symbol", "subject", "description"))
    for wave in range(2):
        t.filings.select((F.col("filing_id") * 2 + wave).alias("id"), F.lit("filing.received").alias("topic"), body.alias("payload"), F.col("observed_at").alias("created_at")).write.mode("append").parquet(f"{root}/inbox")
        pipelines.run_classifier(t.spark, f"{root}/inbox", root)
        pipelines.run_alerts(t.spark, root)
    events = t.spark.read.parquet(f"{root}/classified").select(F.get_json_object("payload", "$.filing_id").cast("bigint").alias("filing_id"))
    alerts = t.spark.read.parquet(f"{root}/alerts").select(F.col("evidence_ref").cast("bigint").alias("filing_id")).groupBy("filing_id").agg(F.count(F.lit(1)).alias("alerts"))
    counts = events.groupBy("filing_id").agg(F.count(F.lit(1)).alias("classified"))
    return counts.join(alerts, "filing_id", "left").select("filing_id", "classified", F.coalesce("alerts", F.lit(0)).alias("alerts"))


@query
def stream_hysteresis(t):
    """Stored signals as a stream of candidates in files of mixed times: the ones that the keyed state issues.

    One candidate in the far future moves the watermark past all others.
    """
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    root = scratch(t, "hysteresis")
    rows = t.signals.withColumn("conviction", F.floor(F.col("conviction") / 10).cast("double")).select(
        "symbol", "profile", F.when(F.col("conviction") >= 40, "hold").otherwise("exit").alias("stance"), "conviction", "model_version", "as_of")
    end = t.spark.range(1).select(F.lit("~").alias("symbol"), F.lit("~").alias("profile"), F.lit("hold").alias("stance"), F.lit(0.0).alias("conviction"), F.lit("~").alias("model_version"), F.lit("2124-01-01").cast("timestamp").alias("as_of"))
    for part in (0, 1):  # every second candidate comes in a later batch
        rows.where(F.pmod(F.xxhash64("symbol", "profile", "as_of"), F.lit(2)) == part).write.mode("append").parquet(f"{root}/candidates")
        if part:
            end.write.mode("append").parquet(f"{root}/candidates")
        issued = issue_stream(t.spark.readStream.schema(rows.schema).parquet(f"{root}/candidates"), "3650 days")
        handle = lambda batch, batch_id: bus.write_batch(batch, f"{root}/issued", batch_id)
        bus.consume(issued, "hysteresis", f"{root}/_ck", handle)
    return t.spark.read.parquet(f"{root}/issued").where("symbol <> '~'").select("symbol", "profile", ts("as_of"))
