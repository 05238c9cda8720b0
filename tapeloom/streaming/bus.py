"""Topic streams over an append-only event folder.

An event is (id, topic, payload JSON, created_at). Every consumer is its own streaming query
with its own checkpoint, so consumers advance independently and replay by a fresh checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tapeloom.schemas import DDL
from tapeloom.sources.sinks import ship_package, stage, staging

EVENT_SCHEMA = DDL["outbox"]
#: Event ids of one folder of the outbox.
EVENT_SPAN = 1_000_000
#: Folders for each doubling of the ids, beyond twice as many spans.
FOLDERS = 64


def last_span(event_id: Column, span: int) -> Column:
    """The last span of the folder that holds an event.

    A folder is one span up to span ``2 * FOLDERS``; from there its width doubles with the ids, so the
    number of folders grows with the logarithm of the ids and a folder holds at most one part in
    ``FOLDERS`` of the ids before it. The layout depends on the ids alone, so appends agree on it.
    """
    own = F.floor(event_id / span)
    digits = F.length(F.bin(F.abs(own)))
    width = F.pow(F.lit(2.0), F.greatest(F.lit(0), digits - FOLDERS.bit_length())).cast("long")
    return (F.floor(own / width) + 1) * width - 1


def append_events(events: DataFrame, path: str, span: int = EVENT_SPAN) -> None:
    """Adds events in folders by range of ids, so that a replay opens none before its start."""
    ranged = events.withColumn("span", last_span(F.col("id"), span))
    # by range of ids, so that a folder has the files of few tasks
    ranged.repartitionByRange("id").write.mode("append").partitionBy("span").parquet(path)


def read_topic(spark: SparkSession, path: str, topic: str, *, max_files: int | None = None, after_id: int | None = None, span: int | None = None) -> DataFrame:
    """Stream of one topic; ``max_files`` bounds what a micro-batch reads, ``after_id`` replays from an offset.

    ``span`` is that of :func:`append_events`, if it wrote the folder: a replay then leaves out the
    folders before its start.
    """
    reader = spark.readStream.schema(EVENT_SCHEMA if span is None else EVENT_SCHEMA + ", span bigint")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(path).where(F.col("topic") == topic)
    if after_id is not None:
        rows = rows.where(F.col("id") > after_id)
        if span is not None:
            rows = rows.where(F.col("span") >= after_id // span)
    return rows if span is None else rows.drop("span")


def parsed_events(events: DataFrame, payload_schema: str, required: list[str]) -> DataFrame:
    """Adds the parsed payload ``_p`` and ``_bad``: it is malformed or lacks a field."""
    parsed = events.withColumn(
        "_p", F.from_json("payload", payload_schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    bad = F.col("_p").isNull() | F.col("_p._corrupt").isNotNull()
    for name in required:
        bad = bad | F.col(f"_p.{name}").isNull()
    return parsed.withColumn("_bad", bad)


def split_poison(batch: DataFrame, payload_schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Parsed good events and dead letters of a batch; one bad event never stops the stream."""
    parsed = parsed_events(batch, payload_schema, required)
    bad = F.col("_bad")
    error = F.when(F.col("_p._corrupt").isNotNull() | F.col("_p").isNull(), "malformed payload").otherwise("missing field")
    good = parsed.where(~bad).select("id", "created_at", "_p.*").drop("_corrupt")
    dead = parsed.where(bad).select("id", "topic", "payload", error.alias("error"))
    return good, dead


#: Spark's setting to delete the shuffle files of a statement at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def consume(
    stream: DataFrame, name: str, checkpoint: str, handle: Callable[[DataFrame, int], None], *, once: bool = True, release: bool = False
):
    """Runs ``handle(batch, batch_id)`` at least once per micro-batch.

    ``handle`` writes idempotently: the batch id names its output, so a retried batch replaces
    its own files. With ``release`` the shuffle files of each statement go when it ends, those of the
    handler and of the stream; otherwise they stay until the driver collects its garbage.
    """
    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(handle)
    conf = stream.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    if release:
        conf.set(SHUFFLE_CLEANUP, "true")
    try:  # the query takes the settings of its session along when it starts
        query = (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        if release:
            conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)
    if once:
        query.awaitTermination()
    return query


def numbered_cycles(batch: DataFrame, max_events: int) -> tuple[DataFrame, int]:
    """The events of a micro-batch with ``_place`` in the order of their ids and ``_cycle`` of ``max_events`` each, and their number.

    Files of any size are sorted and numbered in ranges side by side; only the ranges' sizes pass
    through the driver.
    """
    rows = stage(batch.repartitionByRange("id").withColumn("_range", F.spark_partition_id()), "drain-ranges")
    before, offsets = 0, []
    for r in rows.groupBy("_range").count().orderBy("_range").collect():
        offsets.append((r["_range"], before))
        before += r["count"]
    starts = batch.sparkSession.createDataFrame(offsets, "_range int, _before long")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("id")) - 1
    numbered = rows.join(F.broadcast(starts), "_range").withColumn("_place", place).withColumn("_cycle", F.floor(F.col("_place") / max_events))
    return numbered.select("_cycle", "_place", *batch.columns), before


def event_cycles(batch: DataFrame, max_events: int) -> Iterator[tuple[int, DataFrame]]:
    """The events of a micro-batch in the order of their ids, ``max_events`` at a time.

    Each cycle has a folder of its own, so a cycle reads its own events.
    """
    numbered, n = numbered_cycles(batch, max_events)
    if not n:
        return
    path = stage(numbered.drop("_place"), "drain-cycles", by="_cycle")
    for cycle in range(-(-n // max_events)):
        yield cycle, path.where(F.col("_cycle") == cycle).select(*batch.columns)


def handled_cycles(batch: DataFrame, batch_id: int, handle: Callable[[pa.Table, int, int], pa.Table], max_events: int, returns: str) -> DataFrame:
    """What ``handle`` makes of the cycles of a micro-batch, each cycle in one call in a task."""
    ship_package(batch.sparkSession)
    columns = batch.columns

    def run(cycle: pa.Table) -> pa.Table:
        events = cycle.sort_by("_place")
        return handle(events.select(columns), batch_id, events.column("_cycle")[0].as_py())

    return numbered_cycles(batch, max_events)[0].groupBy("_cycle").applyInArrow(run, returns)


def drain(
    stream: DataFrame, name: str, checkpoint: str, handle: Callable, max_events: int, *, once: bool = True,
    into: str | None = None, returns: str | None = None,
):
    """Runs ``handle(events, batch_id, cycle)`` for at most ``max_events`` events at a time, in the order of their ids.

    A micro-batch is acknowledged when its last cycle is done; after a failure its cycles come again
    under the same numbers, with the same events.

    By itself a cycle is a DataFrame and the driver handles one after the other, which costs a job for
    each. With ``into`` the cycles of a micro-batch are handled side by side: ``handle`` runs in tasks,
    gets the Arrow table of one cycle and gives rows of the schema ``returns``, which are written to
    the micro-batch's folder there.
    """
    def cycles(batch: DataFrame, batch_id: int) -> None:
        with staging(batch.sparkSession):
            if into is not None:
                write_batch(handled_cycles(batch, batch_id, handle, max_events, returns), into, batch_id)
                return
            for cycle, events in event_cycles(batch, max_events):
                handle(events, batch_id, cycle)

    return consume(stream, name, checkpoint, cycles, once=once)


def first_seen(stream: DataFrame, key: str) -> DataFrame:
    """The first event of each key over the whole life of a stream.

    Keys live in the stream's own state, kept on disk by RocksDB with a change log, so a micro-batch
    looks up and adds its own keys and never reads those of earlier ones.
    """
    conf = stream.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return stream.dropDuplicates([key])


def collect_updates(counts: DataFrame, name: str, root: str, mode: str = "update") -> None:
    """Runs an aggregation stream to the end of its input, one folder per micro-batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, f"{root}/{name}", batch_id)

    writer = counts.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/_ck_{name}")
    writer.foreachBatch(handle).trigger(availableNow=True).start().awaitTermination()


def write_batch(df: DataFrame, root: str, batch_id: int, by: str | None = None) -> None:
    """One folder per micro-batch, replaced as a whole when the batch is retried."""
    writer = df.write.mode("overwrite")
    (writer if by is None else writer.partitionBy(by)).parquet(f"{root}/batch={batch_id}")


def written(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """Rows written by earlier micro-batches; None before the first one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not list(fs.listStatus(path)):
        return None
    df = spark.read.parquet(root)
    return df if before is None else df.where(F.col("batch") < before)


def dedup_stream(stream: DataFrame, time: str = "observed_at", delay: str = "30 days") -> DataFrame:
    """First row per content hash inside the watermark; for feeds without late backfills."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def tumbling_counts(stream: DataFrame, time: str, key: str, *, delay: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Event counts per key and window; late rows count until the watermark passes."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return (
        stream.withWatermark(time, delay).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")
    )


def session_counts(stream: DataFrame, time: str, key: str, *, delay: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    return (
        stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")
    )
