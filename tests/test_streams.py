"""Streaming: independent consumers, poison isolation, budgets and hysteresis as state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeloom.streaming import bus, pipelines, stateful

NOW = dt.datetime(2026, 8, 8, 12, tzinfo=dt.timezone.utc)


def emit(spark, path, rows, topic="filing.received"):
    df = spark.createDataFrame([(i, topic, p, NOW) for i, p in rows], bus.EVENT_SCHEMA)
    df.coalesce(1).write.mode("append").parquet(path)


def payload(i, subject):
    return f'{{"filing_id": {i}, "feed": "announcements", "symbol": "X", "subject": "{subject}"}}'


def test_chain_isolates_poison_and_survives_redelivery(spark, tmp_path):
    inbox, root = str(tmp_path / "in"), str(tmp_path / "out")
    emit(spark, inbox, [(1, payload(1, "Resignation of statutory auditor")), (2, "{broken"), (3, payload(3, "Trading window")), (4, payload(1, "Resignation of statutory auditor")), (5, '{"filing_id": 9}')])
    pipelines.run_classifier(spark, inbox, root)
    pipelines.run_alerts(spark, root)
    assert spark.read.parquet(f"{root}/classified").count() == 2
    dead = {r["id"]: r["error"] for r in spark.read.parquet(f"{root}/dead").collect()}
    assert dead == {2: "malformed payload", 5: "missing field"}
    alerts = spark.read.parquet(f"{root}/alerts").collect()
    assert [(a["severity"], a["category"], a["symbol"]) for a in alerts] == [("high", "auditor_resignation", "X")]
    emit(spark, inbox, [(6, payload(6, "Buyback of shares"))])
    pipelines.run_classifier(spark, inbox, root)
    pipelines.run_alerts(spark, root)
    assert spark.read.parquet(f"{root}/alerts").count() == 2


def test_consumers_keep_their_own_position_and_replay(spark, tmp_path):
    inbox = str(tmp_path / "in")
    emit(spark, inbox, [(i, payload(i, "x")) for i in range(1, 6)])
    emit(spark, inbox, [(6, "{}")], topic="other")
    seen = {}

    def consumer(name):
        def handle(batch, batch_id):
            seen.setdefault(name, []).extend(r["id"] for r in batch.select("id").collect())
        return handle

    read = lambda **kw: bus.read_topic(spark, inbox, "filing.received", **kw)
    bus.consume(read(), "a", str(tmp_path / "ck_a"), consumer("a"))
    emit(spark, inbox, [(7, payload(7, "x"))])
    bus.consume(read(), "a", str(tmp_path / "ck_a"), consumer("a"))
    bus.consume(read(), "b", str(tmp_path / "ck_b"), consumer("b"))
    bus.consume(read(after_id=3), "c", str(tmp_path / "ck_c"), consumer("c"))
    bus.consume(read(max_files=1), "d", str(tmp_path / "ck_d"), consumer("d"))
    assert sorted(seen["a"]) == sorted(seen["b"]) == sorted(seen["d"]) == [1, 2, 3, 4, 5, 7]
    assert sorted(seen["c"]) == [4, 5, 7]


def test_budget_carries_over_batches(spark, tmp_path):
    schema = "alert_id bigint, severity string, observed_at timestamp"
    path, root = str(tmp_path / "a"), str(tmp_path / "out")
    for lo, hi in ((0, 8), (8, 16)):
        spark.createDataFrame([(i, "high", NOW + dt.timedelta(minutes=i)) for i in range(lo, hi)], schema).write.mode("append").parquet(path)
        pipelines.run_budget(spark, spark.readStream.schema(schema).parquet(path), root)
    got = [r["sent"] for r in spark.read.parquet(f"{root}/decisions").orderBy("alert_id").collect()]
    assert got == [True] * 12 + [False] * 4


def drain(stream, tmp_path, name):
    out = []
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / f"ck_{name}")).foreachBatch(lambda b, i: out.extend(b.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def test_stateful_budget(spark, tmp_path):
    schema = "alert_id bigint, severity string, observed_at timestamp"
    path = str(tmp_path / "a")
    spark.createDataFrame([(i, "high", NOW + dt.timedelta(seconds=i)) for i in range(15)] + [(99, "low", NOW)], schema).coalesce(1).write.parquet(path)
    rows = drain(stateful.limit_alert_stream(spark.readStream.schema(schema).parquet(path)), tmp_path, "budget")
    assert {r["alert_id"]: r["sent"] for r in rows} == {i: i < 12 for i in range(15)}


def test_stateful_hysteresis_decides_in_time_order(spark, tmp_path):
    """Shuffled candidates over several batches give what the replay in time order gives."""
    import random

    from tapeloom.plans import fusion

    rng = random.Random(7)
    schema = "symbol string, profile string, stance string, conviction double, model_version string, as_of timestamp"
    path = str(tmp_path / "c")
    rows = [(s, "d", rng.choice(["hold", "hold", "hold", "buy"]), float(rng.randrange(40, 70)), rng.choice(["v", "v", "w"]), NOW + dt.timedelta(minutes=m)) for s in "ABC" for m in rng.sample(range(600), 40)]
    rng.shuffle(rows)
    end = [("~", "~", "hold", 0.0, "v", NOW + dt.timedelta(days=900))]
    got = []
    for part in (rows[:50], rows[50:90], rows[90:], end):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        got += drain(stateful.issue_stream(spark.readStream.schema(schema).parquet(path), "1 day"), tmp_path, "hyst")
    want = fusion.replay_hysteresis(spark.createDataFrame(rows, schema)).where("issued").collect()
    key = lambda r: (r["symbol"], r["as_of"], r["stance"], r["conviction"], r["model_version"])
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) < len(rows)


def test_watermark_dedup(spark, tmp_path):
    schema = "content_hash string, observed_at timestamp"
    path = str(tmp_path / "e")
    spark.createDataFrame([("h1", NOW), ("h1", NOW + dt.timedelta(hours=1)), ("h2", NOW)], schema).write.parquet(path)
    rows = drain(bus.dedup_stream(spark.readStream.schema(schema).parquet(path)), tmp_path, "dd")
    assert sorted(r["content_hash"] for r in rows) == ["h1", "h2"]


def test_redelivery_in_a_later_batch_gives_nothing_more(spark, tmp_path):
    inbox, root = str(tmp_path / "in"), str(tmp_path / "out")
    for event in (1, 50):
        emit(spark, inbox, [(event, payload(1, "Resignation of statutory auditor"))])
        pipelines.run_classifier(spark, inbox, root)
        pipelines.run_alerts(spark, root)
    assert spark.read.parquet(f"{root}/classified").count() == 1 and spark.read.parquet(f"{root}/alerts").count() == 1


def test_a_batch_meets_every_earlier_key_without_reading_them(spark, tmp_path):
    """Fifty batches of new and repeated keys: each is answered from the state, and reads its own rows only."""
    path, schema = str(tmp_path / "in"), "id bigint, k string"
    seen = []
    for i in range(50):
        spark.createDataFrame([(i * 10 + j, f"k{i * 10 + j}") for j in range(10)] + [(-i, f"k{i * 3}")], schema).coalesce(1).write.mode("append").parquet(path)
    stream = bus.first_seen(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), "k")
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda b, i: seen.append([r["k"] for r in b.collect()])).trigger(availableNow=True).start()
    query.awaitTermination()
    read = [p["numInputRows"] for p in query.recentProgress]
    assert sorted(k for b in seen for k in b) == sorted(f"k{i}" for i in range(500))
    assert len(seen) == 50 and set(read) <= {0, 11, 22}


@pytest.mark.parametrize("max_events", [1, 7, 40, 1000])
def test_drain_bounds_events_and_keeps_their_order(spark, tmp_path, max_events):
    inbox = str(tmp_path / "in")
    emit(spark, inbox, [(i, payload(i, "x")) for i in range(100, 60, -1)])
    emit(spark, inbox, [(1000, "{}")], topic="other")
    emit(spark, inbox, [(i, payload(i, "x")) for i in range(1, 9)])
    cycles = {}

    def handle(events, batch_id, cycle):
        cycles[batch_id, cycle] = [r["id"] for r in events.orderBy("id").collect()]

    bus.drain(bus.read_topic(spark, inbox, "filing.received"), "d", str(tmp_path / "ck"), handle, max_events)
    runs = [cycles[k] for k in sorted(cycles)]
    assert all(len(r) <= max_events for r in runs) and [i for r in runs for i in r] == [*range(1, 9), *range(61, 101)]
    emit(spark, inbox, [(2000, payload(1, "x"))])
    bus.drain(bus.read_topic(spark, inbox, "filing.received"), "d", str(tmp_path / "ck"), handle, max_events)
    assert cycles[1, 0] == [2000]


def test_replay_opens_no_folder_before_its_start(spark, tmp_path):
    inbox = str(tmp_path / "in")
    bus.append_events(spark.createDataFrame([(i, "filing.received", payload(i, "x"), NOW) for i in range(1, 300)], bus.EVENT_SCHEMA), inbox, span=100)
    rows, names = [], set()

    def handle(batch, batch_id):
        rows.extend(r["id"] for r in batch.collect())
        names.update(f.split("span=")[1].split("/")[0] for f in batch.inputFiles())

    bus.consume(bus.read_topic(spark, inbox, "filing.received", after_id=150, span=100), "r", str(tmp_path / "ck"), handle)
    assert sorted(rows) == list(range(151, 300)) and "0" not in names


def test_staged_tables_go_with_their_block(spark):
    import os

    from tapeloom.sources.sinks import shared_dir, stage, staging

    there = lambda name: [f for f in os.listdir(shared_dir(spark)) if f.startswith(name)]
    with staging(spark):
        with staging(spark):
            stage(spark.range(3), "inner-table")
            kept = stage(spark.range(4), "outer-table", outlives=True)
        assert not there("inner-table") and kept.count() == 4
    assert not there("outer-table")


def test_poison_does_not_block_its_filing(spark, tmp_path):
    inbox, root = str(tmp_path / "in"), str(tmp_path / "out")
    emit(spark, inbox, [(1, '{"filing_id": 1}')])
    pipelines.run_classifier(spark, inbox, root)
    emit(spark, inbox, [(2, payload(1, "Buyback of shares"))])
    pipelines.run_classifier(spark, inbox, root)
    assert spark.read.parquet(f"{root}/classified").count() == 1 and spark.read.parquet(f"{root}/dead").count() == 1


def test_broken_classified_events_are_kept(spark, tmp_path):
    root = str(tmp_path / "out")
    emit(spark, f"{root}/classified/batch=0", [(1, "{broken"), (2, '{"category": "x"}')], topic="filing.classified")
    pipelines.run_alerts(spark, root)
    assert {r["id"]: r["error"] for r in spark.read.parquet(f"{root}/alerts_dead").collect()} == {1: "malformed payload", 2: "missing field"}


@pytest.mark.parametrize("max_events", [1, 7, 1000])
def test_cycles_side_by_side_are_bounded_and_in_order(spark, tmp_path, max_events):
    import pyarrow as pa

    inbox, seen = str(tmp_path / "in"), str(tmp_path / "seen")

    def handle(events, batch_id, cycle):
        ids = events.column("id").to_pylist()
        return pa.table({"cycle": [cycle], "batch": [batch_id], "ids": [ids], "names": [",".join(events.column_names)]})

    def run():
        bus.drain(bus.read_topic(spark, inbox, "filing.received"), "d", str(tmp_path / "ck"), handle, max_events, into=seen, returns="cycle long, batch long, ids array<long>, names string")

    emit(spark, inbox, [(i, payload(i, "x")) for i in range(100, 60, -1)])
    emit(spark, inbox, [(1000, "{}")], topic="other")
    emit(spark, inbox, [(i, payload(i, "x")) for i in range(1, 9)])
    run()
    rows = spark.read.parquet(f"{seen}/batch=0").orderBy("cycle").collect()
    assert [r["cycle"] for r in rows] == list(range(-(-48 // max_events))) and all(len(r["ids"]) <= max_events for r in rows)
    assert [i for r in rows for i in r["ids"]] == [*range(1, 9), *range(61, 101)] and {r["names"] for r in rows} == {"id,topic,payload,created_at"}
    emit(spark, inbox, [(2000, payload(1, "x"))])
    run()
    assert [list(r["ids"]) for r in spark.read.parquet(f"{seen}/batch=1").collect()] == [[2000]]


def test_folders_of_events_grow_slower_than_the_events(spark, tmp_path):
    import os

    inbox = str(tmp_path / "in")
    events = lambda ids: ids.select("id", F.lit("filing.received").alias("topic"), F.lit("{}").alias("payload"), F.lit(NOW).alias("created_at"))
    bus.append_events(events(spark.range(-3, 4000)), inbox, span=1)
    bus.append_events(events(spark.range(4000, 6000)), inbox, span=1)
    folders = [f for f in os.listdir(inbox) if f.startswith("span=")]
    assert len(folders) < 600 and all(f"span={k}" in folders for k in range(100))
    for k, after in enumerate((-5, 0, 127, 3001, 5998)):
        rows, names = [], set()

        def handle(batch, batch_id):
            found = batch.collect()
            rows.extend(r["id"] for r in found)
            names.update(int(r["file"].split("span=")[1].split("/")[0]) for r in found)

        stream = bus.read_topic(spark, inbox, "filing.received", after_id=after, span=1).withColumn("file", F.input_file_name())
        bus.consume(stream, f"r{k}", str(tmp_path / f"ck{k}"), handle)
        assert sorted(rows) == list(range(max(-3, after + 1), 6000)) and min(names) >= after


def test_a_key_sets_one_timer_a_batch():
    from types import SimpleNamespace as Of

    timers, store = [], {"waiting": [], "last": None}
    waiting = Of(appendList=store["waiting"].extend, get=lambda: iter(list(store["waiting"])), put=lambda r: store["waiting"].__setitem__(slice(None), r), clear=lambda: store["waiting"].clear())
    last = Of(get=lambda: store["last"], update=lambda v: store.update(last=v))
    keyed = stateful.Hysteresis()
    keyed.init(Of(getListState=lambda *a: waiting, getValueState=lambda *a: last, registerTimer=timers.append))
    rows = [{"as_of_us": 1000 * m, "stance": "hold", "conviction": float(20 * m), "model_version": "v"} for m in (5, 3, 9, 4, 8)]
    assert list(keyed.handleInputRows(("A", "d"), iter(rows), None)) == [] and timers == [3]
    expired = lambda at, mark: [r.as_of_us // 1000 for r in keyed.handleExpiredTimer(("A", "d"), Of(getCurrentWatermarkInMs=lambda: mark), Of(getExpiryTimeInMs=lambda: at))]
    assert expired(3, 6) == [3, 4, 5] and timers == [3, 8] and len(store["waiting"]) == 2
    assert expired(8, 8) == [8] and timers == [3, 8, 9]
    assert expired(8, 8) == [] and expired(9, 100) == [9] and not store["waiting"]


def test_a_batch_passes_the_state_once(spark, tmp_path, monkeypatch):
    """What a chain writes is read from the stored batch, not through the stream's state again."""
    plans, write = [], bus.write_batch
    monkeypatch.setattr(bus, "write_batch", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().toString()), write(df, *a, **k)))
    inbox, root = str(tmp_path / "in"), str(tmp_path / "out")
    emit(spark, inbox, [(1, payload(1, "Resignation of statutory auditor")), (2, "{broken")])
    pipelines.run_classifier(spark, inbox, root)
    pipelines.run_alerts(spark, root)
    schema = "filing_id bigint, feed string, title string, link string, pub string, description string, observed_at timestamp"
    spark.createDataFrame([(1, "f", "a", "https://x/1.pdf", "", "", NOW), (2, "f", "a", "https://x/1.pdf", "", "", NOW)], schema).write.parquet(f"{root}/entries")
    pipelines.run_ingest(spark, spark.readStream.schema(schema).parquet(f"{root}/entries"), root, ["filing_id", "observed_at"])
    assert [r["filing_id"] for r in spark.read.parquet(f"{root}/filings").collect()] == [1]
    assert len(plans) >= 5 and not any("StreamingDeduplicate" in p or "InMemoryRelation" in p for p in plans)


ENTRY = "filing_id bigint, feed string, title string, link string, pub string, description string, observed_at timestamp"


def ingest(spark, rows, root):
    spark.createDataFrame(rows, ENTRY).repartition(3).write.mode("overwrite").parquet(f"{root}/entries")
    pipelines.run_ingest(spark, spark.readStream.schema(ENTRY).parquet(f"{root}/entries"), root, ["filing_id", "observed_at"])


def test_ingest_keeps_the_first_of_each_content_and_link(spark, tmp_path):
    """Batches of copies by content and by link, with blanks, missing feeds and the separator of the hash in texts."""
    import hashlib
    import os
    import random

    rng, root = random.Random(3), str(tmp_path / "out")
    text = lambda *values: rng.choice(values)
    links = ["https://x/1.pdf", " https://x/1.pdf ", "https://x/2.html", "", None, "b\x1fL", *(f"https://x/{k}.pdf" for k in range(3, 40))]
    waves = [[(w * 100 + i, text("a", "b", "", None, "a\x1fb"), text("T", " T", "", None, "t\x1fu"), text(*links), text("p", None), text("d", ""),
               text(None, NOW, NOW - dt.timedelta(days=w))) for i in range(60)] for w in range(4)]
    waves.append(waves[0])
    hashes, naturals, want = set(), set(), {}
    for wave in waves:
        known = []
        for r in wave:
            parts = [r[1] or "", *((v or "").strip(" ") for v in r[2:6])]
            known.append((r[6] is None, r[6] or NOW, r[0], "\x1f".join(parts), (r[1], parts[2]) if parts[2] else None))
        once, first = {}, {}
        for k in sorted(known, key=lambda k: k[:3]):
            if k[3] not in hashes:
                once.setdefault(k[3], k)
        for k in once.values():
            first.setdefault(k[4] or k[3], k)
        want |= {k[2]: hashlib.sha256(k[3].encode()).hexdigest() for n, k in first.items() if n not in naturals}
        hashes |= {k[3] for k in known}
        naturals |= {k[4] for k in known}
        ingest(spark, wave, root)
    rows = spark.read.parquet(f"{root}/filings").collect()
    assert {r["filing_id"]: r["content_hash"] for r in rows} == want and len(rows) == len(want) > 60
    assert os.listdir(f"{root}/_ck_ingest/sources") == ["0"]  # keys and entries of a batch are of the same files


def test_the_state_of_ingest_has_one_short_key_an_entry(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [(i, "feed", f"title {i}", f"https://files.example/{i % 150}.pdf" if i % 4 else "", "", "a description " * 9, NOW) for i in range(200)]
    ingest(spark, rows, root)
    ingest(spark, rows, root)
    keys = [r["k"] for r in spark.read.format("statestore").load(f"{root}/_ck_ingest").select(F.col("key").getItem("_seen").alias("k")).collect()]
    assert sorted(len(k) for k in keys) == [28] * len({r[3] for r in rows if r[3]}) + [32] * 50


def test_shuffle_files_of_ingest_go_with_their_batch(spark, tmp_path, monkeypatch):
    import glob
    import time

    held, write = [], bus.write_batch
    monkeypatch.setattr(bus, "write_batch", lambda df, *a, **k: (held.append(df), write(df, *a, **k)))
    folders = [d.toString() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}
    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    ingest(spark, [(i, "feed", f"title {i}", "", "", "", NOW) for i in range(200)], str(tmp_path / "out"))
    for _ in range(100):  # the files go in the background
        if held and not files() - before:
            break
        time.sleep(0.1)
    assert held and not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_entries_go_when_the_next_wave_comes(spark, tmp_path):
    import os

    from __spark_entry__ import queries
    from tapeloom.driver.queries import typed_entries
    from tapeloom.driver.tables import Tables
    from tapeloom.operators import keyed
    from tapeloom.sources.sinks import shared_dir

    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    rows = [(i, NOW + dt.timedelta(seconds=i // 3), i % 7, ("click", "view", "error", "signup")[i % 4], 1.0, f'{{"k": {i % 9}}}') for i in range(300)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))
    there = set(os.listdir(shared_dir(spark)))
    got = queries()["stream_dedup"](spark, str(tmp_path))
    root = next(d for d in os.listdir(shared_dir(spark)) if d not in there and d.startswith("dedup-"))
    assert spark.read.parquet(f"{shared_dir(spark)}/{root}/entries").count() == 300
    want = keyed.dedup_filings(typed_entries(Tables(spark, str(tmp_path)))).select("filing_id", "feed", "content_hash")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
