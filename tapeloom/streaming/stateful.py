"""Decisions that depend on earlier decisions: the alert budget and issue hysteresis."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.constants import ALERT_MAX_HIGH_PER_HOUR, HYSTERESIS
from tapeloom.sources.sinks import ship_package, stage

HOUR_US = 3_600_000_000


def admit(sent: list, at_us: int, budget: int) -> tuple[list, bool]:
    """Sent times still inside the trailing hour, and whether one more may be sent."""
    live = [t for t in sent if t >= at_us - HOUR_US]
    if len(live) >= budget:
        return live, False
    return live + [at_us], True


#: Candidate rows of a block of the budget's time line.
BLOCK_ROWS = 1_000_000


def admitted(times: np.ndarray, sent: list[int], budget: int) -> np.ndarray:
    """Places of the ``times`` (sorted) that the budget admits, ``sent`` being the last times sent before.

    One step for each alert sent, not for each alert: the next one is the first after the last that is
    more than an hour later than the alert sent ``budget`` places before.
    """
    last, places, place = list(sent[-budget:]), [], 0
    while True:
        if len(last) >= budget:
            place = max(place, int(np.searchsorted(times, last[-budget] + HOUR_US, side="right")))
        if place >= times.size:
            return np.array(places, dtype=np.int64)
        places.append(place)
        last.append(int(times[place]))
        place += 1


def time_blocks(candidates: DataFrame, block_rows: int) -> DataFrame:
    """(block, us, alert_id): the candidates in blocks of about ``block_rows`` that follow each other in time.

    Written once, so the borders stay where they are. Ties at an instant are few, so a dense hour is
    several blocks, not a large one.
    """
    rows = stage(candidates, "budget-rows")
    n = rows.count()
    if n <= block_rows:
        return rows.select(F.lit(0).alias("block"), "us", "alert_id")
    return stage(rows.repartitionByRange(-(-n // block_rows), "us").withColumn("block", F.spark_partition_id()), "budget-blocks")


def run_blocks(blocks: DataFrame, entry: dict[int, list[int]], budget: int, with_ids: bool) -> DataFrame:
    """Decides the blocks named in ``entry`` from the sent times each begins with.

    Gives (block, sent) with the last sent times at the block's end, or (alert_id) of what is sent.
    """
    times = sorted(entry)
    known = blocks.where(F.col("block").isin(times)) if len(times) < 1000 else blocks
    out = "alert_id long" if with_ids else "block int, sent array<long>"

    def decide(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        if block not in entry:
            return pa.table({"alert_id": pa.array([], pa.int64())} if with_ids else {"block": pa.array([], pa.int32()), "sent": pa.array([], pa.list_(pa.int64()))})
        table = table.select(["us", "alert_id"]).sort_by([("us", "ascending"), ("alert_id", "ascending")])
        us = table.column("us").to_numpy()
        places = admitted(us, entry[block], budget)
        if with_ids:
            return table.select(["alert_id"]).take(pa.array(places))
        return pa.table({"block": pa.array([block], pa.int32()), "sent": pa.array([(entry[block] + us[places].tolist())[-budget:]], pa.list_(pa.int64()))})

    return known.groupBy("block").applyInArrow(decide, out)


def block_entries(blocks: DataFrame, budget: int) -> dict[int, list[int]]:
    """The sent times of the last hour at the start of each block, as the decisions before it leave them.

    All blocks are decided at once from a guess of these times (none), then those whose guess the
    decisions of their predecessor change are decided again. A guess becomes right as soon as it agrees
    with what went before, so the result is that of one run in order, and a task holds one block. Hours
    without many alerts end the influence of what came before them, so few rounds are usual; alerts that
    exceed the budget without a pause need one round for each block. The driver holds ``budget`` numbers a block.
    """
    first = {r["block"]: r["us"] for r in blocks.groupBy("block").agg(F.min("us").alias("us")).collect()}
    order = sorted(first)
    entry: dict[int, list[int]] = {b: [] for b in order}
    if len(order) < 2:
        return entry
    leaves: dict[int, list[int]] = {}
    todo = dict(entry)
    while todo:
        leaves |= {r["block"]: list(r["sent"]) for r in run_blocks(blocks, todo, budget, with_ids=False).collect()}
        todo = {}
        for before, block in zip(order, order[1:]):
            live = [t for t in leaves[before] if t >= first[block] - HOUR_US]
            if live != entry[block]:
                todo[block] = entry[block] = live
    return entry


def limit_alerts(alerts: DataFrame, budget: int = ALERT_MAX_HIGH_PER_HOUR, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``sent``: whether a high alert fits the budget of the trailing hour.

    The budget is shared by all symbols, so a decision needs the decisions before it. Alerts beyond the
    budget at one instant can never be sent and are answered before any ordering; the others form blocks
    of time that are decided side by side (see :func:`block_entries`).
    """
    ship_package(alerts.sparkSession)
    high = alerts.where(F.col("severity") == "high").withColumn("_us", F.unix_micros("observed_at"))
    rank = F.row_number().over(Window.partitionBy("_us").orderBy("alert_id"))
    near = high.select("alert_id", "_us").withColumn("_rank", rank).where(F.col("_rank") <= budget)
    blocks = time_blocks(near.select(F.col("_us").alias("us"), F.col("alert_id").cast("long").alias("alert_id")), block_rows)
    sent = run_blocks(blocks, block_entries(blocks, budget), budget, with_ids=True).select("alert_id", F.lit(True).alias("sent"))
    return high.join(sent, "alert_id", "left").withColumn("sent", F.coalesce("sent", F.lit(False))).drop("_us")


class AlertBudget(StatefulProcessor):
    """Streaming form of the budget, keyed by severity, with the sent times as state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._sent = handle.getListState("sent", "at_us bigint")

    def handleInputRows(self, key, rows, timerValues):
        sent = [r[0] for r in self._sent.get()] if self._sent.exists() else []
        for pdf in rows:
            pdf = pdf.sort_values(["at_us", "alert_id"])
            flags = []
            for at in pdf["at_us"]:
                sent, ok = admit(sent, int(at), ALERT_MAX_HIGH_PER_HOUR)
                flags.append(ok)
            yield pd.DataFrame({"alert_id": pdf["alert_id"], "sent": flags})
        self._sent.put([(t,) for t in sent])

    def close(self) -> None:
        pass


def limit_alert_stream(stream: DataFrame) -> DataFrame:
    """(alert_id, sent) for a stream of (alert_id, severity, observed_at)."""
    high = stream.where(F.col("severity") == "high").select("severity", "alert_id", F.unix_micros("observed_at").alias("at_us"))
    return high.groupBy("severity").transformWithStateInPandas(
        AlertBudget(), outputStructType="alert_id bigint, sent boolean", outputMode="Append", timeMode="None"
    )


class Hysteresis(StatefulProcessor):
    """Streaming form of issue hysteresis, keyed by (symbol, profile): the last issued row and the rows still waiting.

    Rows wait until the watermark has passed them and are then decided in the order of their times, so
    neither the order inside a batch nor the batch a row comes in matters. A key holds the rows of the
    watermark's delay. Only the earliest waiting row of a batch sets a timer; when it expires, all rows
    that the watermark has passed are decided and the earliest of the others sets the next one.
    """

    FIELDS = "as_of bigint, stance string, conviction double, version string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "stance string, conviction double, version string")
        self._waiting = handle.getListState("waiting", self.FIELDS)

    def handleInputRows(self, key, rows, timerValues):
        # a conviction that is missing moves no decision, like one that is not a number
        new = [(r["as_of_us"], r["stance"], math.nan if r["conviction"] is None else r["conviction"], r["model_version"]) for r in rows]
        self._waiting.appendList(new)
        self._handle.registerTimer(min(timer_of(r[0]) for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows = [tuple(r) for r in self._waiting.get()]
        due = sorted(r for r in rows if timer_of(r[0]) <= until)
        rest = [r for r in rows if timer_of(r[0]) > until]
        if not due:
            return
        last, moved = self._last.get(), False
        for at, s, c, v in due:
            if last is None or last[0] != s or last[2] != v or abs(last[1] - c) > HYSTERESIS:
                last, moved = (s, c, v), True
                yield Row(symbol=key[0], profile=key[1], stance=s, conviction=None if math.isnan(c) else c, model_version=v, as_of_us=at)
        if moved:
            self._last.update(last)
        if rest:
            self._waiting.put(rest)
            self._handle.registerTimer(min(timer_of(r[0]) for r in rest))
        else:
            self._waiting.clear()

    def close(self) -> None:
        pass


def timer_of(at_us: int) -> int:
    """The millisecond by whose end an instant is past."""
    return int(-(-at_us // 1000))


def issue_stream(candidates: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The candidates that hysteresis issues, as soon as the watermark (``delay`` behind the newest) has passed them.

    Rows that come later than the delay are left out by the watermark.
    """
    rows = candidates.withWatermark("as_of", delay).withColumns({"as_of_us": F.unix_micros("as_of"), "conviction": F.col("conviction").cast("double")})
    issued = rows.groupBy("symbol", "profile").transformWithState(
        Hysteresis(), outputMode="Append", timeMode="EventTime",
        outputStructType="symbol string, profile string, stance string, conviction double, model_version string, as_of_us bigint")
    return issued.select("symbol", "profile", "stance", "conviction", "model_version", F.timestamp_micros("as_of_us").alias("as_of"))
