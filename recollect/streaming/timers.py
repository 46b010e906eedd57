"""Keyed state with timers: observations that end and end again, timers that fire once.

State lives in Spark's state store by key, and event-time timers fire when the watermark passes them. The processors are
Python (``transformWithState``), one call a key and batch; they need the RocksDB state store, which is set here. Each use of
state or timers is a message to the JVM, so a key that is new costs three: what it holds, the new value, its timer.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Timers that haven't fired after so long are dropped.
PURGE_SECONDS = 7 * 24 * 3600


class EndedObservations(StatefulProcessor):
    """Holds the newest time of an observation; a newer one sets its timer anew. An observation that has ended holds nothing,
    and starts again with its next fact."""

    def __init__(self, inactive_ms: int) -> None:
        self.inactive_ms = inactive_ms

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max(r["at"] for r in rows)
        held = (self.last.get() or (None,))[0]
        if held is None or newest > held:
            if held is not None:
                if held // 1000 + self.inactive_ms <= timerValues.getCurrentWatermarkInMs():
                    yield Row(obs_id=key[0], at=held)  # had ended before these came
                self.handle.deleteTimer(held // 1000 + self.inactive_ms)
            self.last.update((newest,))
            self.handle.registerTimer(newest // 1000 + self.inactive_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield Row(obs_id=key[0], at=self.last.get()[0])
        self.last.clear()

    def close(self) -> None:
        pass


class FiringTimers(StatefulProcessor):
    """Holds the newest row of a timer until it fires or is dropped."""

    FIELDS = ("timeout", "event", "obs_id", "actor_pk", "object_pk")
    STATE = "at long, timeout long, event string, obs_id string, actor_pk string, object_pk string"

    def init(self, handle) -> None:
        self.handle, self.row = handle, handle.getValueState("row", self.STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max((tuple(r[c] for c in ("at", *self.FIELDS)) for r in rows), key=lambda r: (r[0], r[3] or ""))
        held = self.row.get()
        if held is None or (newest[0], newest[3] or "") > (held[0], held[3] or ""):
            if held is not None:
                if self.due(held) <= timerValues.getCurrentWatermarkInMs():
                    yield from self.fired(key, held)
                self.handle.deleteTimer(self.due(held))
            self.row.update(newest)
            self.handle.registerTimer(self.due(newest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.fired(key, self.row.get())
        self.row.clear()

    @staticmethod
    def due(row: tuple) -> int:
        return int(row[0]) // 1000 + 1000 * min(int(row[1]), PURGE_SECONDS)

    def fired(self, key, row: tuple) -> Iterator[Row]:
        at, timeout, *rest = row
        if timeout < PURGE_SECONDS:
            yield Row(id=key[0], at=at, timeout=timeout, **dict(zip(self.FIELDS[1:], rest)))

    def close(self) -> None:
        pass


def ended_observations(facts: DataFrame, inactive_minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """(obs_id, ts) of a stream of facts (obs_id, ts): observations of which no fact has come for so long, by the time in
    the facts, with their newest one. One that goes on is given again when it ends again. The same as
    ``reads.ending_observations`` (strict) at each watermark, with all that was given before as its triggers."""
    facts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = facts.where("obs_id is not null and ts is not null").select("obs_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = rows.withColumn("at", F.unix_micros("ts"))
    ended = rows.groupBy("obs_id").transformWithState(EndedObservations(inactive_minutes * 60_000), "obs_id string, at long", "Append", "EventTime")
    return ended.select("obs_id", F.timestamp_micros("at").alias("ts"))


def fired_timers(timers: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(id, ts, timeout, event, obs_id, actor_pk, object_pk) of a stream of timers (as of ``ingest.timer_rows``; timeout in
    seconds): each fires once when its time has passed; a newer row of its id sets it anew. The same as
    ``reads.active_timers`` at each watermark, less those that have fired. Timers that would fire after seven days don't."""
    timers.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = timers.where("id is not null and ts is not null and timeout is not null")
    rows = rows.select("id", F.col("ts").cast("timestamp").alias("ts"), F.col("timeout").cast("long").alias("timeout"), *FiringTimers.FIELDS[1:]).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    fired = rows.groupBy("id").transformWithState(FiringTimers(), "id string, " + FiringTimers.STATE, "Append", "EventTime")
    return fired.select("id", F.timestamp_micros("at").alias("ts"), *FiringTimers.FIELDS)
