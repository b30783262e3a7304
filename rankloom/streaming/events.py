"""Streaming forms of the event operators: stage rollup, stuck runs, deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rankloom.operators.history import STALE_MINUTES, TERMINAL_EVENTS, logical_stage

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("audit_id", T.LongType()), T.StructField("created_at", T.TimestampType()),
        T.StructField("duration_ms", T.DoubleType()), T.StructField("event", T.StringType()), T.StructField("stage", T.StringType()),
    ]
)
STUCK_SCHEMA = T.StructType(
    [T.StructField("audit_id", T.LongType()), T.StructField("last_event_at", T.TimestampType()), T.StructField("last_event", T.StringType())]
)
_STUCK_MS = STALE_MINUTES * 60 * 1000


def stage_rollup(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts and durations per window, stage and event. Works on a stream (late events are dropped) and on a table."""
    rows = events.withWatermark("created_at", lateness) if events.isStreaming else events
    return (
        rows.groupBy(F.window("created_at", window).alias("w"), logical_stage(F.col("stage")).alias("stage"), "event")
        .agg(F.count(F.lit(1)).alias("events"), F.sum(F.rint(F.col("duration_ms") * 100)).alias("hundredths"), F.max("duration_ms").alias("max_duration_ms"))
        .select(F.col("w.start").alias("window_start"), "stage", "event", "events", (F.col("hundredths") / 100.0).alias("total_duration_ms"), "max_duration_ms")
    )


def dedupe(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Drop repeated deliveries of an event that arrive within the lateness bound; state is released behind it."""
    if events.isStreaming:
        return events.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["id"])
    return events.dropDuplicates(["id"])


class _StuckRun(StatefulProcessor):
    """Remembers a run's latest event and reports the run once nothing followed it for 15 minutes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_us long, event string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        at, event = (known[0], known[1]) if known else (-1, "")
        for batch in rows:
            times = batch["created_at"].astype("datetime64[us]").astype("int64")
            newest = times.idxmax()
            if int(times[newest]) > at:
                at, event = int(times[newest]), str(batch["event"][newest])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((at, event))
        if event not in TERMINAL_EVENTS:
            # a run that is already older than the limit is reported at the next watermark step
            self.handle.registerTimer(max(at // 1000 + _STUCK_MS, timerValues.getCurrentWatermarkInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, event = self.last.get()
        yield pd.DataFrame({"audit_id": [key[0]], "last_event_at": [pd.Timestamp(at, unit="us")], "last_event": [event]})

    def close(self) -> None:
        pass


def stuck_runs_stream(events: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Open runs without an event for 15 minutes, reported when event time has passed that point.

    Needs the RocksDB state store provider; state is one row per run, so a run
    with very many events costs no more state than any other.
    """
    return (
        events.withWatermark("created_at", lateness)
        .groupBy("audit_id")
        .transformWithStateInPandas(_StuckRun(), outputStructType=STUCK_SCHEMA, outputMode="append", timeMode="eventTime")
    )


def stuck_runs(events: DataFrame, now: str) -> DataFrame:
    """Batch twin: open runs whose latest event is 15 minutes old at ``now``."""
    latest = events.groupBy("audit_id").agg(F.max_by(F.struct("created_at", "event"), F.struct("created_at", "id")).alias("last"))
    old = F.col("last.created_at").cast("timestamp") <= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {STALE_MINUTES} MINUTES")
    return latest.filter(~F.col("last.event").isin(*TERMINAL_EVENTS) & old).select(
        "audit_id", F.col("last.created_at").alias("last_event_at"), F.col("last.event").alias("last_event")
    )
