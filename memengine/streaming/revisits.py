"""Revisit marks of a stream by chained stateful steps, so that no task holds a key's share of a batch.

Time is cut into slots no longer than the TTL.  All events of a (key, slot) but
its first are revisits, whatever they are; only the first one needs the past.

1. A windowed aggregate finds the first and the last event of each (key, slot).  It is
   combined before its shuffle, so a key with most of the events is a few rows a task.
2. A state per key compares one such edge row per slot with the last event before it.
3. A stream-stream join by event id brings the answers of step 2 to the events; an
   event without one is not the first of its slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as K
from .jobs import need_rocksdb

SLOT_SECONDS = 60


class _Openings(StatefulProcessor):
    """Per key the time of the last event; one edge row per slot comes in, in any order within a batch."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_us BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        edges = sorted((row for frame in rows for row in frame[["first_us", "last_us", "event_id", "closes"]].itertuples(index=False)), key=lambda e: e[0])
        marks = []
        for first_us, last_us, _, _ in edges:
            marks.append(last is not None and first_us - last < self.ttl_us)
            last = last_us
        self.last.update((int(last),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((int(last) + self.ttl_us) // 1000 + 1)
        yield pd.DataFrame({"opening": [e[2] for e in edges], "is_revisit": marks, "closes": [e[3] for e in edges]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"opening": pd.Series(dtype="int64"), "is_revisit": pd.Series(dtype="bool"), "closes": pd.Series(dtype="datetime64[us]")})

    def close(self) -> None:
        pass


def marked_by_slot(
    events: DataFrame, keys: list[str], ts: str = "ts", tie: str = "event_id", ttl_seconds: int = K.REVISIT_TTL_SECONDS,
    late: str = "1 hour", slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """The events, with is_revisit, whose slot the watermark has closed; ``keys`` are not null.

    ``tie`` is a whole number that tells the events apart.  Events of one key are taken in order of (``ts``, ``tie``),
    however they come within the watermark's delay, so the marks equal those of ``capture.mark_revisits`` over
    the same events.  ``slot_seconds`` must not exceed the TTL and divide a day; a slot more than the delay is what a mark waits.
    """
    if slot_seconds > ttl_seconds:
        raise ValueError("a slot must not be longer than the TTL")
    need_rocksdb(events.sparkSession)
    timed = events.withWatermark(ts, late)
    ends = timed.groupBy(*keys, F.window(ts, f"{slot_seconds} seconds").alias("_slot")).agg(
        F.min(F.struct(F.col(ts).alias("at"), F.col(tie).cast("bigint").alias("id"))).alias("_first"), F.max(ts).alias("_last")
    )
    edges = ends.select(
        *keys, F.window_time("_slot").alias("closes"), F.unix_micros("_first.at").alias("first_us"),
        F.unix_micros("_last").alias("last_us"), F.col("_first.id").alias("event_id"),
    )
    openings = edges.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Openings(ttl_seconds * 1_000_000), outputStructType="opening BIGINT, is_revisit BOOLEAN, closes TIMESTAMP",
        outputMode="Append", timeMode="EventTime", eventTimeColumnName="closes",
    )
    of_slot = (F.col(tie) == F.col("opening")) & (F.col("closes") >= F.col(ts)) & (F.col("closes") <= F.col(ts) + F.expr(f"INTERVAL {slot_seconds} SECONDS"))
    return timed.join(openings.drop(*keys), of_slot, "left_outer").select(*events.columns, F.coalesce("is_revisit", F.lit(True)).alias("is_revisit"))
