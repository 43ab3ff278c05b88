"""Streams: revisit marks, sessions, watch folds, ingest partials, enrichment, tab visits.

State that grows with the number of keys lives in the state store; sinks are
files, so nothing passes through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import constants as K
from ..operators import capture, store
from ..runtime import checkpoint_dir
from .carried import Carried, not_late

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
TAB_GAP = "30 minutes"


def need_rocksdb(spark: SparkSession) -> None:
    if spark.conf.get(STATE_STORE, None) != ROCKSDB:
        raise ValueError(f"set {STATE_STORE} to {ROCKSDB}")


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_files(df: DataFrame, out: str, state: str, mode: str = "append") -> StreamingQuery:
    """Run everything available now into Parquet files."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).option("compression", "zstd")
    return writer.trigger(availableNow=True).start(out)


class _RevisitMarks(StatefulProcessor):
    """Per key the last event time; an event-time timer forgets it after the TTL."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_us BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # The marks need time order; one batch of one key is sorted here.
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["event_us", "event_id"])
        last = self.last.get()[0] if self.last.exists() else None
        marks = []
        for at in batch["event_us"]:
            marks.append(last is not None and 0 <= at - last < self.ttl_ms * 1000)
            last = at if last is None else max(last, at)  # a late event never moves the mark back
        self.last.update((int(last),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(last) // 1000 + self.ttl_ms)
        yield pd.DataFrame({"event_id": batch["event_id"], "is_revisit": marks})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"event_id": pd.Series(dtype="int64"), "is_revisit": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


def revisit_marks(
    events: DataFrame, keys: list[str], ts: str = "ts", ttl_seconds: int = K.REVISIT_TTL_SECONDS,
    late: str = "1 hour",
) -> DataFrame:
    """(event_id, is_revisit) for a stream of events; marks are kept even for events a gate rejects.

    Marks come with their batch, but one key's share of a micro-batch is sorted in one task, so bound the
    batch at the source (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).  Where keys are hot,
    ``revisits.marked_by_slot`` holds no key in a task and waits for the watermark; for a
    backlog, ``operators.capture.mark_revisits`` does the same in batch.  The session must keep
    its state in RocksDB (``STATE_STORE``).
    """
    need_rocksdb(events.sparkSession)
    keyed = events.withWatermark(ts, late).select(
        *keys, "event_id", F.unix_micros(F.col(ts)).alias("event_us"), F.col(ts).alias("event_time")
    )
    return keyed.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_RevisitMarks(ttl_seconds * 1000),
        outputStructType="event_id BIGINT, is_revisit BOOLEAN",
        outputMode="Append",
        timeMode="EventTime",
    )


def stream_sessions(
    events: DataFrame, keys: list[str], ts: str = "ts", gap_seconds: int = K.SESSION_GAP_SECONDS,
    late: str = "1 hour",
) -> DataFrame:
    """Closed sessions with their real end (last event, not last event plus gap)."""
    window = F.session_window(F.col(ts), f"{gap_seconds} seconds")
    return (
        events.withWatermark(ts, late)
        .groupBy(*keys, window.alias("_w"))
        .agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("events"))
        .drop("_w")
    )


def watch_fold(events: DataFrame) -> DataFrame:
    """Greatest cumulative watch time per video; duplicates and disorder do no harm."""
    return events.groupBy("video_id").agg(F.max("watch_time_seconds").alias("watch_time_seconds"))


def upsert_watch(events: DataFrame, out: str, state: str) -> StreamingQuery:
    """Changed totals of each micro-batch as files under its batch id; readers fold by max."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = watch_fold(events).writeStream.outputMode("update").option("checkpointLocation", state)
    return writer.foreachBatch(save).trigger(availableNow=True).start()


def ingest_visits(visits: DataFrame, out: str, state: str, late: str = "1 hour") -> StreamingQuery:
    """Accepted visits to partials of items, page metadata and engagement, in folders of these names.

    Dwell is a sum, so replays must not count twice: events are deduplicated by
    id, and a repeated micro-batch overwrites its own partials.  ``store.fold_items``,
    ``store.fold_page_meta`` and ``fold_partials`` fold what all batches left.

    Ids are carried from batch to batch in files, and only those whose event can still come again within ``late``
    (``carried.Carried``); events behind the watermark are dropped.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        carried = Carried(batch.sparkSession, f"{state}-carried", batch_id)
        old, new = carried.watermarks(batch, "ts", late)
        rows = batch.filter(not_late("ts", old))
        seen = carried.before("seen", rows.select("event_id", "ts").schema)
        told = rows.withColumn("_told", F.lit(False)).unionByName(seen.withColumn("_told", F.lit(True)), allowMissingColumns=True)
        copies = Window.partitionBy("event_id").orderBy(F.col("_told").desc(), "ts")
        once = told.withColumn("_copy", F.row_number().over(copies)).filter("_copy = 1 AND NOT _told").drop("_copy", "_told")
        accepted = capture.accepted_visits(once).withColumn("seq", F.col("event_id"))
        folded = store.fold_visits(capture.visit_delta(accepted)).persist()
        for name, partial in store.visit_partials(folded).items():
            partial.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        folded.unpersist()
        needed = F.lit(False) if new is None else F.unix_micros(F.col("ts") + F.expr(f"INTERVAL {late}")) > F.lit(new)
        carried.keep(told.filter(needed).select("event_id", "ts").dropDuplicates(["event_id"]), "seen")
        carried.forget()

    writer = visits.writeStream.option("checkpointLocation", state)
    return writer.foreachBatch(save).trigger(availableNow=True).start()


def fold_partials(partials: DataFrame) -> DataFrame:
    """Engagement from the partials of many batches (sums, maxima and bounds compose)."""
    return partials.groupBy("memory_id").agg(
        F.sum("dwell_time_seconds").alias("dwell_time_seconds"),
        F.max("watch_time_seconds").alias("watch_time_seconds"),
        F.sum("play_sessions_count").alias("play_sessions_count"),
        F.min("first_opened_at").alias("first_opened_at"),
        F.max("last_accessed_at").alias("last_accessed_at"),
    )


def enrich_stream(
    new_items: DataFrame, job: Callable[[DataFrame], tuple[DataFrame, DataFrame]], out: str, state: str
) -> StreamingQuery:
    """Run the enrichment job on each micro-batch; results, rejects and counts go to files by batch.

    A row of ``runs`` says how many rows of a batch were processed and how many failed.  They are observed while the
    rows are written, so counting costs no job; a batch that is repeated replaces its row.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        done, failed = Observation(), Observation()
        count = F.count(F.lit(1)).alias("rows")
        enriched, rejects = job(batch)
        enriched.observe(done, count).write.mode("overwrite").parquet(f"{out}/enriched/batch_id={batch_id}")
        rejects.observe(failed, count).write.mode("overwrite").parquet(f"{out}/rejects/batch_id={batch_id}")
        row = batch.sparkSession.createDataFrame([(done.get["rows"], failed.get["rows"])], "processed BIGINT, failed BIGINT")
        row.write.mode("overwrite").parquet(f"{out}/runs/batch_id={batch_id}")

    writer = new_items.writeStream.option("checkpointLocation", state)
    return writer.foreachBatch(save).trigger(availableNow=True).start()


def tab_visits(signals: DataFrame, keys: list[str], gap: str = TAB_GAP, late: str = "1 hour") -> DataFrame:
    """Signals of a tab until it falls silent, emitted once per visit with all that the tab told."""
    window = F.session_window("ts", gap).alias("_w")
    told = [F.min("ts").alias("opened_at"), F.count("*").alias("signals")]
    return capture.page_rollup(signals.withWatermark("ts", late), [*keys, window], "ts", *told).drop("_w")


def with_metadata(detected: DataFrame, load: Callable[[], DataFrame], out: str, state: str) -> StreamingQuery:
    """Detections with metadata that may arrive later: the table is read anew for each batch."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.join(load(), "video_id", "left").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = detected.writeStream.option("checkpointLocation", state)
    return writer.foreachBatch(save).trigger(availableNow=True).start()


def late_metadata(
    detected: DataFrame, metadata: DataFrame, key: str = "video_id", ts: str = "timestamp", arrived: str = "fetched_at",
    within: str = "30 minutes", late: str = "1 hour",
) -> DataFrame:
    """Detections with the metadata that arrives up to ``within`` after them, in whatever batch; both sides are streams.

    A detection is given out with each metadata row of its key in that time.  One without any waits until
    the watermarks of both streams say that none can come, and is given out once, with nulls.  Rows
    later than ``late`` in their own stream may be dropped.  ``detected`` and ``metadata`` share no column but ``key``.
    """
    left, right = detected.withWatermark(ts, late), metadata.withWatermark(arrived, late).withColumnRenamed(key, "_key")
    in_time = (F.col(arrived) >= F.col(ts)) & (F.col(arrived) <= F.col(ts) + F.expr(f"INTERVAL {within}"))
    return left.join(right, (F.col(key) == F.col("_key")) & in_time, "left_outer").drop("_key")
