"""State of streams as files, for jobs that work on whole micro-batches.

Each micro-batch leaves its state in a folder of its own and reads that of the batch
before it.  A batch that is repeated after a failure reads the same and overwrites
its own, so nothing counts twice; folders of older batches go.  The state is worked on by joins and windows over the whole
batch, not key by key, and no Python worker is asked for each key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..operators import capture

WAIT_SECONDS = 60


class Carried:
    """The state that the batch before ``batch_id`` left in ``folder``, and that of this one."""

    def __init__(self, spark: SparkSession, folder: str, batch_id: int):
        self.spark, self.folder, self.batch_id = spark, folder, batch_id

    def before(self, name: str, schema) -> DataFrame:
        if not self.batch_id:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{self.batch_id - 1}/{name}")

    def keep(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{self.batch_id}/{name}")

    def watermarks(self, batch: DataFrame, ts: str, late: str) -> tuple[int | None, int | None]:
        """The watermark, in microseconds, before this batch and after it: ``late`` behind the latest event; kept for the next batch."""
        old = self.before("clock", "watermark BIGINT").first()
        old = old and old[0]
        new = batch.agg(F.unix_micros(F.max(ts) - F.expr(f"INTERVAL {late}"))).first()[0]
        new = max((w for w in (old, new) if w is not None), default=None)
        self.keep(self.spark.createDataFrame([(new,)], "watermark BIGINT").coalesce(1), "clock")
        return old, new

    def forget(self) -> None:
        """Remove what the batch before the last one left; a repeated batch never reads it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.batch_id - 2}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def not_late(ts: str, watermark: int | None) -> Column:
    """Rows without a time are never late."""
    return F.lit(True) if watermark is None else F.coalesce(F.unix_micros(ts) >= F.lit(watermark), F.lit(True))


def mark_revisits(
    events: DataFrame, keys: list[str], out: str, state: str, ts: str = "ts", tie: str = "event_id",
    ttl_seconds: int = K.REVISIT_TTL_SECONDS, late: str = "1 hour", wait_seconds: int | None = WAIT_SECONDS,
    then: Callable[[DataFrame], DataFrame] = lambda marked: marked,
) -> StreamingQuery:
    """A stream of events with ``is_revisit``, through ``then``, into Parquet files under ``out``.

    An event is given out once the watermark is ``wait_seconds`` past it, so the marks equal those of ``capture.mark_revisits`` over the same
    events in whatever order they come within ``late``.  Without ``wait_seconds`` marks come with their batch, and an
    event that comes after a later one of an earlier batch is compared with those of its own batch only.  Events
    behind the watermark are dropped, and those without a time.

    Carried from batch to batch: the events that still wait, and per key the last one given out, until its time to live is
    over.  No task holds a key's share of a batch (``operators.sequences``).
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        carried = Carried(batch.sparkSession, f"{state}-carried", batch_id)
        old, new = carried.watermarks(batch, ts, late)
        rows = batch.filter(F.col(ts).isNotNull() & not_late(ts, old))
        edges = carried.before("last", rows.select(*keys, ts, tie).schema)
        if wait_seconds is None:
            ready = F.lit(True)
        else:
            rows = rows.unionByName(carried.before("waiting", batch.schema))
            ready = F.lit(False) if new is None else F.unix_micros(ts) + wait_seconds * 1_000_000 < F.lit(new)
        told = rows.withColumn("_told", F.lit(False)).unionByName(edges.withColumn("_told", F.lit(True)), allowMissingColumns=True)
        marked = capture.mark_revisits(told, keys, ts, tie, ttl_seconds).filter(~F.col("_told") & ready).select(*batch.columns, "is_revisit")
        then(marked).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        if wait_seconds is not None:
            carried.keep(rows.filter(~ready), "waiting")
        lasts = told.filter(F.col("_told") | ready).groupBy(*keys).agg(F.max(F.struct(ts, tie)).alias("_l")).select(*keys, "_l.*")
        needed = F.lit(True) if new is None else F.unix_micros(ts) >= F.lit(new - (ttl_seconds + (wait_seconds or 0)) * 1_000_000)
        carried.keep(lasts.filter(needed), "last")
        carried.forget()

    writer = events.writeStream.option("checkpointLocation", state)
    return writer.foreachBatch(save).trigger(availableNow=True).start()
