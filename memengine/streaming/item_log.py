"""Items of mail, pages and videos as one stream of deltas, and its merge into the item store.

``append`` unites the deltas of the three sources in one log: one query, one
checkpoint, one order.  The log's file sink commits whole batches, so readers see
each delta once whatever restarts there were.  ``merge_into`` streams the log into
a ``bucket_store``; its checkpoint says what has been merged.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import bucket_store, capture, store
from .jobs import write_files

# the order of sources that deliver at the same moment
_RANK = {"gmail": 0, "chrome": 1, "youtube": 2}


def sequence(ingest_ts: Column, source: str, event: Column) -> Column:
    """One order over all sources: by time, then source, then the source's own order."""
    return F.struct(F.unix_micros(ingest_ts).alias("at"), F.lit(_RANK[source]).alias("source"), event.cast("bigint").alias("event"))


def item_deltas(
    mail: DataFrame | None = None, visits: DataFrame | None = None, detected: DataFrame | None = None, fetched: DataFrame | None = None,
) -> DataFrame:
    """Item rows of flat mail, accepted visits, accepted detections and fetched video metadata; tables or streams.

    Each frame has ``event`` (its own order; unique), mail and metadata also ``ingest_ts``.
    """
    parts = []
    for df, source, when, rows in (
        (mail, "gmail", "ingest_ts", capture.mail_to_delta), (visits, "chrome", "ts", capture.visits_to_delta),
        (detected, "youtube", "timestamp", capture.videos_to_delta), (fetched, "youtube", "ingest_ts", capture.video_refresh_to_delta),
    ):
        if df is not None:
            parts.append(rows(df.withColumn("seq", sequence(F.col(when), source, F.col("event"))))[0])
    return reduce(DataFrame.unionByName, parts)


def once(df: DataFrame, ts: str, key: str, late: str = "1 hour") -> DataFrame:
    """A stream without the rows that are sent again within ``late``."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def append(deltas: DataFrame, log: str, state: str) -> StreamingQuery:
    return write_files(deltas, log, state)


def merge_into(
    log: DataFrame, folder: str, state: str, buckets: int = bucket_store.BUCKETS, texts: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Merge what the log has gained into the item store.

    A batch is reduced to one row per key for each of title, text and first sight before it meets the store, and
    rewrites only the buckets of its keys.  Folding the same batch again gives the same rows, so a batch that is
    repeated after a failure does no harm.  A log may name long texts instead of holding them: ``texts`` then
    puts them in for the few rows that are left of a batch.
    """

    def fold(table: DataFrame | None, deltas: DataFrame) -> DataFrame:
        return fold_deltas(table, texts(store.compact_items(deltas)) if texts else deltas)

    def save(batch: DataFrame, batch_id: int) -> None:
        bucket_store.merge(folder, batch, fold, batch_id, buckets=buckets)

    return log.writeStream.option("checkpointLocation", state).foreachBatch(save).trigger(availableNow=True).start()


def fold_deltas(table: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """New item rows, without ``created_new``: a store has no use for it."""
    return store.fold_items(table, deltas).drop("created_new")
