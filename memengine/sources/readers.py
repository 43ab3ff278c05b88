"""Batch and streaming readers with explicit schemas, and validation splits.

JSON is read permissively: a line that is no JSON, or has a value of another type,
keeps its text in ``BAD_LINE`` and goes to the rejects (``split_lines``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas as S
from ..functions import gates, urls


BAD_LINE = "_bad_line"


def _json(spark: SparkSession, schema: str, folder: str, streaming: bool) -> DataFrame:
    """One record a line.  Lines are parsed by an expression, since a JSON scan does not let its bad lines be read alone."""
    reader = spark.readStream if streaming else spark.read
    record = F.from_json("value", f"{schema}, {BAD_LINE} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE})
    return reader.text(folder).filter(F.length("value") > 0).select(record.alias("r")).select("r.*")


def page_visits(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    return _json(spark, S.PAGE_VISIT, folder, streaming)


def page_signals(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    return _json(spark, S.PAGE_SIGNAL, folder, streaming)


def split_lines(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that were read whole, and (line, reason) of the others."""
    good = rows.filter(F.col(BAD_LINE).isNull()).drop(BAD_LINE)
    return good, rows.filter(F.col(BAD_LINE).isNotNull()).select(F.col(BAD_LINE).alias("line"), F.lit("unreadable").alias("reason"))


def video_events(
    spark: SparkSession, detected: str, heartbeats: str, closed: str, streaming: bool = False
) -> DataFrame:
    """The three video streams as one frame, told apart by ``kind``."""
    return merge_video_events(
        _json(spark, S.VIDEO_DETECTED, detected, streaming), _json(spark, S.VIDEO_HEARTBEAT, heartbeats, streaming),
        _json(spark, S.VIDEO_CLOSED, closed, streaming),
    )


def merge_video_events(detected: DataFrame, heartbeats: DataFrame, closed: DataFrame) -> DataFrame:
    closing = closed.withColumnRenamed("final_watch_time_seconds", "watch_time_seconds")
    parts = [
        frame.withColumn("kind", F.lit(kind))
        for kind, frame in (("detected", detected), ("heartbeat", heartbeats), ("closed", closing))
    ]
    merged = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return merged.unionByName(parts[2], allowMissingColumns=True)


def split_visits(visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visits within bounds, and the rejected rest with a reason."""
    ok = gates.valid_visit(
        F.col("dwell_seconds"), F.col("scroll_depth"), F.col("interaction_count"),
        F.col("revisit_count"), F.col("word_count"),
    )
    rejects = visits.filter(~ok).withColumn("reason", F.lit("out_of_bounds"))
    return visits.filter(ok), rejects


def recorded_visits(visits: DataFrame, private_mode: str = "private_mode") -> DataFrame:
    """Visits the capture side keeps: no private mode, internal, video or excluded pages."""
    return visits.filter(~urls.is_skipped_visit(F.col("url"), F.col(private_mode)))
