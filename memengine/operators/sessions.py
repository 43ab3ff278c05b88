"""Activity sessions, source switches, toggles and time patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from . import sequences


def sessionize(
    events: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    gap_seconds: int = K.SESSION_GAP_SECONDS,
    switch: str | None = None,
) -> DataFrame:
    """Add ``session_no`` (1.. per key) and, with ``switch``, ``is_switch``.

    A gap of exactly ``gap_seconds`` stays in the session.
    """
    fields = [ts] + ([switch] if switch else [])
    placed = sequences.with_slot(events, keys, [ts, tie])
    near = sequences.neighbour(placed, keys, [ts, tie], fields, "_before")
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(F.col(f"_before.{ts}"))
    opens = F.coalesce(gap > F.lit(gap_seconds * 1_000_000), F.lit(True))
    flagged = near.withColumn("_opens", opens.cast("int"))
    if switch:
        other = F.coalesce(F.col(switch) != F.col(f"_before.{switch}"), F.lit(False))
        flagged = flagged.withColumn("is_switch", other & (F.col("_opens") == 0))
    numbered = sequences.running_total(flagged, keys, [ts, tie], F.col("_opens"), "session_no")
    return numbered.drop("_before", "_opens", *sequences.PLACE)


def session_key(keys: list[str]) -> Column:
    return F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("session_no")), 256)


def summarize_sessions(numbered: DataFrame, keys: list[str], ts: str, group: str) -> DataFrame:
    """Per session: bounds, length, dominant group, switches, rows.

    First per (session, group), then per session, so neither step needs more
    than counters in memory.  The dominant group is the most frequent, ties to
    the smallest.
    """
    by_group = numbered.groupBy(*keys, "session_no", group).agg(
        F.count("*").alias("_n"),
        F.min(ts).alias("_start"),
        F.max(ts).alias("_end"),
        F.sum(F.col("is_switch").cast("int")).alias("_switches"),
    )
    top = F.min(F.struct((-F.col("_n")).alias("n"), F.col(group).alias("g")))
    out = by_group.groupBy(*keys, "session_no").agg(
        F.min("_start").alias("session_start"),
        F.max("_end").alias("session_end"),
        top.alias("_top"),
        F.sum("_switches").alias("source_switch_count"),
        F.sum("_n").alias("events"),
    )
    seconds = F.unix_seconds("session_end") - F.unix_seconds("session_start")
    return out.withColumn("total_duration_seconds", seconds).withColumn(
        "dominant_group", F.col("_top.g")
    ).drop("_top")


def session_items(numbered: DataFrame, keys: list[str], item: str) -> DataFrame:
    return numbered.select(*keys, "session_no", item).distinct()


def time_patterns(sessions: DataFrame, grain: str, group: str, totals: bool = False) -> DataFrame:
    """Session seconds per day or hour and dominant group; ``totals`` adds roll-up rows."""
    bucket = {
        "day": F.to_date("session_start"),
        "hour": F.hour("session_start"),
        "weekday": F.weekday("session_start"),
    }[grain].alias(grain)
    grouped = sessions.rollup(bucket, F.col(group)) if totals else sessions.groupBy(bucket, F.col(group))
    return grouped.agg(
        F.sum("total_duration_seconds").alias("total_seconds"), F.count("*").alias("sessions")
    )


def toggle_state(log: DataFrame, key: str) -> DataFrame:
    """Marked now? Every row flips the state."""
    return log.groupBy(key).agg((F.count("*") % 2 == 1).alias("is_marked"), F.count("*").alias("toggles"))


def toggle_patterns(log: DataFrame, ts: str) -> DataFrame:
    """Toggles by hour and weekday (0 = Monday)."""
    return log.groupBy(F.hour(ts).alias("hour"), F.weekday(ts).alias("weekday")).agg(
        F.count("*").alias("toggles")
    )
