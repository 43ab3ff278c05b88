"""Duration, timestamp and counter expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DURATION = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?"


def iso_duration_seconds(text: Column) -> Column:
    """``PT#H#M#S`` to seconds; anything else is 0."""

    def part(group: int) -> Column:
        return F.coalesce(F.regexp_extract(text, _DURATION, group).try_cast("bigint"), F.lit(0))

    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3), F.lit(0)).cast("int")


def tolerant_timestamp(text: Column, default: Column) -> Column:
    """ISO-8601, then RFC 2822, else ``default``.

    The weekday of an RFC date is stripped because an ``EEE`` pattern is refused
    by the default parser; a trailing zone comment such as ``(UTC)`` goes too.
    """
    value = F.trim(text)
    iso = F.when(
        value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"),
        F.try_to_timestamp(value),
    )
    bare = F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)$", "")
    bare = F.regexp_replace(bare, r"\s(GMT|UTC|UT)$", " +0000")
    rfc = F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(iso, rfc, default)


def scroll_fraction(offset: Column, document_height: Column, viewport_height: Column) -> Column:
    """Share of the scrollable height above the viewport, three decimals."""
    room = F.greatest(document_height - viewport_height, F.lit(1))
    return F.round(F.greatest(F.least(offset / room, F.lit(1.0)), F.lit(0.0)), 3)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def completion_rate(watch: Column, duration: Column) -> Column:
    return F.when(duration > 0, F.least(F.lit(1.0), watch / duration))
