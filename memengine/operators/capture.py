"""From captured events to rows ready for the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import gates, urls
from ..functions.core import let
from ..functions.times import tolerant_timestamp
from . import sequences


def memory_key(source_type: Column, source_id: Column) -> Column:
    return F.sha2(F.concat_ws(":", source_type, source_id), 256)


def mark_revisits(
    events: DataFrame, keys: list[str], ts: str, tie: str, ttl_seconds: int = K.REVISIT_TTL_SECONDS
) -> DataFrame:
    """Add ``is_revisit``: the key was seen less than ``ttl_seconds`` earlier (sliding)."""
    near = sequences.neighbour(events, keys, [ts, tie], [ts], "_previous", slot_seconds=ttl_seconds)
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(F.col(f"_previous.{ts}"))
    return near.withColumn(
        "is_revisit", F.coalesce(gap < F.lit(ttl_seconds * 1_000_000), F.lit(False))
    ).drop("_previous")


def classify_visits(visits: DataFrame) -> DataFrame:
    """Canonical URL, application flag, and the outcome of exclusion and gate."""
    canonical = F.coalesce(F.nullif(F.col("canonical_url"), F.lit("")), urls.canonical_url(F.col("url")))
    app = F.coalesce(F.col("is_app_page"), F.lit(False)) | urls.is_app_page(F.col("domain"))
    prepared = visits.withColumn("canonical_url", canonical).withColumn("is_app_page", app)
    passed = gates.page_gate(
        F.col("dwell_seconds"), F.col("scroll_depth"), F.col("interaction_count"), F.col("revisit_count")
    )
    outcome = (
        F.when(urls.is_excluded_path(F.col("url")), "excluded")
        .when(F.col("is_app_page"), "engagement_only")
        .when(passed, "content_and_engagement")
        .otherwise("discarded")
    )
    return prepared.withColumn("outcome", outcome)


def accepted_visits(visits: DataFrame) -> DataFrame:
    return classify_visits(visits).filter(
        F.col("outcome").isin("engagement_only", "content_and_engagement")
    )


def accepted_videos(detected: DataFrame) -> DataFrame:
    """Detections (with ``is_revisit``) that pass the gate."""
    return detected.filter(
        gates.video_gate(
            F.col("watch_time_seconds"), F.col("triggered_by"), F.col("interaction_type"), F.col("is_revisit")
        )
    )


_ITEM_COLUMNS = [
    "memory_id", "source_type", "source_id", "system_group_id", "title", "raw_text", "created_at",
    "ingest_ts", "seq",
]


def _with_key(df: DataFrame, source: str, source_id: str) -> DataFrame:
    return df.withColumn("source_type", F.lit(source)).withColumn(
        "source_id", F.col(source_id)
    ).withColumn("memory_id", memory_key(F.lit(source), F.col(source_id)))


def visit_delta(visits: DataFrame) -> DataFrame:
    """Accepted page visits (with ``ts``, ``seq``) with all columns of their item, metadata and engagement rows."""
    return _with_key(visits, "chrome", "canonical_url").withColumns({
        "system_group_id": F.lit(K.GROUP_IDS["misc"]),
        "title": F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("canonical_url")),
        "raw_text": F.when(~F.col("is_app_page"), F.col("content_extract")),
        "created_at": F.col("ts"),
        "ingest_ts": F.col("ts"),
        "dwell_time_seconds": F.col("dwell_seconds").cast("bigint"),
        "watch_time_seconds": F.lit(0).cast("bigint"),
        "play_sessions_count": F.lit(1).cast("bigint"),
        "accessed_at": F.col("ts"),
    })


def visits_to_delta(visits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted page visits (with ``ts``, ``seq``) to item, metadata and engagement rows."""
    rows = visit_delta(visits)
    meta = rows.select(
        "memory_id", "seq", "url", "canonical_url", "domain", "referrer", "scroll_depth",
        "interaction_count", "revisit_count", "word_count",
    )
    engagement = rows.select(
        "memory_id", "dwell_time_seconds", "watch_time_seconds", "play_sessions_count", "accessed_at",
    )
    return rows.select(*_ITEM_COLUMNS), meta, engagement


def mail_to_delta(mail: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Flat mail rows (with ``ingest_ts``, ``seq``) to item, metadata, engagement, attachment rows."""
    from ..functions.text import attachment_extract

    base = _with_key(mail, "gmail", "email_id").withColumn(
        "created_at", tolerant_timestamp(F.col("date"), F.col("ingest_ts"))
    )
    title = F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.lit(K.NO_SUBJECT_TITLE))
    items = (
        base.withColumn("system_group_id", F.lit(K.GROUP_IDS["personal"]))
        .withColumn("title", title)
        .withColumn("raw_text", F.coalesce(F.col("body"), F.lit("")))
        .select(*_ITEM_COLUMNS)
    )
    meta = base.select(
        "memory_id", "seq", "email_id", "thread_id", "sender", "recipients", title.alias("subject"),
        F.col("created_at").alias("received_at"), "has_attachments", "gmail_labels", "is_sent",
    )
    engagement = base.select(
        "memory_id",
        *[F.lit(0).cast("bigint").alias(c) for c in
          ("dwell_time_seconds", "watch_time_seconds", "play_sessions_count")],
        F.col("ingest_ts").alias("accessed_at"),
    )
    attachments = (
        base.select("memory_id", F.explode("attachments").alias("a"))
        .select(
            "memory_id", "a.filename", "a.mime_type", F.col("a.size").alias("file_size"),
            attachment_extract(F.col("a.filename"), F.col("a.mime_type"), F.col("a.size")).alias(
                "lightweight_extract"
            ),
            F.lit(True).alias("is_processed"),
        )
        .filter(F.col("filename") != "")
        .dropDuplicates(["memory_id", "filename", "file_size"])
    )
    return items, meta, engagement, attachments


def videos_to_delta(detected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted detections (with ``seq``) to item, metadata and engagement rows.

    A detection knows no text and no channel, so those stay null and the fold
    keeps what a metadata refresh brought.
    """
    base = _with_key(detected, "youtube", "video_id")
    items = (
        base.withColumn("system_group_id", F.lit(K.GROUP_IDS["entertainment"]))
        .withColumn("title", F.lit(""))
        .withColumn("raw_text", F.lit(None).cast("string"))
        .withColumn("created_at", F.col("timestamp"))
        .withColumn("ingest_ts", F.col("timestamp"))
        .select(*_ITEM_COLUMNS)
    )
    meta = base.select(
        "memory_id", "seq", "video_id",
        *[F.lit(None).cast("string").alias(c) for c in ("channel_name", "channel_id")],
        F.lit(None).cast("int").alias("duration_seconds"),
        urls.is_short(F.col("url"), F.lit(None).cast("int")).alias("is_short"),
        F.lit(None).cast("string").alias("transcript_text"),
        F.lit(None).cast("int").alias("youtube_category_id"),
    )
    engagement = base.select(
        "memory_id",
        F.lit(0).cast("bigint").alias("dwell_time_seconds"),
        F.lit(0).cast("bigint").alias("watch_time_seconds"),
        F.lit(1).cast("bigint").alias("play_sessions_count"),
        F.col("timestamp").alias("accessed_at"),
    )
    return items, meta, engagement


def watch_updates(events: DataFrame) -> DataFrame:
    """Heartbeats and closings to engagement partials; watch time is cumulative."""
    return events.filter(F.col("kind").isin("heartbeat", "closed")).select(
        memory_key(F.lit("youtube"), F.col("video_id")).alias("memory_id"),
        F.lit(0).cast("bigint").alias("dwell_time_seconds"),
        F.col("watch_time_seconds").cast("bigint").alias("watch_time_seconds"),
        F.lit(0).cast("bigint").alias("play_sessions_count"),
        F.col("timestamp").alias("accessed_at"),
    )


def video_refresh_to_delta(metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fetched metadata (with ``transcript_text``, ``ingest_ts``, ``seq``) to item and metadata rows.

    Text is description, transcript and tags; empty text leaves the stored text alone.
    """
    from ..functions.text import category_id

    base = _with_key(metadata, "youtube", "video_id")
    text = F.concat_ws(
        " ",
        F.nullif(F.col("description"), F.lit("")),
        F.nullif(F.col("transcript_text"), F.lit("")),
        F.nullif(F.array_join("tags", " "), F.lit("")),
    )
    items = (
        base.withColumn("system_group_id", F.lit(K.GROUP_IDS["entertainment"]))
        .withColumn("raw_text", let(F.trim(text), lambda t: F.nullif(t, F.lit(""))))
        .withColumn("created_at", F.col("ingest_ts"))
        .select(*_ITEM_COLUMNS)
    )
    meta = base.select(
        "memory_id", "seq", "video_id", "channel_name", "channel_id", "duration_seconds",
        F.coalesce(F.col("duration_seconds").between(1, K.SHORT_VIDEO_SECONDS - 1), F.lit(False)).alias(
            "is_short"
        ),
        F.nullif(F.col("transcript_text"), F.lit("")).alias("transcript_text"),
        category_id(F.col("category_id")).alias("youtube_category_id"),
    )
    return items, meta


def sent_once(visits: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Application pages that pass their gate, the first time of each of ``keys`` only: (``keys``, ``order``)."""
    passed = urls.is_app_page(F.col("domain")) & gates.app_page_gate(F.col("dwell_seconds"), F.col("interaction_count"))
    return visits.filter(passed).groupBy(*keys).agg(F.min(order).alias(order))


def page_rollup(signals: DataFrame, keys: list[str | Column], order: str, *more: Column, tie: str = "event_id") -> DataFrame:
    """One row per tab visit from its repeated signals: running maxima and last non-empty texts.

    Of signals of the same ``order`` the one of the greater ``tie`` is later.  ``more``: further aggregates.
    """
    latest = F.struct(*dict.fromkeys([order, tie]))

    def last_text(column: str) -> Column:
        filled = F.coalesce(F.col(column), F.lit("")) != ""
        return F.max_by(F.col(column), F.when(filled, latest))

    return signals.groupBy(*keys).agg(
        last_text("url").alias("url"),
        last_text("title").alias("title"),
        last_text("content_extract").alias("content_extract"),
        last_text("referrer").alias("referrer"),
        F.max("scroll_depth").alias("scroll_depth"),
        F.max("interaction_count").alias("interaction_count"),
        F.max("word_count").alias("word_count"),
        F.bool_or("is_app_page").alias("is_app_page"),
        *more,
    )


def active_time(
    states: DataFrame,
    keys: list[str],
    order: list[str],
    flags: list[str],
    activity: str | None = None,
    idle_seconds: int = K.IDLE_SECONDS,
) -> DataFrame:
    """Seconds per key during which every flag held.

    ``states`` are change events: a flag is null where it did not change.  With
    ``activity`` (timestamp of user input, null elsewhere) a stretch also ends
    ``idle_seconds`` after the last input.
    """
    ts = order[0]
    carried = flags + ([activity] if activity else [])
    known = sequences.last_known(sequences.with_slot(states, keys, order), keys, order, carried)
    ahead = sequences.neighbour(known, keys, order, [ts], "_next", step=-1)
    start, end = F.unix_micros(F.col(ts)), F.unix_micros(F.col(f"_next.{ts}"))
    if activity:
        end = F.least(end, F.unix_micros(F.col(activity)) + F.lit(idle_seconds * 1_000_000))
    held = F.lit(True)
    for flag in flags:
        held = held & F.coalesce(F.col(flag), F.lit(False))
    spell = F.when(held & F.col("_next").isNotNull(), F.greatest(end - start, F.lit(0))).otherwise(F.lit(0))
    return ahead.groupBy(*keys).agg((F.sum(spell) / 1_000_000).alias("active_seconds"))
