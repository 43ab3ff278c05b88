"""Joined views over the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def wide_items(
    items: DataFrame, engagement: DataFrame, pages: DataFrame, mail: DataFrame, videos: DataFrame
) -> DataFrame:
    """One row per item with engagement (required) and its source's metadata (optional)."""
    key = "memory_id"
    return (
        items.select(
            key, "source_type", "title", "created_at", "auto_keywords", "system_group_id", "is_deleted",
            "preprocessed",
        )
        .join(
            engagement.select(
                key, "dwell_time_seconds", "watch_time_seconds", "last_accessed_at", "first_opened_at",
                "play_sessions_count", "completion_rate",
            ),
            key,
        )
        .join(
            pages.select(
                key, "url", "canonical_url", "domain", "scroll_depth", "revisit_count",
                "interaction_count",
            ),
            key, "left",
        )
        .join(
            mail.select(
                key, "sender", "subject", "has_attachments", "thread_id", "recipients", "gmail_labels"
            ),
            key, "left",
        )
        .join(
            videos.select(
                key, "channel_name", "video_id", "is_short", "duration_seconds", "youtube_category_id"
            ),
            key, "left",
        )
    )


def searchable(items: DataFrame, engagement: DataFrame) -> DataFrame:
    """What structured search reads of the wide view: one join, no metadata."""
    return items.select(
        "memory_id", "source_type", "title", "auto_keywords", "created_at", "is_deleted", "preprocessed"
    ).join(engagement.select("memory_id", "last_accessed_at"), "memory_id")


def with_details(results: DataFrame, wide: DataFrame) -> DataFrame:
    """Result rows with the wide columns they lack."""
    extra = [c for c in wide.columns if c == "memory_id" or c not in results.columns]
    return results.join(wide.select(*extra), "memory_id")


def candidate_view(items: DataFrame, registry: DataFrame, engagement: DataFrame, mail: DataFrame) -> DataFrame:
    """Live items with active registry text, engagement, and mail subject and sender."""
    active = registry.filter("is_active").select("memory_id", F.col("embeddable_text").alias("_text"))
    return (
        items.filter(~F.col("is_deleted"))
        .join(active, "memory_id", "left")
        .join(
            engagement.select(
                "memory_id", "dwell_time_seconds", "watch_time_seconds", "last_accessed_at"
            ),
            "memory_id", "left",
        )
        .join(mail.select("memory_id", "subject", "sender"), "memory_id", "left")
        .withColumn("embeddable_text", F.coalesce("_text", "raw_text", F.lit("")))
        .drop("_text")
    )


def thread_history(items: DataFrame, mail: DataFrame) -> DataFrame:
    """Mail rows of every thread, oldest first.

    Rows, not one array per thread: the sort is a range sort over (thread, time),
    so a thread of any length is spread over tasks.
    """
    joined = items.select("memory_id", "title", "raw_text", "first_ingested_at").join(
        mail.select(
            "memory_id", "thread_id", "sender", "recipients", "gmail_labels", "received_at",
            "has_attachments",
        ),
        "memory_id",
    )
    return joined.orderBy("thread_id", "received_at", "memory_id")


def item_context(items: DataFrame, mail: DataFrame, pages: DataFrame, videos: DataFrame) -> DataFrame:
    """Items with everything cleaning and classification read, absent texts as ``''``."""

    def text(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit("")).alias(column)

    joined = (
        items.select("memory_id", "source_type", "source_id", text("title"), text("raw_text"), "created_at")
        .join(
            mail.select("memory_id", "thread_id", "sender", "recipients", "subject", "gmail_labels",
                        "has_attachments"),
            "memory_id", "left",
        )
        .join(pages.select("memory_id", "url", "canonical_url", "domain"), "memory_id", "left")
        .join(
            videos.select("memory_id", "video_id", "channel_name", "channel_id", "duration_seconds",
                          "is_short", "transcript_text", "youtube_category_id"),
            "memory_id", "left",
        )
    )
    filled = {c: F.coalesce(F.col(c), F.lit("")) for c in
              ("sender", "domain", "canonical_url", "url", "channel_name", "transcript_text")}
    filled["subject"] = F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.col("title"))
    filled["is_short"] = F.coalesce(F.col("is_short"), F.lit(False))
    return joined.withColumns(filled).withColumn("sender_domain", urls.sender_domain(F.col("sender")))


def reconcile(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Per presence (both / old_only / new_only): number of distinct keys."""
    left = old.select(key).distinct().withColumn("_old", F.lit(True))
    right = new.select(key).distinct().withColumn("_new", F.lit(True))
    where = (
        F.when(F.col("_old") & F.col("_new"), "both").when(F.col("_old"), "old_only").otherwise("new_only")
    )
    return left.join(right, key, "full_outer").groupBy(where.alias("presence")).agg(
        F.count("*").alias("keys")
    )
