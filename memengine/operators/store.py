"""Upsert-folds: conflict rules as associative aggregates.

A delta is reduced to one row per key first (map-side combined), then merged
into the snapshot.  In the merge the delta is the right side of a left join and
the only thing the snapshot gives up for the search of new keys is its key
column, so a small delta never shuffles stored texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import times


def _order(column: str, seq: str) -> Column:
    """``seq``, and among rows of one ``seq`` a hash of the value, so that equal deltas fold to equal rows."""
    return F.struct(F.col(seq), F.xxhash64(column))


def _last(column: str, seq: str = "seq") -> Column:
    return F.max_by(F.col(column), _order(column, seq))


def _first(column: str, seq: str = "seq") -> Column:
    return F.min_by(F.col(column), _order(column, seq))


def _last_known(column: str, seq: str = "seq") -> Column:
    """Value of the latest row where the column is not null."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), _order(column, seq)))


def _item_folds() -> list[Column]:
    titled = F.max_by("title", F.when(F.coalesce(F.col("title"), F.lit("")) != "", _order("title", "seq")))
    return [
        F.first("source_type").alias("source_type"),
        F.first("source_id").alias("source_id"),
        _first("system_group_id").alias("system_group_id"),
        F.coalesce(titled, F.lit("")).alias("title"),
        _last_known("raw_text").alias("raw_text"),
        _first("created_at").alias("created_at"),
        F.min("ingest_ts").alias("first_ingested_at"),
        F.max("ingest_ts").alias("last_updated_at"),
    ]


def _item_places() -> list[Column]:
    """Of which row an item's first sight, title and text are."""
    title_seq = F.max(F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.col("seq")))
    text_seq = F.max(F.when(F.col("raw_text").isNotNull(), F.col("seq")))
    return [F.min("seq").alias("_first"), title_seq.alias("_title"), text_seq.alias("_text")]


def reduce_items(delta: DataFrame) -> DataFrame:
    """Item rows of one delta to one row per key."""
    return delta.groupBy("memory_id").agg(*_item_folds())


def compact_items(delta: DataFrame) -> DataFrame:
    """Item rows of one delta to at most three per key that fold to the same result, also with other deltas.

    One row stands for the first sight of the item, one for its title and one for its text.
    """
    return _item_rows(delta.groupBy("memory_id").agg(*_item_folds(), *_item_places()))


def _item_rows(folded: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")

    def row(seq: Column, ingest: str, title: Column, text: Column) -> Column:
        return F.struct(
            seq.alias("seq"), F.col(ingest).alias("ingest_ts"), title.alias("title"), text.alias("raw_text")
        )

    rows = F.array(
        row(F.col("_first"), "first_ingested_at", none, none),
        row(F.coalesce("_title", "_first"), "last_updated_at", F.col("title"), none),
        row(F.col("_text"), "last_updated_at", none, F.col("raw_text")),
    )
    kept = F.filter(rows, lambda r: r["seq"].isNotNull())
    same = ["memory_id", "source_type", "source_id", "system_group_id", "created_at"]
    return folded.select(*same, F.explode(kept).alias("_r")).select(*same, "_r.*")


def _page_places() -> list[Column]:
    """Of which row the addresses, the referrer and the word count of a page are."""
    known = lambda c: F.max(F.when(F.col(c).isNotNull(), F.col("seq")))
    return [F.max("seq").alias("_last"), known("referrer").alias("_referrer"), known("word_count").alias("_words")]


def compact_page_meta(rows: DataFrame) -> DataFrame:
    """Page metadata rows of one delta to at most three per key that fold to the same result."""
    return _page_rows(rows.groupBy("memory_id").agg(*_page_folds(), *_page_places()))


def _page_rows(folded: DataFrame) -> DataFrame:
    def row(seq: str, referrer: Column, words: Column) -> Column:
        return F.struct(F.col(seq).alias("seq"), referrer.alias("referrer"), words.alias("word_count"))

    no_text, no_count = F.lit(None).cast("string"), F.lit(None).cast("int")
    parts = F.array(
        row("_last", no_text, no_count), row("_referrer", F.col("referrer"), no_count),
        row("_words", no_text, F.col("word_count")),
    )
    same = [
        "memory_id", "url", "canonical_url", "domain", "scroll_depth", "interaction_count", "revisit_count"
    ]
    kept = F.filter(parts, lambda r: r["seq"].isNotNull())
    return folded.select(*same, F.explode(kept).alias("_r")).select(*same, "_r.*")


def fold_visits(delta: DataFrame) -> DataFrame:
    """Visits (``capture.visit_delta``) to one row per key with the folds of item, metadata and engagement: one shuffle for all three."""
    folds = [*_item_folds(), *_item_places(), *_page_folds(), *_page_places(), *_engagement_folds()]
    return delta.groupBy("memory_id").agg(*folds)


def visit_partials(folded: DataFrame) -> dict[str, DataFrame]:
    """Rows of ``fold_visits`` as ``compact_items``, ``compact_page_meta`` and ``fold_engagement`` give them."""
    engagement = ["dwell_time_seconds", "watch_time_seconds", "play_sessions_count", "first_opened_at", "last_accessed_at"]
    return {"items": _item_rows(folded), "page_meta": _page_rows(folded), "engagement": folded.select("memory_id", *engagement)}


def _as_new(reduced: DataFrame) -> DataFrame:
    return reduced.select(
        "memory_id", "system_group_id", "source_type", "source_id", "title", "raw_text",
        F.array().cast("array<string>").alias("auto_keywords"),
        F.lit(False).alias("preprocessed"),
        F.lit("pending").alias("classified_by"),
        F.lit(None).cast("double").alias("classification_confidence"),
        "created_at", "first_ingested_at", "last_updated_at",
        F.lit(False).alias("is_deleted"),
        F.lit(True).alias("created_new"),
    )


def fold_items(snapshot: DataFrame | None, delta: DataFrame) -> DataFrame:
    """Merge a delta into the item table; ``created_new`` marks keys the snapshot lacked.

    Title: last non-empty.  Text: last non-null; a changed text asks for
    enrichment again.  Group, creation and first-ingest times stay.
    """
    reduced = reduce_items(delta)
    if snapshot is None:
        return _as_new(reduced)
    fresh = reduced.select(
        "memory_id",
        F.nullif(F.col("title"), F.lit("")).alias("_title"),
        F.col("raw_text").alias("_text"),
        F.col("last_updated_at").alias("_updated"),
    )
    changed = F.col("_text").isNotNull() & ~F.col("_text").eqNullSafe(F.col("raw_text"))
    updated = snapshot.join(fresh, "memory_id", "left").select(
        "memory_id", "system_group_id", "source_type", "source_id",
        F.coalesce("_title", "title").alias("title"),
        F.coalesce("_text", "raw_text").alias("raw_text"),
        "auto_keywords",
        (F.col("preprocessed") & ~changed).alias("preprocessed"),
        "classified_by", "classification_confidence", "created_at", "first_ingested_at",
        F.greatest("last_updated_at", "_updated").alias("last_updated_at"),
        "is_deleted",
        F.lit(False).alias("created_new"),
    )
    new = reduced.join(snapshot.select("memory_id"), "memory_id", "left_anti")
    return updated.unionByName(_as_new(new))


def fold_mail_meta(rows: DataFrame) -> DataFrame:
    """Last value of every column except the mail id; null flags and arrays get defaults."""
    empty = F.array().cast("array<string>")
    return rows.groupBy("memory_id").agg(
        _first("email_id").alias("email_id"),
        _last("thread_id").alias("thread_id"),
        _last("sender").alias("sender"),
        F.coalesce(_last("recipients"), empty).alias("recipients"),
        _last("subject").alias("subject"),
        _last("received_at").alias("received_at"),
        F.coalesce(_last("has_attachments"), F.lit(False)).alias("has_attachments"),
        F.coalesce(_last("gmail_labels"), empty).alias("gmail_labels"),
        F.coalesce(_last("is_sent"), F.lit(False)).alias("is_sent"),
    )


def _page_folds() -> list[Column]:
    return [
        _last("url").alias("url"),
        _last("canonical_url").alias("canonical_url"),
        _last("domain").alias("domain"),
        _last_known("referrer").alias("referrer"),
        F.max(F.coalesce("scroll_depth", F.lit(0.0))).alias("scroll_depth"),
        F.max(F.coalesce("interaction_count", F.lit(0))).alias("interaction_count"),
        F.max(F.coalesce("revisit_count", F.lit(0))).alias("revisit_count"),
        _last_known("word_count").alias("word_count"),
    ]


def fold_page_meta(rows: DataFrame) -> DataFrame:
    """Addresses last, referrer and word count last known, counters greatest."""
    return rows.groupBy("memory_id").agg(*_page_folds())


def fold_video_meta(rows: DataFrame) -> DataFrame:
    """Last known value per column; once short, always short."""
    return rows.groupBy("memory_id").agg(
        _first("video_id").alias("video_id"),
        *[_last_known(c).alias(c) for c in ("channel_name", "channel_id", "duration_seconds")],
        F.bool_or("is_short").alias("is_short"),
        *[_last_known(c).alias(c) for c in ("transcript_text", "youtube_category_id")],
    )


def _engagement_folds() -> list[Column]:
    return [
        F.sum(F.coalesce("dwell_time_seconds", F.lit(0))).alias("dwell_time_seconds"),
        F.max(F.coalesce("watch_time_seconds", F.lit(0))).alias("watch_time_seconds"),
        F.sum(F.coalesce("play_sessions_count", F.lit(0))).alias("play_sessions_count"),
        F.min("accessed_at").alias("first_opened_at"),
        F.max("accessed_at").alias("last_accessed_at"),
    ]


def fold_engagement(partials: DataFrame) -> DataFrame:
    """Dwell and plays add up, watch time is the greatest, first and latest access."""
    return partials.groupBy("memory_id").agg(*_engagement_folds())


def completion(engagement: DataFrame, video_meta: DataFrame) -> DataFrame:
    """Engagement with the completion rate of the folded (greatest) watch time."""
    lengths = video_meta.select("memory_id", F.col("duration_seconds").alias("_duration"))
    return engagement.join(lengths, "memory_id", "left").withColumn(
        "completion_rate", times.completion_rate(F.col("watch_time_seconds"), F.col("_duration"))
    ).drop("_duration")


def fold_embeddings(rows: DataFrame, seq: str = "indexed_at") -> DataFrame:
    """Latest registry row per item, active; vector and text always from the same version."""
    fields = ["embedding_version", "vector_dimension", "indexed_at", "embeddable_text", "embedding"]
    present = [f for f in fields if f in rows.columns]
    latest = rows.groupBy("memory_id").agg(F.max_by(F.struct(*present), F.struct(F.col(seq), F.xxhash64(*present))).alias("_r"))
    return latest.select("memory_id", "_r.*", F.lit(True).alias("is_active"))


def placeholder_registry(items: DataFrame, text: str, version: str = "placeholder-v1") -> DataFrame:
    """Registry rows without vectors: dimension = word count, clamped."""
    low, high = K.PLACEHOLDER_DIM_RANGE
    words = times.word_count(F.col(text))
    return items.select(
        "memory_id",
        F.lit(version).alias("embedding_version"),
        F.greatest(F.lit(low), F.least(F.lit(high), words)).alias("vector_dimension"),
        F.lit(True).alias("is_active"),
        F.col(text).alias("embeddable_text"),
    )


def stale_embeddings(registry: DataFrame, version: str) -> DataFrame:
    return registry.filter(~F.col("is_active") | (F.col("embedding_version") != version))


def write_enrichment(items: DataFrame, enriched: DataFrame) -> DataFrame:
    """Items with group, method, confidence and keywords of the enriched rows."""
    ids = F.create_map(*[F.lit(v) for pair in K.GROUP_IDS.items() for v in pair])
    fresh = enriched.select(
        "memory_id",
        F.coalesce(F.try_element_at(ids, F.col("category")), F.lit(K.MISC_GROUP)).alias("_group"),
        F.col("method").alias("_method"),
        F.col("confidence").alias("_confidence"),
        F.col("auto_keywords").alias("_keywords"),
        F.lit(True).alias("_done"),
    )
    done = F.coalesce(F.col("_done"), F.lit(False))
    joined = items.join(fresh, "memory_id", "left")
    pairs = {
        "system_group_id": "_group", "classified_by": "_method",
        "classification_confidence": "_confidence", "auto_keywords": "_keywords",
    }
    return joined.select(
        *[
            F.when(done, F.col(pairs[c])).otherwise(F.col(c)).alias(c) if c in pairs
            else (F.col(c) | done).alias(c) if c == "preprocessed"
            else F.col(c)
            for c in items.columns
        ]
    )


def pending_items(items: DataFrame) -> DataFrame:
    """Unprocessed items; deleted ones are not left out."""
    return items.filter(~F.col("preprocessed"))


def live_children(children: DataFrame, items: DataFrame) -> DataFrame:
    """Child rows whose item still exists."""
    return children.join(items.select("memory_id"), "memory_id", "left_semi")


def new_mail(mail: DataFrame, mail_meta: DataFrame) -> DataFrame:
    return mail.join(mail_meta.select("email_id"), "email_id", "left_anti")


def mail_export(mail: DataFrame) -> DataFrame:
    """Flat export rows; the body is cut to the exported length."""
    return mail.select(
        "memory_id", "subject", "sender", F.col("date").alias("received_time"),
        F.array_join("gmail_labels", ",").alias("labels"),
        F.substring("body", 1, K.EXPORT_BODY_CHARS).alias("body"),
    )


def save_bucketed(df: DataFrame, table: str, buckets: int, key: str = "memory_id") -> None:
    """Store a table bucketed and sorted by its item key, so item joins need no shuffle."""
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
