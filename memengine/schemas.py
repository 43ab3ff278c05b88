"""Explicit schemas of every input and table; nothing is inferred."""

from __future__ import annotations

PAGE_VISIT = (
    "user_id BIGINT, event_id BIGINT, ts TIMESTAMP, url STRING, canonical_url STRING, title STRING, "
    "domain STRING, dwell_seconds INT, scroll_depth DOUBLE, interaction_count INT, revisit_count INT, "
    "content_extract STRING, word_count INT, referrer STRING, is_app_page BOOLEAN"
)
PAGE_SIGNAL = (
    "tab_id BIGINT, type STRING, url STRING, title STRING, scrollDepth DOUBLE, interactionCount INT, "
    "contentExtract STRING, wordCount INT, referrer STRING, isAppPage BOOLEAN, timestamp BIGINT"
)
VIDEO_DETECTED = (
    "event_id BIGINT, url STRING, video_id STRING, is_short BOOLEAN, watch_time_seconds INT, "
    "triggered_by STRING, interaction_type STRING, timestamp TIMESTAMP"
)
VIDEO_HEARTBEAT = "event_id BIGINT, video_id STRING, watch_time_seconds INT, timestamp TIMESTAMP"
VIDEO_CLOSED = "event_id BIGINT, video_id STRING, final_watch_time_seconds INT, timestamp TIMESTAMP"

MAIL_DUMP = (
    "id STRING, threadId STRING, labelIds ARRAY<STRING>, payload STRUCT<"
    "headers: ARRAY<STRUCT<name: STRING, value: STRING>>, body: STRUCT<data: STRING>, "
    "parts: ARRAY<STRUCT<mimeType: STRING, filename: STRING, size: INT, body: STRUCT<data: STRING>>>>"
)
VIDEO_DUMP = (
    "id STRING, snippet STRUCT<title: STRING, description: STRING, channelTitle: STRING, "
    "channelId: STRING, publishedAt: STRING, categoryId: STRING, tags: ARRAY<STRING>>, "
    "contentDetails STRUCT<duration: STRING>"
)
CAPTION_DUMP = "video_id STRING, kind STRING, priority INT, body STRING"
CAPTION_JSON = "events ARRAY<STRUCT<segs: ARRAY<STRUCT<utf8: STRING>>>>"

INTENT_REPLY = (
    "sources ARRAY<STRING>, time_filter STRING, fetch_attachment BOOLEAN, fetch_api BOOLEAN, "
    "query_clean STRING, scope_level INT, is_ambiguous BOOLEAN, original_query STRING, "
    "skip_postgres_filter BOOLEAN, full_faiss_scan BOOLEAN"
)

ITEMS = (
    "memory_id STRING, system_group_id INT, source_type STRING, source_id STRING, title STRING, "
    "raw_text STRING, auto_keywords ARRAY<STRING>, preprocessed BOOLEAN, classified_by STRING, "
    "classification_confidence DOUBLE, created_at TIMESTAMP, first_ingested_at TIMESTAMP, "
    "last_updated_at TIMESTAMP, is_deleted BOOLEAN"
)
MAIL_META = (
    "memory_id STRING, email_id STRING, thread_id STRING, sender STRING, recipients ARRAY<STRING>, "
    "subject STRING, received_at TIMESTAMP, has_attachments BOOLEAN, gmail_labels ARRAY<STRING>, "
    "is_sent BOOLEAN"
)
PAGE_META = (
    "memory_id STRING, url STRING, canonical_url STRING, domain STRING, referrer STRING, "
    "scroll_depth DOUBLE, interaction_count INT, revisit_count INT, word_count INT"
)
VIDEO_META = (
    "memory_id STRING, video_id STRING, channel_name STRING, channel_id STRING, duration_seconds INT, "
    "is_short BOOLEAN, transcript_text STRING, youtube_category_id INT"
)
ENGAGEMENT = (
    "memory_id STRING, dwell_time_seconds BIGINT, watch_time_seconds BIGINT, first_opened_at TIMESTAMP, "
    "last_accessed_at TIMESTAMP, play_sessions_count BIGINT"
)
ATTACHMENTS = (
    "memory_id STRING, filename STRING, mime_type STRING, file_size INT, lightweight_extract STRING, "
    "is_processed BOOLEAN"
)
EMBEDDINGS = (
    "memory_id STRING, embedding_version STRING, vector_dimension INT, indexed_at TIMESTAMP, "
    "is_active BOOLEAN, embeddable_text STRING, embedding ARRAY<FLOAT>"
)
MESSAGES = "session_id STRING, message STRING, created_at TIMESTAMP"
MESSAGE_BODY = "role STRING, content STRING, created_at STRING"
