"""Upsert-folds, views, sessions, toggles, messages, groups, checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text
from ..operators import capture, checks, groups, messages, sessions, store, views
from ..sources import dimensions
from . import query
from .capture import caption_dump, flat_mail, video_dump
from .tables import Tables, with_tables


def _us(column: str):
    return F.unix_micros(F.col(column)).alias(column)


# --- items: two ingests of the mail, the second changes some and brings the rest ---
def _ingest(t: Tables, second: bool) -> DataFrame:
    base = t.mail_docs.select("memory_id", "source_id", "title", "text", "created_at", "doc_id")
    row = F.col("doc_id")
    if not second:
        rows = base.filter("doc_id % 10 <> 4").withColumn("raw_text", F.col("text")).withColumn("seq", F.lit(1))
    else:
        rows = (
            base.filter("doc_id % 3 = 0 OR doc_id % 10 = 4")
            .withColumn("title", F.when(row % 12 == 0, "").otherwise(F.concat(F.lit("v2 "), F.col("title"))))
            .withColumn("raw_text", F.when(row % 9 != 0, F.concat(F.lit("v2 "), F.col("text"))))
            .withColumn("seq", F.lit(2))
        )
    return rows.select(
        "memory_id", F.lit("gmail").alias("source_type"), "source_id", F.lit(4).alias("system_group_id"),
        "title", "raw_text", "created_at",
        F.timestamp_micros(F.unix_micros("created_at") + F.col("seq") * 1_000_000).alias("ingest_ts"), "seq",
    )


_INGEST = """
    SELECT memory_id, title, text AS raw_text, 1 AS seq, created_at FROM mail_docs WHERE doc_id % 10 <> 4
    UNION ALL
    SELECT memory_id, CASE WHEN doc_id % 12 = 0 THEN '' ELSE 'v2 ' || title END,
           CASE WHEN doc_id % 9 <> 0 THEN 'v2 ' || text END, 2, created_at FROM mail_docs WHERE doc_id % 3 = 0 OR doc_id % 10 = 4"""


@query(
    "item_fold",
    with_tables(
        "mail_docs",
        """SELECT memory_id, coalesce(arg_max(title, seq) FILTER (WHERE title <> ''), '') AS title,
                  md5(arg_max(raw_text, seq) FILTER (WHERE raw_text IS NOT NULL)) AS text_hash,
                  min(seq) = 2 AS created_new,
                  epoch_us(min(created_at)) + min(seq) * 1000000 AS first_ingested_at,
                  epoch_us(min(created_at)) + max(seq) * 1000000 AS last_updated_at
           FROM ingest GROUP BY memory_id""",
        ingest=_INGEST,
    ),
)
def item_fold(t: Tables) -> DataFrame:
    snapshot = store.fold_items(None, _ingest(t, second=False)).drop("created_new")
    folded = store.fold_items(snapshot, _ingest(t, second=True))
    return folded.select(
        "memory_id", "title", F.md5("raw_text").alias("text_hash"), "created_new", _us("first_ingested_at"),
        _us("last_updated_at"),
    )


@query(
    "page_upsert",
    with_tables(
        "accepted",
        """SELECT sha256('chrome:' || canonical_url) AS memory_id,
                  arg_max(CASE WHEN title = '' THEN canonical_url ELSE title END, event_id) AS title,
                  arg_max(content_extract, event_id) FILTER (WHERE NOT app) AS raw_text,
                  epoch_us(arg_min(ts, event_id)) AS created_at FROM accepted GROUP BY canonical_url""",
    ),
)
def page_upsert(t: Tables) -> DataFrame:
    accepted = capture.accepted_visits(t.named_visits).withColumn("seq", F.col("event_id"))
    items, _, _ = capture.visits_to_delta(accepted)
    return t.with_extracts(store.fold_items(None, items), "raw_text").select("memory_id", "title", "raw_text", _us("created_at"))


@query(
    "page_metadata_fold",
    with_tables(
        "accepted",
        """SELECT sha256('chrome:' || canonical_url) AS memory_id, arg_max(url, event_id) AS url,
                  arg_max(domain, event_id) AS domain,
                  arg_max(referrer, event_id) FILTER (WHERE referrer IS NOT NULL) AS referrer,
                  max(scroll_depth) AS scroll_depth, max(interaction_count) AS interaction_count,
                  max(revisit_count) AS revisit_count,
                  arg_max(word_count, event_id) FILTER (WHERE word_count IS NOT NULL) AS word_count
           FROM accepted GROUP BY canonical_url""",
    ),
)
def page_metadata_fold(t: Tables) -> DataFrame:
    accepted = capture.accepted_visits(t.visits).withColumn("seq", F.col("event_id"))
    _, meta, _ = capture.visits_to_delta(accepted)
    return store.fold_page_meta(meta).drop("canonical_url")


@query(
    "page_engagement_fold",
    with_tables(
        "accepted",
        """SELECT sha256('chrome:' || canonical_url) AS memory_id, sum(dwell_seconds)::BIGINT AS dwell_time_seconds,
                  count(*) AS play_sessions_count, epoch_us(max(ts)) AS last_accessed_at
           FROM accepted GROUP BY canonical_url""",
    ),
)
def page_engagement_fold(t: Tables) -> DataFrame:
    accepted = capture.accepted_visits(t.visits).withColumn("seq", F.col("event_id"))
    _, _, engagement = capture.visits_to_delta(accepted)
    return store.fold_engagement(engagement).select(
        "memory_id", "dwell_time_seconds", "play_sessions_count", _us("last_accessed_at")
    )


@query(
    "mail_metadata_fold",
    with_tables(
        "mail_docs",
        """SELECT memory_id, source_id AS email_id, 't' || (doc_id % 50) AS thread_id,
                  CASE WHEN doc_id % 3 = 0 THEN 'moved' WHEN doc_id % 14 = 0 THEN 'SENT,INBOX' ELSE 'INBOX' END AS labels,
                  CASE WHEN doc_id % 3 = 0 THEN false ELSE true END AS has_attachments,
                  CASE WHEN title = '' THEN '(no subject)' ELSE title END AS subject FROM mail_docs""",
    ),
)
def mail_metadata_fold(t: Tables) -> DataFrame:
    stamped = flat_mail(t).withColumn("ingest_ts", F.lit("2024-02-01").cast("timestamp")).withColumn("seq", F.lit(1))
    _, meta, _, _ = capture.mail_to_delta(stamped)
    doc = F.substring("email_id", 2, 20).cast("bigint")
    again = meta.filter(doc % 3 == 0).withColumn("seq", F.lit(2)).withColumn(
        "gmail_labels", F.array(F.lit("moved"))
    ).withColumn("has_attachments", F.lit(None).cast("boolean"))
    return store.fold_mail_meta(meta.unionByName(again)).select(
        "memory_id", "email_id", "thread_id", F.array_join("gmail_labels", ",").alias("labels"),
        "has_attachments", "subject",
    )


@query(
    "video_metadata_fold",
    with_tables(
        "video_events video_docs",
        """SELECT sha256('youtube:' || video_id) AS memory_id, any_value(d.channel_id) AS channel_id,
                  any_value(d.duration_seconds) AS duration_seconds,
                  bool_or(short_url) OR coalesce(any_value(d.duration_seconds) BETWEEN 1 AND 59, false) AS is_short,
                  any_value(d.category) AS youtube_category_id
           FROM (SELECT * FROM video_events WHERE kind = 'detected') e
           FULL JOIN (SELECT source_id AS video_id, 'UC' || source AS channel_id,
                       CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END::INTEGER AS duration_seconds,
                       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 30 END::INTEGER AS category
                      FROM video_docs) d USING (video_id) GROUP BY video_id""".replace(
            "bool_or(short_url) OR", "coalesce(bool_or(short_url), false) OR"
        ),
    ),
)
def video_metadata_fold(t: Tables) -> DataFrame:
    detected = t.video_events.filter("kind = 'detected'").withColumn("seq", F.col("event_id"))
    _, seen, _ = capture.videos_to_delta(detected)
    _, fetched = capture.video_refresh_to_delta(refresh_rows(t))
    return store.fold_video_meta(seen.unionByName(fetched)).select(
        "memory_id", "channel_id", "duration_seconds", "is_short", "youtube_category_id"
    )


def refresh_rows(t: Tables) -> DataFrame:
    """Fetched metadata with transcripts, as the refresh job sees it."""
    from .. import schemas as S
    from ..sources import dumps

    flat = dumps.flatten_video_metadata(dumps.parse_dump(video_dump(t), "payload", S.VIDEO_DUMP))
    spoken = dumps.flatten_captions(caption_dump(t))
    return flat.join(spoken, "video_id", "left").withColumn(
        "ingest_ts", F.lit("2024-03-01").cast("timestamp")
    ).withColumn("seq", F.lit(10**12))


@query(
    "video_refresh",
    with_tables(
        "video_docs",
        r"""SELECT memory_id, title, md5(trim(concat_ws(' ', nullif(text, ''), nullif(spoken, ''),
                  lang || ' ' || source))) AS text_hash
            FROM (SELECT *, CASE WHEN doc_id % 4 = 1 THEN
                    trim(regexp_replace('Tom & ' || text || ' end', '\s+', ' ', 'g'))
                  ELSE array_to_string(list_filter(list_transform(
                    list_filter(string_split(text, ' '), lambda w: w <> ''),
                    lambda w: regexp_replace(w, '^\s+|\s+$', '', 'g')), lambda w: w <> ''), ' ') END AS spoken
                  FROM video_docs)""",
    ),
)
def video_refresh(t: Tables) -> DataFrame:
    items, _ = capture.video_refresh_to_delta(refresh_rows(t))
    return store.fold_items(None, items).select("memory_id", "title", F.md5("raw_text").alias("text_hash"))


@query(
    "engagement_fold",
    with_tables(
        "engagement",
        """SELECT memory_id, dwell_time_seconds, watch_time_seconds, play_sessions_count,
                  epoch_us(first_opened_at) AS first_opened_at, epoch_us(last_accessed_at) AS last_accessed_at,
                  round(completion_rate, 6) AS completion_rate FROM engagement""",
    ),
)
def engagement_fold(t: Tables) -> DataFrame:
    return t.engagement.select(
        "memory_id", "dwell_time_seconds", "watch_time_seconds", "play_sessions_count", _us("first_opened_at"),
        _us("last_accessed_at"), F.round("completion_rate", 6).alias("completion_rate"),
    )


@query(
    "watch_updates",
    with_tables(
        "video_events",
        """SELECT sha256('youtube:' || video_id) AS memory_id, max(watch_time_seconds)::BIGINT AS watch_time_seconds,
                  epoch_us(max(ts)) AS last_accessed_at FROM video_events WHERE kind IN ('heartbeat', 'closed')
           GROUP BY video_id""",
    ),
)
def watch_updates(t: Tables) -> DataFrame:
    return store.fold_engagement(capture.watch_updates(t.video_events)).select(
        "memory_id", "watch_time_seconds", _us("last_accessed_at")
    )


def registry(t: Tables) -> DataFrame:
    """Two versions of the vectors: every third one was indexed again."""
    base = t.read("embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id")).alias("memory_id"), "vec_id",
        F.lit("m1").alias("embedding_version"), F.size("embedding").alias("vector_dimension"),
        F.lit("2024-01-01").cast("timestamp").alias("indexed_at"),
        F.concat(F.lit("text "), F.col("label")).alias("embeddable_text"), "embedding",
    )
    again = base.filter("vec_id % 3 = 0").withColumn("embedding_version", F.lit("m2")).withColumn(
        "indexed_at", F.lit("2024-02-01").cast("timestamp")
    ).withColumn("embeddable_text", F.lit("new text"))
    return base.unionByName(again)


@query(
    "embedding_registry",
    """SELECT 'v' || vec_id AS memory_id, CASE WHEN vec_id % 3 = 0 THEN 'm2' ELSE 'm1' END AS embedding_version,
              len(embedding)::INTEGER AS vector_dimension,
              CASE WHEN vec_id % 3 = 0 THEN 'new text' ELSE 'text ' || label END AS embeddable_text,
              true AS is_active FROM embeddings""",
)
def embedding_registry(t: Tables) -> DataFrame:
    return store.fold_embeddings(registry(t)).select(
        "memory_id", "embedding_version", "vector_dimension", "embeddable_text", "is_active"
    )


@query(
    "stale_embeddings",
    "SELECT 'v' || vec_id AS memory_id FROM embeddings WHERE vec_id % 3 <> 0",
)
def stale_embeddings(t: Tables) -> DataFrame:
    return store.stale_embeddings(store.fold_embeddings(registry(t)), "m2").select("memory_id")


@query(
    "placeholder_registry",
    with_tables(
        "mail_docs",
        r"""SELECT memory_id, greatest(1, least(1536, len(list_filter(string_split_regex(text, '\s+'),
                  lambda w: w <> ''))))::INTEGER AS vector_dimension FROM mail_docs""",
    ),
)
def placeholder_registry(t: Tables) -> DataFrame:
    return store.placeholder_registry(t.mail_docs, "text").select("memory_id", "vector_dimension")


@query(
    "pending_items",
    with_tables("items", "SELECT memory_id, source_type FROM items WHERE NOT preprocessed"),
)
def pending_items(t: Tables) -> DataFrame:
    return store.pending_items(t.items).select("memory_id", "source_type")


@query(
    "live_attachments",
    with_tables(
        "mail_docs", "SELECT memory_id FROM mail_docs WHERE doc_id % 3 <> 0 AND doc_id % 4 = 0"
    ),
)
def live_attachments(t: Tables) -> DataFrame:
    children = t.mail_docs.filter("doc_id % 3 <> 0").select("memory_id")
    return store.live_children(children, t.mail_docs.filter("doc_id % 4 = 0"))


# --- views ---------------------------------------------------------------------
@query(
    "wide_items",
    with_tables(
        "items engagement page_meta mail_meta video_meta",
        """SELECT i.memory_id, i.source_type, i.title, e.dwell_time_seconds, round(e.completion_rate, 6) AS completion_rate,
                  p.canonical_url, m.thread_id, m.has_attachments, v.video_id, v.duration_seconds
           FROM items i JOIN engagement e USING (memory_id) LEFT JOIN page_meta p USING (memory_id)
           LEFT JOIN mail_meta m USING (memory_id) LEFT JOIN video_meta v USING (memory_id)""",
    ),
)
def wide_items(t: Tables) -> DataFrame:
    return t.wide.select(
        "memory_id", "source_type", "title", "dwell_time_seconds",
        F.round("completion_rate", 6).alias("completion_rate"), "canonical_url", "thread_id", "has_attachments",
        "video_id", "duration_seconds",
    )


@query(
    "thread_history",
    with_tables(
        "mail_meta mail_docs",
        """SELECT thread_id, d.memory_id, epoch_us(received_at) AS received_at, sender
           FROM mail_meta m JOIN mail_docs d USING (memory_id)""",
    ),
)
def thread_history(t: Tables) -> DataFrame:
    return views.thread_history(t.items, t.mail_meta).select(
        "thread_id", "memory_id", _us("received_at"), "sender"
    )


@query(
    "store_reconciliation",
    with_tables(
        "mail_docs",
        """SELECT CASE WHEN doc_id % 3 = 0 AND doc_id % 4 = 0 THEN 'both' WHEN doc_id % 3 = 0 THEN 'old_only'
                       ELSE 'new_only' END AS presence, count(*) AS keys
           FROM mail_docs WHERE doc_id % 3 = 0 OR doc_id % 4 = 0 GROUP BY 1""",
    ),
)
def store_reconciliation(t: Tables) -> DataFrame:
    docs = t.mail_docs
    return views.reconcile(docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 4 = 0"), "source_id")


@query(
    "duplicate_keys",
    """SELECT md5(text) AS text_hash, count(*) AS rows FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_keys(t: Tables) -> DataFrame:
    return checks.duplicate_keys(t.documents.select(F.md5("text").alias("text_hash")), ["text_hash"])


@query(
    "engagement_gaps",
    with_tables(
        "items partials",
        """SELECT memory_id, 'no_engagement' AS problem FROM items ANTI JOIN
           (SELECT memory_id FROM partials WHERE plays > 0) USING (memory_id)""",
    ),
)
def engagement_gaps(t: Tables) -> DataFrame:
    clicked = t.partials.filter("play_sessions_count > 0")
    return checks.one_to_one_gaps(t.items, store.fold_engagement(clicked))


# --- sessions and toggles --------------------------------------------------------
_SESSIONS = """
    SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no,
           CASE WHEN opens = 0 AND event_type <> before THEN 1 ELSE 0 END AS switched
    FROM (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000, true) THEN 1 ELSE 0 END
                 AS opens, lag(event_type) OVER w AS before
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
_SUMMARY = """
    SELECT user_id, session_no, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) AS session_end,
           sum(switched) AS source_switch_count, count(*) AS events FROM numbered GROUP BY ALL"""


def numbered_events(t: Tables) -> DataFrame:
    return sessions.sessionize(t.events, ["user_id"], "ts", "event_id", 6 * 3600, switch="event_type")


@query(
    "session_numbers",
    f"""WITH numbered AS ({_SESSIONS}) SELECT event_id, session_no::BIGINT AS session_no, switched = 1 AS is_switch
        FROM numbered""",
)
def session_numbers(t: Tables) -> DataFrame:
    return numbered_events(t).select("event_id", F.col("session_no").cast("bigint").alias("session_no"), "is_switch")


@query(
    "session_summary",
    f"""WITH numbered AS ({_SESSIONS}), summary AS ({_SUMMARY}),
        counts AS (SELECT user_id, session_no, event_type, count(*) AS n FROM numbered GROUP BY ALL),
        top AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_no ORDER BY n DESC, event_type) AS r FROM counts)
        SELECT s.user_id, s.session_no::BIGINT AS session_no, session_start, session_end,
               source_switch_count::BIGINT AS source_switch_count, events, top.event_type AS dominant_group
        FROM summary s JOIN top USING (user_id, session_no) WHERE r = 1""",
)
def session_summary(t: Tables) -> DataFrame:
    out = sessions.summarize_sessions(numbered_events(t), ["user_id"], "ts", "event_type")
    return out.select(
        "user_id", F.col("session_no").cast("bigint").alias("session_no"), _us("session_start"), _us("session_end"),
        "source_switch_count", "events", "dominant_group",
    )


@query(
    "session_items",
    f"""WITH numbered AS ({_SESSIONS}) SELECT DISTINCT user_id, session_no::BIGINT AS session_no,
        event_type AS item FROM numbered""",
)
def session_items(t: Tables) -> DataFrame:
    return sessions.session_items(numbered_events(t), ["user_id"], "event_type").select(
        "user_id", F.col("session_no").cast("bigint").alias("session_no"), F.col("event_type").alias("item")
    )


@query(
    "session_numbers_hot_keys",
    """SELECT event_id, sum(opens) OVER (PARTITION BY k ORDER BY ts, event_id)::BIGINT AS session_no
       FROM (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 300000000, true) THEN 1 ELSE 0 END
             AS opens FROM (SELECT *, user_id % 4 AS k FROM events) WINDOW w AS (PARTITION BY k ORDER BY ts, event_id))""",
)
def session_numbers_hot_keys(t: Tables) -> DataFrame:
    keyed = t.events.withColumn("k", F.col("user_id") % 4)
    return sessions.sessionize(keyed, ["k"], "ts", "event_id").select(
        "event_id", F.col("session_no").cast("bigint").alias("session_no")
    )


@query(
    "time_patterns",
    f"""WITH numbered AS ({_SESSIONS}), summary AS ({_SUMMARY}),
        counts AS (SELECT user_id, session_no, event_type, count(*) AS n FROM numbered GROUP BY ALL),
        top AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_no ORDER BY n DESC, event_type) AS r FROM counts)
        SELECT strftime(make_timestamp(session_start), '%Y-%m-%d') AS day, event_type AS dominant_group,
               sum(session_end // 1000000 - session_start // 1000000)::BIGINT AS total_seconds, count(*) AS sessions
        FROM summary JOIN top USING (user_id, session_no) WHERE r = 1 GROUP BY 1, 2""",
)
def time_patterns(t: Tables) -> DataFrame:
    summary = sessions.summarize_sessions(numbered_events(t), ["user_id"], "ts", "event_type")
    return sessions.time_patterns(summary, "day", "dominant_group").withColumn("day", F.col("day").cast("string"))


@query(
    "time_pattern_totals",
    f"""WITH numbered AS ({_SESSIONS}), summary AS ({_SUMMARY}),
        counts AS (SELECT user_id, session_no, event_type, count(*) AS n FROM numbered GROUP BY ALL),
        top AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_no ORDER BY n DESC, event_type) AS r FROM counts),
        named AS (SELECT make_timestamp(session_start) AS at_time, event_type AS dominant_group,
          session_end // 1000000 - session_start // 1000000 AS seconds FROM summary JOIN top USING (user_id, session_no) WHERE r = 1)
        SELECT 'hour' AS grain, hour(at_time)::INTEGER AS bucket, dominant_group, sum(seconds)::BIGINT AS total_seconds,
               count(*) AS sessions FROM named GROUP BY ROLLUP (hour(at_time)::INTEGER, dominant_group)
        UNION ALL
        SELECT 'weekday', (isodow(at_time) - 1)::INTEGER AS bucket, dominant_group, sum(seconds)::BIGINT, count(*)
        FROM named GROUP BY ROLLUP ((isodow(at_time) - 1)::INTEGER, dominant_group)""",
)
def time_pattern_totals(t: Tables) -> DataFrame:
    """Hours and weekdays with their roll-up rows."""
    summary = sessions.summarize_sessions(numbered_events(t), ["user_id"], "ts", "event_type")

    def of(grain: str) -> DataFrame:
        rows = sessions.time_patterns(summary, grain, "dominant_group", totals=True)
        return rows.withColumnRenamed(grain, "bucket").withColumn("grain", F.lit(grain))

    return of("hour").unionByName(of("weekday"))


@query(
    "regret_state",
    """SELECT user_id, count(*) % 2 = 1 AS is_marked, count(*) AS toggles FROM events WHERE event_type = 'error'
       GROUP BY user_id""",
)
def regret_state(t: Tables) -> DataFrame:
    return sessions.toggle_state(t.events.filter("event_type = 'error'"), "user_id")


@query(
    "regret_patterns",
    """SELECT hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS weekday, count(*) AS toggles FROM events
       WHERE event_type = 'error' GROUP BY 1, 2""",
)
def regret_patterns(t: Tables) -> DataFrame:
    return sessions.toggle_patterns(t.events.filter("event_type = 'error'"), "ts")


# --- messages -----------------------------------------------------------------------
def message_log(t: Tables) -> DataFrame:
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    at = F.timestamp_micros(start + (F.col("conv_id") * 3600 + F.col("turn")) * 1_000_000)
    return t.read("conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"),
        messages.message_json(F.col("role"), F.col("text"), at).alias("message"), at.alias("created_at"),
    )


@query(
    "message_counts",
    "SELECT conv_id::VARCHAR AS session_id, count(*) AS messages FROM conversations GROUP BY 1",
)
def message_counts(t: Tables) -> DataFrame:
    return messages.message_counts(message_log(t))


@query(
    "message_scan",
    "SELECT turn AS seq, role, text AS content FROM conversations WHERE conv_id = 7",
)
def message_scan(t: Tables) -> DataFrame:
    scanned = messages.session_messages(message_log(t), "7")
    return messages.parse_messages(scanned).select("seq", "role", "content")


@query(
    "message_history",
    """SELECT conv_id::VARCHAR AS session_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END
              || text, chr(10) ORDER BY turn) AS history
       FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
       WHERE r <= 3 GROUP BY conv_id""",
)
def message_history(t: Tables) -> DataFrame:
    return messages.history_text(messages.parse_messages(message_log(t)), n=3)


@query(
    "message_retention",
    """SELECT conv_id::VARCHAR AS session_id, count(*) AS kept FROM conversations
       WHERE conv_id * 3600 + turn >= 40 * 3600 GROUP BY 1""",
)
def message_retention(t: Tables) -> DataFrame:
    now = F.lit("2024-01-31 16:00:00").cast("timestamp")
    return messages.retain_messages(message_log(t), now, 29).groupBy("session_id").agg(F.count("*").alias("kept"))


@query(
    "message_expiry_count",
    "SELECT count(*) FILTER (WHERE conv_id * 3600 + turn < 40 * 3600) AS deleted FROM conversations",
)
def message_expiry_count(t: Tables) -> DataFrame:
    return messages.expired_count(message_log(t), F.lit("2024-01-31 16:00:00").cast("timestamp"), 29)


@query(
    "session_deletion",
    """SELECT conv_id::VARCHAR AS session_id, CASE WHEN conv_id % 50 = 0 THEN 0 ELSE count(*) END AS kept,
              CASE WHEN conv_id % 50 = 0 THEN count(*) ELSE 0 END AS deleted FROM conversations GROUP BY conv_id""",
)
def session_deletion(t: Tables) -> DataFrame:
    """Every fiftieth session deleted: what stays of each session and what went."""
    log = message_log(t)
    named = t.read("conversations").filter("conv_id % 50 = 0").select(F.col("conv_id").cast("string").alias("session_id"))
    kept, deleted = messages.delete_sessions(log, named)
    counts = messages.message_counts(kept).withColumnRenamed("messages", "kept")
    return counts.join(deleted, "session_id", "full").select(
        "session_id", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("deleted", F.lit(0)).alias("deleted")
    )


@query(
    "message_append",
    """SELECT conv_id::VARCHAR AS session_id, part, role, text AS content FROM (
         SELECT u.conv_id, u.turn, 0 AS part, u.role, u.text FROM conversations u JOIN conversations a
           ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'
         UNION ALL
         SELECT a.conv_id, a.turn, 1, a.role, a.text FROM conversations u JOIN conversations a
           ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')""",
)
def message_append(t: Tables) -> DataFrame:
    talk = t.read("conversations")
    asked = talk.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("user_query"))
    said = talk.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("assistant_answer"))
    turns = asked.join(said, ["conv_id", "turn"]).select(
        F.col("conv_id").cast("string").alias("session_id"), "user_query", "assistant_answer",
        F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )
    return messages.parse_messages(messages.turns_to_messages(turns)).select("session_id", "part", "role", "content")


# --- user groups ----------------------------------------------------------------------
def rules(t: Tables) -> DataFrame:
    """One rule per source (channel), per host, per sender host, three hour windows, per language."""
    docs = t.documents.select("source", "lang").distinct()

    def shaped(df: DataFrame, kind: str, value) -> DataFrame:
        return df.select(
            F.concat(F.lit(kind + ":"), value).alias("rule_id"), F.lit("g" + kind[:2]).alias("group_id"),
            F.lit(kind).alias("rule_type"), value.alias("rule_value"),
        )

    sources = docs.select("source").distinct()
    hours = t.events.select((F.hour("ts") % 3 * 7).alias("h")).distinct()
    out = (
        shaped(sources, "channel", F.concat(F.lit("UC"), F.col("source")))
        .unionByName(shaped(sources, "sender", F.concat(F.col("source"), F.lit(".Example.com"))))
        .unionByName(shaped(t.pages.select("domain").distinct(), "domain", F.col("domain")))
        .unionByName(shaped(hours, "time_window", F.concat(F.col("h"), F.lit("-"), F.col("h") + 2)))
        .unionByName(shaped(docs.select("lang").distinct(), "keyword", F.upper("lang")))
    )
    return out.withColumn("is_active", ~F.col("rule_value").isin("UCsrc3", "de", "DE")).withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp")
    )


_RULE_MATCHES = """
    SELECT memory_id, 'channel:' || channel_id AS rule_id, 'gch' AS group_id FROM video_meta WHERE channel_id <> 'UCsrc3'
    UNION SELECT m.memory_id, 'sender:' || d.source || '.Example.com', 'gse' FROM mail_meta m
      JOIN mail_docs d USING (memory_id) WHERE m.sender LIKE 'x@%'
    UNION SELECT memory_id, 'domain:' || domain, 'gdo' FROM page_meta
    UNION SELECT memory_id, 'time_window:' || h || '-' || (h + 2), 'gti' FROM items JOIN
      (SELECT DISTINCT hour(ts) % 3 * 7 AS h FROM events) ON hour(created_at) >= h AND hour(created_at) < h + 2
    UNION SELECT memory_id, 'keyword:' || upper(lang), 'gke' FROM items JOIN (SELECT DISTINCT lang FROM documents)
      ON lang <> 'de' AND (contains(lower(title), lang)
         OR len(list_filter(auto_keywords, lambda k: contains(lower(k), lang))) > 0)"""


def rule_matches(t: Tables) -> DataFrame:
    subject = (
        t.items.select("memory_id", "title", "auto_keywords", "created_at")
        .join(t.mail_meta.select("memory_id", "sender"), "memory_id", "left")
        .join(t.page_meta.select("memory_id", "domain"), "memory_id", "left")
        .join(t.video_meta.select("memory_id", "channel_id", "channel_name"), "memory_id", "left")
    )
    return groups.match_rules(subject, rules(t))


@query(
    "rule_matches",
    with_tables(
        "items mail_meta page_meta video_meta mail_docs",
        "SELECT memory_id, rule_id, group_id FROM matches", matches=_RULE_MATCHES,
    ),
)
def rule_matches_query(t: Tables) -> DataFrame:
    return rule_matches(t)


@query(
    "rule_match_counts",
    with_tables(
        "items mail_meta page_meta video_meta mail_docs",
        """SELECT rule_id, count(memory_id) AS match_count FROM (SELECT rule_id FROM all_rules) LEFT JOIN matches
           USING (rule_id) GROUP BY rule_id""",
        matches=_RULE_MATCHES,
        all_rules="""SELECT DISTINCT 'channel:UC' || source AS rule_id FROM documents
            UNION SELECT 'sender:' || source || '.Example.com' FROM documents
            UNION SELECT 'domain:' || domain FROM page_meta
            UNION SELECT 'time_window:' || (hour(ts) % 3 * 7) || '-' || (hour(ts) % 3 * 7 + 2) FROM events
            UNION SELECT 'keyword:' || upper(lang) FROM documents""",
    ),
)
def rule_match_counts(t: Tables) -> DataFrame:
    return groups.rule_match_counts(rules(t), rule_matches(t)).select("rule_id", "match_count")


@query(
    "dead_rules",
    with_tables(
        "items mail_meta page_meta video_meta mail_docs",
        """SELECT rule_id FROM (SELECT DISTINCT 'channel:UC' || source AS rule_id FROM documents
             UNION SELECT 'sender:' || source || '.Example.com' FROM documents
             UNION SELECT 'domain:' || domain FROM page_meta
             UNION SELECT 'time_window:' || (hour(ts) % 3 * 7) || '-' || (hour(ts) % 3 * 7 + 2) FROM events
             UNION SELECT 'keyword:' || upper(lang) FROM documents) ANTI JOIN matches USING (rule_id)""",
        matches=_RULE_MATCHES,
    ),
)
def dead_rules(t: Tables) -> DataFrame:
    counted = groups.rule_match_counts(rules(t), rule_matches(t))
    return groups.dead_rules(counted, F.lit("2024-03-01").cast("timestamp")).select("rule_id")


def decisions(t: Tables) -> DataFrame:
    """Suggestions with decisions made for some of them."""
    pending = groups.suggest(rule_matches(t))
    bucket = F.conv(F.substring("memory_id", 1, 4), 16, 10).cast("int") % 3
    return pending.withColumn(
        "decision", F.when(bucket == 0, "accepted").when(bucket == 1, "rejected").otherwise(F.col("decision"))
    ).withColumn("reviewed", bucket < 2)


_BUCKET = "('0x' || substring(memory_id, 1, 4))::INTEGER % 3"


@query(
    "accepted_groups",
    with_tables(
        "items mail_meta page_meta video_meta mail_docs",
        f"SELECT DISTINCT memory_id, group_id FROM matches WHERE {_BUCKET} = 0", matches=_RULE_MATCHES,
    ),
)
def accepted_groups(t: Tables) -> DataFrame:
    return groups.accepted_groups(decisions(t))


@query(
    "review_queue",
    with_tables(
        "items mail_meta page_meta video_meta mail_docs",
        f"""SELECT memory_id, group_id, count(*) AS rules FROM matches WHERE {_BUCKET} = 2
            GROUP BY memory_id, group_id""",
        matches=_RULE_MATCHES,
    ),
)
def review_queue(t: Tables) -> DataFrame:
    return groups.review_queue(decisions(t)).select("memory_id", "group_id", "rules")


@query(
    "placeholder_words",
    r"""SELECT page_id, len(list_filter(string_split_regex(url, '\s+'), lambda w: w <> ''))::INTEGER AS words
        FROM pages""",
)
def placeholder_words(t: Tables) -> DataFrame:
    from ..functions.times import word_count

    return t.pages.select("page_id", word_count(F.col("url")).alias("words"))


_SEEDED = """
  SELECT 'no_table' AS problem, 'page_meta' AS table_name, NULL AS column_name, NULL AS expected, NULL AS found
  UNION ALL SELECT 'no_column', 'items', 'auto_keywords', 'array<string>', NULL
  UNION ALL SELECT 'other_type', 'engagement', 'watch_time_seconds', 'bigint', 'string'
  UNION ALL SELECT 'no_group', 'groups', 'personal', '4', NULL"""


@query(
    "catalog_checks",
    with_tables(
        "items",
        f"""{_SEEDED}
            UNION ALL SELECT 'repeated_key', 'items', source_type, source_id, count(*)::VARCHAR FROM stored GROUP BY source_type, source_id HAVING count(*) > 1
            UNION ALL SELECT 'null_key', 'items', memory_id, NULL, NULL FROM stored WHERE group_id IS NULL""",
        stored="""SELECT memory_id, source_type, source_id, CASE WHEN length(title) % 9 <> 3 THEN 5 END AS group_id FROM items
                  UNION ALL SELECT memory_id, source_type, source_id, 5 FROM items WHERE is_deleted""",
    ),
)
def catalog_checks(t: Tables) -> DataFrame:
    """The model against the session catalog: a table, a column, a type and a seed row are wrong, and keys repeat or are null."""
    prefix = f"checked_{uuid.uuid4().hex}_"
    items = t.items.withColumn("system_group_id", F.when(F.length("title") % 9 != 3, F.col("system_group_id")))
    stored = items.unionByName(t.items.filter("is_deleted"))
    views_of = {
        "items": stored.drop("auto_keywords"), "mail_meta": t.mail_meta, "video_meta": t.video_meta,
        "engagement": store.fold_engagement(t.partials).withColumn("watch_time_seconds", F.col("watch_time_seconds").cast("string")),
    }
    for name, df in views_of.items():
        df.createOrReplaceTempView(prefix + name)
    try:
        found = checks.catalog_columns(t.spark, prefix)
    finally:
        for name in views_of:
            t.spark.catalog.dropTempView(prefix + name)
    model = {"items": S.ITEMS, "mail_meta": S.MAIL_META, "video_meta": S.VIDEO_META, "page_meta": S.PAGE_META, "engagement": S.ENGAGEMENT}
    gaps = checks.schema_gaps(found, checks.model_columns(t.spark, model))
    groups_there = dimensions.groups(t.spark).filter("group_name <> 'personal'")
    shaped = lambda df, problem, table, column, expected, seen: df.select(
        F.lit(problem).alias("problem"), F.lit(table).alias("table_name"), column.cast("string").alias("column_name"),
        expected.cast("string").alias("expected"), seen.cast("string").alias("found"),
    )
    none = F.lit(None)
    return (
        gaps.unionByName(shaped(checks.missing_groups(groups_there), "no_group", "groups", F.col("group_name"), F.col("system_group_id"), none))
        .unionByName(shaped(checks.duplicate_keys(stored, ["source_type", "source_id"]), "repeated_key", "items", F.col("source_type"), F.col("source_id"), F.col("rows")))
        .unionByName(shaped(checks.null_keys(stored, "system_group_id"), "null_key", "items", F.col("memory_id"), none, none))
    )


@query(
    "flat_values",
    """SELECT doc_id, concat_ws(' ', coalesce(lang, ''), coalesce(source, '') || ' ' || coalesce(text, ''), coalesce(n_chars::VARCHAR, ''))
         AS flat FROM documents""",
)
def flat_values(t: Tables) -> DataFrame:
    """Nested values of known types as text: a struct with a list and a map."""
    nested = t.documents.select(
        "doc_id", F.struct("lang", F.array("source", "text").alias("said"), F.create_map(F.lit("n"), F.col("n_chars")).alias("counted")).alias("value")
    )
    return nested.select("doc_id", text.flatten_text(F.col("value"), nested.schema["value"].dataType).alias("flat"))


@query(
    "bucket_merge",
    with_tables(
        "mail_docs",
        """SELECT memory_id, coalesce(arg_max(title, seq) FILTER (WHERE title <> ''), '') AS title,
                  md5(arg_max(raw_text, seq) FILTER (WHERE raw_text IS NOT NULL)) AS text_hash FROM ingest GROUP BY memory_id""",
        ingest=_INGEST,
    ),
)
def bucket_merge(t: Tables) -> DataFrame:
    """Two ingests through the store's files; the second rewrites the buckets of its keys, and is repeated once."""
    from ..operators import bucket_store
    from ..streaming.item_log import fold_deltas
    from ..streaming.jobs import work_folder

    folder = work_folder(t.spark, "items")
    second = _ingest(t, second=True)
    for number, delta in enumerate([_ingest(t, second=False), second, second]):
        bucket_store.merge(folder, delta, fold_deltas, number, buckets=32)
    return bucket_store.read(t.spark, folder).select("memory_id", "title", F.md5("raw_text").alias("text_hash"))
