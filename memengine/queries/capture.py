"""Sources, gates, dumps, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import gates, times, urls
from ..functions import text as X
from ..operators import capture, store
from ..sources import dimensions, dumps, readers
from ..streaming.jobs import work_folder, write_files
from . import query
from .tables import Tables, with_tables


def _us(column: str):
    return F.unix_micros(F.col(column))


@query("canonical_urls", with_tables("pg", "SELECT page_id, canonical_url, domain FROM pg"))
def canonical_urls(t: Tables) -> DataFrame:
    return t.pages.select("page_id", "canonical_url", "domain")


@query("visit_outcomes", with_tables("judged", "SELECT event_id, canonical_url, outcome FROM judged"))
def visit_outcomes(t: Tables) -> DataFrame:
    return capture.classify_visits(t.visits).select("event_id", "canonical_url", "outcome")


@query(
    "visit_validation",
    with_tables(
        "visits",
        """SELECT CASE WHEN dwell_seconds - 2 >= 0 AND scroll_depth * 2.5 BETWEEN 0 AND 1 THEN 'valid'
                       ELSE 'out_of_bounds' END AS reason, count(*) AS visits FROM visits GROUP BY 1""",
    ),
)
def visit_validation(t: Tables) -> DataFrame:
    shifted = t.visits.withColumns(
        {"dwell_seconds": F.col("dwell_seconds") - 2, "scroll_depth": F.col("scroll_depth") * 2.5}
    )
    good, bad = readers.split_visits(shifted)
    both = good.select(F.lit("valid").alias("reason")).unionByName(bad.select("reason"))
    return both.groupBy("reason").agg(F.count("*").alias("visits"))


@query(
    "recorded_visits",
    with_tables(
        "visits",
        """SELECT event_id FROM visits WHERE event_id % 19 <> 0
           AND NOT contains(url, 'github.com/issues') AND NOT contains(url, 'github.com/pulls')
           AND NOT starts_with(url, 'https://www.youtube.com/')""",
    ),
)
def recorded_visits(t: Tables) -> DataFrame:
    marked = t.visits.withColumn("private_mode", F.col("event_id") % 19 == 0)
    return readers.recorded_visits(marked).select("event_id")


@query(
    "app_page_gate",
    with_tables(
        "visits",
        """SELECT event_id, app AND (dwell_seconds >= 5 OR interaction_count >= 1) AS keep
           FROM visits WHERE app""",
    ),
)
def app_page_gate(t: Tables) -> DataFrame:
    apps = t.visits.filter(urls.is_app_page(F.col("domain")))
    return apps.select(
        "event_id", gates.app_page_gate(F.col("dwell_seconds"), F.col("interaction_count")).alias("keep")
    )


@query(
    "revisit_marks",
    """SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type
       ORDER BY ts, event_id)) < 86400000000, false) AS is_revisit FROM events""",
)
def revisit_marks(t: Tables) -> DataFrame:
    return capture.mark_revisits(t.events, ["user_id", "event_type"], "ts", "event_id").select(
        "event_id", "is_revisit"
    )


@query(
    "video_gate",
    with_tables(
        "video_events",
        """SELECT video_id, event_id, watch_time_seconds >= 20 OR (by_hand AND interaction_type IS NOT NULL)
                  OR is_revisit AS keep
           FROM (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY video_id
                 ORDER BY ts, event_id)) < 86400000000, false) AS is_revisit
                 FROM video_events WHERE kind = 'detected')""",
    ),
)
def video_gate(t: Tables) -> DataFrame:
    detected = t.video_events.filter("kind = 'detected'")
    marked = capture.mark_revisits(detected, ["video_id"], "timestamp", "event_id")
    keep = gates.video_gate(
        F.col("watch_time_seconds"), F.col("triggered_by"), F.col("interaction_type"), F.col("is_revisit")
    )
    return marked.select("video_id", "event_id", keep.alias("keep"))


@query(
    "video_addresses",
    with_tables(
        "video_events",
        """SELECT event_id, video_id, short_url OR watch_time_seconds < 60 AS is_short, true AS is_video,
                  substring(sha256(video_id), 1, 16) AS key_hash FROM video_events""",
    ),
)
def video_addresses(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.video_events.select(
        "event_id",
        urls.video_id(url).alias("video_id"),
        urls.is_short(url, F.col("watch_time_seconds")).alias("is_short"),
        urls.is_video_url(url).alias("is_video"),
        urls.key_hash(F.col("video_id")).alias("key_hash"),
    )


@query(
    "video_event_union",
    with_tables(
        "video_events",
        """SELECT kind, count(*) AS events, count(interaction_type) AS with_interaction,
                  sum(watch_time_seconds)::BIGINT AS watched FROM video_events GROUP BY kind""",
    ),
)
def video_event_union(t: Tables) -> DataFrame:
    kinds = {k: t.video_events.filter(F.col("kind") == k).drop("kind") for k in ("detected", "heartbeat", "closed")}
    merged = readers.merge_video_events(
        kinds["detected"],
        kinds["heartbeat"].select("event_id", "video_id", "watch_time_seconds", "timestamp"),
        kinds["closed"].select(
            "event_id", "video_id", F.col("watch_time_seconds").alias("final_watch_time_seconds"), "timestamp"
        ),
    ).withColumn(
        "interaction_type",
        F.when(F.col("kind") == "detected", F.col("interaction_type")).otherwise(
            F.when(F.col("event_id") % 4 == 0, "pause")
        ),
    )
    return merged.groupBy("kind").agg(
        F.count("*").alias("events"), F.count("interaction_type").alias("with_interaction"),
        F.sum("watch_time_seconds").alias("watched"),
    )


def mail_dump(t: Tables) -> DataFrame:
    """Mail documents written as JSON messages: every third without parts, the rest multipart."""
    data = F.translate(F.base64(F.encode("text", "UTF-8")), "+/", "-_")
    body = F.struct(data.alias("data"))
    none = F.struct(F.lit(None).cast("string").alias("data"))

    def header(name: str, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    def part(mime, filename, size, content):
        return F.struct(
            mime.alias("mimeType"), filename.alias("filename"), size.cast("int").alias("size"), content.alias("body")
        )

    null = F.lit(None).cast("string")
    parts = F.array(
        part(F.lit("text/html"), F.lit(""), F.lit(0), none),
        part(F.lit("text/plain"), F.lit(""), F.lit(0), body),
        part(null, F.concat(F.lit("f"), F.col("doc_id"), F.lit(".pdf")), F.col("n_chars"), none),
        part(F.lit("image/png"), F.lit("  "), F.lit(3), none),
    )
    single = F.col("doc_id") % 3 == 0
    date = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    headers = F.array(
        header("Subject", F.lit("old")),
        header("From", F.concat(F.lit("x@"), F.col("source"), F.lit(".example.com"))),
        header("To", F.when(F.col("doc_id") % 4 == 0, "").otherwise("me@example.com")),
        header("Date", date),
        header("Subject", F.col("title")),
    )
    payload = F.struct(
        headers.alias("headers"),
        F.when(single, body).otherwise(none).alias("body"),
        F.when(single, F.array().cast(parts_type())).otherwise(parts).alias("parts"),
    )
    message = F.struct(
        F.col("source_id").alias("id"),
        F.concat(F.lit("t"), F.col("doc_id") % 50).alias("threadId"),
        F.when(F.col("doc_id") % 14 == 0, F.array(F.lit("SENT"), F.lit("INBOX"))).otherwise(
            F.array(F.lit("INBOX"))
        ).alias("labelIds"),
        payload.alias("payload"),
    )
    return t.mail_docs.select("doc_id", F.to_json(message).alias("payload"))


def parts_type() -> str:
    return "array<struct<mimeType:string,filename:string,size:int,body:struct<data:string>>>"


def flat_mail(t: Tables) -> DataFrame:
    return dumps.flatten_mail(dumps.parse_dump(mail_dump(t), "payload", S.MAIL_DUMP))


@query(
    "mail_flatten",
    with_tables(
        "mail_docs",
        """SELECT source_id AS email_id, 't' || (doc_id % 50) AS thread_id, title AS subject,
                  'x@' || source || '.example.com' AS sender,
                  CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'me@example.com' END AS recipients,
                  md5(text) AS body_hash, doc_id % 14 = 0 AS is_sent, doc_id % 3 <> 0 AS has_attachments,
                  epoch_us(created_at) AS sent_us FROM mail_docs""",
    ),
)
def mail_flatten(t: Tables) -> DataFrame:
    return flat_mail(t).select(
        "email_id", "thread_id", "subject", "sender", F.array_join("recipients", ",").alias("recipients"),
        F.md5("body").alias("body_hash"), "is_sent", "has_attachments",
        F.unix_micros(times.tolerant_timestamp(F.col("date"), F.lit(None).cast("timestamp"))).alias("sent_us"),
    )


@query(
    "mail_attachments",
    with_tables(
        "mail_docs",
        """SELECT memory_id, 'f' || doc_id || '.pdf' AS filename, 'application/octet-stream' AS mime_type,
                  n_chars::INTEGER AS file_size,
                  concat_ws(' | ', 'f' || doc_id || '.pdf', 'application/octet-stream',
                            nullif(n_chars::VARCHAR, '0')) AS lightweight_extract
           FROM mail_docs WHERE doc_id % 3 <> 0""",
    ),
)
def mail_attachments(t: Tables) -> DataFrame:
    stamped = flat_mail(t).withColumn("ingest_ts", F.lit("2024-02-01").cast("timestamp")).withColumn("seq", F.lit(1))
    *_, attachments = capture.mail_to_delta(stamped)
    return attachments.drop("is_processed")


@query(
    "mail_export",
    with_tables(
        "mail_docs",
        """SELECT memory_id, title AS subject, 'x@' || source || '.example.com' AS sender,
                  strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS received_time,
                  CASE WHEN doc_id % 14 = 0 THEN 'SENT,INBOX' ELSE 'INBOX' END AS labels,
                  substring(text, 1, 500) AS body FROM mail_docs""",
    ),
)
def mail_export(t: Tables) -> DataFrame:
    keyed = flat_mail(t).withColumn("memory_id", capture.memory_key(F.lit("gmail"), F.col("email_id")))
    return store.mail_export(keyed)


@query(
    "new_mail",
    with_tables("mail_docs", "SELECT source_id AS email_id FROM mail_docs WHERE doc_id % 3 <> 0"),
)
def new_mail(t: Tables) -> DataFrame:
    known = t.mail_docs.filter("doc_id % 3 = 0").select(F.col("source_id").alias("email_id"))
    return store.new_mail(flat_mail(t).select("email_id"), known)


def video_dump(t: Tables) -> DataFrame:
    seconds = F.col("n_chars")
    duration = F.concat(
        F.lit("PT"),
        F.floor(seconds / 3600), F.lit("H"), F.floor(seconds % 3600 / 60), F.lit("M"), seconds % 60, F.lit("S"),
    )
    snippet = F.struct(
        F.col("title"), F.col("text").alias("description"),
        F.concat(F.lit("Channel "), F.col("source")).alias("channelTitle"),
        F.concat(F.lit("UC"), F.col("source")).alias("channelId"),
        F.lit("2024-01-01T00:00:00Z").alias("publishedAt"),
        F.when(F.col("doc_id") % 5 == 0, "none").otherwise((F.col("doc_id") % 30).cast("string")).alias("categoryId"),
        F.array("lang", "source").alias("tags"),
    )
    dump = F.struct(
        F.col("source_id").alias("id"), snippet.alias("snippet"),
        F.struct(
            F.when(F.col("doc_id") % 7 == 0, "soon").otherwise(duration).alias("duration")
        ).alias("contentDetails"),
    )
    return t.video_docs.select("doc_id", F.to_json(dump).alias("payload"))


@query(
    "video_metadata",
    with_tables(
        "video_docs",
        """SELECT source_id AS video_id, title, md5(text) AS description_hash,
                  'UC' || source AS channel_id,
                  CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END::INTEGER AS duration_seconds,
                  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 30 END::INTEGER AS category,
                  lang || ',' || source AS tags FROM video_docs""",
    ),
)
def video_metadata(t: Tables) -> DataFrame:
    flat = dumps.flatten_video_metadata(dumps.parse_dump(video_dump(t), "payload", S.VIDEO_DUMP))
    return flat.select(
        "video_id", "title", F.md5("description").alias("description_hash"), "channel_id", "duration_seconds",
        X.category_id(F.col("category_id")).alias("category"), F.array_join("tags", ",").alias("tags"),
    )


def caption_dump(t: Tables) -> DataFrame:
    """Two caption sources per video; the JSON one is empty for every fourth."""
    line = lambda s: F.struct(s.alias("utf8"))
    words = F.filter(F.split("text", " "), lambda w: w != "")
    events = F.transform(words, lambda w: F.struct(F.array(line(F.concat(F.lit(" "), w))).alias("segs")))
    body = F.to_json(F.struct(F.when(F.col("doc_id") % 4 == 1, F.slice(events, 1, 0)).otherwise(events).alias("events")))
    json3 = t.video_docs.select(
        F.col("source_id").alias("video_id"), F.lit("json3").alias("kind"), F.lit(1).alias("priority"), body.alias("body")
    )
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    marked = F.concat(F.lit("<t><p a='1'>Tom &amp; "), escaped, F.lit("</p>\n<p>end</p></t>"))
    xml = t.video_docs.select(
        F.col("source_id").alias("video_id"), F.lit("xml").alias("kind"), F.lit(2).alias("priority"), marked.alias("body")
    )
    return json3.unionByName(xml)


@query(
    "captions",
    with_tables(
        "video_docs",
        r"""SELECT source_id AS video_id,
                  CASE WHEN doc_id % 4 = 1 THEN
                    trim(regexp_replace('Tom & ' || text || ' end', '\s+', ' ', 'g'))
                  ELSE array_to_string(list_filter(list_transform(
                    list_filter(string_split(text, ' '), lambda w: w <> ''),
                    lambda w: regexp_replace(w, '^\s+|\s+$', '', 'g')), lambda w: w <> ''), ' ') END AS transcript_text
            FROM video_docs""",
    ),
)
def captions(t: Tables) -> DataFrame:
    return dumps.flatten_captions(caption_dump(t))


@query(
    "page_signal_rollup",
    with_tables(
        "visits",
        """SELECT user_id, page_id, max(scroll_depth) AS scroll_depth, max(interaction_count) AS interaction_count,
                  max(word_count) AS word_count, arg_max(title, event_id) FILTER (WHERE title <> '') AS title,
                  arg_max(referrer, event_id) FILTER (WHERE referrer IS NOT NULL) AS referrer,
                  bool_or(app) AS is_app_page FROM visits GROUP BY user_id, page_id""",
    ),
)
def page_signal_rollup(t: Tables) -> DataFrame:
    signals = t.visits.withColumn("is_app_page", urls.is_app_page(F.col("domain")))
    return capture.page_rollup(signals, ["user_id", "page_id"], "event_id").select(
        "user_id", "page_id", "scroll_depth", "interaction_count", "word_count", "title", "referrer", "is_app_page"
    )


@query(
    "app_pages_sent",
    with_tables(
        "visits",
        """SELECT user_id, page_id, min(event_id) AS event_id FROM visits
           WHERE app AND (dwell_seconds >= 5 OR interaction_count >= 1) GROUP BY user_id, page_id""",
    ),
)
def app_pages_sent(t: Tables) -> DataFrame:
    return capture.sent_once(t.visits, ["user_id", "page_id"], "event_id")


_STATES = """
    SELECT user_id, ts, event_id, CASE WHEN event_type = 'view' THEN true WHEN event_type = 'error' THEN false END AS playing,
           CASE WHEN event_type = 'click' THEN true WHEN event_type = 'signup' THEN false END AS focused,
           CASE WHEN event_type IN ('click', 'purchase') THEN ts END AS input_at FROM events"""
_FILL = """
    SELECT user_id, epoch_us(ts) AS began, lead(epoch_us(ts)) OVER w AS nxt,
           last_value(playing IGNORE NULLS) OVER r AS playing, last_value(focused IGNORE NULLS) OVER r AS focused,
           epoch_us(last_value(input_at IGNORE NULLS) OVER r) AS input_at
    FROM states WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
      r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query(
    "active_time",
    f"""WITH states AS ({_STATES}), filled AS ({_FILL})
        SELECT user_id, (sum(CASE WHEN coalesce(playing, false) AND coalesce(focused, false) AND nxt IS NOT NULL
                        THEN greatest(least(nxt, input_at + 3600000000) - began, 0) ELSE 0 END) / 1000000)::DOUBLE
                 AS active_seconds FROM filled GROUP BY user_id""",
)
def active_time(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    states = t.events.select(
        "user_id", "ts", "event_id",
        F.when(kind == "view", True).when(kind == "error", False).alias("playing"),
        F.when(kind == "click", True).when(kind == "signup", False).alias("focused"),
        F.when(kind.isin("click", "purchase"), F.col("ts")).alias("input_at"),
    )
    return capture.active_time(
        states, ["user_id"], ["ts", "event_id"], ["playing", "focused"], "input_at", idle_seconds=3600
    )


@query(
    "scroll_depths",
    """SELECT page_id, round(least((page_id * 37 % 5000) / greatest(length(html) - 900, 1), 1.0), 3)::DOUBLE AS depth
       FROM pages""",
)
def scroll_depths(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id",
        times.scroll_fraction(F.col("page_id") * 37 % 5000, F.length("html"), F.lit(900)).alias("depth"),
    )


@query(
    "category_hints",
    with_tables(
        "video_docs",
        """SELECT doc_id, CASE doc_id % 30 WHEN 1 THEN 'film animation' WHEN 15 THEN 'pets animals'
             WHEN 17 THEN 'sports' WHEN 19 THEN 'travel events' WHEN 23 THEN 'comedy'
             WHEN 25 THEN 'news politics' WHEN 27 THEN 'education learning tutorial' ELSE '' END AS hint
           FROM video_docs""",
    ),
)
def category_hints(t: Tables) -> DataFrame:
    return t.video_docs.select(
        "doc_id", X.category_hint((F.col("doc_id") % 30).cast("string")).alias("hint")
    )


@query(
    "group_dimension",
    with_tables(
        "items",
        """SELECT g.group_name, count(*) AS items FROM items i JOIN (VALUES (1, 'work'), (2, 'study'),
           (3, 'entertainment'), (4, 'personal'), (5, 'misc')) g(gid, group_name)
           ON g.gid = length(i.title) % 5 + 1 GROUP BY g.group_name""",
    ),
)
def group_dimension(t: Tables) -> DataFrame:
    keyed = t.items.select((F.length("title") % 5 + 1).cast("int").alias("system_group_id"))
    return keyed.join(F.broadcast(dimensions.groups(t.spark)), "system_group_id").groupBy("group_name").agg(
        F.count("*").alias("items")
    )


VISIT_LINES = ["user_id", "event_id", "ts", "url", "title", "domain", "dwell_seconds", "scroll_depth", "interaction_count", "revisit_count", "word_count"]
_INTAKE_SQL = with_tables(
    "video_events",
    """SELECT 'visit' AS kind, event_id, CASE WHEN event_id % 10 = 3 OR event_id % 15 = 4 THEN 'unreadable'
              WHEN floor(value)::BIGINT % 20 < 2 THEN 'out_of_bounds' ELSE 'kept' END AS outcome FROM events
       UNION ALL
       SELECT kind, event_id, CASE WHEN event_id % 9 = 2 THEN 'unreadable' ELSE 'kept' END FROM video_events""",
)


def write_lines(t: Tables, folder: str) -> None:
    """Events as JSON lines: some are cut off in the middle, some have text where a number belongs, some are out of bounds."""
    from_event = t.events.select(
        "user_id", "event_id", "ts", F.concat(F.lit("https://h.org/"), F.floor(F.col("event_id") / 40)).alias("url"), F.col("props").alias("title"),
        F.lit("h.org").alias("domain"), (F.floor("value") % 20 - 2).cast("int").alias("dwell_seconds"),
        (F.col("event_id") % 10 / 20).alias("scroll_depth"), F.lit(0).alias("interaction_count"), F.lit(0).alias("revisit_count"), F.lit(7).alias("word_count"),
    )
    line = F.to_json(F.struct(*VISIT_LINES))
    spoilt = F.when(F.col("event_id") % 10 == 3, F.substring(line, 1, F.length(line) - 9)).when(
        F.col("event_id") % 15 == 4, F.regexp_replace(line, r'"dwell_seconds":-?\d+', '"dwell_seconds":"some"')
    ).otherwise(line)
    from_event.select(spoilt.alias("value")).write.text(f"{folder}/visits")
    shapes = {
        "detected": ["event_id", "url", "video_id", "watch_time_seconds", "triggered_by", "interaction_type", "timestamp"],
        "heartbeat": ["event_id", "video_id", "watch_time_seconds", "timestamp"],
        "closed": ["event_id", "video_id", "final_watch_time_seconds", "timestamp"],
    }
    videos = t.video_events.withColumn("final_watch_time_seconds", F.col("watch_time_seconds"))
    for kind, columns in shapes.items():
        line = F.to_json(F.struct(*columns))
        value = F.when(F.col("event_id") % 9 == 2, F.concat(line, F.lit("}"), line)).otherwise(line)
        broken = F.when(F.col("event_id") % 9 == 2, F.substring(value, 1, F.length(line) - 2)).otherwise(value)
        videos.filter(F.col("kind") == kind).select(broken.alias("value")).write.text(f"{folder}/{kind}")


def taken_in(t: Tables, folder: str, streaming: bool = False) -> DataFrame:
    """What became of each line: (kind, event_id, outcome)."""
    lines = readers.page_visits(t.spark, f"{folder}/visits", streaming)
    read, bad = readers.split_lines(lines)
    good, beyond = readers.split_visits(read)
    event = F.regexp_extract("line", r'"event_id":(\d+)', 1).cast("bigint")
    outcome = lambda df, kind, event_id, what: df.select(F.lit(kind).alias("kind") if kind else F.col("kind"), event_id.alias("event_id"), what.alias("outcome"))
    videos = readers.video_events(t.spark, *[f"{folder}/{k}" for k in ("detected", "heartbeat", "closed")], streaming)
    told = F.coalesce(F.col("event_id"), F.regexp_extract(readers.BAD_LINE, r'"event_id":(\d+)', 1).cast("bigint"))
    watched = outcome(videos, None, told, F.when(F.col(readers.BAD_LINE).isNull(), "kept").otherwise("unreadable"))
    return (
        outcome(good, "visit", F.col("event_id"), F.lit("kept"))
        .unionByName(outcome(beyond, "visit", F.col("event_id"), F.col("reason")))
        .unionByName(outcome(bad, "visit", event, F.col("reason")))
        .unionByName(watched)
    )


@query("json_intake", _INTAKE_SQL)
def json_intake(t: Tables) -> DataFrame:
    folder = work_folder(t.spark, "lines")
    write_lines(t, folder)
    return taken_in(t, folder)


@query("stream_json_intake", _INTAKE_SQL)
def stream_json_intake(t: Tables) -> DataFrame:
    """The same lines read as streams."""
    folder = work_folder(t.spark, "lines")
    write_lines(t, folder)
    write_files(taken_in(t, folder, streaming=True), f"{folder}/out", f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")
