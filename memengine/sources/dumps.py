"""Flatten mail, video-metadata and caption dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas as S
from ..functions import text as X
from ..functions import times
from ..functions.core import blank_to_null, strip


def parse_dump(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """One parsed column set per JSON line; a bad line gives nulls."""
    return df.select(F.from_json(F.col(payload), schema).alias("_d")).select("_d.*")


def _header(name: str) -> Column:
    hits = F.filter(F.col("payload.headers"), lambda h: h["name"] == name)
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit(""))


def _decode_url_safe(data: Column) -> Column:
    return F.try_to_binary(F.translate(data, "-_", "+/"), F.lit("base64")).cast("string")


def _body() -> Column:
    """First non-empty top-level plain part; without parts the payload body; else empty."""
    parts = F.col("payload.parts")
    plain = F.filter(
        parts,
        lambda p: (p["mimeType"] == "text/plain") & (F.coalesce(p["body"]["data"], F.lit("")) != ""),
    )
    from_parts = F.get(plain, F.lit(0))["body"]["data"]
    data = F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, from_parts).otherwise(F.col("payload.body.data"))
    return F.coalesce(_decode_url_safe(data), F.lit(""))


def _attachments() -> Column:
    named = F.filter(
        F.col("payload.parts"), lambda p: F.coalesce(strip(p["filename"]), F.lit("")) != ""
    )
    rows = F.transform(
        named,
        lambda p: F.struct(
            p["filename"].alias("filename"),
            F.coalesce(p["mimeType"], F.lit(K.DEFAULT_MIME)).alias("mime_type"),
            F.coalesce(p["size"], F.lit(0)).alias("size"),
        ),
    )
    return F.coalesce(rows, F.array().cast("array<struct<filename:string,mime_type:string,size:int>>"))


def flatten_mail(mail: DataFrame) -> DataFrame:
    """Parsed mail dump to flat rows; the last header of a name wins."""
    to = _header("To")
    labels = F.coalesce(F.col("labelIds"), F.array().cast("array<string>"))
    return mail.select(
        F.col("id").alias("email_id"),
        F.col("threadId").alias("thread_id"),
        _header("Subject").alias("subject"),
        _header("From").alias("sender"),
        F.when(to == "", F.array().cast("array<string>")).otherwise(F.array(to)).alias("recipients"),
        _header("Date").alias("date"),
        labels.alias("gmail_labels"),
        F.array_contains(labels, "SENT").alias("is_sent"),
        _body().alias("body"),
        _attachments().alias("attachments"),
    ).withColumn("has_attachments", F.size("attachments") > 0)


def explode_attachments(flat_mail: DataFrame) -> DataFrame:
    return flat_mail.select("email_id", F.explode("attachments").alias("a")).select(
        "email_id", "a.filename", "a.mime_type", "a.size"
    )


def flatten_video_metadata(videos: DataFrame) -> DataFrame:
    def field(name: str) -> Column:
        return F.coalesce(F.col(f"snippet.{name}"), F.lit(""))

    return videos.select(
        F.col("id").alias("video_id"),
        field("title").alias("title"),
        field("description").alias("description"),
        field("channelTitle").alias("channel_name"),
        field("channelId").alias("channel_id"),
        field("publishedAt").alias("published_at"),
        times.iso_duration_seconds(F.col("contentDetails.duration")).alias("duration_seconds"),
        field("categoryId").alias("category_id"),
        F.coalesce(F.col("snippet.tags"), F.array().cast("array<string>")).alias("tags"),
    )


def _caption_text(kind: Column, body: Column) -> Column:
    events = F.from_json(body, S.CAPTION_JSON)["events"]
    segments = F.flatten(F.transform(events, lambda e: F.coalesce(e["segs"], F.array().cast("array<struct<utf8:string>>"))))
    spoken = F.filter(F.transform(segments, lambda s: strip(s["utf8"])), lambda t: t != "")
    marked = X.unescape_html(F.regexp_replace(body, r"<[^>]+>", " "))
    return F.when(kind == "json3", F.array_join(spoken, " ")).otherwise(
        strip(F.regexp_replace(marked, r"(?U)\s+", " "))
    )


def flatten_captions(captions: DataFrame) -> DataFrame:
    """One transcript per video: the first source (by priority) with any text, else ``''``."""
    texts = captions.withColumn("_text", blank_to_null(_caption_text(F.col("kind"), F.col("body"))))
    best = F.expr("min_by(_text, priority) FILTER (WHERE _text IS NOT NULL)")
    return texts.groupBy("video_id").agg(F.coalesce(best, F.lit("")).alias("transcript_text"))


