"""Conversation log: append, read, render, retain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas as S
from ..runtime import top_per_group


def message_json(role: Column, content: Column, created_at: Column) -> Column:
    stamp = F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.to_json(F.struct(role.alias("role"), content.alias("content"), stamp.alias("created_at")))


def turns_to_messages(turns: DataFrame) -> DataFrame:
    """One question/answer turn to two rows: user first, then assistant (``part`` 0, 1)."""
    pair = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("user_query").alias("content")),
        F.struct(
            F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("assistant_answer").alias("content")
        ),
    )
    rows = turns.select("session_id", "created_at", F.explode(pair).alias("m"))
    body = message_json(F.col("m.role"), F.col("m.content"), F.col("created_at"))
    return rows.select("session_id", F.col("m.part").alias("part"), body.alias("message"), "created_at")


def append_turns(turns: DataFrame, path: str) -> None:
    turns_to_messages(turns).write.mode("append").parquet(path)


def parse_messages(messages: DataFrame) -> DataFrame:
    body = F.from_json("message", S.MESSAGE_BODY)
    return messages.withColumn("_m", body).withColumns(
        {"role": F.col("_m.role"), "content": F.col("_m.content")}
    ).drop("_m")


def session_messages(messages: DataFrame, session_id: str) -> DataFrame:
    return messages.filter(F.col("session_id") == session_id)


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count("*").alias("messages"))


def history_text(
    parsed: DataFrame, sessions: DataFrame | None = None, order: str = "seq", n: int = K.HISTORY_MESSAGES
) -> DataFrame:
    """Last ``n`` messages per session as lines, oldest first.

    ``sessions`` lists sessions that must appear even without messages.  A null content is an empty line.
    """
    recent = top_per_group(
        parsed.select("session_id", order, "role", "content"), ["session_id"], [F.col(order).desc()], n
    )
    label = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    lines = F.sort_array(F.collect_list(F.struct(F.col(order), F.concat(label, F.coalesce("content", F.lit(""))).alias("line"))))
    text = recent.groupBy("session_id").agg(
        F.array_join(F.transform(lines, lambda m: m["line"]), "\n").alias("history")
    )
    if sessions is None:
        return text
    return sessions.select("session_id").distinct().join(text, "session_id", "left").withColumn(
        "history", F.coalesce("history", F.lit(K.NO_HISTORY_TEXT))
    )


def retain_messages(messages: DataFrame, now: Column, days: int = K.MESSAGE_RETENTION_DAYS) -> DataFrame:
    return messages.filter(F.col("created_at") >= now - F.make_interval(days=F.lit(days)))


def expired_count(messages: DataFrame, now: Column, days: int = K.MESSAGE_RETENTION_DAYS) -> DataFrame:
    old = F.col("created_at") < now - F.make_interval(days=F.lit(days))
    return messages.agg(F.count_if(old).alias("deleted"))


def delete_sessions(messages: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages of all other sessions, and (session_id, deleted) of the named ones, 0 where there was nothing."""
    named = sessions.select("session_id").distinct()
    gone = message_counts(messages.join(named, "session_id", "left_semi"))
    counts = named.join(gone, "session_id", "left").select(
        "session_id", F.coalesce("messages", F.lit(0)).alias("deleted")
    )
    return messages.join(named, "session_id", "left_anti"), counts
