"""User groups: rule matching, suggestions, review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import urls
from ..runtime import lookup_join
from .phrases import match_phrases


def _window_hours(value: Column) -> Column:
    """``'22-6'``: hours from 22 up to but not including 6, over midnight."""
    start = F.regexp_extract(value, r"^(\d{1,2})-(\d{1,2})$", 1).try_cast("int")
    stop = F.regexp_extract(value, r"^(\d{1,2})-(\d{1,2})$", 2).try_cast("int")
    inside = lambda h: F.when(
        start <= stop, (h >= start) & (h < stop)
    ).otherwise((h >= start) | (h < stop))
    return F.filter(F.sequence(F.lit(0), F.lit(23)), inside)


def _rule_keys(rules: DataFrame) -> DataFrame:
    hours = F.transform(_window_hours(F.col("rule_value")), lambda h: h.cast("string"))
    values = F.when(F.col("rule_type") == "time_window", hours).otherwise(
        F.array(F.lower(F.trim("rule_value")))
    )
    return rules.select("rule_id", "group_id", "rule_type", F.explode(values).alias("rule_key"))


def _item_keys(items: DataFrame) -> DataFrame:
    """Each item's rule keys: host, channel id or name, sender or its host, hour."""

    def key(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("rule_type"), value.alias("rule_key"))

    bracketed = F.regexp_extract("sender", r"<([^>]+)>", 1)
    address = F.lower(F.trim(F.when(bracketed != "", bracketed).otherwise(F.col("sender"))))
    keys = F.array(
        key("domain", F.lower(F.trim("domain"))),
        key("channel", F.lower(F.col("channel_id"))),
        key("channel", F.lower(F.trim("channel_name"))),
        key("sender", address),
        key("sender", urls.sender_domain(F.col("sender"))),
        key("time_window", F.hour("created_at").cast("string")),
    )
    filled = F.filter(keys, lambda k: F.coalesce(k["rule_key"], F.lit("")) != "")
    return items.select("memory_id", F.explode(F.array_distinct(filled)).alias("k")).select(
        "memory_id", "k.*"
    )


def match_rules(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(memory_id, rule_id, group_id) of every active rule that fires on an item.

    Four rule types are one equi-join on (type, key); keyword rules go through
    the phrase search over title and keywords.
    """
    active = rules.filter("is_active")
    keyed = lookup_join(
        _item_keys(items), _rule_keys(active.filter("rule_type <> 'keyword'")), ["rule_type", "rule_key"]
    )
    words = active.filter("rule_type = 'keyword'").withColumn("phrase", F.lower(F.trim("rule_value")))
    text = F.concat_ws("\x1f", F.col("title"), F.array_join("auto_keywords", "\x1f"))
    hits = match_phrases(items, text, words.select("phrase"), ["memory_id"])
    found = lookup_join(hits, words.select("phrase", "rule_id", "group_id"), ["phrase"])
    columns = ["memory_id", "rule_id", "group_id"]
    return keyed.select(*columns).unionByName(found.select(*columns)).distinct()


def rule_match_counts(rules: DataFrame, matches: DataFrame) -> DataFrame:
    counts = matches.groupBy("rule_id").agg(F.count("*").alias("match_count"))
    return rules.drop("match_count").join(counts, "rule_id", "left").withColumn(
        "match_count", F.coalesce("match_count", F.lit(0))
    )


def suggest(matches: DataFrame) -> DataFrame:
    """One pending suggestion per item and group; never accepted by itself."""
    return matches.groupBy("memory_id", "group_id").agg(F.count("*").alias("rules")).select(
        "memory_id", "group_id", "rules",
        F.lit("pending").alias("decision"), F.lit(False).alias("reviewed"),
    )


def accepted_groups(suggestions: DataFrame) -> DataFrame:
    """Item/group bridge: accepted decisions only."""
    return suggestions.filter(F.col("decision") == "accepted").select("memory_id", "group_id").distinct()


def review_queue(suggestions: DataFrame) -> DataFrame:
    return suggestions.filter(~F.coalesce("reviewed", F.lit(False)))


def dead_rules(counted_rules: DataFrame, now: Column, days: int = K.DEAD_RULE_DAYS) -> DataFrame:
    return counted_rules.filter(
        (F.col("match_count") == 0) & (F.col("created_at") <= now - F.make_interval(days=F.lit(days)))
    )
