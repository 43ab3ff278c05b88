"""Retrieval: raw replies to intents, search, quality, widening, re-rank, answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas as S
from ..functions.core import strip, string_array
from ..functions.gates import effective_sources
from ..operators import knn as N
from ..operators.search import expanded, search
from ..runtime import cut_lineage, top_per_group


def normalize_intents(replies: DataFrame) -> DataFrame:
    """(query_id, user_query, reply) to intents; a broken reply becomes the fallback intent.

    Code fences are removed; all required keys must be present.
    """
    raw = strip(F.col("reply"))
    fenced = F.get(F.split(raw, "```"), F.lit(1))
    bare = strip(F.regexp_replace(fenced, r"(?s)^json", ""))
    body = F.when(raw.startswith("```"), bare).otherwise(raw)
    parsed = F.from_json("_body", S.INTENT_REPLY)
    missing = F.array_except(string_array(K.INTENT_KEYS), F.json_object_keys("_body"))
    good = F.coalesce(F.size(missing) == 0, F.lit(False)) & F.col("_p").isNotNull()
    fallback = F.struct(
        string_array(K.SOURCES).alias("sources"),
        F.lit(None).cast("string").alias("time_filter"),
        F.lit(False).alias("fetch_attachment"),
        F.lit(False).alias("fetch_api"),
        F.col("user_query").alias("query_clean"),
        F.lit(0).alias("scope_level"),
        F.lit(True).alias("is_ambiguous"),
        F.col("user_query").alias("original_query"),
        F.lit(False).alias("skip_postgres_filter"),
        F.lit(False).alias("full_faiss_scan"),
    )
    return (
        replies.withColumn("_body", body)
        .withColumn("_p", parsed)
        .withColumn("_intent", F.when(good, F.col("_p")).otherwise(fallback))
        .select("query_id", "_intent.*", good.alias("is_parsed"))
    )


def quality(results: DataFrame, intents: DataFrame) -> DataFrame:
    """(query_id, quality): empty, weak or strong, checks in a fixed order.

    ``results``: query_id, source_type, created_at, similarity (of the vector
    result, null without one).
    """
    per_query = results.groupBy("query_id").agg(
        F.count("*").alias("_rows"),
        F.collect_set("source_type").alias("_found"),  # at most one entry per source
        F.max("created_at").alias("_latest"),
        F.max("similarity").alias("_top"),
    )
    return _verdicts(intents.join(per_query, "query_id", "left"))


def quality_of_scopes(intents: DataFrame, members: DataFrame, results: DataFrame, near: DataFrame) -> DataFrame:
    """As ``quality``, from results once per scope (``search.search_scopes``) and the few nearest of each query, unpaired."""
    per_scope = results.groupBy("scope").agg(
        F.count("*").alias("_rows"), F.collect_set("source_type").alias("_found"), F.max("created_at").alias("_latest")
    )
    top = near.groupBy("query_id").agg(F.max("similarity").alias("_top"))
    placed = members.join(per_scope, "scope", "left").drop("scope")
    return _verdicts(intents.join(placed, "query_id", "left").join(top, "query_id", "left"))


def _verdicts(joined: DataFrame) -> DataFrame:
    rows = F.coalesce("_rows", F.lit(0))
    asked = effective_sources(F.col("sources"))
    specific = F.size(asked) < len(K.SOURCES)
    since = F.try_to_timestamp(F.col("time_filter"))
    verdict = (
        F.when(rows == 0, "empty")
        .when(specific & ~F.arrays_overlap(asked, F.col("_found")), "empty")
        .when(since.isNotNull() & (F.col("_latest") < since), "weak")
        .when(rows < K.MIN_STRONG_RESULTS, "weak")
        .when(F.col("_top") < K.MIN_TOP_SIMILARITY, "weak")
        .otherwise("strong")
    )
    return joined.select("query_id", verdict.alias("quality"), rows.alias("result_count"))


def widen(intents: DataFrame) -> DataFrame:
    """One widening step per intent, by its ``attempt``; attempt always grows by one."""
    time, attempt, phrase = F.col("time_filter"), F.col("attempt"), F.col("query_clean")
    timed = F.coalesce(time, F.lit("")) != ""
    all_sources = string_array(K.SOURCES)
    opened = (F.size(F.array_except(all_sources, F.coalesce("sources", F.array().cast("array<string>")))) == 0) | (
        F.coalesce(F.array_contains("sources", K.ALL_SOURCES_MARK), F.lit(False))
    )
    first_word = F.coalesce(F.nullif(F.regexp_extract(phrase, r"(?U)^\s*(\S+)", 1), F.lit("")), phrase)
    earlier = F.date_format(
        F.try_to_timestamp(time) - F.make_interval(days=F.lit(K.WIDEN_DAYS)), "yyyy-MM-dd'T'HH:mm:ss"
    )
    trims = ((attempt == 0) & ~timed & opened) | (attempt == 1)
    return intents.withColumns(
        {
            "time_filter": F.when((attempt == 0) & timed, earlier).when(attempt == 1, None).otherwise(time),
            "sources": F.when(
                ((attempt == 0) & ~timed & ~opened) | (attempt == 1), all_sources
            ).otherwise(F.col("sources")),
            "query_clean": F.when(trims, first_word).otherwise(phrase),
            "skip_postgres_filter": F.col("skip_postgres_filter") | (attempt >= 2),
            "full_faiss_scan": F.col("full_faiss_scan") | (attempt >= 2),
            "attempt": attempt + 1,
        }
    )


def vector_search(
    intents: DataFrame, results: DataFrame, vectors: DataFrame, k: int = K.KNN_K, dim: int = K.VECTOR_DIM, by: str = "query_id"
) -> DataFrame:
    """Nearest items per intent: among its candidates, or all vectors for a full scan.

    The candidates of an intent are the results of its ``by``: with ``scope`` they are given once for all its intents.

    ``intents`` carry ``query_vector``; unknown ids vanish, no candidates give no rows.
    """
    full = F.coalesce(F.col("full_faiss_scan"), F.lit(False))
    narrow = intents.filter(~full)
    pairs = results.select(by, "memory_id").join(narrow.select(by), by, "left_semi")
    near = N.knn(narrow, vectors, pairs, k=k, dim=dim, by=by)
    return near.unionByName(N.knn(intents.filter(full), vectors, None, k=k, dim=dim))


def _one_round(
    intents: DataFrame, view: DataFrame, vectors: DataFrame, limit: int, k: int, dim: int
) -> tuple[DataFrame, DataFrame]:
    found = cut_lineage(search(intents, view, limit))
    # Vectors of items that cannot be found would use up places among the k nearest.
    live = vectors.join(view.select("memory_id"), "memory_id", "left_semi")
    near = vector_search(intents, found, live, k, dim).select(
        "query_id", "memory_id", "distance", "similarity", F.col("rank").alias("vector_rank")
    )
    # A full scan may reach live items the structured limit left out: they join in.
    details = view.select(
        "memory_id", F.col("source_type").alias("_source"), F.col("created_at").alias("_created"),
        F.col("last_accessed_at").alias("_accessed"),
    )
    reached = near.join(details, "memory_id")
    merged = found.join(reached, ["query_id", "memory_id"], "full_outer").select(
        "query_id", "memory_id",
        F.coalesce("source_type", "_source").alias("source_type"),
        F.coalesce("created_at", "_created").alias("created_at"),
        F.coalesce("last_accessed_at", "_accessed").alias("last_accessed_at"),
        "rank", "distance", "similarity", "vector_rank",
    )
    merged = cut_lineage(merged)
    return merged, quality(merged, intents)


def retrieve(
    intents: DataFrame,
    view: DataFrame,
    vectors: DataFrame,
    limit: int = K.SEARCH_LIMIT,
    k: int = K.KNN_K,
    dim: int = K.VECTOR_DIM,
    max_rounds: int = K.MAX_WIDEN_ATTEMPTS + 1,
) -> tuple[DataFrame, DataFrame]:
    """(results, states) after searching and widening.

    Each round works on the still-unsatisfied intents only.  The live searchable
    columns are checkpointed once for all rounds, and so are the small per-round
    tables, so a round never recomputes what came before it.
    ``states``: the intents with attempt, quality, result_count and no_results.
    """
    waiting = cut_lineage(intents.withColumn("attempt", F.lit(0)))
    view = cut_lineage(
        view.filter(~F.col("is_deleted") & F.col("preprocessed")).select(
            "memory_id", "source_type", "title", "auto_keywords", "created_at", "last_accessed_at",
            "is_deleted", "preprocessed",
        )
    )
    all_results, all_states = [], []
    for n in range(max_rounds):
        results, judged = _one_round(waiting, view, vectors, limit, k, dim)
        judged = cut_lineage(waiting.join(judged, "query_id"))
        last = n == max_rounds - 1
        done = judged if last else judged.filter(F.col("quality") == "strong")
        strong = judged.filter(F.col("quality") == "strong")
        all_results.append(results.join(strong.select("query_id"), "query_id", "left_semi"))
        all_states.append(done.withColumn("no_results", F.col("quality") != "strong"))
        if last:
            break
        open_intents = judged.filter(F.col("quality") != "strong").select(*waiting.columns)
        if open_intents.isEmpty():
            break
        waiting = cut_lineage(widen(open_intents))
    return reduce(DataFrame.unionByName, all_results), reduce(DataFrame.unionByName, all_states)


def rerank_score(
    similarity: Column, dwell: Column, watch: Column, age_days: Column, effort: Column,
    weights: dict[str, float] | None = None,
) -> Column:
    return _weighted(similarity, _engagement(dwell, watch), _recency(age_days), effort, weights)


def _engagement(dwell: Column, watch: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(F.coalesce(dwell, F.lit(0)) + F.coalesce(watch, F.lit(0))) / F.log1p(F.lit(3600)))


def _recency(age_days: Column) -> Column:
    return F.exp(-F.greatest(age_days, F.lit(0.0)) / F.lit(30.0))


def _weighted(similarity: Column, engagement: Column, recency: Column, effort: Column, weights: dict[str, float] | None) -> Column:
    w = weights or K.RERANK_WEIGHTS
    return (
        F.lit(w["semantic"]) * F.coalesce(similarity, F.lit(0.0))
        + F.lit(w["engagement"]) * engagement
        + F.lit(w["recency"]) * recency
        + F.lit(w["effort"]) * F.coalesce(effort, F.lit(0.0))
    )


def _with_terms(results: DataFrame, details: DataFrame, now: Column) -> DataFrame:
    """Results with the terms of the score that are of the item alone, ``_engagement``, ``_recency`` and ``_effort``."""
    joined = results.join(
        details.select(
            "memory_id", "dwell_time_seconds", "watch_time_seconds", "completion_rate", "word_count"
        ),
        "memory_id",
    )
    read = F.when(
        F.col("word_count") > 0,
        F.least(F.lit(1.0), F.col("dwell_time_seconds") / (F.col("word_count") / F.lit(200.0) * F.lit(60.0))),
    )
    effort = F.when(F.col("source_type") == "chrome", read).when(
        F.col("source_type") == "youtube", F.col("completion_rate")
    )
    age = (F.unix_seconds(now) - F.unix_seconds("last_accessed_at")) / F.lit(86_400.0)
    return joined.withColumns(
        {
            "_engagement": _engagement(F.col("dwell_time_seconds"), F.col("watch_time_seconds")),
            "_recency": _recency(F.coalesce(age, F.lit(1e9))),
            "_effort": effort,
        }
    )


def _ranked(scored: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    semantic = F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.col("distance")), F.lit(0.0))
    score = _weighted(semantic, F.col("_engagement"), F.col("_recency"), F.col("_effort"), weights)
    window = Window.partitionBy("query_id").orderBy(F.col("final_score").desc(), F.col("memory_id"))
    done = scored.withColumn("final_score", score).drop("_engagement", "_recency", "_effort")
    return done.withColumn("final_rank", F.row_number().over(window))


def rerank(
    results: DataFrame, details: DataFrame, now: Column, weights: dict[str, float] | None = None
) -> DataFrame:
    """Results with ``final_score`` and ``final_rank``.

    Semantic part ``1/(1+distance)``; effort is reading completion for pages
    (200 words a minute), completion rate for videos, 0 for mail.  ``details``:
    memory_id, dwell_time_seconds, watch_time_seconds, completion_rate, word_count.
    """
    return _ranked(_with_terms(results, details, now), weights)


def rerank_scopes(
    members: DataFrame, results: DataFrame, near: DataFrame, details: DataFrame, now: Column, weights: dict[str, float] | None = None
) -> DataFrame:
    """(query_id, memory_id, distance, final_score, final_rank) as ``rerank`` gives them, from results once per scope and the nearest few of each query.

    The terms of an item are joined once per scope.  The rows of a query and its distances meet in the shuffle that ranks them.
    """
    terms = ["_engagement", "_recency", "_effort"]
    found = expanded(members, _with_terms(results, details, now).select("scope", "memory_id", *terms))
    told = near.select("query_id", "memory_id", *[F.lit(None).cast("double").alias(c) for c in terms], "distance")
    rows = found.select("query_id", "memory_id", *terms, F.lit(None).cast("double").alias("distance")).unionByName(told)
    merged = rows.repartition("query_id").groupBy("query_id", "memory_id").agg(*[F.max(c).alias(c) for c in (*terms, "distance")])
    return _ranked(merged.filter("_engagement IS NOT NULL"), weights)


def attachment_hits(results: DataFrame, intents: DataFrame, mail: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, fetch): attachment asked for, and one of the top ``k`` rows has one.

    The top rows go by vector rank if the query has a vector result, else by row order.
    """
    has_vector = results.groupBy("query_id").agg(F.count("vector_rank").alias("_v"))
    position = F.when(F.col("_v") > 0, F.col("vector_rank")).otherwise(F.col("rank"))
    top = results.join(has_vector, "query_id").filter(position <= k).filter(F.col("rank").isNotNull())
    held = top.join(mail.select("memory_id", "has_attachments"), "memory_id").groupBy("query_id").agg(
        F.bool_or("has_attachments").alias("_has")
    )
    return intents.join(held, "query_id", "left").select(
        "query_id",
        (F.coalesce("fetch_attachment", F.lit(False)) & F.coalesce("_has", F.lit(False))).alias("fetch"),
    )


def answers(states: DataFrame) -> DataFrame:
    """One answer row per intent: a result summary, or a message saying what was searched."""
    shown = F.when(F.size("sources") > 0, F.array_join("sources", ", ")).otherwise("all sources")
    timed = F.when(
        F.coalesce("time_filter", F.lit("")) != "", F.concat(F.lit(" from around "), F.col("time_filter"))
    ).otherwise("")
    none = F.format_string(
        "No results found for '%s'%s across %s. Broader filters were tried %d times. Try a shorter "
        "keyword, drop the time limit, or check that the content was captured and processed.",
        F.col("original_query"), timed, shown, F.lit(K.MAX_WIDEN_ATTEMPTS),
    )
    some = F.format_string(
        "Retrieved %d candidate(s) for query: '%s'.", F.col("result_count"), F.col("original_query")
    )
    return states.select(
        "query_id", F.when(F.col("no_results"), none).otherwise(some).alias("answer"),
        "no_results", "result_count",
    )
