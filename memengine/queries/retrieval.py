"""Intents, search, vectors, quality, widening, re-rank, answers."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import knn as N
from ..operators import search as R
from ..operators import postings, store, views
from ..plans import retrieval as P
from ..runtime import cut_lineage, shuffles_go
from ..streaming.jobs import work_folder
from . import ORACLES, query
from .tables import Tables, with_tables

DIM = 64
_ALL = "['gmail', 'chrome', 'youtube']"


# --- inputs derived from the tables ---------------------------------------------
def intents_of(t: Tables) -> DataFrame:
    """One intent per fiftieth document: a piece of its title, varied sources, times and flags."""
    d = F.col("doc_id")
    array = lambda *xs: F.array(*[F.lit(x) for x in xs])
    sources = (
        F.when(d % 200 == 0, array("gmail")).when(d % 200 == 50, array("chrome"))
        .when(d % 200 == 100, array("all")).otherwise(array("gmail", "youtube"))
    )
    phrase = (
        F.when(d % 350 == 300, "")
        .when(d % 450 == 400, F.concat(F.substring("text", 1, 5), F.lit(" zzz")))
        .otherwise(F.substring("text", 4, 4))
    )
    return t.documents.filter(d % 50 == 0).select(
        F.concat(F.lit("q"), d).alias("query_id"), d.alias("doc_id"), sources.alias("sources"),
        F.when(d % 3 == 1, "2024-01-02").when(d % 3 == 2, "2024-01-03T05:30:00").alias("time_filter"),
        (d % 100 == 0).alias("fetch_attachment"), F.lit(False).alias("fetch_api"),
        phrase.alias("query_clean"), F.concat(F.lit("find "), d).alias("original_query"),
        (d % 500 == 450).alias("skip_postgres_filter"), F.lit(False).alias("full_faiss_scan"),
    )


_INTENTS = """
    SELECT 'q' || doc_id AS query_id, doc_id,
      CASE doc_id % 200 WHEN 0 THEN ['gmail'] WHEN 50 THEN ['chrome'] WHEN 100 THEN ['all'] ELSE ['gmail', 'youtube'] END AS sources,
      CASE doc_id % 3 WHEN 1 THEN '2024-01-02' WHEN 2 THEN '2024-01-03T05:30:00' END AS time_filter,
      doc_id % 100 = 0 AS fetch_attachment,
      CASE WHEN doc_id % 350 = 300 THEN '' WHEN doc_id % 450 = 400 THEN substring(text, 1, 5) || ' zzz'
           ELSE substring(text, 4, 4) END AS query_clean,
      'find ' || doc_id AS original_query, doc_id % 500 = 450 AS skip, false AS full_scan, 0 AS attempt
    FROM documents WHERE doc_id % 50 = 0"""


def _found_sql(source: str) -> str:
    return f"""
    SELECT q.query_id, l.memory_id, l.source_type, l.created_at, l.last_accessed_at,
           row_number() OVER (PARTITION BY q.query_id ORDER BY l.last_accessed_at DESC NULLS LAST, l.memory_id) AS rank
    FROM (SELECT *, regexp_replace(lower(query_clean), '^\\s+|\\s+$', '', 'g') AS phrase FROM {source}) q JOIN live l
      ON q.skip OR ((list_contains(q.sources, 'all') OR len(q.sources) = 3 OR list_contains(q.sources, l.source_type))
        AND (q.time_filter IS NULL OR l.created_at >= q.time_filter::TIMESTAMP)
        AND (q.phrase = '' OR contains(lower(l.title), q.phrase)
             OR len(list_filter(l.auto_keywords, lambda k: contains(lower(k), q.phrase))) > 0))
    QUALIFY rank <= 1000"""


_FOUND = _found_sql("intents")


@query(
    "intent_search",
    with_tables("live", "SELECT query_id, memory_id, source_type, rank FROM found", intents=_INTENTS, found=_FOUND),
)
def intent_search(t: Tables) -> DataFrame:
    """Flagship: structured search of every intent over the joined item view."""
    return R.search(intents_of(t), t.searchable).select("query_id", "memory_id", "source_type", "rank")


@query(
    "intent_search_top10",
    with_tables(
        "live", "SELECT query_id, memory_id, rank FROM found WHERE rank <= 10", intents=_INTENTS, found=_FOUND
    ),
)
def intent_search_top10(t: Tables) -> DataFrame:
    return R.search(intents_of(t), t.searchable, limit=10).select("query_id", "memory_id", "rank")


@query(
    "latest_per_thread",
    with_tables(
        "mail_meta",
        """SELECT thread_id, arg_max(email_id, received_at) AS email_id, epoch_us(max(received_at)) AS received_at
           FROM mail_meta GROUP BY thread_id""",
    ),
)
def latest_per_thread(t: Tables) -> DataFrame:
    latest = F.max_by(F.struct("email_id", "received_at"), F.col("received_at")).alias("m")
    return t.mail_meta.groupBy("thread_id").agg(latest).select(
        "thread_id", "m.email_id", F.unix_micros("m.received_at").alias("received_at")
    )


def candidate_queries(t: Tables) -> DataFrame:
    """A query set: a phrase from inside every fiftieth document, and some sender hosts."""
    return t.documents.filter("doc_id % 50 = 0").select(
        F.concat(F.lit("c"), F.col("doc_id")).alias("query_id"),
        F.when(F.col("doc_id") % 200 == 0, F.concat("source", F.lit(".EXAMPLE"))).otherwise(
            F.substring("text", 100, 12)
        ).alias("query"),
    )


@query(
    "candidate_lookup",
    with_tables(
        "items engagement mail_meta",
        """SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY last_accessed_at DESC NULLS LAST,
                  created_at DESC, memory_id) AS rank
           FROM (SELECT 'c' || doc_id AS query_id, lower(CASE WHEN doc_id % 200 = 0 THEN source || '.EXAMPLE'
                   ELSE substring(text, 100, 12) END) AS q FROM documents WHERE doc_id % 50 = 0)
           JOIN (SELECT i.*, e.last_accessed_at, m.sender FROM items i LEFT JOIN engagement e USING (memory_id)
                 LEFT JOIN mail_meta m USING (memory_id) WHERE NOT is_deleted)
             ON q <> '' AND (contains(lower(title), q) OR contains(lower(raw_text), q) OR contains(lower(coalesce(sender, '')), q))
           QUALIFY rank <= 5""",
    ),
)
def candidate_lookup(t: Tables) -> DataFrame:
    registry = store.placeholder_registry(t.items, "title")
    view = views.candidate_view(t.items, registry, t.engagement, t.mail_meta)
    return R.candidates(candidate_queries(t), view).select("query_id", "memory_id", "rank")


@query("stored_candidates", ORACLES["candidate_lookup"])
def stored_candidates(t: Tables) -> DataFrame:
    """The same by stored postings, made of two deltas of which the second changes nothing but comes again."""
    view = views.candidate_view(t.items, store.placeholder_registry(t.items, "title"), t.engagement, t.mail_meta)
    folder, saved = work_folder(t.spark, "postings"), work_folder(t.spark, "view")
    # the deltas and the search all read the view: its texts are joined once
    view = view.select("memory_id", "title", "raw_text", "subject", "sender", "last_accessed_at", "created_at")
    with shuffles_go(t.spark):
        view.write.option("compression", "zstd").parquet(saved)
    view = t.spark.read.parquet(saved)
    second = F.length("title") % 3 == 0
    for delta in (view.filter(~second), view.filter(second), view.filter(second & (F.length("title") % 2 == 0))):
        postings.append(delta, R.candidate_text(), folder)
    return R.candidates(candidate_queries(t), view, match=partial(postings.match, folder=folder)).select("query_id", "memory_id", "rank")


@query(
    "candidate_texts",
    with_tables(
        "items",
        """SELECT memory_id, CASE WHEN source_type = 'gmail' THEN title ELSE raw_text END AS embeddable_text
           FROM items WHERE NOT is_deleted AND source_type <> 'chrome'""",
    ),
)
def candidate_texts(t: Tables) -> DataFrame:
    registry = store.placeholder_registry(t.items, "title")
    sources = t.items.select("memory_id", "source_type")
    marked = registry.join(sources, "memory_id").withColumn("is_active", F.col("source_type") == "gmail")
    view = views.candidate_view(t.items, marked, t.engagement, t.mail_meta)
    return view.filter("source_type <> 'chrome'").select("memory_id", "embeddable_text")


def anchors(t: Tables) -> DataFrame:
    """A query set: the beginning of every fiftieth document."""
    return t.documents.filter("doc_id % 50 = 0").select(
        F.concat(F.lit("a"), F.col("doc_id")).alias("query_id"),
        F.substring("text", 1, 10).alias("anchor_phrase"),
        F.array(F.lit("all")).alias("sources"),
        F.lit("").alias("query_clean"),
        F.lit(False).alias("skip_postgres_filter"),
    )


@query(
    "after_anchor",
    with_tables(
        "live",
        """SELECT a.query_id, l.memory_id, row_number() OVER (PARTITION BY a.query_id
                  ORDER BY l.last_accessed_at DESC NULLS LAST, l.memory_id) AS rank
           FROM (SELECT query_id, max(created_at) AS at_time FROM
                  (SELECT 'a' || doc_id AS query_id, regexp_replace(lower(substring(text, 1, 10)), '^\\s+|\\s+$', '', 'g') AS p
                   FROM documents WHERE doc_id % 50 = 0) JOIN live ON contains(lower(title), p)
                   OR len(list_filter(auto_keywords, lambda k: contains(lower(k), p))) > 0 GROUP BY query_id) a
           JOIN live l ON l.created_at > a.at_time QUALIFY rank <= 1000""",
    ),
)
def after_anchor(t: Tables) -> DataFrame:
    return R.after_anchor(anchors(t), t.searchable).select("query_id", "memory_id", "rank")


# --- vectors -------------------------------------------------------------------------
def item_vectors(t: Tables) -> DataFrame:
    keys = t.mail_docs.select("doc_id", "memory_id").unionByName(t.video_docs.select("doc_id", "memory_id"))
    return t.read("embeddings").join(keys, F.col("vec_id") == F.col("doc_id")).select("memory_id", "embedding")


def vector_intents(t: Tables) -> DataFrame:
    queries = t.read("embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").alias("query_vector"))
    joined = intents_of(t).withColumn("_v", F.floor(F.col("doc_id") / 50)).join(queries, "_v").drop("_v")
    return joined.withColumn("full_faiss_scan", F.col("doc_id") % 250 == 0)


_L2 = "list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_COS = (
    "list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda p: p[1] * p[2]))"
    " / sqrt(list_sum(list_transform({a}::DOUBLE[], lambda x: x * x)))"
    " / sqrt(list_sum(list_transform({b}::DOUBLE[], lambda x: x * x)))"
)
_KNN_ALL = f"""
    SELECT q.vec_id AS query_id, v.vec_id AS memory_id, round({_L2.format(a='q.embedding', b='v.embedding')}, 6) AS distance,
           round({_COS.format(a='q.embedding', b='v.embedding')}, 6) AS similarity,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY {_L2.format(a='q.embedding', b='v.embedding')}, v.vec_id) AS rank
    FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q CROSS JOIN embeddings v QUALIFY rank <= 20"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(
        "query_id", "memory_id", F.round("distance", 6).alias("distance"),
        F.round("similarity", 6).alias("similarity"), "rank",
    )


def _all_vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    table = t.read("embeddings")
    queries = table.filter("vec_id % 50 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")
    )
    return queries, table.select(F.col("vec_id").alias("memory_id"), "embedding")


@query("nearest_vectors", _KNN_ALL)
def nearest_vectors(t: Tables) -> DataFrame:
    return _rounded(N.knn(*_all_vectors(t), dim=DIM))


@query("nearest_vectors_grid", _KNN_ALL)
def nearest_vectors_grid(t: Tables) -> DataFrame:
    """The same result by the block grid, the form for query sets too large to send around."""
    return _rounded(N.knn(*_all_vectors(t), dim=DIM, matrix_bytes=0, block_rows=200))


_VECTORS = """
    SELECT memory_id, embedding FROM embeddings JOIN (SELECT doc_id, memory_id FROM mail_docs
      UNION ALL SELECT doc_id, memory_id FROM video_docs) ON doc_id = vec_id"""
_QVECS = """
    SELECT i.query_id, e.embedding AS qv, doc_id % 250 = 0 AS full_scan FROM intents i
    JOIN embeddings e ON e.vec_id = i.doc_id // 50"""
_NEAR = f"""
    SELECT q.query_id, v.memory_id, {_L2.format(a='qv', b='v.embedding')} AS distance,
           {_COS.format(a='qv', b='v.embedding')} AS similarity,
           row_number() OVER (PARTITION BY q.query_id ORDER BY {_L2.format(a='qv', b='v.embedding')}, v.memory_id) AS rank
    FROM qvecs q JOIN vectors v ON q.full_scan OR EXISTS (SELECT 1 FROM found f WHERE f.query_id = q.query_id
      AND f.memory_id = v.memory_id) QUALIFY rank <= 20"""


@query(
    "vector_search",
    with_tables(
        "live",
        """SELECT query_id, memory_id, round(distance, 6) AS distance, round(similarity, 6) AS similarity, rank FROM near""",
        intents=_INTENTS, found=_FOUND, vectors=_VECTORS, qvecs=_QVECS, near=_NEAR,
    ),
)
def vector_search(t: Tables) -> DataFrame:
    asked = vector_intents(t)
    members, found = R.search_scopes(asked, t.searchable)
    return _rounded(P.vector_search(asked.join(members, "query_id", "left"), found, item_vectors(t), dim=DIM, by="scope"))


def _scopes_with_vectors(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Intents, their scopes, the results once per scope, and the nearest few of each intent; no intent is paired with its results."""
    asked = vector_intents(t).withColumn("full_faiss_scan", F.lit(False))
    members, found = R.search_scopes(asked, t.searchable)
    found = cut_lineage(found)
    near = P.vector_search(asked.join(members, "query_id", "left"), found, item_vectors(t), dim=DIM, by="scope")
    return asked, members, found, near.withColumnRenamed("rank", "vector_rank")


_NARROW = dict(
    intents=_INTENTS, found=_FOUND, vectors=_VECTORS, qvecs=_QVECS.replace("doc_id % 250 = 0", "false"), near=_NEAR,
    results="""SELECT f.*, n.distance, n.similarity, n.rank AS vector_rank FROM found f
               LEFT JOIN near n USING (query_id, memory_id)""",
)


def _quality_sql(intents_name: str, results_name: str) -> str:
    return f"""
    SELECT i.query_id, CASE WHEN coalesce(n, 0) = 0 THEN 'empty'
        WHEN NOT (list_contains(i.sources, 'all') OR len(i.sources) = 3) AND NOT list_has_any(i.sources, srcs) THEN 'empty'
        WHEN i.time_filter IS NOT NULL AND latest < i.time_filter::TIMESTAMP THEN 'weak'
        WHEN n < 2 THEN 'weak' WHEN top < 0.35 THEN 'weak' ELSE 'strong' END AS quality,
        coalesce(n, 0) AS result_count
    FROM {intents_name} i LEFT JOIN (SELECT query_id, count(*) AS n, list(DISTINCT source_type) AS srcs,
        max(created_at) AS latest, max(similarity) AS top FROM {results_name} GROUP BY query_id) USING (query_id)"""


_QUALITY = _quality_sql("intents", "results")


@query(
    "result_quality",
    with_tables("live", _QUALITY, **_NARROW),
)
def result_quality(t: Tables) -> DataFrame:
    asked, *rest = _scopes_with_vectors(t)
    return P.quality_of_scopes(asked, *rest)


@query(
    "reranked_results",
    with_tables(
        "live page_meta",
        """SELECT query_id, memory_id, final_score, row_number() OVER (PARTITION BY query_id
             ORDER BY score DESC, memory_id) AS final_rank FROM (SELECT *, round(score, 6) AS final_score FROM (
             SELECT r.query_id, r.memory_id, 0.40 * coalesce(1 / (1 + distance), 0)
             + 0.30 * least(1, ln(1 + dwell_time_seconds + watch_time_seconds) / ln(3601))
             + 0.20 * exp(-greatest((1707955200 - epoch_us(r.last_accessed_at) // 1000000) / 86400.0, 0) / 30)
             + 0.10 * coalesce(CASE r.source_type WHEN 'chrome' THEN least(1, dwell_time_seconds / (word_count / 200.0 * 60))
                                 WHEN 'youtube' THEN completion_rate END, 0) AS score
           FROM results r JOIN live l USING (memory_id) LEFT JOIN page_meta p USING (memory_id)))""",
        **_NARROW,
    ),
)
def reranked_results(t: Tables) -> DataFrame:
    _, *found = _scopes_with_vectors(t)
    details = t.engagement.join(t.page_meta.select("memory_id", "word_count"), "memory_id", "left")
    ranked = P.rerank_scopes(*found, details, F.lit("2024-02-15").cast("timestamp"))
    return ranked.select("query_id", "memory_id", F.round("final_score", 6).alias("final_score"), "final_rank")


@query(
    "attachment_check",
    with_tables(
        "live mail_meta",
        """SELECT i.query_id, i.fetch_attachment AND coalesce(has_any, false) AS fetch FROM intents i
           JOIN embeddings e ON e.vec_id = i.doc_id // 50
           LEFT JOIN (SELECT query_id, bool_or(m.has_attachments) AS has_any FROM (
               SELECT *, CASE WHEN count(vector_rank) OVER (PARTITION BY query_id) > 0 THEN vector_rank ELSE rank END AS pos
               FROM results) JOIN mail_meta m USING (memory_id) WHERE pos <= 3 GROUP BY query_id) USING (query_id)""",
        **_NARROW,
    ),
)
def attachment_check(t: Tables) -> DataFrame:
    asked, members, found, near = _scopes_with_vectors(t)
    # only the first three by either rank can count
    by_rank = R.expanded(members, found.filter("rank <= 3")).select("query_id", "memory_id", "rank", F.lit(None).cast("int").alias("vector_rank"))
    by_vector = near.filter("vector_rank <= 3").select("query_id", "memory_id", F.col("vector_rank").alias("rank"), "vector_rank")
    return P.attachment_hits(by_rank.unionByName(by_vector), asked, t.mail_meta)


@query(
    "answer_rows",
    with_tables(
        "live",
        """SELECT query_id, quality <> 'strong' AS no_results, result_count,
             CASE WHEN quality = 'strong' THEN 'Retrieved ' || result_count || ' candidate(s) for query: ''' || original_query || '''.'
             ELSE 'No results found for ''' || original_query || '''' ||
               CASE WHEN time_filter IS NULL THEN '' ELSE ' from around ' || time_filter END || ' across ' ||
               array_to_string(sources, ', ') || '. Broader filters were tried 3 times. Try a shorter keyword, drop the '
               || 'time limit, or check that the content was captured and processed.' END AS answer
           FROM judged JOIN intents USING (query_id)""",
        **_NARROW, judged=_QUALITY,
    ),
)
def answer_rows(t: Tables) -> DataFrame:
    asked, *rest = _scopes_with_vectors(t)
    states = asked.join(P.quality_of_scopes(asked, *rest), "query_id").withColumn(
        "no_results", F.col("quality") != "strong"
    )
    return P.answers(states)


_FIRST = "coalesce(nullif(regexp_extract(query_clean, '^\\s*(\\S+)', 1), ''), query_clean)"
_TIMED = "coalesce(time_filter, '') <> ''"
_OPEN = "(list_contains(sources, 'all') OR len(sources) = 3)"


def _widen_sql(source: str, extra: str = "") -> str:
    return f"""
    SELECT query_id, {extra} CASE WHEN attempt = 0 AND {_TIMED}
          THEN strftime(try_cast(time_filter AS TIMESTAMP) - INTERVAL 4 DAY, '%Y-%m-%dT%H:%M:%S')
        WHEN attempt = 1 THEN NULL ELSE time_filter END AS time_filter,
      CASE WHEN (attempt = 0 AND NOT {_TIMED} AND NOT {_OPEN}) OR attempt = 1 THEN {_ALL} ELSE sources END AS sources,
      CASE WHEN (attempt = 0 AND NOT {_TIMED} AND {_OPEN}) OR attempt = 1 THEN {_FIRST} ELSE query_clean END AS query_clean,
      skip OR attempt >= 2 AS skip, full_scan OR attempt >= 2 AS full_scan, attempt + 1 AS attempt
    FROM {source}"""


@query(
    "widened_intents",
    f"""WITH intents AS ({_INTENTS}), staged AS (SELECT * REPLACE (doc_id // 50 % 4 AS attempt,
          CASE WHEN doc_id % 700 = 50 THEN 'soon' ELSE time_filter END AS time_filter) FROM intents)
        SELECT query_id, time_filter, array_to_string(sources, ',') AS sources, query_clean, skip, full_scan,
               attempt::INTEGER AS attempt FROM ({_widen_sql('staged')})""",
)
def widened_intents(t: Tables) -> DataFrame:
    staged = intents_of(t).withColumn("attempt", (F.floor(F.col("doc_id") / 50) % 4).cast("int")).withColumn(
        "time_filter", F.when(F.col("doc_id") % 700 == 50, "soon").otherwise(F.col("time_filter"))
    )
    return P.widen(staged).select(
        "query_id", "time_filter", F.array_join("sources", ",").alias("sources"), "query_clean",
        F.col("skip_postgres_filter").alias("skip"), F.col("full_faiss_scan").alias("full_scan"), "attempt",
    )


def _retrieve_sql() -> str:
    """The widening loop unrolled: each round searches what the last one left open."""
    steps = {
        "vectors": _VECTORS,
        "r0_intents": f"SELECT i.*, e.embedding AS qv FROM ({_INTENTS}) i JOIN embeddings e ON e.vec_id = i.doc_id // 50",
    }
    for n in range(K.MAX_WIDEN_ATTEMPTS + 1):
        r = f"r{n}_"
        steps[r + "found"] = _found_sql(r + "intents")
        steps[r + "near"] = (
            _NEAR.replace("FROM qvecs q", f"FROM {r}intents q").replace("FROM found f", f"FROM {r}found f")
        )
        steps[r + "results"] = f"""
            SELECT query_id, memory_id, coalesce(f.source_type, l.source_type) AS source_type,
                   coalesce(f.created_at, l.created_at) AS created_at, n.similarity
            FROM {r}found f FULL JOIN (SELECT n.* FROM {r}near n SEMI JOIN live USING (memory_id)) n USING (query_id, memory_id)
            LEFT JOIN live l USING (memory_id)"""
        steps[r + "judged"] = _quality_sql(r + "intents", r + "results")
        steps[f"r{n + 1}_intents"] = (
            _widen_sql(f"(SELECT * FROM {r}intents SEMI JOIN (SELECT query_id FROM {r}judged WHERE quality <> 'strong') USING (query_id))", "doc_id, qv,")
        )
    parts = []
    for n in range(K.MAX_WIDEN_ATTEMPTS + 1):
        keep = "true" if n == K.MAX_WIDEN_ATTEMPTS else "quality = 'strong'"
        parts.append(
            f"SELECT query_id, quality, result_count, quality <> 'strong' AS no_results, {n} AS attempt FROM r{n}_judged WHERE {keep}"
        )
    return with_tables("live", " UNION ALL ".join(parts), **steps)


@query("retrieval_loop", _retrieve_sql())
def retrieval_loop(t: Tables) -> DataFrame:
    """Search, judge, widen, repeat; the state each intent ended in."""
    asked = vector_intents(t).withColumn("full_faiss_scan", F.lit(False))
    _, states = P.retrieve(asked, t.searchable, item_vectors(t), dim=DIM)
    return states.select("query_id", "quality", "result_count", "no_results", "attempt")


def replies(t: Tables) -> DataFrame:
    """Model replies for user turns: good, fenced, incomplete, and not JSON."""
    body = F.to_json(
        F.struct(
            F.array(F.lit("gmail")).alias("sources"), F.lit("2024-01-05").alias("time_filter"),
            F.lit(True).alias("fetch_attachment"), F.lit(False).alias("fetch_api"),
            F.substring("text", 1, 20).alias("query_clean"), F.lit(0).alias("scope_level"),
            F.lit(False).alias("is_ambiguous"), F.col("text").alias("original_query"),
            F.lit(False).alias("skip_postgres_filter"), F.lit(False).alias("full_faiss_scan"),
        )
    )
    kind = (F.col("conv_id") + F.col("turn")) % 4
    reply = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.replace(body, F.lit('"sources":["gmail"],'), F.lit("")))
        .otherwise(F.concat(F.lit("Sure! "), body))
    )
    return t.read("conversations").filter("role = 'user'").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("user_query"), reply.alias("reply")
    )


@query(
    "intent_normalization",
    f"""SELECT conv_id || '-' || turn AS query_id, kind < 2 AS is_parsed, kind >= 2 AS is_ambiguous,
          array_to_string(CASE WHEN kind < 2 THEN ['gmail'] ELSE {_ALL} END, ',') AS sources,
          CASE WHEN kind < 2 THEN '2024-01-05' END AS time_filter,
          CASE WHEN kind < 2 THEN substring(text, 1, 20) ELSE text END AS query_clean, text AS original_query
        FROM (SELECT *, (conv_id + turn) % 4 AS kind FROM conversations WHERE role = 'user')""",
)
def intent_normalization(t: Tables) -> DataFrame:
    return P.normalize_intents(replies(t)).select(
        "query_id", "is_parsed", "is_ambiguous", F.array_join("sources", ",").alias("sources"), "time_filter",
        "query_clean", "original_query",
    )


@query(
    "query_validation",
    """SELECT conv_id, turn, length(text) BETWEEN 1 AND 2000 AS is_valid FROM conversations""",
)
def query_validation(t: Tables) -> DataFrame:
    from ..functions.gates import valid_query

    return t.read("conversations").select("conv_id", "turn", valid_query(F.col("text")).alias("is_valid"))
