"""Structured search of a table of intents over the item view.

Equal intents share one *scope* (phrase, lower time bound, sources), searched
once.  Scopes with a phrase start from the phrase search and are joined on
(phrase, source).  Scopes without one ("browse") would match most items, so
they use ranked time nodes: the bounds asked for cut time into spans, of each
span only the best rows are kept, and the spans are the leaves of a binary tree
in which "from bound x on" is a handful of nodes.  Beyond ``FEW_BOUNDS`` the
leaves are hours.  Both ways are equi-joins; neither pairs every intent with
every item.

Items are numbered in the order of results first (``placed``).  All the rows that the
search finds, sorts and ranks are two numbers, scope and place; the columns of an item
are joined to the rows that are left.

The result is factorized: results once per scope, and the queries of each scope
beside them (``search_scopes``).  ``expanded`` pairs them, salted where many
queries share a scope.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import gates
from ..functions.core import places_below, strip
from ..runtime import beside, cut_lineage, listed, lookup_join, top_per_group, within, wide_tasks
from .phrases import match_phrases

HOUR_BITS = 24  # 2^24 hours after 1970, almost two thousand years
FEW_BOUNDS = 50_000  # distinct lower time bounds that go along with each item
HOT_SCOPE = 1_000  # queries of one scope beyond which their pairs are salted
FEW_SCOPES = 5_000  # a scope makes at most 3 x 24 node rows, so a broadcast stays under 360,000 slim rows
_SEPARATOR = "\x1f"


def search_text(title: Column, keywords: Column) -> Column:
    return F.concat_ws(_SEPARATOR, title, F.array_join(keywords, _SEPARATOR))


def order_by_access() -> list[Column]:
    return [F.col("last_accessed_at").desc_nulls_last(), F.col("memory_id")]


def scoped(intents: DataFrame) -> DataFrame:
    """Intents with ``scope``, ``phrase``, ``since`` and opened ``sources``.

    A time filter that is no timestamp finds nothing, so its intent is left out.
    ``since_exclusive`` (optional column) asks for strictly later items.
    """
    skip = F.coalesce(F.col("skip_postgres_filter"), F.lit(False))
    given = F.coalesce(F.col("time_filter"), F.lit("")) != ""
    parsed = F.try_to_timestamp(F.col("time_filter"))
    everything = F.array(*[F.lit(s) for s in K.SOURCES])
    base = (
        intents.withColumn("_bad", ~skip & given & parsed.isNull())
        .filter(~F.col("_bad"))
        .withColumn("phrase", F.when(skip, "").otherwise(F.lower(strip(F.coalesce("query_clean", F.lit(""))))))
        .withColumn("since", F.when(~skip & given, parsed))
        .withColumn(
            "sources",
            F.sort_array(F.when(skip, everything).otherwise(gates.effective_sources(F.col("sources")))),
        )
        .drop("_bad")
    )
    if "since_exclusive" in intents.columns:
        later = F.timestamp_micros(F.unix_micros("since") + 1)
        base = base.withColumn(
            "since", F.when(F.coalesce("since_exclusive", F.lit(False)), later).otherwise(F.col("since"))
        )
    return base.withColumn("scope", F.sha2(F.to_json(F.struct("phrase", "since", "sources")), 256))


def _by_phrase(scopes: DataFrame, items: DataFrame, few: bool) -> DataFrame:
    text = search_text(F.col("title"), F.col("auto_keywords"))
    hits = match_phrases(items, text, scopes.select("phrase"), ["place", "source_type", "created_at"])
    placed = scopes.select("scope", "phrase", "since", F.explode("sources").alias("source_type"))
    joined = lookup_join(hits, placed, ["phrase", "source_type"], few, salt_by="place")
    return joined.filter(F.col("since").isNull() | (F.col("created_at") >= F.col("since"))).select("scope", "place")


def _hour(ts: Column) -> Column:
    """Hour as a leaf of the tree, 1970 in its middle.  Times beyond its ends share the outermost leaf.

    That loses nothing: the leaf of a bound is always compared row by row.
    """
    hour = F.floor(F.unix_micros(ts) / F.lit(3_600_000_000)).cast("bigint") + F.lit(1 << (HOUR_BITS - 1))
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit((1 << HOUR_BITS) - 1).cast("bigint"), hour))


def _shift(number: Column, bits: Column) -> Column:
    return F.call_function("shiftright", number, bits)


def _later_nodes(leaf: Column, bits: int) -> Column:
    """Tree nodes that together hold exactly the leaves after ``leaf``."""
    levels = F.filter(
        F.sequence(F.lit(0), F.lit(bits - 1)),
        lambda b: _shift(leaf, b).bitwiseAND(F.lit(1)) == 0,
    )
    return F.transform(
        levels,
        lambda b: F.struct(b.alias("level"), (_shift(leaf, b) + 1).alias("node")),
    )


def _root(bits: int) -> Column:
    return F.array(F.struct(F.lit(bits).alias("level"), F.lit(0).cast("bigint").alias("node")))


def _nodes_of(leaf: Column, bits: int) -> Column:
    inner = F.transform(
        F.sequence(F.lit(0), F.lit(bits - 1)),
        lambda b: F.struct(b.alias("level"), _shift(leaf, b).alias("node")),
    )
    return F.concat(inner, _root(bits))


def _browse(scopes: DataFrame, items: DataFrame, limit: int, few: bool) -> DataFrame:
    """Candidates per browse scope: a superset of its ``limit`` best rows."""
    at = scopes.filter("since IS NOT NULL").select(F.unix_micros("since").alias("at")).distinct().limit(FEW_BOUNDS + 1)
    bounds = listed(at, "_bounds")
    number = bounds.select(F.size("_bounds")).first()[0]
    if number > FEW_BOUNDS:
        return _browse_by_hour(scopes, items, limit, few)
    bits = max(1, number.bit_length())
    # an item's leaf is the number of bounds that it meets; one without a time meets none
    leaf = lambda ts: F.coalesce(F.when(F.col(ts).isNotNull(), places_below(F.col("_bounds"), F.unix_micros(ts))), F.lit(0)).cast("bigint")
    slim = beside(items.select("place", "source_type", "created_at"), bounds, "place").select("place", "source_type", leaf("created_at").alias("leaf"))
    best = top_per_group(slim, ["source_type", "leaf"], [F.col("place")], limit).drop("rank")
    placed = beside(scopes.select("scope", "since", F.explode("sources").alias("source_type")), bounds, "scope")
    placed = placed.withColumn("_leaf", leaf("since")).drop("_bounds")
    from_bound = F.when(F.col("since").isNull(), _root(bits)).otherwise(_later_nodes(F.col("_leaf") - 1, bits))
    return _by_nodes(best.withColumn("n", F.explode(_nodes_of(F.col("leaf"), bits))).drop("leaf"), placed, from_bound, limit, few)


def _by_nodes(spread: DataFrame, placed: DataFrame, cover: Column, limit: int, few: bool) -> DataFrame:
    """Rows at tree nodes to the scopes whose ``cover`` names these nodes, the ``limit`` best of each node."""
    keys = ["source_type", "level", "node"]
    covers = placed.select("scope", "source_type", F.explode(cover).alias("n")).select("scope", "source_type", "n.level", "n.node")
    needed = covers.select(*keys).distinct()
    at_nodes = lookup_join(spread.select("place", "source_type", "n.level", "n.node"), needed, keys, few, salt_by="place")
    ranked = top_per_group(at_nodes, keys, [F.col("place")], limit)
    return lookup_join(ranked.drop("rank"), covers, keys, few, salt_by="place").select("scope", "place")


def _browse_by_hour(scopes: DataFrame, items: DataFrame, limit: int, few: bool) -> DataFrame:
    """The same with hours as leaves, for any number of bounds; the hour of a bound is compared row by row."""
    slim = items.select("place", "source_type", "created_at")
    placed = scopes.select("scope", "since", F.explode("sources").alias("source_type"))
    cover = F.when(F.col("since").isNull(), _root(HOUR_BITS)).otherwise(_later_nodes(_hour(F.col("since")), HOUR_BITS))
    later = _by_nodes(slim.withColumn("n", F.explode(_nodes_of(_hour(F.col("created_at")), HOUR_BITS))), placed, cover, limit, few)
    edge = placed.filter("since IS NOT NULL").withColumn("_hour", _hour(F.col("since")))
    same_hour = lookup_join(
        slim.withColumn("_hour", _hour(F.col("created_at"))), edge, ["source_type", "_hour"], few, salt_by="place"
    ).filter(F.col("created_at") >= F.col("since"))
    return later.unionByName(same_hour.select("scope", "place"))


def placed(items: DataFrame) -> DataFrame:
    """Items with ``place``, a number that grows in the order of results, in partitions of which each holds a stretch of it."""
    order = order_by_access()
    dealt = items.repartitionByRange(wide_tasks(items.sparkSession), *order).sortWithinPartitions(*order)
    return cut_lineage(dealt.withColumn("place", F.monotonically_increasing_id()))


def best_places(intents: DataFrame, view: DataFrame, limit: int = K.SEARCH_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(query_id, scope) of all intents, (scope, place, rank) once per scope, and the live items with ``place``."""
    live = placed(
        view.filter(gates.is_live_enriched(F.col("is_deleted"), F.col("preprocessed"))).select(
            "memory_id", "source_type", "title", "auto_keywords", "created_at", "last_accessed_at"
        )
    )
    asked = cut_lineage(scoped(intents).select("query_id", "scope", "phrase", "since", "sources"))  # read several times below
    distinct = asked.select("scope", "phrase", "since", "sources").dropDuplicates(["scope"])
    scopes = cut_lineage(distinct.withColumn("number", F.monotonically_increasing_id()))
    members = asked.select("query_id", "scope").join(scopes.select("scope", "number"), "scope").select("query_id", F.col("number").alias("scope"))
    scopes = scopes.drop("scope").withColumnRenamed("number", "scope")
    few = within(scopes, FEW_SCOPES)
    found = _by_phrase(scopes.filter("phrase <> ''"), live, few).unionByName(
        _browse(scopes.filter("phrase = ''"), live, limit, few)
    )
    return members, top_per_group(found, ["scope"], [F.col("place")], limit), live


def _with_items(results: DataFrame, live: DataFrame) -> DataFrame:
    details = live.select("place", "memory_id", "source_type", "created_at", "last_accessed_at")
    return results.join(details, "place").select(results.columns[0], *details.columns[1:], "rank")


def search_scopes(intents: DataFrame, view: DataFrame, limit: int = K.SEARCH_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(query_id, scope) of all intents, and (scope, memory_id, source_type, created_at, last_accessed_at, rank) once per scope.

    ``view``: the searchable columns of the items (see ``views.searchable``); the
    wide view does too, but joining details to the few results is cheaper.
    """
    members, best, live = best_places(intents, view, limit)
    return members, _with_items(best, live)


def expanded(members: DataFrame, results: DataFrame, key: str = "scope") -> DataFrame:
    """Each query with the results of its scope.  Where queries share a scope in great numbers they are dealt over salts."""
    hot = not members.groupBy(key).count().filter(F.col("count") > HOT_SCOPE).isEmpty()
    pairs = lookup_join(members, results, [key], few=False, salt_by="query_id") if hot else members.join(results, key)
    return pairs.drop(key)


def search(intents: DataFrame, view: DataFrame, limit: int = K.SEARCH_LIMIT) -> DataFrame:
    """(query_id, memory_id, source_type, created_at, last_accessed_at, rank), latest access first; see ``search_scopes``."""
    members, best, live = best_places(intents, view, limit)
    return _with_items(expanded(members, best).select("query_id", "place", "rank"), live)


def after_anchor(
    anchors: DataFrame, view: DataFrame, limit: int = K.SEARCH_LIMIT
) -> DataFrame:
    """Per query: find its anchor item, then the items created after it.

    ``anchors``: query_id, anchor_phrase, plus the intent columns of the second
    step.  The anchor is the latest item whose title or keywords hold the phrase.
    """
    live = view.filter(gates.is_live_enriched(F.col("is_deleted"), F.col("preprocessed")))
    wanted = anchors.select(F.lower(strip(F.col("anchor_phrase"))).alias("phrase"), "query_id")
    hits = match_phrases(
        live, search_text(F.col("title"), F.col("auto_keywords")), wanted.select("phrase"),
        ["memory_id", "created_at"],
    )
    latest = hits.groupBy("phrase").agg(F.max("created_at").alias("_anchor"))
    timed = (
        anchors.withColumn("phrase", F.lower(strip(F.col("anchor_phrase"))))
        .join(latest, "phrase")
        .withColumn("time_filter", F.date_format("_anchor", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .withColumn("since_exclusive", F.lit(True))
        .drop("phrase", "_anchor", "anchor_phrase")
    )
    return search(timed, view, limit)


def candidate_text() -> Column:
    return F.concat_ws(_SEPARATOR, "title", "raw_text", "subject", "sender")


def candidates(
    queries: DataFrame, view: DataFrame, limit: int = K.CANDIDATE_LIMIT, match: Callable[..., DataFrame] = match_phrases
) -> DataFrame:
    """Live items whose title, text, subject or sender holds the phrase, latest access first.

    ``queries``: query_id, query.  Whole texts are searched, or found by stored postings of ``candidate_text``
    with ``match=functools.partial(postings.match, folder=..)``.
    """
    wanted = queries.select("query_id", F.lower("query").alias("phrase"))
    hits = match(view, candidate_text(), wanted.select("phrase"), ["memory_id", "last_accessed_at", "created_at"])
    order = [
        F.col("last_accessed_at").desc_nulls_last(), F.col("created_at").desc(), F.col("memory_id")
    ]
    return expanded(wanted, top_per_group(hits, ["phrase"], order, limit), "phrase")
