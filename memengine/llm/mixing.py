"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .inputs import all_columns, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
PERCENT = 150
MOST_COPIES = 2
BUCKETS = 8192
SEED = 20240


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def by_length(size: Column) -> Column:
    """Default appeal of a document: one more eighth for each doubling of its size; few distinct values."""
    return F.lit(1.0) + F.length(F.bin(size)) / 8.0


def _filled(share: Column, cap: Column, weight: Column, total: Column, within: Window, order: list[Column]) -> Column:
    """Level at which ``sum(least(cap, level * weight))`` is ``total``; the greatest of the window is meant.

    In the order of rising cap / weight, all before the row are capped and all from it on are not: that holds
    for the first row whose own cap is not below the level, and later rows give lower levels.
    """
    before = within.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    behind = within.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum(weight).over(behind)
    return F.when(share >= level, level)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, percent: float = PERCENT) -> DataFrame:
    """(source, source_size, target): words wanted of each source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``percent`` of all words; none wants more than ``MOST_COPIES`` times its
    size, and what is above goes to the others by weight.  One row per source
    is ranked in one task.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = totals.withColumn("weight", F.get(turn, place % len(weights))).select(
        "*",
        (F.lit(float(MOST_COPIES)) * F.col("source_size")).alias("cap"),
        (F.sum("source_size").over(everything) * (percent / 100.0)).alias("wanted"),
    )
    share = F.col("cap") / F.col("weight")
    level = _filled(
        share, F.col("cap"), F.col("weight"), F.col("wanted"), everything, [share, F.col("source").asc_nulls_last()]
    )
    return (
        weighed.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select(
            "source", "source_size",
            F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.lit(0.0)).alias("target"),
        )
    )


def mixture(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, percent: float = PERCENT, seed: int = SEED, appeal=by_length,
    row: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, source, size, source_size, target, copies, extra, taken.

    ``docs`` needs doc_id, source and text.  size counts words (null text: 0).
    A document is expected ``level * appeal(size)`` times, ``MOST_COPIES`` at
    most, where the level meets its source's target.  The whole part of that are
    certain copies.  The rest is its inclusion probability p: documents are
    ranked by ``u / (1 - u) / (p / (1 - p))``, u a hash of doc_id and seed, and
    taken in this order until the source has as many words as its target says;
    the last one gives only the words still missing (``extra``).  So ``taken``,
    ``copies * size + extra``, adds up to the rounded target of each source.

    Null sources are one source.  Rows of one doc_id are ranked alike and each
    counts; rows with a null doc_id share one hash.  Empty texts take 0 words.
    ``appeal`` should have few distinct values: one row per source and value is
    kept.  The ranking is cut at a bucket of ranks, so no task sorts a source.
    ``row`` names a column that tells rows apart and becomes row_id; without
    one, rows are numbered as they are read.  No rows: no rows.
    """
    sizes = scratch.saved(
        docs.select(
            (F.col(row) if row else F.monotonically_increasing_id()).alias("row_id"), F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"), word_count().alias("size"),
        ).withColumn("appeal", appeal(F.col("size")).cast("double")),
        "sizes",
    )
    targets = source_targets(sizes, weights, percent)
    levels = sizes.groupBy("source", "appeal").agg(F.sum("size").alias("words"))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    of_source = Window.partitionBy("key")
    known = levels.withColumn("key", key).join(targets.withColumn("key", key).drop("source"), "key")
    weight = F.col("appeal") * F.col("words")
    cap = F.lit(float(MOST_COPIES)) * F.col("words")
    level = _filled(F.lit(float(MOST_COPIES)) / F.col("appeal"), cap, weight, F.col("target"), of_source, [F.desc("appeal")])
    expected = scratch.saved(
        known.withColumn("_level", F.when(weight > 0, level))
        .withColumn("level", F.max("_level").over(of_source))
        .select(
            "key", "appeal", "source_size", "target",
            F.coalesce(F.least(F.lit(float(MOST_COPIES)), F.col("level") * F.col("appeal")), F.lit(0.0)).alias("expected"),
        ),
        "expected",
    )
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    share = F.col("expected") - F.col("copies")
    odds = (u / (1.0 - u)) / (share / (1.0 - share))
    ranked = (
        sizes.withColumn("key", key).join(expected, ["key", "appeal"])
        .withColumn("copies", F.floor("expected").cast("bigint"))
        .withColumn("rank", F.when((share > 0) & (F.col("size") > 0), odds))
        .withColumn("bucket", F.floor(F.col("rank") / (1.0 + F.col("rank")) * BUCKETS).cast("int"))
        .drop("appeal", "expected")
    )
    by_bucket = ranked.groupBy("key", "bucket").agg(
        F.sum(F.when(F.col("bucket").isNotNull(), F.col("size")).otherwise(0)).alias("words"),
        F.sum(F.col("copies") * F.col("size")).alias("certain"), F.first("target").alias("target"),
    )
    rows = Window.partitionBy("key")
    places = by_bucket.select(
        "key", "bucket", "words",
        (F.round("target").cast("bigint") - F.sum("certain").over(rows)).alias("missing"),
        F.coalesce(F.sum("words").over(rows.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    ).filter("bucket is not null").withColumn("missing", F.greatest("missing", F.lit(0)))
    edges = scratch.saved(
        places.filter("before < missing and before + words >= missing")
        .select("key", F.col("bucket").alias("edge"), (F.col("missing") - F.col("before")).alias("left")),
        "edges",
    )
    cut = ranked.join(edges, "key", "left")
    order = Window.partitionBy("key").orderBy("rank", "doc_id", "size", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.filter("bucket = edge").withColumn(
        "extra", F.least("size", F.greatest(F.lit(0), F.col("left") - F.coalesce(F.sum("size").over(order), F.lit(0))))
    )
    outside = cut.filter("bucket is null or edge is null or bucket <> edge").withColumn(
        "extra", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(0)
    )
    return (
        inside.unionByName(outside)
        .withColumn("extra", F.col("extra").cast("bigint"))
        .select(
            "row_id", "doc_id", "source", "size", "source_size", "target", "copies", "extra",
            (F.col("copies") * F.col("size") + F.col("extra")).alias("taken"),
        )
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its columns, each row as often as the mixture takes it, a last copy cut to the words it takes.

    Rows of which no word is taken go.  The cut keeps the text up to the end of
    its last word; ``n_chars``, if there is such a column, follows it.  If
    doc_ids are null or repeat, the rows are written out with a number first.
    """
    row, copies_, extra, size, words = unused(docs, "row", "copies", "extra", "size", "words")
    kept = all_columns(docs)
    ids = docs.select(F.col("doc_id").alias("id"))
    unique = ids.groupBy("id").count().filter("id is null or count > 1").isEmpty()
    marked = docs.select(*kept, (F.col("doc_id").cast("bigint") if unique else F.monotonically_increasing_id()).alias(row))
    if not unique:
        marked = scratch.saved(marked, "rows")
    shares = mixture(marked.select("doc_id", "source", "text", row), row=row, **options).filter("taken > 0").select(
        F.col("row_id").alias(row), F.col("copies").alias(copies_), F.col("extra").alias(extra), F.col("size").alias(size)
    )
    whole, none = F.lit(-1).cast("bigint"), F.array().cast("array<bigint>")
    rest = F.when(F.col(extra) == F.col(size), F.array(whole)).when(F.col(extra) > 0, F.array(extra)).otherwise(none)
    copies = F.concat(F.array_repeat(whole, F.col(copies_).cast("int")), rest)
    taken = marked.join(shares, row).withColumn(words, F.explode(copies))
    spaces = r"[\x20\x09-\x0D]*"
    # possessive: the JVM matches such a group in a loop, any other one by a call inside a call for each word
    pattern = F.concat(F.lit(f"^(?:{spaces}{WORD}){{"), F.col(words).cast("string"), F.lit("}+"))
    part = F.col(words) > 0
    taken = taken.withColumn("text", F.when(part, F.regexp_substr(F.col("text").cast("string"), pattern)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        taken = taken.withColumn("n_chars", F.when(part, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return taken.select(*kept)
