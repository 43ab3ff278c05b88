"""Stored postings for the phrase search: which items hold which eight characters.

A text gives the pieces that begin at every ``stride``-th of its characters.  A phrase
may stand anywhere in it, so it is looked up by its pieces at ``stride`` successive
offsets, of which one must have been stored, if it has ``PIECE + stride - 1`` characters
or more.  Three characters are in most long texts, and their lists
grow with the texts for every phrase asked; eight are in hardly any that does not hold the phrase.

The table is Parquet, partitioned by the piece.  Pieces and items stand in it as
numbers, hashes of themselves; equal hashes only name more items, and the check of the phrase drops
them.  Deltas append the pieces of new and changed texts and rewrite nothing.  Pieces
of texts that have changed stay until the table is built anew: they too only name
items that the check drops again, and no item is ever missed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded_broadcast, cut_lineage, shuffles_go
from .phrases import first_pieces, match_phrases, strided_pieces

PIECE = 8
STRIDE = 5  # phrases of 12 characters and more are found by postings
BUCKETS = 64
PARTS = 8
PART_BYTES = 64 << 20  # of text to a part, unless there would be more than PARTS
FEW_PIECES = 10_000  # as many pieces are named to the scan; beyond, their table is joined


def _bucket(buckets: int) -> Column:
    return F.pmod("piece", F.lit(buckets))


def append(items: DataFrame, text: Column, folder: str, key: str = "memory_id", buckets: int = BUCKETS, stride: int = STRIDE) -> None:
    """Add the pieces of ``items``.  ``buckets`` and ``stride`` are properties of the table and must stay the same.

    Pieces are several times their texts while they are dealt to the buckets, so large deltas are added in parts, ``PARTS`` at most, by
    a hash of the key: no more than a part is under way at a time, for as many reads of the texts.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = min(PARTS, math.ceil(size / PART_BYTES)) or 1
    for part in range(parts):
        some = items.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == part) if parts > 1 else items
        rows = some.select(F.hash(key).alias("item"), F.explode(strided_pieces(lowered, PIECE, stride)).alias("piece"))
        rows = rows.withColumn("piece", F.hash("piece"))
        # a bucket may hold a frequent piece, so its rows are dealt over some tasks by item
        dealt = rows.repartition(_bucket(buckets), F.pmod("item", F.lit(4))).withColumn("bucket", _bucket(buckets))
        with shuffles_go(items.sparkSession):
            dealt.sortWithinPartitions("bucket", "piece", "item").write.mode("append").partitionBy("bucket").parquet(folder)


def match(
    df: DataFrame, text: Column, phrases: DataFrame, keep: list[str], folder: str, buckets: int = BUCKETS, stride: int = STRIDE
) -> DataFrame:
    """Rows (``keep``, ``phrase``) as ``phrases.match_phrases`` gives them, by way of the stored postings of ``df``'s texts.

    ``keep[0]`` is the key the postings were made with.  Only texts of the items that the postings of a phrase's
    pieces name are looked at.  Phrases too short for the table's stride are searched in all texts.
    Every text of ``df`` must have been appended.
    """
    spark = df.sparkSession
    wanted = cut_lineage(phrases.select(F.lower("phrase").alias("phrase")).filter("phrase <> ''").distinct())
    long = F.char_length("phrase") >= PIECE + stride - 1
    asked = wanted.filter(long).select("phrase", F.explode(first_pieces(F.col("phrase"), PIECE, stride)).alias("piece")).withColumn("piece", F.hash("piece"))
    asked = cut_lineage(asked.withColumn("bucket", _bucket(buckets)))
    named = asked.select("piece", "bucket").distinct().limit(FEW_PIECES + 1).collect()
    stored = spark.read.schema("item INT, piece INT, bucket INT").parquet(folder)
    if len(named) <= FEW_PIECES:
        stored = stored.filter(F.col("bucket").isin(sorted({r["bucket"] for r in named})) & F.col("piece").isin([r["piece"] for r in named]))
    found = stored.join(bounded_broadcast(asked), ["piece", "bucket"]).select("phrase", "item").distinct()
    rows = df.select(*keep, F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
    hits = rows.withColumn("item", F.hash(keep[0])).join(found, "item").filter(F.contains("_text", "phrase")).select(*keep, "phrase")
    short = wanted.filter(~long)
    return hits if short.isEmpty() else hits.unionByName(match_phrases(df, text, short, keep))
