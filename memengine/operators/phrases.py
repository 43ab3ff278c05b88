"""Substring search of many phrases over a text column, without a cross join.

Every phrase is filed under one of its pieces, its anchor, the rarest one.  A text
can only hold a phrase whose anchor is among the pieces of the text, so an
equi-join on the piece finds the candidates and ``contains`` settles them.  Pieces
have three characters, those of phrases of eight and more have eight: three are in
most long texts, and eight in hardly any that does not hold the phrase.  Phrases of twelve
and more need no more than every fifth piece of a text: one of their first five pieces begins there,
so they are filed under all five.  Nothing leaves the JVM and no phrase passes through the driver's
code, however many there are.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let
from ..runtime import beside, bounded_broadcast, cut_lineage, listed, lookup_join

PIECE = 3
FEW_PHRASES = 100_000
FEW_BYTES = 32 << 20
LONG_PIECE = 8
STRIDE = 5  # of texts, pieces of eight at every fifth character are enough for phrases of twelve and more
FEW_ANCHORS = 16_384  # so few are compared with a text's pieces before these become rows
FEW_SHORT = 64  # so few phrases are looked for one by one, which is less than cutting a text into pieces


def _pieces(text: Column) -> Column:
    """Distinct pieces of one to three characters.

    The lookahead walks the text once; cutting substrings by position would
    walk it once per position.
    """
    longest = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{PIECE}}}))"), 1))

    def shorter(found: Column, n: int) -> Column:
        return F.array_distinct(F.transform(found, lambda p: F.left(p, F.lit(n))))

    return let(longest, lambda p: F.array_distinct(F.concat(p, *[shorter(p, n) for n in range(1, PIECE)])))


def whole_pieces(text: Column, length: int = PIECE) -> Column:
    """Pieces of full length, repeats included."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{length}}}))"), 1)


def first_pieces(phrase: Column, length: int = LONG_PIECE, stride: int = STRIDE) -> Column:
    """The pieces of a phrase of which ``strided_pieces`` of a text that holds it has one, if it is long enough for the stride."""
    return F.array_distinct(F.slice(whole_pieces(phrase, length), 1, stride))


def strided_pieces(text: Column, length: int = LONG_PIECE, stride: int = STRIDE) -> Column:
    """Distinct pieces of full length that begin at every ``stride``-th character."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{length}}})).{{{stride}}}"), 1))


def _phrase_pieces(phrases: DataFrame, length: int = PIECE) -> DataFrame:
    whole = F.array_distinct(whole_pieces(F.col("phrase"), length))
    short = F.char_length("phrase") < length
    return phrases.select("phrase", F.explode(F.when(short, F.array("phrase")).otherwise(whole)).alias("_piece"))


def _anchors(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """Each phrase with the rarest of its pieces by ``counts`` (_piece, _n)."""
    rated = pieces.join(counts, "_piece", "left")
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_piece"))
    return rated.groupBy("phrase").agg(rarest.alias("_a")).select("phrase", "_a._piece")


def match_phrases(
    df: DataFrame, text: Column, phrases: DataFrame, keep: list[str], few: int = FEW_PHRASES
) -> DataFrame:
    """Rows (``keep``, ``phrase``): each row of ``df`` with each phrase its text contains.

    ``phrases`` has one column ``phrase``; matching is case-insensitive, blank
    phrases match nothing.  ``keep[0]`` is the key of ``df``, unique and not null.

    Up to ``few`` phrases (and ``FEW_BYTES``) the pieces asked for are broadcast and one pass over the rows does
    everything, or one for the short, one for the long and one for the longer phrases, if there are more of the first two
    than can be looked for one by one.  Rarity is that among the phrases.
    Few anchors go along with each row, and only pieces that are anchors become rows.
    Beyond, rarity is counted over the texts, and only keys and pieces that are
    anchors move to the join, which salts frequent pieces.
    """
    wanted = cut_lineage(phrases.select(F.lower("phrase").alias("phrase")).filter("phrase <> ''").distinct())
    rows = df.select(*keep, F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
    length = F.char_length("phrase")
    short, far = length < LONG_PIECE, length >= LONG_PIECE + STRIDE - 1
    counts = [F.count("*").alias("n"), F.count_if(short).alias("short"), F.count_if(far).alias("far")]
    size = wanted.agg(*counts, F.sum(F.octet_length("phrase")).alias("bytes")).first()
    if size["n"] <= few and (size["bytes"] or 0) <= FEW_BYTES:
        n_long, ways = size["n"] - size["short"] - size["far"], []
        if size["short"] + n_long <= FEW_SHORT:
            near = wanted.filter(~far)
            ways.append(_strided_hits(rows, wanted.filter(far), near) if size["far"] else _short_hits(rows, near))
        else:
            few_short = size["short"] <= FEW_SHORT
            ways.append(_short_hits(rows, wanted.filter(short)) if few_short else _hits(rows, wanted.filter(short), PIECE))
            if n_long:
                ways.append(_hits(rows, wanted.filter(~short & ~far), LONG_PIECE))
            if size["far"]:
                ways.append(_strided_hits(rows, wanted.filter(far)))
        hits = reduce(DataFrame.unionByName, ways)
    else:
        asked = _phrase_pieces(wanted)
        placed = rows.select(F.col(keep[0]).alias("_row"), F.explode(_pieces(F.col("_text"))).alias("_piece"))
        anchors = _anchors(asked, placed.groupBy("_piece").agg(F.count("*").alias("_n")))
        in_use = placed.join(bounded_broadcast(anchors.select("_piece").distinct()), "_piece", "left_semi")
        pairs = lookup_join(in_use, anchors, ["_piece"], few=False, salt_by="_row").select("_row", "phrase")
        hits = rows.join(pairs, F.col(keep[0]) == F.col("_row"))
    return hits.filter(F.contains("_text", "phrase")).select(*keep, "phrase")


def _one_by_one(phrases: DataFrame) -> Column:
    """Those of a handful of phrases that ``_text`` contains."""
    wanted = F.from_json(F.lit(json.dumps(sorted(r[0] for r in phrases.limit(FEW_SHORT).collect()))), "array<string>")
    return F.filter(wanted, lambda p: F.contains("_text", p))


def _short_hits(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """Rows with each of a handful of phrases that their text contains."""
    return rows.withColumn("phrase", F.explode(_one_by_one(phrases)))


def _strided_hits(rows: DataFrame, phrases: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Rows with each phrase their text contains, found by every ``STRIDE``-th piece; with those of ``near``, looked for one by one, in the same pass."""
    asked = phrases.select("phrase", F.explode(first_pieces(F.col("phrase"))).alias("_piece"))
    looked_up = strided_pieces(F.col("_text"))
    if near is not None:
        mark = F.lit(" " * (LONG_PIECE + 1))  # longer than any piece
        asked = asked.unionByName(near.select("phrase", F.concat(mark, "phrase").alias("_piece")))
        looked_up = F.concat(looked_up, F.transform(_one_by_one(near), lambda p: F.concat(mark, p)))
    found = rows.withColumn("_piece", F.explode(looked_up)).join(F.broadcast(asked), "_piece")
    # a text may have several pieces of a phrase: it counts by that of the phrase's first place in the text
    offset = F.pmod(1 - F.position("phrase", "_text"), F.lit(STRIDE))
    own = (F.char_length("_piece") > LONG_PIECE) | (F.col("_piece") == F.substring("phrase", offset + 1, F.lit(LONG_PIECE)))
    return found.filter(F.contains("_text", "phrase") & own).drop("_piece")


def _hits(rows: DataFrame, phrases: DataFrame, length: int) -> DataFrame:
    """Rows with each phrase whose anchor, of ``length`` characters unless the phrase has fewer, is in their text."""
    asked = _phrase_pieces(phrases, length)
    anchors = _anchors(asked, asked.groupBy("_piece").agg(F.count("*").alias("_n")))
    used = listed(anchors.select("_piece").distinct().limit(FEW_ANCHORS + 1), "_used")
    number, shortest = used.select(F.size("_used"), F.array_min(F.transform("_used", F.char_length))).first()
    found = _pieces(F.col("_text")) if number and shortest < length else whole_pieces(F.col("_text"), length)
    if number <= FEW_ANCHORS:
        rows = beside(rows, used, rows.columns[0])
        found = F.array_intersect(found, F.col("_used"))
    else:
        found = F.array_distinct(found)
    return rows.withColumn("_piece", F.explode(found)).drop("_used").join(F.broadcast(anchors), "_piece").drop("_piece")
