"""Line-first cleaning with column functions only: bad lines go, then documents that lose too much.

The counts of a document (``base_counts``) are computed beside it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memengine.functions.core import let

from .inputs import all_columns

WORD = r"[^\x20\x09-\x0D]"
GRAM = 5
MOST_REPEATED = 20  # percent of words in repeated windows
FEWEST_WORDS = 10
LEAST_KEPT = 50  # percent of words that must be left

# Phrases that mark boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "cookie settings", "enable javascript", "lorem ipsum",
    "log in", "privacy policy", "read more", "sign up", "skip to content", "subscribe to our newsletter",
    "terms of service", "terms of use", "we use cookies",
)
# What may end a sentence, and what may stand behind it.
_ENDS = r"[.!?…。！？:;][\"'’”»)\]]*$"
_SEPARATORS = r"[|»›•·]"
_SYMBOL = r"[#*$%&|<>]"
_SMALL, _CAPITAL = r"\p{Ll}", r"\p{Lu}"


def words_of(text: Column) -> Column:
    """Words of a text that is not null; white space alone gives none."""
    return F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0))


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def measured_lines(lines: Column, symbols: Column, separators: Column) -> Column:
    """Lines as structs: line, bare (without white space around it), n (words), symbols, separators.

    The two flags tell whether the text has such characters at all; if not, no line is searched for them.
    """

    def measure(line: Column) -> Column:
        return F.struct(
            line.alias("line"), F.btrim(line, F.lit(" \t\x0b\x0c\r")).alias("bare"),
            F.regexp_count(line, F.lit(f"{WORD}+")).alias("n"),
            F.when(symbols, F.regexp_count(line, F.lit(_SYMBOL))).otherwise(0).alias("symbols"),
            F.when(separators, F.regexp_count(line, F.lit(_SEPARATORS))).otherwise(0).alias("separators"),
        )

    return F.transform(lines, measure)


def has_boilerplate(text: Column) -> Column:
    return let(F.lower(text), lambda t: reduce(or_, [t.contains(phrase) for phrase in BOILERPLATE]))


def line_passes(line: Column, boilerplate: Column) -> Column:
    """The rules of one measured line: punctuation, navigation, boilerplate, symbols, shouting.

    * it ends a sentence, or is a heading of at most five words without separators;
    * fewer than three separators, and not one for every four words;
    * no boilerplate phrase (searched for only where ``boilerplate`` says that the text has one);
    * at most one symbol for ten words;
    * not in capitals throughout, if it has three words or more.
    """
    bare, n, symbols, separators = (line[c] for c in ("bare", "n", "symbols", "separators"))
    return (
        (separators < 3) & (separators * 4 <= n) & (symbols * 10 <= n)
        & (((n <= 5) & (separators == 0)) | bare.rlike(_ENDS))
        & ~((n >= 3) & ~bare.rlike(_SMALL) & bare.rlike(_CAPITAL))
        & ~F.when(boilerplate, has_boilerplate(bare)).otherwise(False)
    )


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the array ``lines``.

    n_repeat_words counts the words covered by five-word windows that stand twice or more in the text.
    The windows are compared by hash: one pass over a primitive array tells the texts without repeats, and
    only the others sort their windows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    step = docs.withColumn("_text", text).withColumn("_words", words_of(F.col("_text"))).withColumn("lines", lines_of(F.col("_text")))
    n = F.size("_words")
    window = lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(GRAM)])
    hashes = F.when(n >= GRAM, F.transform(F.sequence(F.lit(0), n - GRAM), window)).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumn("_hashes", hashes).withColumn("_twice", F.size("_hashes") > F.size(F.array_distinct("_hashes")))
    pairs = F.when(F.col("_twice"), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.withColumn("_pairs", pairs)

    def place(pair: Column, j: Column) -> Column:
        beside = [F.get(F.col("_pairs"), j + d)["h"] == pair["h"] for d in (-1, 1)]
        return F.when(F.coalesce(beside[0], F.lit(False)) | F.coalesce(beside[1], F.lit(False)), pair["i"])

    places = F.sort_array(F.filter(F.transform("_pairs", place), lambda p: p.isNotNull()))
    step = step.withColumn("_places", F.when(F.col("_twice"), places))
    covered = F.aggregate(
        F.transform("_places", lambda p, j: F.least(F.lit(GRAM), F.coalesce(F.get(F.col("_places"), j + 1) - p, F.lit(GRAM)))),
        F.lit(0), lambda total, x: total + x,
    )
    t = F.col("_text")
    return (
        step.withColumn("n_words", n.cast("bigint"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("bigint"))
        .withColumn("n_symbols", F.regexp_count(t, F.lit(_SYMBOL)).cast("bigint"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"))
        .withColumn("n_repeat_words", F.when(F.col("_twice"), covered).otherwise(0).cast("bigint"))
        .drop("_text", "_words", "_hashes", "_twice", "_pairs", "_places")
    )


def cleaned(docs: DataFrame, least_kept: int = LEAST_KEPT) -> DataFrame:
    """``docs`` with the base counts, clean_text, n_clean_words, base_failed and kept.

    clean_text joins the lines that pass.  base_failed: fewer than 10 words, or more than 20 % of the
    words in repeated windows.  kept: not base_failed, and the lines that pass hold at least
    ``least_kept`` percent of the words, and at least 10.

    A null, empty or blank text has zero counts, an empty clean_text and fails.  Rows are judged one by
    one: repeated rows and null ids change nothing, other columns pass through, and columns of the
    new names are replaced.  No rows: no rows.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "n_clean_words", "base_failed", "kept"]
    kept = all_columns(docs.drop(*new))
    counted = base_counts(docs.select(F.struct(*kept).alias("doc"), "text"))  # whatever the columns, none clashes with those of the counting
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    flags = F.struct(
        (F.col("n_symbols") > 0).alias("symbols"), text.rlike(_SEPARATORS).alias("separators"),
        has_boilerplate(text).alias("boilerplate"),
    )

    def passing_lines(flag: Column) -> Column:
        lines = measured_lines(F.col("lines"), flag["symbols"], flag["separators"])
        return F.filter(lines, lambda line: line_passes(line, flag["boilerplate"]))

    # bound by let: an optimizer that moved the flags into the lambdas would search the text once per line
    passing = counted.withColumn("_passing", let(flags, passing_lines))
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    judged = (
        passing.withColumn("clean_text", F.array_join(F.col("_passing")["line"], "\n"))
        .withColumn("n_clean_words", F.aggregate(F.col("_passing")["n"], F.lit(0), lambda total, x: total + x).cast("bigint"))
        .withColumn("base_failed", (n < FEWEST_WORDS) | (100 * repeats > MOST_REPEATED * n))
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_clean_words") >= FEWEST_WORDS) & (100 * F.col("n_clean_words") >= least_kept * n))
    )
    return judged.select("doc.*", *new)
