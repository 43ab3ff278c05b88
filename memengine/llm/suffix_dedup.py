"""Repeated passages by sparse suffix arrays.

1. A minimiser scheme picks suffixes by content: of every ``window`` neighbouring
   word n-grams the one with the least hash.  A passage of ``min_words`` words
   has its pick among its first ``window`` words wherever it stands, so its
   copies keep the same suffix, with ``min_words - window + 1`` words of the
   passage to the right of it at least.
2. The kept suffixes are sorted by that right context and neighbours compared: one
   whose neighbour agrees survives.
3. Survivors are extended: every left shift for which the suffix is still the pick
   gives a passage of exactly ``min_words`` words, left and right context
   together.  Those are sorted and compared again.  So each passage with a copy
   anywhere is found, not only those of the nearest neighbours, and runs of
   them are the whole repeats.

Both comparisons go through ``repeated``: a task sorts its own rows first and
sends one row per value, so a passage that stands in a third of all documents
sends as many rows as there are tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom, scratch
from .held import let_go
from .inputs import all_columns, prepared, shuffle_partitions, texts_by_id, unused
from .words import Words, blocked, mix, words_of

MIN_WORDS = 50
WINDOW = 20
GRAM = 8
ROWS_IN_TASK = 300_000
_PLACE = np.uint64((1 << 28) - 1)

Keyed = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def repeated(rows: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Keyed], parts: int) -> DataFrame:
    """(doc, at, first) of all places whose key stands elsewhere too; first marks the least (doc, at) of a key.

    ``keys`` turns the batches of a task into arrays (key, doc, at).
    """

    def local(held: list) -> pa.RecordBatch:
        key, doc, at = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((at, doc, key))
        key, doc, at = key[order], doc[order], at[order]
        new = np.r_[True, key[1:] != key[:-1]]
        starts = np.flatnonzero(new)
        many = np.repeat(np.diff(np.r_[starts, len(key)]) > 1, np.diff(np.r_[starts, len(key)]))
        place = np.where(new, key, mix(doc.view(np.uint64) + at.astype(np.uint64)))
        kind = np.where(new, many.astype(np.int8), np.int8(2))
        return pa.record_batch([pa.array(x) for x in (place.view(np.int64), key.view(np.int64), doc, at, kind)],
                               ["place", "key", "doc", "at", "kind"])

    def spread(batches):
        let_go()
        held, total = [], 0
        for item in keys(batches):
            held.append(item)
            total += len(item[0])
            if total > ROWS_IN_TASK:
                yield local(held)
                held, total = [], 0
        if total:
            yield local(held)

    def compare(batches):
        """Sorted by key, a row is repeated if a neighbour has its key or its own task had seen the key again."""
        let_go()
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, doc, at, kind = (table.column(c).to_numpy() for c in ("key", "doc", "at", "kind"))
        order = np.lexsort((at, doc, kind == 2, key))
        key, doc, at, kind = key[order], doc[order], at[order], kind[order]
        new = np.r_[True, (key[1:] != key[:-1]) | ((kind[1:] == 2) != (kind[:-1] == 2))]
        last = np.r_[new[1:], True]
        told = (kind > 0) | ~(new & last)
        first = new & (kind != 2)
        for low in range(0, len(key), 200_000):
            to = slice(low, low + 200_000)
            yield pa.record_batch([pa.array(x[to][told[to]]) for x in (doc, at, first)], ["doc", "at", "first"])

    sent = rows.mapInArrow(spread, "place bigint, key bigint, doc bigint, at int, kind tinyint")
    return sent.repartition(parts, "place").mapInArrow(compare, "doc bigint, at int, first boolean")


def picks(words: Words, min_words: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all passages of ``min_words`` words, the pick of each), as places among the words."""
    sizes = np.diff(words.first)
    counts = np.maximum(sizes - min_words + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.repeat(words.first[:-1] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(total)
    least = (words.grams(gram) & ~_PLACE) | np.arange(len(words.hashes), dtype=np.uint64)
    width = 1
    while width < window:
        step = min(width, window - width)
        least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
        width += step
    return starts, (least[starts] & _PLACE).astype(np.int64)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, at, first): every passage of ``min_words`` words, from word ``at`` on, that stands twice or more.

    Copies may be in one document or in several, and may overlap; first marks
    the copy with the least (doc_id, at).  Words are compared as they are;
    white space between them does not count.  Null, empty and shorter texts have
    none.  Ids: see ``inputs.texts_by_id``.  Other columns are ignored.
    """
    if not 1 <= window <= min_words - gram + 1:
        raise ValueError("a window and an n-gram must fit into a passage")
    prepared(docs.sparkSession)
    docs = texts_by_id(docs).filter("text is not null")
    right = min_words - window + 1

    def suffixes(batches) -> Keyed:
        for batch in blocked(batches, "text"):
            words = words_of(batch.column("text"))
            kept = np.unique(picks(words, min_words, window, gram)[1])
            ids = batch.column("doc_id").to_numpy()
            row = np.searchsorted(words.first, kept, side="right") - 1
            yield words.grams(right)[kept], ids[row], (kept - words.first[row]).astype(np.int32)

    bytes_of_text = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(docs), math.ceil(bytes_of_text / 60e6))
    survivors = scratch.saved(repeated(docs, suffixes, parts).select("doc", "at"), "suffixes")
    found = bloom.build(survivors, "doc")

    @F.arrow_udf("boolean")
    def worth(ids: pa.Array) -> pa.Array:
        return pa.array(bloom.may_hold(found, ids.to_numpy(zero_copy_only=False)))

    def passages(batches) -> Keyed:
        for batch in blocked(batches, "text"):
            words = words_of(batch.column("text"))
            starts, kept = picks(words, min_words, window, gram)
            listed = batch.column("survivors")
            owner = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
            alive = np.zeros(len(words.hashes) + 1, dtype=bool)
            alive[words.first[owner] + listed.flatten().to_numpy()] = True
            starts = starts[alive[kept]]
            row = np.searchsorted(words.first, starts, side="right") - 1
            yield words.grams(min_words)[starts], batch.column("doc_id").to_numpy()[row], (starts - words.first[row]).astype(np.int32)

    by_doc = survivors.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("at").alias("survivors"))
    extended = docs.filter(worth("doc_id")).join(by_doc, "doc_id").select("doc_id", "text", "survivors")
    return repeated(extended, passages, parts).select(F.col("doc").alias("doc_id"), "at", "first")


def spans(passages: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs of overlapping passages: doc_id, start_word, n_words, later_words (those with an earlier copy).

    One row per run.  A window sorts one document's passages at a time, no more than it has words.
    """
    by_place = Window.partitionBy("doc_id").orderBy("at")
    later_end = F.max(F.when(~F.col("first"), F.col("at") + min_words)).over(
        by_place.rowsBetween(Window.unboundedPreceding, -1)
    )
    marked = passages.select(
        "doc_id", "at", "first",
        (F.col("at") > F.coalesce(F.lag("at").over(by_place) + min_words, F.lit(-1))).cast("int").alias("opens"),
        F.when(
            ~F.col("first"), F.col("at") + min_words - F.greatest(F.col("at"), F.coalesce(later_end, F.lit(0)))
        ).otherwise(0).alias("fresh"),
    ).withColumn("run", F.sum("opens").over(by_place))
    return marked.groupBy("doc_id", "run").agg(
        F.min("at").cast("bigint").alias("start_word"),
        (F.max("at") + min_words - F.min("at")).cast("bigint").alias("n_words"),
        F.sum("fresh").cast("bigint").alias("later_words"),
    ).drop("run")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its columns, where only the first copy of each repeated passage is left in the texts.

    The first copy is the one of the least (doc_id, place).  If doc_ids are null or repeat, the rows are written out
    with a number each, and stand in this order instead; every row is a document of its own.
    The cut goes from the first word of a later copy up to the word behind it;
    what stands before and behind stays as it is.  A document of which no word
    is left goes.  Texts without repeats, null and empty ones too, are returned
    as they are.  ``n_chars``, if there is such a column, follows the text.
    """
    spark = prepared(docs.sparkSession)
    row, mark, own, places_ = unused(docs, "row", "worth", "id", "cuts")
    kept, given = all_columns(docs), F.col("doc_id").cast("bigint")
    if docs.select(given.alias("id")).groupBy("id").count().filter("id is null or count > 1").isEmpty():
        rows = docs.withColumn(row, given)
    else:
        rows = scratch.saved(docs.select(*kept, F.monotonically_increasing_id().alias(row)), "rows")
    passages = scratch.saved(repeats(rows.select(F.col(row).alias("doc_id"), "text"), min_words), "passages").filter(~F.col("first"))
    cuts = passages.groupBy(F.col("doc_id").alias(own)).agg(F.collect_list("at").alias(places_))
    found = bloom.build(passages, "doc_id")

    @F.arrow_udf("boolean")
    def worth(ids: pa.Array) -> pa.Array:
        return pa.array(bloom.may_hold(found, ids.to_numpy(zero_copy_only=False)))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for i in range(len(texts)):
            words = words_of(texts.slice(i, 1))
            gone = np.zeros(len(words.starts) + 1, dtype=np.int32)
            at = np.array(places[i].as_py(), dtype=np.int64)
            at = at[at + min_words <= len(words.starts)]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + min_words, -1)
            inside = np.cumsum(gone[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
            raw, parts, last = words.data.tobytes(), [], 0
            for low, high in zip(edge[::2], edge[1::2]):
                parts.append(raw[last : words.starts[low]])
                last = words.starts[high] if high < len(words.starts) else words.ends[-1]
            parts.append(raw[last:])
            out.append(None if inside.all() else b"".join(parts).decode())
        return pa.array(out, pa.string())

    del spark
    marked = rows.withColumn(mark, worth(F.col(row)))
    some = F.col(places_).isNotNull()
    changed = (
        marked.filter(F.col(mark)).join(cuts, F.col(row) == F.col(own), "left")
        .withColumn("text", F.when(some, cut(F.coalesce("text", F.lit("")), F.coalesce(places_, F.array().cast("array<int>")))).otherwise(F.col("text")))
        .filter(~some | F.col("text").isNotNull())
    )
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(some, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return changed.select(*kept).unionByName(marked.filter(~F.col(mark)).select(*kept))
