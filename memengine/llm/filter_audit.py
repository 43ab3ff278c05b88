"""What each of several filters does in each order they may stand in, by sorted posting lists.

Each filter is judged once, on all rows.  The rows that fail it become a posting
list of row numbers per part and range of numbers, so a part that holds a third
of all rows is many lists of bounded length.  In each range the lists are
merged: the union of what a set of filters removes, then what a further filter
fails beyond that union.  There are far fewer (set, filter) pairs than places in
orders, and their sizes add up over ranges.  Everything asked of an order is read
from these sums.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memengine.runtime import spread

from . import scratch
from .inputs import prepared

RANGE_BITS = 15  # numbers of a posting list's range
HELD_PARTS = 4096  # parts that a task adds up before it sends them on
WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


class Repeated:
    """Stands for the filter that a text fails if a row of a smaller doc_id has the same text."""


REPEATED = Repeated()


def text_filters(text: str = "text") -> dict[str, Column | Repeated]:
    """Filters A to E: few words, few distinct words, many capitals, symbols, repeated texts."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 50, "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")).cast("bigint") > 5 * F.length(t).cast("bigint"),
        "D": t.rlike(r"[#$%&*|]"), "E": REPEATED,
    }


def gallop(entries: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """First place in the sorted ``entries`` that is not below each of ``wanted``.

    All are sought at once: each starts where an even spread of the entries would put it, doubles its steps until it
    has passed its place, then halves what is between.
    """
    n = len(entries)
    if not n or not len(wanted):
        return np.zeros(len(wanted), dtype=np.int64)
    span = int(entries[-1]) - int(entries[0]) + 1
    start = np.clip((wanted - entries[0]) * n // span, 0, n - 1)
    below = entries[start] < wanted
    low, high = np.where(below, start, -1), np.where(below, n, start)  # entries[low] < wanted <= entries[high]
    step, open_ = 1, np.arange(len(wanted))
    while len(open_):
        probe = np.where(below[open_], start[open_] + step, start[open_] - step)
        inside = (probe < n) & (probe >= 0)
        open_, probe = open_[inside], probe[inside]
        less = entries[probe] < wanted[open_]
        low[open_[less]], high[open_[~less]] = probe[less], probe[~less]
        open_ = open_[less == below[open_]]
        step *= 2
    while len(open_ := np.flatnonzero(high - low > 1)):
        probe = (low[open_] + high[open_]) // 2
        less = entries[probe] < wanted[open_]
        low[open_[less]], high[open_[~less]] = probe[less], probe[~less]
    return high


def stands_in(wanted: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which of the sorted ``wanted`` are among the sorted ``entries``; the shorter list is sought in the longer."""
    if len(wanted) > len(entries):
        places = gallop(wanted, entries)
        hit = np.zeros(len(wanted), dtype=bool)
        inside = places < len(wanted)
        places = places[inside]
        hit[places[wanted[places] == entries[inside]]] = True
        return hit
    places = gallop(entries, wanted)
    hit = np.zeros(len(wanted), dtype=bool)
    inside = places < len(entries)
    hit[inside] = entries[places[inside]] == wanted[inside]
    return hit


def union(lists: list[np.ndarray]) -> np.ndarray:
    """All entries of some sorted lists, the longest first: what each further one adds goes to its place."""
    out, *rest = sorted(lists, key=len, reverse=True)
    for other in rest:
        places = gallop(out, other)
        new = np.ones(len(other), dtype=bool)
        inside = places < len(out)
        new[inside] = out[places[inside]] != other[inside]
        out = np.insert(out, places[new], other[new])
    return out


def _sets(n: int) -> list[tuple[int, int]]:
    """(set of filters as bits, further filter): what a filter fails beyond the set."""
    return [(s, f) for s in range(1 << n) for f in range(n) if not s >> f & 1]


def _measured(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each of ``_sets``: entries of the set's union, entries the filter adds, good and toxic ones of these."""
    n = len(lists)
    unions = [union([lists[f] for f in range(n) if s >> f & 1] or [lists[0][:0]]) for s in range(1 << n)]
    out = np.zeros((len(_sets(n)), 4), dtype=np.int64)
    for i, (s, f) in enumerate(_sets(n)):
        beyond = lists[f][~stands_in(lists[f], unions[s])]
        out[i] = len(unions[s]), len(beyond), stands_in(beyond, good).sum(), stands_in(beyond, toxic).sum()
    return out


def _summed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, np.ndarray]] = {}

        def send() -> pa.RecordBatch:
            parts, rows, sets, filters, sizes = [], [], [], [], []
            for part, (count, table) in held.items():
                parts += [part] * len(table)
                rows += [count] * len(table)
                sets += [s for s, _ in _sets(n)]
                filters += [f for _, f in _sets(n)]
                sizes.append(table)
            held.clear()
            columns = np.concatenate(sizes).T if sizes else np.zeros((4, 0), dtype=np.int64)
            return pa.record_batch(
                [pa.array(parts, pa.string()), pa.array(rows, pa.int64()), pa.array(sets, pa.int32()), pa.array(filters, pa.int32()), *map(pa.array, columns)],
                ["part", "n", "set", "filter", "before", "removed", "good", "toxic"],
            )

        for batch in batches:
            columns = [batch.column(c) for c in [*(f"fails_{f}" for f in range(n)), "good", "toxic"]]
            for i, (part, count) in enumerate(zip(batch.column("part").to_pylist(), batch.column("n").to_pylist())):
                *lists, good, toxic = [c[i].values.to_numpy(zero_copy_only=False) for c in columns]
                rows, table = held.get(part, (0, 0))
                held[part] = (rows + count, table + _measured(lists, good, toxic))
                if len(held) >= HELD_PARTS:
                    yield send()
        yield send()

    return run


def postings(docs: DataFrame, filters: dict[str, Column | Repeated], labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, range, n, fails_0 .., good, toxic): sorted row numbers per part and range of 2**15 numbers.

    ``fails_i`` are the rows that fail the ``i``-th filter, ``good`` and ``toxic`` those a label calls so,
    ``n`` counts all rows.  Rows are numbered as they are first written.
    """
    spark = prepared(docs.sparkSession)
    plain = [(f, c) for f, c in enumerate(filters.values()) if not isinstance(c, Repeated)]
    repeated = [f for f, c in enumerate(filters.values()) if isinstance(c, Repeated)]
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)) if repeated else F.lit(None).cast("binary")
    facts = scratch.saved(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
            F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), digest.alias("digest"),
            *[F.coalesce(c, F.lit(False)).alias(f"f{f}") for f, c in plain],
        ),
        "facts",
    )
    known = facts.filter("doc_id is not null")
    told = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    marked = known.join(told, "doc_id", "left")
    if repeated:
        # of equal texts the row of the smallest id passes; ids are far more even join keys than texts
        first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
        marked = marked.join(first, ["doc_id", "digest"], "left")
    marked = marked.select("row", "part", *[f"f{f}" for f, _ in plain], *[F.col("first").isNull().alias(f"f{f}") for f in repeated], "good", "toxic")
    unnamed = facts.filter("doc_id is null").select(
        "row", "part", *[f"f{f}" for f, _ in plain], *[F.lit(False).alias(f"f{f}") for f in repeated], F.lit(False).alias("good"), F.lit(False).alias("toxic")
    )
    rows_where = lambda flag: F.sort_array(F.collect_list(F.when(flag, F.col("row"))))
    lists = (
        marked.unionByName(unnamed).groupBy("part", F.shiftright("row", RANGE_BITS).alias("range"))
        .agg(F.count("*").alias("n"), *[rows_where(F.col(f"f{f}")).alias(f"fails_{f}") for f in range(len(filters))], rows_where(F.col("good")).alias("good"), rows_where(F.col("toxic")).alias("toxic"))
    )
    lists = scratch.saved(lists, "postings")
    scratch.drop(facts)
    return lists


def audit(docs: DataFrame, filters: dict[str, Column | Repeated], labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, filter_order, step, and counts): what the step's filter does in each order of the filters, per part.

    ``docs`` needs doc_id, text and ``part``; ``filters`` are named by one letter and say which rows fail.  kept: rows left
    after the step; removed: rows that go here; redundant: rows that fail here but went before; unique_fails: rows that
    fail this filter only; good_lost, toxic_lost: removed rows whose label says quality 1, toxic 1;
    shapley: the filter's removed rows added up over all orders.

    A null part is the empty string.  Filters that are null pass.  A label holds for all rows of its id; of several labels
    of one id any may say so, and ids without a document count nothing.  Rows of one id are rows each; those with
    the smallest id of a text pass ``REPEATED`` together, and so does a row without id, which has no label.  Every part
    has all rows, zeros included.  Other columns are ignored.  No rows: no rows.

    The work doubles with each filter, and the result has ``n`` times ``n!`` rows a part: meant for up to six filters.
    """
    n = len(filters)
    lists = postings(docs, filters, labels, part)
    sums = "part string, n bigint, set int, filter int, before bigint, removed bigint, good bigint, toxic bigint"
    sizes = spread(lists.drop("range")).mapInArrow(_summed(n), sums).groupBy("part", "set", "filter").agg(
        *[F.sum(c).alias(c) for c in ("n", "before", "removed", "good", "toxic")]
    )
    weight = F.get(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), F.bit_count("set"))
    others = F.lit((1 << n) - 1).bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.col("filter")))
    by_filter = sizes.groupBy("part", "filter").agg(
        F.map_from_entries(F.collect_list(F.struct("set", F.struct("n", "before", "removed", "good", "toxic")))).alias("sizes"),
        F.max(F.when(F.col("set") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.col("set") == others, F.col("removed"))).alias("unique_fails"), F.sum(weight * F.col("removed")).alias("shapley"),
    )
    places: list[list[dict]] = [[] for _ in range(n)]
    for order in permutations(range(n)):
        for k, f in enumerate(order):
            places[f].append({"order": "".join(list(filters)[x] for x in order), "step": k + 1, "set": sum(1 << x for x in order[:k])})
    all_places = F.from_json(F.lit(json.dumps(places)), "array<array<struct<order: string, step: int, set: int>>>")
    each = by_filter.withColumn("place", F.explode(F.get(all_places, F.col("filter")))).withColumn("here", F.col("sizes")[F.col("place.set")])
    return each.select(
        "part", F.col("place.order").alias("filter_order"), F.col("place.step").alias("step"),
        (F.col("here.n") - F.col("here.before") - F.col("here.removed")).alias("kept"), F.col("here.removed").alias("removed"),
        (F.col("fails") - F.col("here.removed")).alias("redundant"), "unique_fails", F.col("here.good").alias("good_lost"),
        F.col("here.toxic").alias("toxic_lost"), "shapley",
    )
