"""Histogram sort: shards against a plain sort, ties, hot groups, odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
from fractions import Fraction

import pytest

from memengine.llm import sharding
from test_llm import DOCS, ODD, docs_of, small


def plain(rows, shards, tolerance=Fraction(1, 1000)):
    """(id, shard, slot) of (id, text) rows by sorting them all; ids are distinct."""
    keyed = sorted((hashlib.md5((t or "").encode()).hexdigest()[:15], i, len((t or "").encode()) + 1) for i, t in rows)
    highs = list(itertools.accumulate(k[2] for k in keyed))
    total, borders = highs[-1], []
    group = {}
    for (content, _, size), high in zip(keyed, highs):
        low, _ = group.get(content, (high - size, 0))
        group[content] = (low, high)
    for s in range(1, shards):
        target = Fraction(s * total, shards)
        content, _, size, high = next((*k, h) for k, h in zip(keyed, highs) if h - k[2] <= target < h)
        near = min(group[content], key=lambda e: (abs(e - target), e))
        if abs(near - target) > tolerance * total / shards:
            near = min((high - size, high), key=lambda e: (abs(e - target), e))
        borders.append(near)
    out, slots = {}, [0] * shards
    for (_, i, size), high in zip(keyed, highs):
        shard = sum(b <= high - size for b in borders)
        out[i] = (shard, slots[shard])
        slots[shard] += 1
    return out


def dealt(df, **options):
    return {r.doc_id: (r.shard, r.slot) for r in sharding.sharded(df, **options).collect()}


def hot_rows():
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.random()}" for _ in range(rng.randrange(40)))) for i in range(600)]
    rows += [(1000 + 3 * i, "the same text in a third of all rows") for i in range(400)]
    return rows + [(-5 - i, None if i % 2 else "") for i in range(200)]


@pytest.mark.parametrize("shards", [1, 2, 7, 16])
def test_shards_equal_those_of_a_plain_sort(spark, shards):
    rows = hot_rows()
    df = spark.createDataFrame([(i, t, "en", "a", 1, "x") for i, t in rows], DOCS).repartition(5)
    assert dealt(df, shards=shards) == plain(rows, shards)


def test_ranges_do_not_change_the_shards(spark):
    rows = [(r.doc_id, r.text) for r in small(spark).collect()]
    want = plain(rows, 16)
    assert dealt(small(spark)) == want
    assert dealt(small(spark), range_bytes=2000) == want  # many ranges a shard


def test_a_group_stays_whole_within_the_tolerance(spark):
    rows = hot_rows()
    df = docs_of(spark, [(i, t, "en", "a", 1, "x") for i, t in rows])
    got = dealt(df, shards=4, tolerance=0.9)
    assert len({got[i][0] for i, t in rows if t == "the same text in a third of all rows"}) == 1
    assert got == plain(rows, 4, Fraction(9, 10))


def test_rows_that_no_key_tells_apart_are_divided_too(spark):
    df = docs_of(spark, [(None, "same", None, None, None, "x")] * 900 + [(i, f"other {i}", "en", "a", 1, "x") for i in range(300)])
    rows = sharding.sharded(df, shards=8).collect()
    sizes = [sum(sharding_size(r.text) for r in rows if r.shard == s) for s in range(8)]
    assert len(rows) == 1200 and max(sizes) - min(sizes) <= 2 * max(sharding_size(r.text) for r in rows)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def sharding_size(text):
    return len((text or "").encode()) + 1


def test_odd_rows_and_clashing_columns(spark):
    extra = ["slot", "shard", "place", "k0", "at", "range", "doc", "last", "size", "number", "node", "says", "digit", "low.x"]
    df = docs_of(spark, ODD)
    for name in extra:
        df = df.withColumn(name, df.rank)
    out = sharding.sharded(df, shards=3)
    rows = out.collect()
    assert len(rows) == len(ODD) and set(out.columns) == set(df.columns)
    assert {r["low.x"] for r in rows} == {"x", None} and all(r.place == r.rank and r.doc == r.rank for r in rows)
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    empty = sharding.sharded(docs_of(spark, []))
    assert empty.count() == 0 and dict(empty.dtypes)["slot"] == "bigint"


def test_one_exchange_of_whole_rows_and_no_nested_loop(spark):
    plan = sharding.sharded(small(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange shufflepartitionid") == 1 and "Exchange hashpartitioning" not in plan
    assert "NestedLoop" not in plan and "Python" not in plan and "Arrow" not in plan


def test_files_hold_each_shard_in_order(spark, tmp_path):
    read = sharding.write(small(spark), str(tmp_path / "shards"), shards=4)
    assert {r.doc_id: (r.shard, r.slot) for r in read.collect()} == dealt(small(spark), shards=4)
