"""Filter audit against counting by hand; galloping against plain search; odd rows."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memengine.llm import filter_audit
from test_llm import DOCS, ODD, docs_of

LABELS = "doc_id bigint, quality int, toxic int"
SORTED = st.lists(st.integers(0, 400), unique=True).map(lambda x: np.array(sorted(x), dtype=np.int64))


@given(SORTED, SORTED, SORTED)
@settings(max_examples=200, deadline=None)
def test_galloping_finds_what_plain_search_finds(a, b, c):
    assert (filter_audit.gallop(a, b) == np.searchsorted(a, b)).all()
    assert (filter_audit.stands_in(a, b) == np.isin(a, b)).all()
    assert (filter_audit.union([a, b, c]) == np.union1d(np.union1d(a, b), c)).all()


def test_galloping_over_uneven_lists():
    entries = np.unique(np.r_[0, np.arange(10**6, 10**6 + 5000), 2**40])
    wanted = np.r_[-5, 0, 1, 10**6 - 1, 10**6 + 2500, 10**6 + 9000, 2**40, 2**40 + 1]
    assert (filter_audit.gallop(entries, wanted) == np.searchsorted(entries, wanted)).all()


def fails(rows):
    """Failed letters of each (id, text) row."""
    out = []
    for i, text in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append([
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            bool(re.search(r"[#$%&*|]", t)), i is not None and any(j is not None and j < i and (u or "") == t for j, u in rows),
        ])
    return out


def plain(rows, parts, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failed = fails(rows)
    out = {}
    for part in set(parts):
        mine = [n for n, p in enumerate(parts) if p == part]
        removed_in = {f: 0 for f in range(5)}
        for order in itertools.permutations(range(5)):
            here = set(mine)
            for step, f in enumerate(order, 1):
                gone = {n for n in here if failed[n][f]}
                mine_fails = {n for n in mine if failed[n][f]}
                here -= gone
                removed_in[f] += len(gone)
                out[part, "".join("ABCDE"[x] for x in order), step] = [
                    len(here), len(gone), len(mine_fails - gone), sum(sum(failed[n]) == 1 for n in mine_fails),
                    sum(rows[n][0] in good for n in gone), sum(rows[n][0] in toxic for n in gone),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed_in["ABCDE".index(order[step - 1])])
    return out


def audited(spark, df, labels):
    out = filter_audit.audit(df, filter_audit.text_filters(), spark.createDataFrame(labels, LABELS))
    return {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in out.collect()}


@pytest.mark.parametrize("bits", [15, 3])
def test_counts_equal_those_of_going_through_every_order(spark, monkeypatch, bits):
    monkeypatch.setattr(filter_audit, "RANGE_BITS", bits)  # ranges of eight rows: many lists a part
    varied = [(100 + i, " ".join(f"w{(i * k) % (3 + i)}" for k in range(20 + 5 * i)) + (" A#" if i % 3 else ""), "en", "abc"[i % 3], 1, "x") for i in range(30)]
    rows = ODD + varied + [(300 + i, varied[1][1], "en", "b" if i % 4 else None, 1, "x") for i in range(40)]
    rows += [(None, varied[1][1], "en", "", 1, "x")] * 20 + [(7, "another text of the same id", "en", "z", 1, "x")]
    labels = [(100 + i, i % 2, i % 5 == 0) for i in range(0, 30)] + [(7, 1, None), (7, 0, 1), (None, 1, 1), (99999, 1, 1), (301, None, None)]
    labels = [(i, q, None if x is None else int(x)) for i, q, x in labels]
    got = audited(spark, docs_of(spark, rows).repartition(3), labels)
    want = plain([(r[0], r[1]) for r in rows], [r[3] or "" for r in rows], labels)
    assert got == want


def test_empty_tables_clashing_columns_and_other_filters(spark):
    assert audited(spark, docs_of(spark, []), []) == {}
    df = docs_of(spark, ODD)
    for name in ("row", "part", "digest", "f0", "good", "toxic", "quality", "first", "n"):
        df = df.withColumn(name, F.lit(1))
    assert audited(spark, df, [(4, 1, 0)]) == audited(spark, docs_of(spark, ODD), [(4, 1, 0)])
    assert all(r[0] + r[1] + r[2] <= len(ODD) for r in audited(spark, df, []).values())
    two = filter_audit.audit(df, {"x": F.col("n_chars") > 5, "y": F.col("lang").isNull()}, spark.createDataFrame([], LABELS), part="rank")
    rows = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails) for r in two.collect()}
    assert set(rows) == {(p, o, s) for p in ("x", "") for o in ("xy", "yx") for s in (1, 2)}
    assert rows["x", "xy", 1] == (4, 5, 0, 5) and rows["x", "xy", 2] == (2, 2, 0, 2)  # of nine rows
