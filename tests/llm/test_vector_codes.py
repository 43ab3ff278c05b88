"""Vector codes against plain Lloyd rounds; metric trees against all distances; odd rows."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from memengine.llm import metric_tree, vector_codes
from test_llm import small

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, entries=16, rounds=6, parts=8, scale=4096):
    """{(id, code, error, label_error)} and the digest, with Python's own numbers."""
    fit = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows if fit(v)]
    each = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    kept = [(i, v + [0] * (parts * each - len(v)), label) for i, v, label in kept]
    cut = lambda v, p: v[p * each : (p + 1) * each]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, p: min(range(len(books[p])), key=lambda e: (away(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(nearest(cut(v, p), p), []).append(cut(v, p))
            for e, own in mine.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out, by_label = [], {}
    for i, v, label in kept:
        code = [nearest(cut(v, p), p) for p in range(parts)]
        error = sum(away(cut(v, p), books[p][c]) for p, c in enumerate(code))
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, tuple(code), error, label))
    text = ",".join(str(x) for p in books for e in p for x in e)
    return sorted(((i, c, e, by_label[l]) for i, c, e, l in out), key=repr), hashlib.sha256(text.encode()).hexdigest()


def coded(df, **options):
    codes = vector_codes.compressed(df, **options)
    return sorted(((r.id, tuple(r.codes), r.error, r.label_error) for r in codes.rows.collect()), key=repr), codes.digest()


@pytest.mark.parametrize("kind", ["normal", "clusters", "grid", "equal", "large"])
def test_trees_give_every_point_to_its_nearest_entry(kind):
    rng = np.random.default_rng(7)
    points = {
        "normal": lambda: rng.normal(size=(3000, 4)) * 500, "clusters": lambda: rng.normal(size=(30, 4))[rng.integers(0, 30, 3000)] * 9000 + rng.normal(size=(3000, 4)) * 20,
        "grid": lambda: rng.integers(-2, 3, size=(3000, 3)), "equal": lambda: np.r_[np.zeros((2500, 4)), rng.normal(size=(40, 4)) * 90],
        "large": lambda: rng.normal(size=(1000, 4)) * 2**25,
    }[kind]().astype(np.int64)
    entries = points[rng.integers(0, len(points), 16)]
    t = metric_tree.Tree.unpacked(metric_tree.tree(points, leaf=16).packed())
    assert (np.sort(t.order) == np.arange(len(points))).all() and (points[t.order] == t.points).all()
    for n in range(len(t.start)):  # every ball holds its points, caches their sum, and is split by its children
        own = t.points[t.start[n] : t.end[n]]
        assert (own.sum(axis=0) == t.total[n]).all()
        assert np.sqrt(((own - t.centre[n]) ** 2).sum(axis=1)).max() <= t.radius[n] * (1 + 1e-9) + 1e-9
        a, b = t.children[n]
        assert (a < 0) == (b < 0) and (a < 0 or (t.start[n], t.end[a], t.end[n]) == (t.start[a], t.start[b], t.end[b]))
    chosen, counts, sums, singles = metric_tree.owners(t, entries)
    want = ((t.points[:, None, :] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (chosen == want).all() and (counts == np.bincount(want, minlength=16)).all()
    assert all((sums[e] == t.points[want == e].sum(axis=0)).all() for e in range(16))
    if kind in ("clusters", "equal"):
        assert singles < len(points) / 2  # whole balls were owned


def test_anchors_own_what_is_nearest_to_them():
    points = np.random.default_rng(1).integers(-100, 100, size=(500, 3))
    groups = metric_tree.anchors(points, np.arange(500), 20)
    assert len(groups) == 20 and sorted(np.concatenate(groups)) == list(range(500))
    pivots = [next(p for p in g[np.argsort(((points[g] - points[g].mean(axis=0)) ** 2).sum(axis=1))]) for g in groups]
    assert len({int(p) for p in pivots}) == 20


def test_codes_equal_those_of_plain_rounds(spark):
    df = small(spark, "embeddings").limit(200)
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = plain(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert coded(df, leaf=8) == want
    assert coded(df, block=17, leaf=4) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf], None), (5, [], None), (6, [0.5, -0.25, 0.125], None), (6, [0.5, 0.25], 2),
            (None, [0.1] * 11, 2), (None, [0.1] * 11, 2), (7, [-0.0] * 11, None)] + [(100 + i, [0.25, 0.5], 3) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows, entries=5)
    assert coded(df, entries=5) == want
    for name in ("id", "v", "codes", "error", "label_error", "of", "trees", "salt"):
        df = df.withColumn(name, F.lit("x"))
    assert coded(df, entries=5) == want
    few = coded(spark.createDataFrame(rows[5:6], SCHEMA))
    assert few == plain(rows[5:6]) and few[0][0][2] == 0
    none = vector_codes.compressed(spark.createDataFrame(rows[:4], SCHEMA))
    assert none.rows.count() == 0 and none.rows.columns == ["id", "label", "codes", "error", "label_error"]
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compressed(spark.createDataFrame([(1, [1e30], 1)], SCHEMA))


def test_many_labels_are_joined_with_salts(spark, monkeypatch):
    rows = [(i, [math.sin(i), math.cos(i)], None if i % 3 == 0 else i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = coded(df, parts=2)
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 2)
    assert coded(df, parts=2) == want == plain(rows, parts=2)


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    df = small(spark, "embeddings")
    codes = vector_codes.compressed(df)
    rows = codes.rows.withColumn("near", codes.decoded()).join(df, F.col("id") == F.col("vec_id")).collect()
    for r in rows[:50]:
        away = sum((math.floor(4096 * a) + 0.5 - 4096 * b) ** 2 for a, b in zip(r.embedding, r.near))
        assert away == pytest.approx(r.error)
