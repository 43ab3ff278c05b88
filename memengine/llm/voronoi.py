"""Exact top-k by inner product: a Voronoi kNN join.

Maximum inner product is nearest neighbour once each candidate gets one more
coordinate that brings all to the same length (queries get 0 there).  Pivots cut
this space into cells.  Summaries of the cells (how far their queries reach, how
near and far their candidates are, the nearest candidates of each pivot) bound
the distance within which a cell's queries must have their k results; only cells
that reach into it are replicated to them.  Both sides travel as blocks of
bounded size, so a cell that holds a third of all vectors is many blocks, and a
task keeps k results per query of one block while candidates stream by.  Bounds
only spare work: scores are exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memengine.runtime import top_per_group

from . import scratch
from .inputs import prepared, shuffle_partitions

K = 20
SCALE = 64.0
MOST_PIVOTS = 256
QUERY_BLOCK = 512
DATA_BLOCK = 4096
BLOCKS_IN_STREAM = 64


def quantized(vector: Column, scale: float = SCALE) -> Column:
    """``floor(scale * x)`` of each component; null if the vector is null or holds a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("bigint")))


def _lifted(rows: np.ndarray, longest: float) -> np.ndarray:
    """Candidates with the coordinate that makes them all ``longest`` long."""
    squares = np.einsum("ij,ij->i", rows, rows)
    return np.c_[rows, np.sqrt(np.maximum(longest**2 - squares, 0))]


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", rows, rows)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :]
    return np.sqrt(np.maximum(squares - 2 * rows @ pivots.T, 0))


def top_k(
    vectors: DataFrame, wanted: Column, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding",
    scale: float = SCALE, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row where ``wanted`` holds, the ``k`` other rows of highest score.

    The score is the inner product of the quantized vectors, ties go to the smaller id; fewer than ``k``
    other rows are all returned.  Vectors that are null or hold null or non-finite components take no part,
    nor do rows without an id; of rows that share an id the one with the greatest vector stays.  Shorter
    vectors count as padded with zeros.  Components beyond 64-bit sums are not supported.  Other columns are
    ignored.  No rows or no queries: no rows.
    """
    spark = prepared(vectors.sparkSession)
    given = vectors.select(
        F.col(id_column).cast("bigint").alias("id"), F.coalesce(wanted, F.lit(False)).alias("wanted"),
        quantized(F.col(vector_column), scale).alias("v"),
    ).filter("id is not null and v is not null")
    if not given.groupBy("id").count().filter("count > 1").isEmpty():
        given = given.groupBy("id").agg(F.max(F.struct("v", "wanted")).alias("s")).select("id", "s.wanted", "s.v")
    rows = scratch.saved(given, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    size = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0))
    facts = rows.agg(
        F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(square).alias("square"), F.max(size).alias("most"),
        F.sum(F.col("wanted").cast("int")).alias("queries"),
    ).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not facts["n"] or not facts["queries"]:
        return spark.createDataFrame([], schema)
    dim, longest = max(1, facts["dim"]), math.sqrt(facts["square"])
    stored = np.dtype(next(t for t, top in (("<i1", 127), ("<i2", 32767), ("<i4", 2**31 - 1), ("<i8", math.inf)) if facts["most"] <= top))
    bound = dim * float(facts["most"]) ** 2
    exact = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    pivots = _pivots(rows, facts["n"], dim, longest)
    slack = 1e-6 * (1.0 + longest + float(np.abs(pivots).max()))

    def matrix(column: pa.Array) -> np.ndarray:
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros((len(column), dim), dtype=np.float64 if exact != np.int64 else np.int64)
        inside = np.arange(dim)[None, :] < lengths[:, None]
        out[inside] = column.flatten().to_numpy()
        return out

    def assign(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                values = matrix(part.column("v"))
                wanted_rows = part.column("wanted").to_numpy(zero_copy_only=False).astype(bool)
                points = values.astype(np.float64)
                for query in (False, True):
                    chosen = np.flatnonzero(wanted_rows) if query else np.arange(len(values))
                    if not len(chosen):
                        continue
                    lifted = np.c_[points[chosen], np.zeros(len(chosen))] if query else _lifted(points, longest)
                    far = _distances(lifted, pivots)
                    cell = far.argmin(axis=1)
                    yield pa.record_batch(
                        [
                            part.column("id").take(pa.array(chosen)), pa.array(np.full(len(chosen), query)),
                            pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(chosen)), cell]),
                            pa.array([v.tobytes() for v in values[chosen].astype(stored)], pa.binary()),
                        ],
                        ["id", "query", "cell", "far", "v"],
                    )

    placed = scratch.saved(rows.mapInArrow(assign, "id bigint, query boolean, cell int, far double, v binary"), "cells")
    cells = placed.groupBy("query", "cell").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).toPandas()
    nearest = top_per_group(placed.filter(~F.col("query")).select("cell", "far"), ["cell"], [F.col("far")], k + 1).toPandas()
    routes = _routes(cells, nearest, pivots, k, slack)

    blocks = _blocks(placed, cells, query_block, data_block)
    streams = max(1, math.ceil(sum(math.ceil(n / data_block) for n in cells[~cells["query"]]["n"]) / BLOCKS_IN_STREAM))
    routed = F.broadcast(spark.createDataFrame(routes, "query_cell int, cell int, least double"))
    queries = blocks.filter("query").select(
        F.col("cell").alias("query_cell"), F.col("block").alias("query_block"),
        F.explode(F.sequence(F.lit(0), F.lit(streams - 1))).alias("stream"), F.lit(-1.0).alias("least"), "ids", "vs",
    )
    query_blocks = F.broadcast(blocks.filter("query").select(F.col("cell").alias("query_cell"), F.col("block").alias("query_block")))
    data = (
        blocks.filter(~F.col("query")).join(routed, "cell").join(query_blocks, "query_cell")
        .select("query_cell", "query_block", F.pmod(F.xxhash64("cell", "block"), F.lit(streams)).cast("int").alias("stream"), "least", "ids", "vs")
    )
    units = queries.withColumn("stream", F.col("stream").cast("int")).unionByName(data)
    key = ["query_cell", "query_block", "stream"]
    parts = max(shuffle_partitions(vectors), spark.sparkContext.defaultParallelism)
    ordered = units.repartition(parts, *key).sortWithinPartitions(*key, "least")

    def solve(batches) -> Iterator[pa.RecordBatch]:
        current, best = None, None
        for batch in batches:
            for *unit, least, ids, vs in zip(*(c.to_pylist() for c in batch.columns)):
                if unit != current:
                    if best is not None:
                        yield best.rows()
                    current, best = unit, None
                ids = np.frombuffer(ids, dtype="<i8")
                values = np.frombuffer(vs, dtype=stored).reshape(len(ids), -1)
                if least < 0:
                    best = _Best(ids, values.astype(exact), k)
                else:
                    best.offer(ids, values.astype(exact), least, longest, slack)
        if best is not None:
            yield best.rows()

    found = ordered.mapInArrow(solve, "query_id bigint, vec_id bigint, score bigint")
    ranked = top_per_group(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _pivots(rows: DataFrame, n: int, dim: int, longest: float) -> np.ndarray:
    """Lifted pivots: distinct candidates of the least hashes, about ``sqrt(n) / 16`` of them, a bounded number."""
    wanted = min(MOST_PIVOTS, max(1, math.isqrt(n) // 16))
    hashed = rows.select(F.xxhash64("v").alias("h"), "v")
    least = hashed.select("h").distinct().orderBy("h").limit(wanted)
    picked = hashed.join(F.broadcast(least), "h").groupBy("h").agg(F.max("v").alias("v")).orderBy("h").toPandas()
    points = np.zeros((len(picked), dim))
    for i, v in enumerate(picked["v"]):
        points[i, : len(v)] = v
    return _lifted(points, longest)


def _routes(cells: pd.DataFrame, nearest: pd.DataFrame, pivots: np.ndarray, k: int, slack: float) -> list[tuple[int, int, float]]:
    """(query cell, data cell, least distance): which cells can hold results of a cell's queries.

    The k + 1 candidates that are surely nearest bound the distance: one of them may be the query itself.
    """
    between = _distances(pivots, pivots)
    known_cell, known_far = nearest["cell"].to_numpy(dtype=int), nearest["far"].to_numpy(dtype=float)
    data = cells[~cells["query"]]
    routes = []
    for i, reach in cells[cells["query"]][["cell", "far"]].itertuples(index=False):
        most = np.sort(known_far + between[known_cell, i]) + reach
        limit = most[k] if len(most) > k else math.inf
        for j, near, far in data[["cell", "near", "far"]].itertuples(index=False):
            least = max(0.0, between[i, j] - reach - far, near - between[i, j] - reach)
            if least <= limit + slack:
                routes.append((int(i), int(j), float(least)))
    return routes


def _blocks(placed: DataFrame, cells: pd.DataFrame, query_block: int, data_block: int) -> DataFrame:
    """Rows of a cell packed into blocks of about the given size: ids and vectors as binaries."""
    counts = F.broadcast(
        placed.sparkSession.createDataFrame(
            [(bool(q), int(c), max(1, math.ceil(n / (query_block if q else data_block)))) for q, c, n in cells[["query", "cell", "n"]].itertuples(index=False)],
            "query boolean, cell int, blocks int",
        )
    )
    dealt = placed.join(counts, ["query", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def pack(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        ids = frame["id"].to_numpy(dtype="<i8").tobytes()
        return pd.DataFrame({"query": [key[0]], "cell": [key[1]], "block": [key[2]], "ids": [ids], "vs": [b"".join(frame["v"])]})

    packed = dealt.select("query", "cell", "block", "id", "v").groupBy("query", "cell", "block").applyInPandas(
        pack, "query boolean, cell int, block int, ids binary, vs binary"
    )
    return scratch.saved(packed, "blocks")


class _Best:
    """The k best candidates so far of each query of a block."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int):
        self.ids, self.values, self.k = ids, values, k
        self.squares = (values.astype(np.float64) ** 2).sum(axis=1)
        self.rows_, self.found, self.scores = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.floor = np.full(len(ids), -np.inf)

    def offer(self, ids: np.ndarray, values: np.ndarray, least: float, longest: float, slack: float) -> None:
        if least > slack:  # scores that a distance of ``least`` or more allows
            above = (self.squares + longest**2 - (least - slack) ** 2) / 2
            if (above + 1 < self.floor).all():
                return
        scores = self.values @ values.T
        scores = scores.astype(np.int64) if scores.dtype != np.float32 else np.rint(scores).astype(np.int64)
        own = self.ids[:, None] == ids[None, :]
        if own.any():
            scores[own] = np.iinfo(np.int64).min
        floor = np.where(np.isinf(self.floor), np.iinfo(np.int64).min + 1, self.floor).astype(np.int64)
        if len(ids) > self.k:
            floor = np.maximum(floor, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        row, col = np.nonzero((scores >= floor[:, None]) & ~own)
        row, found, score = np.r_[self.rows_, row], np.r_[self.found, ids[col]], np.r_[self.scores, scores[row, col]]
        order = np.lexsort((found, -score, row))
        row, found, score = row[order], found[order], score[order]
        starts = np.searchsorted(row, np.arange(len(self.ids)))
        keep = np.arange(len(row)) - starts[row] < self.k
        self.rows_, self.found, self.scores = row[keep], found[keep], score[keep]
        counts = np.bincount(self.rows_, minlength=len(self.ids))
        last = np.cumsum(counts) - 1
        full = counts >= self.k
        self.floor[full] = self.scores[last[full]]

    def rows(self) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array(self.ids[self.rows_]), pa.array(self.found), pa.array(self.scores)], ["query_id", "vec_id", "score"]
        )
