"""Exact nearest neighbours by squared L2 distance.

Three shapes of the same result:

* with candidates: an equi-join on the item key, then the distance;
* all vectors, few queries: the query matrix (size checked) goes to every task,
  each task keeps its k best per query, a final rank merges them;
* all vectors, many queries: a grid of vector blocks x query blocks of fixed
  size; each cell keeps k per query.
No shape ever writes out all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .. import constants as K
from ..functions import vectors as V
from ..runtime import bounded_broadcast, top_per_group, within

QUERY_MATRIX_BYTES = 64 << 20
BLOCK_ROWS = 20_000
TILE_COLUMNS = 2000
TILE = 1 << 24  # doubles of the pairs of one tile, were all of them computed exactly: 128 MB
_PARTIAL = "query_id {id}, memory_id {mid}, distance double, similarity double"


class _Best:
    """The k nearest seen so far for each query.

    Vectors and queries meet in tiles, so a task holds at most ``TILE`` products
    at a time beside the matrices themselves.
    """

    def __init__(self, ids: list, matrix: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, matrix, k
        self.q_sq = np.einsum("ij,ij->i", matrix, matrix)
        self.items: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * len(ids)

    def add(self, keys: np.ndarray, block: np.ndarray) -> None:
        block_sq = np.einsum("ij,ij->i", block, block)
        wide = max(1, min(len(block), TILE_COLUMNS))
        tall = max(1, TILE // (wide * max(1, block.shape[1])))
        for at in range(0, len(block), wide):
            part = slice(at, at + wide)
            for top in range(0, len(self.ids), tall):
                self._add_tile(top, min(top + tall, len(self.ids)), keys[part], block[part], block_sq[part])

    def _add_tile(self, top: int, end: int, keys: np.ndarray, block: np.ndarray, block_sq: np.ndarray) -> None:
        q, q_sq = self.q[top:end], self.q_sq[top:end]
        rough = q_sq[:, None] + block_sq[None, :] - 2.0 * (q @ block.T)
        # The product form rounds: keep everything near the border, and compute that exactly.
        border = np.full(end - top, np.inf)
        if len(block) > self.k:
            border = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1]
            border = border + 1e-9 * (q_sq + block_sq.max() + 1.0)
        at_q, at_v = np.nonzero(rough <= border[:, None])
        diff = block[at_v] - q[at_q]
        exact = np.einsum("ij,ij->i", diff, diff)
        norms = np.sqrt(q_sq[at_q] * block_sq[at_v])
        dots = np.einsum("ij,ij->i", block[at_v], q[at_q])
        cos = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
        found = keys[at_v]
        starts = np.searchsorted(at_q, np.arange(end - top + 1))
        for n in range(end - top):
            mine = slice(starts[n], starts[n + 1])
            new = (exact[mine], found[mine], cos[mine])
            old = self.items[top + n]
            both = new if old is None else tuple(np.concatenate(pair) for pair in zip(old, new))
            first = np.lexsort((both[1], both[0]))[: self.k]
            self.items[top + n] = tuple(column[first] for column in both)

    def columns(self) -> tuple[list, list, list, list]:
        found = [(q, *got) for q, got in zip(self.ids, self.items) if got is not None]
        ids = [q for q, distance, *_ in found for _ in range(len(distance))]
        distances, keys, cosines = ([x for f in found for x in f[n].tolist()] for n in (1, 2, 3))
        return ids, keys, distances, cosines


def _keys(column: pa.Array) -> np.ndarray:
    """Item keys in an order numpy can sort."""
    keys = column.to_numpy(zero_copy_only=False)
    return keys.astype(str) if keys.dtype == object else keys


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def knn(
    queries: DataFrame,
    vectors: DataFrame,
    candidates: DataFrame | None = None,
    k: int = K.KNN_K,
    dim: int = K.VECTOR_DIM,
    block_rows: int = BLOCK_ROWS,
    matrix_bytes: int = QUERY_MATRIX_BYTES,
    by: str = "query_id",
) -> DataFrame:
    """(query_id, memory_id, distance, similarity, rank), nearest first.

    ``queries``: query_id, query_vector.  ``vectors``: memory_id, embedding.
    ``candidates``: optional (query_id, memory_id) pairs; unknown ids vanish.  Queries that share candidates may name
    them by another column ``by``, which both have.
    """
    k = max(k, 1)
    queries = queries.filter(V.has_dimension(F.col("query_vector"), dim)).select(*dict.fromkeys(["query_id", by]), "query_vector")
    vectors = vectors.filter(V.has_dimension(F.col("embedding"), dim)).select("memory_id", "embedding")
    if candidates is not None:
        partial = _candidate_distances(queries, vectors, candidates, by)
    elif within(queries, max(1, matrix_bytes // (8 * dim))):
        partial = _broadcast_scan(queries, vectors, k, dim)
    else:
        partial = _grid_scan(queries, vectors, k, dim, block_rows)
    return top_per_group(partial, ["query_id"], [F.col("distance"), F.col("memory_id")], k)


def _candidate_distances(queries: DataFrame, vectors: DataFrame, candidates: DataFrame, by: str) -> DataFrame:
    pairs = candidates.select(by, "memory_id").join(vectors, "memory_id")
    joined = pairs.join(bounded_broadcast(queries, 20_000), by)
    return joined.select(
        "query_id", "memory_id",
        V.squared_l2(F.col("query_vector"), F.col("embedding")).alias("distance"),
        V.cosine(F.col("query_vector"), F.col("embedding")).alias("similarity"),
    )


def _partial_schema(queries: DataFrame, vectors: DataFrame) -> str:
    return _PARTIAL.format(
        id=queries.schema["query_id"].dataType.simpleString(),
        mid=vectors.schema["memory_id"].dataType.simpleString(),
    )


def _broadcast_scan(queries: DataFrame, vectors: DataFrame, k: int, dim: int) -> DataFrame:
    rows = queries.collect()  # at most matrix_bytes, checked by the caller
    ids = [r["query_id"] for r in rows]
    matrix = np.array([r["query_vector"] for r in rows], dtype=np.float64).reshape(-1, dim)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    types = [
        to_arrow_type(queries.schema["query_id"].dataType),
        to_arrow_type(vectors.schema["memory_id"].dataType),
        pa.float64(),
        pa.float64(),
    ]
    names = ["query_id", "memory_id", "distance", "similarity"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*shared.value, k)
        for batch in batches:
            best.add(_keys(batch.column("memory_id")), _matrix(batch.column("embedding"), dim))
        found = best.columns()
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types)], names)

    return vectors.mapInArrow(scan, _partial_schema(queries, vectors))


def _grid_scan(queries: DataFrame, vectors: DataFrame, k: int, dim: int, block_rows: int) -> DataFrame:
    v_blocks = max(1, math.ceil(vectors.count() / block_rows))
    q_blocks = max(1, math.ceil(queries.count() / block_rows))

    def place(df: DataFrame, key: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        # one type for both sides: equal numbers of other types go to other partitions
        mine = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
        return mine.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    placed_v = place(vectors, "memory_id", "vb", v_blocks, "qb", q_blocks)
    placed_q = place(queries, "query_id", "qb", q_blocks, "vb", v_blocks)

    def cell(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "memory_id", "distance", "similarity"]
        if not len(v) or not len(q):
            return pd.DataFrame(columns=names)
        best = _Best(q["query_id"].tolist(), np.stack(q["query_vector"].to_list()).astype(np.float64), k)
        best.add(_keys(pa.array(v["memory_id"])), np.stack(v["embedding"].to_list()).astype(np.float64))
        return pd.DataFrame(dict(zip(names, best.columns())))

    cells = placed_v.groupBy("vb", "qb").cogroup(placed_q.groupBy("vb", "qb"))
    return cells.applyInPandas(cell, _partial_schema(queries, vectors))
