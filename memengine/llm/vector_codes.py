"""Vector codes: parts of vectors named by the nearest entries of trained codebooks, one codebook a part.

Training is Lloyd's, exact in whole numbers.  The rows are written once as blocks
of bounded size, each with a metric tree per part (``metric_tree``), so no round
reads a vector that a ball already answers for.  A round sends the codebooks to
the blocks, of fixed size however many rows there are, and gets back
sums and counts per entry, combined before the shuffle.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memengine.runtime import BROADCAST_ROWS, JOIN_SALTS, spread, within

from . import metric_tree, scratch
from .inputs import prepared
from .voronoi import quantized

SCALE = 4096.0
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 8192
LARGEST = 1 << 28  # of a component in whole numbers: squares and their sums stay exact


@dataclass
class Codes:
    """``rows``: id, label, codes (an entry per part), error, label_error; ``codebooks[part][entry]``: whole numbers."""

    rows: DataFrame
    codebooks: list[list[list[int]]]

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.codebooks for entry in part for x in entry).encode()).hexdigest()

    def decoded(self, codes: str = "codes", scale: float = SCALE):
        """Column: the vector that ``codes`` stand for, each component at the middle of its step."""
        books = F.array(*[F.array(*[F.array(*[F.lit((x + 0.5) / scale) for x in e]) for e in p]) for p in self.codebooks])
        return F.flatten(F.transform(F.col(codes), lambda c, i: F.get(F.get(books, i), c)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _blocks(width: int, parts: int, stored: np.dtype, leaf: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            values = _matrix(table.column("v").combine_chunks(), width)
            trees = [metric_tree.tree(p, leaf) for p in np.split(values, parts, axis=1)]
            for t in trees:
                t.points = t.points.astype(stored)
            ends = pa.array([0, len(table)], pa.int32())
            ids, labels = (pa.ListArray.from_arrays(ends, pa.concat_arrays(table.column(c).chunks)) for c in ("id", "label"))
            return pa.record_batch([ids, labels, pa.array([pickle.dumps([t.packed() for t in trees])], pa.binary())], ["ids", "labels", "trees"])

        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - rows)
                held.append(part)
                rows, batch = rows + part.num_rows, batch.slice(part.num_rows)
                if rows == block:
                    yield made(held)
                    held, rows = [], 0
        if rows:
            yield made(held)

    return run


def _trees(column: pa.Array) -> Iterator[list[metric_tree.Tree]]:
    for data in column:
        yield [metric_tree.Tree.unpacked(t) for t in pickle.loads(data.as_py())]


def _gathered(codebooks: np.ndarray):
    """Points and sums per part, entry and position of all blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = codebooks.shape
        counts, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros(codebooks.shape, dtype=np.int64)
        for batch in batches:
            for trees in _trees(batch.column("trees")):
                for p, t in enumerate(trees):
                    _, n, total, _ = metric_tree.owners(t, codebooks[p])
                    counts[p] += n
                    sums[p] += total
        index = [a.ravel().astype(np.int32) for a in np.indices(codebooks.shape)]
        yield pa.record_batch([*map(pa.array, index), pa.array(np.repeat(counts.ravel(), width)), pa.array(sums.ravel())], ["part", "entry", "place", "n", "total"])

    return run


def _coded(codebooks: np.ndarray):
    """Rows with their codes and errors, in the order of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, trees in enumerate(_trees(batch.column("trees"))):
                codes = np.empty((len(trees[0].points), len(trees)), dtype=np.int32)
                error = np.zeros(len(codes), dtype=np.int64)
                for p, t in enumerate(trees):
                    chosen, *_ = metric_tree.owners(t, codebooks[p])
                    codes[t.order, p] = chosen
                    error[t.order] += ((t.points.astype(np.int64) - codebooks[p][chosen]) ** 2).sum(axis=1)
                offsets = pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32())
                lists = [batch.column(c)[i].values for c in ("ids", "labels")]
                yield pa.record_batch([*lists, pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())), pa.array(error)], ["id", "label", "codes", "error"])

    return run


def compressed(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str | None = "label",
    block: int = BLOCK, leaf: int = metric_tree.LEAF,
) -> Codes:
    """Codes of all vectors, and the codebooks they refer to.

    A component becomes ``floor(scale * x)``; a vector is cut into ``parts`` equal consecutive parts.  A
    part's codebook starts as that part of the vectors of the ``entries`` smallest ids.  Each of ``rounds`` rounds
    gives every part to its nearest entry (squared distance, ties to the lower) and replaces each entry that has parts by
    their mean, rounded down.  Then parts are given to entries once more.  error is a row's squared distance
    summed over parts, label_error the errors of all rows of the same label, null being one of them.

    Rows whose vector is null or holds a null or non-finite component take no part.  Rows that share an id are
    rows each, and start codebooks in order of their vectors; rows without an id take part and come last there.  Vectors
    shorter than the longest, and a length that ``parts`` does not divide, count as filled up with zeros.  Fewer vectors
    than ``entries``: as many entries.  Components beyond ``LARGEST`` in whole numbers raise ValueError.  Other
    columns are ignored.  No vectors: no rows and empty codebooks.
    """
    spark = prepared(vectors.sparkSession)
    label = F.col(f"`{label_column}`") if label_column else F.lit(None).cast("int")
    given = vectors.select(
        F.col(id_column).cast("bigint").alias("id"), label.alias("label"), quantized(F.col(vector_column), scale).alias("v")
    ).filter("v is not null")
    largest = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0))
    facts = given.agg(F.max(F.size("v")).alias("width"), F.max(largest).alias("largest")).first()
    kind = T.StructType([T.StructField("id", T.LongType()), given.schema["label"], T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    if facts["width"] is None:
        return Codes(spark.createDataFrame([], kind).withColumn("label_error", F.col("error")), [[] for _ in range(parts)])
    if facts["largest"] > LARGEST:
        raise ValueError(f"components of {facts['largest'] / scale} at scale {scale} are too large to be summed exactly")
    each = max(1, -(-facts["width"] // parts))
    stored = np.dtype(next(t for t, top in (("<i2", 32767), ("<i4", 2**31 - 1)) if facts["largest"] <= top))
    start = [r["v"] for r in given.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    codebooks = np.zeros((parts, len(start), each), dtype=np.int64)
    for i, v in enumerate(start):
        codebooks[:, i, :] = np.pad(np.array(v, dtype=np.int64), (0, parts * each - len(v))).reshape(parts, each)

    listed = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(given.schema["label"].dataType)), T.StructField("trees", T.BinaryType())])
    blocks = scratch.saved(spread(given).mapInArrow(_blocks(parts * each, parts, stored, leaf, block), listed), "trees")
    for _ in range(rounds):
        gathered = blocks.select("trees").mapInArrow(_gathered(codebooks), "part int, entry int, place int, n bigint, total bigint")
        # one row per part, entry and position: as many as the codebooks have numbers
        for r in gathered.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            if r["n"]:
                codebooks[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    rows = scratch.saved(blocks.mapInArrow(_coded(codebooks), kind), "codes")
    scratch.drop(blocks)
    return Codes(_with_label_errors(rows), codebooks.tolist())


def _with_label_errors(rows: DataFrame) -> DataFrame:
    """Add the errors of a row's label: labels are summed before the shuffle; many labels are joined with salts."""
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if within(sums, BROADCAST_ROWS):
        return rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    copies = sums.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "codes"), F.lit(JOIN_SALTS)).cast("int"))
    return salted.join(copies, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("copy"))).drop("of", "salt", "copy")
