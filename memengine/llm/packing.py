"""Best-fit packing of token pieces by a grouping genetic algorithm.

Pieces are dealt at random into shards of bounded size.  Each shard is solved by
several islands: a population of packings, where crossover puts whole
well-filled bins of one parent into the other, drops the bins that now hold a
piece twice, and places their other pieces again by best fit.  After a round
the elite of each island goes to the next island of its shard.  An island whose
best packing meets the lower bound stops at once.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .inputs import prepared
from .tokens import KEPT_PARTS, TEXT_BYTES, encoder
from .words import blocked

CAPACITY = 2048
END_ID = 0
SHARD_PIECES = 8192
ISLANDS = 3
ROUNDS = 2
POPULATION = 4
GENERATIONS = 6
ELITE = 2
WELL_FILLED = 0.995


def encoded_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, kept_parts: int = KEPT_PARTS,
    digest: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit).

    With ``digest`` ids_crc32 stands in place of the ids, taken where they are made, so that they need not be sent.

    A document is the ids of its whole text and ``end_id``; null counts as
    empty.  One longer than ``capacity`` is cut into pieces of that length, the
    first of which may be shorter.  Each row of ``docs`` is a document of its
    own, also if its doc_id is null or repeats; other columns are ignored.
    """
    prepared(docs.sparkSession)

    def encode(batches):
        end = np.array([end_id], dtype="<u4")
        tool = encoder(tokenizer, kept_parts)
        for batch in blocked(batches, "text", TEXT_BYTES):
            columns: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tool.encode(batch.column("text"))):
                ids = np.concatenate([ids, end])
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for piece, (low, high) in enumerate(zip(cuts, cuts[1:])):
                    raw = ids[low:high].tobytes()
                    for column, value in zip(columns, (doc, piece, low, high - low, zlib.crc32(raw) if digest else raw)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", last.split()[0]])

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    last = "ids_crc32 bigint" if digest else "ids binary"
    return given.mapInArrow(encode, f"doc_id bigint, piece int, start bigint, length bigint, {last}")


class Bins:
    """Open bins by room left, for best fit: the fullest bin with room enough is found by one bit operation."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.filled = capacity, 0, [[] for _ in range(capacity + 1)]

    def put(self, room: int, number: int) -> None:
        if room:
            self.filled[room].append(number)
            self.rooms |= 1 << room

    def take(self, length: int) -> tuple[int, int]:
        """(room, number) of the fullest bin with room for ``length``, or (0, -1)."""
        fitting = self.rooms >> length
        if not fitting:
            return 0, -1
        room = length + (fitting & -fitting).bit_length() - 1
        held = self.filled[room]
        number = held.pop()
        if not held:
            self.rooms ^= 1 << room
        return room, number


def best_fit(lengths: list[int], order, bins: np.ndarray, open_rooms: list[tuple[int, int]], used: int, capacity: int) -> int:
    """Place the pieces of ``order`` one by one into ``bins``; returns how many bins there are now."""
    table = Bins(capacity)
    for room, number in open_rooms:
        table.put(room, number)
    for piece in order:
        length = lengths[piece]
        room, number = table.take(length)
        if number < 0:
            room, number, used = capacity, used, used + 1
        bins[piece] = number
        table.put(room - length, number)
    return used


def _numbered(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def _fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Fewer bins first; among equals, the more unequal the filling, the better for later crossings."""
    fills = np.bincount(bins, weights=sizes) / capacity
    return float(np.mean(fills**2))


def crossed(sizes: np.ndarray, lengths: list[int], one: np.ndarray, two: np.ndarray, rng, capacity: int) -> np.ndarray:
    """Child of ``one`` with whole well-filled bins of ``two``."""
    fills = np.bincount(two, weights=sizes)
    good = np.flatnonzero(fills >= WELL_FILLED * capacity)
    if not len(good):
        good = np.flatnonzero(fills >= np.median(fills))
    chosen = np.zeros(len(fills), dtype=bool)
    chosen[good[rng.random(len(good)) < 0.5]] = True
    injected = chosen[two]
    broken = np.zeros(one.max() + 1, dtype=bool)
    broken[one[injected]] = True
    left = np.bincount(one, weights=sizes)
    weak = np.flatnonzero(~broken & (left < WELL_FILLED * capacity))
    broken[weak] = True  # what is not full is packed again with the displaced
    displaced = broken[one] & ~injected
    child = np.where(injected, two + one.max() + 1, one)
    child[displaced] = -1
    kept = ~displaced
    child[kept] = _numbered(child[kept])
    used = int(child[kept].max()) + 1 if kept.any() else 0
    rooms = capacity - np.bincount(child[kept], weights=sizes[kept], minlength=used).astype(int) if used else np.zeros(0, int)
    order = np.flatnonzero(displaced)
    order = order[np.argsort(-sizes[order], kind="stable")]
    best_fit(lengths, order.tolist(), child, [(int(r), i) for i, r in enumerate(rooms) if r], used, capacity)
    return child


def evolve(sizes: np.ndarray, guests: list[np.ndarray], seed: int, capacity: int) -> list[np.ndarray]:
    """The best packings of an island after one round, best first.  ``sizes`` fall; each packing maps pieces to bins."""
    rng = np.random.default_rng(seed)
    lengths = sizes.tolist()
    bound = math.ceil(sizes.sum() / capacity)
    population = [_numbered(g) for g in guests]

    def add(packing: np.ndarray) -> bool:
        population.append(packing)
        return packing.max() + 1 <= bound

    done = any(p.max() + 1 <= bound for p in population)
    while not done and len(population) < POPULATION:
        order = np.arange(len(sizes))
        if population:  # best fit, nearly by falling size
            order = np.argsort(-sizes * rng.uniform(0.9, 1.1, len(sizes)), kind="stable")
        packing = np.empty(len(sizes), dtype=np.int32)
        best_fit(lengths, order.tolist(), packing, [], 0, capacity)
        done = add(packing)
    rank = lambda p: (p.max(), -_fitness(sizes, p, capacity))
    population.sort(key=rank)
    for _ in range(GENERATIONS):
        if done:
            break
        for _ in range(POPULATION // 2):
            a, b = rng.choice(min(len(population), POPULATION), 2, replace=False)
            done = add(crossed(sizes, lengths, population[a], population[b], rng, capacity)) or done
        population.sort(key=rank)
        del population[POPULATION:]
    population.sort(key=rank)
    return population[:ELITE]


def _island(capacity: int, number: int):
    """Group function of one round: the pieces of a shard and the elite that has come to this island."""

    def run(key, pieces: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "row_id"], ascending=[False, True])
        sizes = pieces["length"].to_numpy()
        coming = [np.asarray(g, dtype=np.int32) for g in guests.sort_values("place")["bins"]]
        seed = zlib.crc32(repr((number, *map(int, key))).encode())
        best = evolve(sizes, coming, seed, capacity) if len(sizes) else []
        rows = [
            (int(key[0]), int(key[1]), place, int(b.max()) + 1, _fitness(sizes, b, capacity), b.tolist())
            for place, b in enumerate(best)
        ]
        return pd.DataFrame(rows, columns=["shard", "island", "place", "n_bins", "fitness", "bins"])

    return run


def _laid(key, pieces: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
    """Place of each piece of a shard: its bin, and the tokens before it there."""
    pieces = pieces.sort_values(["length", "row_id"], ascending=[False, True])
    bins = np.asarray(best["bins"].iloc[0], dtype=np.int64)
    order = np.argsort(bins, kind="stable")
    sizes, sorted_bins = pieces["length"].to_numpy()[order], bins[order]
    before = np.cumsum(sizes) - sizes
    starts = np.flatnonzero(np.r_[True, sorted_bins[1:] != sorted_bins[:-1]])
    offsets = before - np.repeat(before[starts], np.diff(np.r_[starts, len(sizes)]))
    return pd.DataFrame(
        {"row_id": pieces["row_id"].to_numpy()[order], "sequence_id": (int(key[0]) << 32 | sorted_bins) * 2, "offset": offsets}
    )


def packed(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` with its columns and sequence_id, offset: rows of one sequence_id fill it without gaps from offset 0.

    ``pieces`` needs ``length``, from 1 to ``capacity``; a full piece is a
    sequence of its own.  The table is written once, so that its rows have
    numbers that stay.  No rows: no rows.  Columns of the new names are replaced.
    """
    prepared(pieces.sparkSession)
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset", "row_id")]
    rows = scratch.saved(pieces.select(*kept).withColumn("row_id", F.monotonically_increasing_id()), "pieces")
    part = rows.filter(F.col("length") < capacity).select("row_id", "length")
    shards = max(1, math.ceil(part.count() / shard_pieces))
    part = scratch.saved(
        part.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards))), "dealt"
    )
    islands = part.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    schema = "shard bigint, island int, place int, n_bins int, fitness double, bins array<int>"
    elite = rows.sparkSession.createDataFrame([], schema)
    for number in range(ROUNDS):
        coming = elite.withColumn("island", F.expr(f"(island + 1) % {ISLANDS}").cast("int"))
        if number:  # an island keeps its own best beside those that come
            coming = coming.unionByName(elite.filter("place = 0").withColumn("place", F.lit(ELITE)))
        elite = scratch.saved(
            islands.groupBy("shard", "island").cogroup(coming.groupBy("shard", "island")).applyInPandas(_island(capacity, number), schema),
            "elite",
        )
    order = Window.partitionBy("shard").orderBy("n_bins", F.desc("fitness"), "island", "place")
    best = elite.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select("shard", "bins")
    laid = (
        part.groupBy("shard").cogroup(best.groupBy("shard"))
        .applyInPandas(_laid, "row_id bigint, sequence_id bigint, offset bigint")
    )
    full = rows.filter(F.col("length") >= capacity).select(
        *kept, (F.col("row_id") * 2 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    short = rows.filter(F.col("length") < capacity).join(laid, "row_id").select(*kept, "sequence_id", "offset")
    return short.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, kept_parts: int = KEPT_PARTS) -> DataFrame:
    """The digest of a packing: pieces with ids_crc32 instead of their ids, and where each one is."""
    return packed(encoded_pieces(docs, tokenizer, capacity, kept_parts=kept_parts, digest=True), capacity)
