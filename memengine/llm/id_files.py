"""Token-id files with a minimal perfect hash index.

A table is written as shards in ascending doc_id order.  A shard is two files:
``<n>.ids``, the raw little-endian ids of its documents one after the other, and
``<n>.index``, a minimal perfect hash from doc_id to the place of its ids.  The
index stores no keys, only a fingerprint per slot, so a lookup takes a few bit
probes, one fingerprint and one range of the payload, however many documents
there are.  Files are written under a name of the attempt and renamed, so a
task that runs again replaces its own files by equal ones.
"""

from __future__ import annotations

import json
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memengine.functions.core import places_below

from .inputs import prepared, shuffle_partitions
from .tokens import TEXT_BYTES, encoder
from .words import blocked, mix

END_ID = 0
SHARD_BYTES = 16 << 20  # of text; a few times more on a large cluster
GAMMA = 2.0  # bits per key still to be placed, on each level
_MAGIC = 0x4D504849


def _level(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    h = mix(keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1)))
    return ((h >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


@dataclass
class PerfectHash:
    """Levels of bits: a key's slot is the rank of the first level's bit that is its alone."""

    sizes: np.ndarray  # bits of each level
    words: np.ndarray  # all bits, 64 to a word, each level from a new word on
    ranks: np.ndarray  # set bits before each word

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        """Keys must be distinct unsigned 64-bit values."""
        sizes, parts, left, level = [], [], keys, 0
        while len(left):
            bits = 64 * math.ceil(GAMMA * len(left) / 64)
            at = _level(left, level, bits)
            alone = np.bincount(at, minlength=bits) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(bits)
            left, level = left[~alone[at]], level + 1
        words = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        ranks = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]
        return PerfectHash(np.array(sizes, dtype=np.int64), words, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key that was built in; any slot or -1 for others."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_, first = np.arange(len(keys)), 0
        for level, bits in enumerate(self.sizes.tolist()):
            at = _level(keys[open_], level, bits) + 64 * first
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.ranks[at >> 6] + np.bitwise_count(below))[hit]
            open_, first = open_[~hit], first + bits // 64
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


class Index:
    """Index of a shard: slot -> fingerprint, first record, number of records; record -> offset in ids."""

    def __init__(self, table: PerfectHash, prints: np.ndarray, first: np.ndarray, count: np.ndarray, offsets: np.ndarray, width: int):
        self.table, self.prints, self.first, self.count, self.offsets, self.width = table, prints, first, count, offsets, width

    @staticmethod
    def of(ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, width: int) -> Index:
        """``ids`` ascending; records whose id is not ``known`` (null) come first and have no key."""
        nulls = int((~known).sum())
        keys, first, count = np.unique(ids[known].view(np.uint64), return_index=True, return_counts=True)
        table = PerfectHash.build(keys)
        slots = table.slots(keys)
        columns = [np.zeros(len(keys), dtype=t) for t in (np.uint32, np.int64, np.int64)]
        for column, values in zip(columns, (fingerprints(keys), first + nulls, count)):
            column[slots] = values
        return Index(table, *columns, np.r_[0, np.cumsum(lengths)].astype(np.int64), width)

    def lookup(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first record, number of records) of each id, 0 records for those that are not there."""
        keys = ids.astype(np.int64).view(np.uint64)
        slots = self.table.slots(keys)
        found = slots >= 0
        found[found] = self.prints[slots[found]] == fingerprints(keys[found])
        safe = np.where(found, slots, 0)
        if not len(self.first):
            return np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        return np.where(found, self.first[safe], 0), np.where(found, self.count[safe], 0)

    def dump(self) -> bytes:
        arrays = (self.table.sizes, self.table.words, self.table.ranks, self.prints, self.first, self.count, self.offsets)
        head = np.array([_MAGIC, self.width, *[len(a) for a in arrays]], dtype="<i8")
        return head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)

    @staticmethod
    def load(raw: bytes) -> Index:
        head = np.frombuffer(raw, dtype="<i8", count=9)
        if head[0] != _MAGIC:
            raise ValueError("not an index file")
        at, arrays = head.nbytes, []
        for n, kind in zip(head[2:].tolist(), ("<i8", "<u8", "<i8", "<u4", "<i8", "<i8", "<i8")):
            arrays.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
            at += arrays[-1].nbytes
        return Index(PerfectHash(*arrays[:3]), *arrays[3:], int(head[1]))


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a folder; also for stores that pyarrow knows by their scheme, an unknown one is an error."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):", path)
    if scheme is None:
        return arrow_fs.LocalFileSystem(), path
    if scheme[1].lower() == "file":
        return arrow_fs.LocalFileSystem(), "/" + path[len(scheme[0]) :].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path)


def write(docs: DataFrame, path: str, tokenizer: str, shard_bytes: int = SHARD_BYTES, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (doc_id, text) to ``path``, a folder all executors reach; returns the shards.

    A shard row: shard, n_docs, n_ids, first_id, last_id, start (ids of all shards before).  Each row of
    ``docs`` is a record: the ids of its whole text (null: none) and ``end_id``.  Records are in ascending
    doc_id order, null first, those of one doc_id by their text.  Ids are two bytes wide where the
    vocabulary allows, else four.  Other columns are ignored; no rows write no shards.
    """
    spark = prepared(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(docs), math.ceil(total / shard_bytes))

    def shards(batches):
        from pyspark import TaskContext

        number, tool = TaskContext.get().partitionId(), encoder(tokenizer)
        width = 2 if max(len(tool.token_bytes) - 1, end_id) < 1 << 16 else 4
        end, ids, lengths = np.array([end_id], dtype="<u4"), [], []
        store, folder = _open(path)
        store.create_dir(folder, recursive=True)
        draft = f"{folder}/{number}.{uuid.uuid4().hex}"
        stream = None
        for batch in blocked(batches, "text", TEXT_BYTES):
            if stream is None and batch.num_rows:
                stream = store.open_output_stream(f"{draft}.ids")
            for doc, found in zip(batch.column("doc_id").to_pylist(), tool.encode(batch.column("text"))):
                ids.append(doc)
                lengths.append(len(found) + 1)
                stream.write(np.concatenate([found, end]).astype(f"<u{width}").tobytes())
        if stream is None:
            return
        stream.close()
        known = np.array([i is not None for i in ids])
        index = Index.of(np.array([i or 0 for i in ids], dtype=np.int64), known, np.array(lengths, dtype=np.int64), width)
        with store.open_output_stream(f"{draft}.index") as out:
            out.write(index.dump())
        with store.open_output_stream(f"{draft}.keys") as out:
            out.write(np.array([i for i in ids if i is not None], dtype="<i8").tobytes())
        for kind in ("ids", "index", "keys"):
            store.move(f"{draft}.{kind}", f"{folder}/{number}.{kind}")
        have = [i for i in ids if i is not None]
        yield pa.record_batch(
            [pa.array([v], pa.int64()) for v in (number, len(ids), sum(lengths), min(have, default=None), max(have, default=None))],
            ["shard", "n_docs", "n_ids", "first_id", "last_id"],
        )

    ordered = given.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    listed = ordered.mapInArrow(shards, "shard bigint, n_docs bigint, n_ids bigint, first_id bigint, last_id bigint")
    listed.write.parquet(f"{path}/shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{path}/shards").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _shard(path: str, number: int) -> tuple[Index, np.ndarray, arrow_fs.FileSystem, str]:
    store, folder = _open(path)
    with store.open_input_stream(f"{folder}/{number}.index") as f:
        index = Index.load(f.read())
    with store.open_input_stream(f"{folder}/{number}.keys") as f:
        keys = np.frombuffer(f.read(), dtype="<i8")
    return index, keys, store, f"{folder}/{number}.ids"


def read(path: str, shards: DataFrame, batch_docs: int = 512) -> DataFrame:
    """All documents of a written folder: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit).

    Each document is found through the index, by its key; records without a key by their place.
    """
    prepared(shards.sparkSession)

    def documents(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist()):
                index, keys, store, name = _shard(path, number)
                with store.open_input_file(name) as payload:
                    yield from _records(index, keys, payload, start, batch_docs)

    one_each = shards.select("shard", "start").repartition(max(1, shards.count()), "shard")
    return one_each.mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _records(index: Index, keys: np.ndarray, payload, start: int, batch_docs: int) -> Iterator[pa.RecordBatch]:
    nulls = len(index.offsets) - 1 - len(keys)
    distinct = np.unique(keys)
    first, count = index.lookup(distinct)
    if (count == 0).any() or count.sum() != len(keys):
        raise ValueError("an index does not find its own keys")
    records = np.r_[np.arange(nulls), np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(keys))]
    names = [None] * nulls + np.repeat(distinct, count).tolist()
    for low in range(0, len(records), batch_docs):
        some = records[low : low + batch_docs]
        at, to = index.offsets[some], index.offsets[some + 1]
        ids = []
        for a, b in zip(at.tolist(), to.tolist()):
            payload.seek(a * index.width)
            raw = payload.read((b - a) * index.width)
            ids.append(np.frombuffer(raw, dtype=f"<u{index.width}").astype("<u4").tobytes())
        yield pa.record_batch(
            [pa.array(names[low : low + batch_docs], pa.int64()), pa.array(at + start), pa.array(to - at), pa.array(ids, pa.binary())],
            ["doc_id", "start", "n_tokens", "ids"],
        )


def find(spark: SparkSession, path: str, keys: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``keys`` whose id is stored, one per record: the id, n_tokens, ids.

    Each key finds the only shard whose id range can hold it by halving the shards' bounds, two numbers per shard.
    """
    prepared(spark)
    shards = spark.read.parquet(f"{path}/shards").filter("first_id is not null").orderBy("first_id").select("shard", "first_id", "last_id").collect()

    def seek(batches) -> Iterator[pa.RecordBatch]:
        opened: dict[int, tuple] = {}
        for batch in batches:
            for number, wanted in zip(*(batch.column(c).to_pylist() for c in ("shard", "wanted"))):
                if number not in opened:
                    opened.clear()
                    opened[number] = _shard(path, number)
                index, _, store, name = opened[number]
                ids = np.array(wanted, dtype=np.int64)
                first, count = index.lookup(ids)
                with store.open_input_file(name) as payload:
                    for doc, at, n in zip(wanted, first.tolist(), count.tolist()):
                        for record in range(at, at + n):
                            a, b = int(index.offsets[record]), int(index.offsets[record + 1])
                            payload.seek(a * index.width)
                            raw = np.frombuffer(payload.read((b - a) * index.width), dtype=f"<u{index.width}")
                            yield pa.record_batch(
                                [pa.array([doc], pa.int64()), pa.array([b - a], pa.int64()), pa.array([raw.astype("<u4").tobytes()], pa.binary())],
                                [column, "n_tokens", "ids"],
                            )

    wanted = keys.select(F.col(column).cast("bigint").alias("key")).filter("key is not null").distinct()
    numbers, first, last = (F.from_json(F.lit(json.dumps([r[c] for r in shards])), "array<bigint>") for c in ("shard", "first_id", "last_id"))
    place = places_below(first, F.col("key")) - 1
    routed = wanted.withColumn("place", place).filter((F.col("place") >= 0) & (F.get(last, F.col("place")) >= F.col("key")))
    routed = routed.withColumn("shard", F.get(numbers, F.col("place")))
    blocks = routed.groupBy("shard", F.pmod(F.xxhash64("key"), F.lit(64)).alias("block")).agg(F.collect_list("key").alias("wanted"))
    return blocks.sortWithinPartitions("shard").mapInArrow(seek, f"{column} bigint, n_tokens bigint, ids binary")
