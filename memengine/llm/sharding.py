"""Shards of near equal bytes by histogram sort, with column functions only.

Rows are ordered by content: 60 bits of the text's MD5, then doc_id.  So equal
texts stand side by side, and the order says nothing about where a text came
from.  A border between two shards is a key.  Rounds of counting find it: the
exact bytes of each probed interval are summed over all partitions, the
intervals that hold a border not yet settled are probed again at finer steps,
and the rest is left alone.  A border goes to the nearest edge of a group of
equal texts if that is within the tolerance, else to the nearest row, so only a
group too large for the tolerance is divided.

Finer borders at looser tolerance divide the shards into ranges of bounded size.
They tell each row's range and how many rows of its shard stand before the range;
so one exchange by range and a row number inside each range give the slots.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .inputs import shuffle_partitions

SHARDS = 16
TOLERANCE = 0.001  # of a shard's bytes: how far a border moves to spare a group of equal texts
RANGE_BYTES = 256 << 20
MOST_RANGES = 16_384
FIRST_BITS = 14
MOST_PROBES = 1 << 20  # counted intervals of a round, as far as six bits a node allow
_KEYS = ("k0", "k1", "k2")
_TOP = -(1 << 63)


@dataclass
class _Bucket:
    """Rows of one probed interval: bytes and rows before and in it, least and greatest keys."""

    digit: int
    low: int
    size: int
    rows_before: int
    rows: int
    least: tuple[int, ...]
    most: tuple[int, ...]
    child: _Node | None = None

    @property
    def tied(self) -> bool:
        return self.least == self.most


@dataclass
class _Node:
    """An interval under probe: ``2**bits`` equal steps of one key part."""

    number: int
    part: int
    shift: int
    bits: int
    low: int = 0
    rows_before: int = 0
    buckets: list[_Bucket] = field(default_factory=list)
    lows: list[int] = field(default_factory=list)


def content_key(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus 1; a null text has none."""
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("bigint") + 1


def _keyed(rows: DataFrame) -> DataFrame:
    """The keys and the size of ``rows``, which hold a document as a struct and the last key."""
    text, doc_id = F.col("doc")["text"].cast("string"), F.col("doc")["doc_id"].cast("bigint")
    return rows.select(
        "doc", content_key(F.coalesce(text, F.lit(""))).alias("k0"), F.coalesce(doc_id, F.lit(_TOP)).alias("k1"),
        F.col("last").alias("k2"), size_of(text).alias("size"),
    )


def _digit(part: Column, shift: Column, mask: Column) -> Column:
    value = F.when(part == 0, F.col("k0")).when(part == 1, F.col("k1")).otherwise(F.col("k2")).bitwiseXOR(F.lit(_TOP))
    return F.call_function("shiftrightunsigned", value, shift).bitwiseAND(mask).cast("int")


def _at_nodes(rows: DataFrame, level: list[tuple[_Node, list[int]]]) -> DataFrame:
    """``rows`` with ``says`` of the node that each stands at (``place`` is ``-1 - number``) and its ``digit`` there, else null.

    All rows stand at the first node at first, so this one is a constant; the others are joined, a bounded number.
    """
    if level[0][0].number == 0:
        node, says = level[0]
        return rows.withColumns(
            {
                "says": F.from_json(F.lit(json.dumps(says)), "array<int>"),
                "digit": _digit(F.lit(node.part), F.lit(node.shift), F.lit((1 << node.bits) - 1).cast("bigint")),
            }
        )
    table = rows.sparkSession.createDataFrame(
        [(-1 - node.number, node.part, node.shift, (1 << node.bits) - 1, says) for node, says in level],
        "at int, part int, shift int, mask bigint, says array<int>",
    )
    joined = rows.join(F.broadcast(table), F.col("place") == F.col("at"), "left")
    return joined.withColumn("digit", _digit(F.col("part"), F.col("shift"), F.col("mask"))).drop("at", "part", "shift", "mask")


def _descended(rows: DataFrame, levels: list[list[tuple[_Node, list[int]]]]) -> DataFrame:
    """``rows`` with ``place``, what the last node that a row reaches says of its digit.

    A node says one number per digit: a settled one from 0 on, or ``-1 - number`` of a node further down.
    """
    rows = rows.withColumn("place", F.lit(-1))
    for level in levels:
        place = F.when(F.col("digit").isNull(), F.col("place")).otherwise(F.get("says", F.col("digit")))
        rows = _at_nodes(rows, level).withColumn("place", place).drop("says", "digit")
    return rows


def _says(node: _Node, settled) -> list[int]:
    says = [0] * (1 << node.bits)
    for bucket in node.buckets:
        says[bucket.digit] = -1 - bucket.child.number if bucket.child else settled(bucket)
    return says


def _count(keys: DataFrame, levels: list[list[_Node]]) -> None:
    """Fill the buckets of the last level's nodes: one pass over the keys, combined before the shuffle."""
    nodes = {node.number: node for node in levels[-1]}
    above = _descended(keys, [[(node, _says(node, lambda _: 0)) for node in level] for level in levels[:-1]])
    ends = [(f"{name}_{k}", best(k)) for name, best in (("least", F.min), ("most", F.max)) for k in _KEYS]
    counted = (
        _at_nodes(above.filter("place < 0"), [(node, []) for node in levels[-1]]).groupBy("place", "digit")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *[end.alias(name) for name, end in ends]).collect()
    )
    for r in sorted(counted, key=lambda r: (r["place"], r["digit"])):
        node = nodes[-1 - r["place"]]
        last = node.buckets[-1] if node.buckets else None
        low, before = (last.low + last.size, last.rows_before + last.rows) if last else (node.low, node.rows_before)
        least, most = (tuple(r[f"{name}_{k}"] for k in _KEYS) for name in ("least", "most"))
        node.lows.append(low)
        node.buckets.append(_Bucket(r["digit"], low, r["bytes"], before, r["n"], least, most))


def _below(bucket: _Bucket, number: int, wanted_bits: int) -> _Node:
    """A node over the rows of a bucket, from the first bit in which their keys differ."""
    part = next(i for i in range(3) if bucket.least[i] != bucket.most[i])
    differ = ((bucket.least[part] ^ bucket.most[part]) & (2**64 - 1)).bit_length()
    shift = max(0, differ - wanted_bits)
    return _Node(number, part, shift, differ - shift, bucket.low, bucket.rows_before)


@dataclass
class _Border:
    """A border wanted at ``target`` bytes; settled at (bytes, rows) before it."""

    target: Fraction
    within: Fraction
    between_shards: bool
    at: tuple[int, int] | None = None
    torn: bool = False  # it falls among rows that no key tells apart

    def meet(self, node: _Node) -> _Bucket | None:
        """Settle at an edge of the bucket that holds the target, or return it to be probed further."""
        bucket = node.buckets[bisect_right(node.lows, self.target) - 1]
        above = (bucket.low + bucket.size, bucket.rows_before + bucket.rows)
        edge = min((bucket.low, bucket.rows_before), above, key=lambda e: (abs(e[0] - self.target), e[0]))
        away = abs(edge[0] - self.target)
        # between shards the edge of a group is wanted as long as the bucket holds several, then that of a row
        coarse = self.between_shards and (node.part > 0 or bucket.least[0] != bucket.most[0])
        if bucket.tied or away == 0 or (away <= self.within and not coarse):
            self.at, self.torn = edge, self.between_shards and bucket.rows > 1 and away > self.within
            return None
        return bucket


def _borders(total: int, shards: int, each: int, tolerance: float) -> list[_Border]:
    n, allowed = shards * each, Fraction(tolerance).limit_denominator(10**9) * total / shards
    return [_Border(Fraction(s * total, n), *((allowed, True) if s % each == 0 else (Fraction(total, 4 * n), False))) for s in range(1, n)]


def _probe(keys: DataFrame, borders: list[_Border]) -> list[list[_Node]]:
    """Rounds of counting until every border is settled: the nodes, by level."""
    levels, made = [[_Node(0, 0, 60 - FIRST_BITS, FIRST_BITS)]], 1
    open_borders = {0: borders}
    while True:
        _count(keys, levels)
        further: dict[int, list[_Border]] = {}
        deeper: list[tuple[_Bucket, int]] = []
        for node in levels[-1]:
            for border in open_borders[node.number]:
                bucket = border.meet(node)
                if bucket is None:
                    continue
                if not deeper or deeper[-1][0] is not bucket:
                    deeper.append((bucket, made))
                    made += 1
                further.setdefault(deeper[-1][1], []).append(border)
        if not deeper:
            return levels
        bits = min(12, max(6, (MOST_PROBES // len(deeper)).bit_length() - 1))
        for bucket, number in deeper:
            bucket.child = _below(bucket, number, bits)
        levels.append([bucket.child for bucket, _ in deeper])
        open_borders = further


def sharded(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``docs`` with shard (0 to ``shards`` - 1) and slot (gapless from 0 in each shard, in order of content and doc_id).

    ``docs`` needs doc_id and text and is read twice; an input that is not the same at each reading should be
    saved before.  A row weighs the UTF-8 bytes of its text plus 1.  Each border between shards lies at the edge of a
    group of equal texts nearest to its place if that is within ``tolerance`` of a shard's bytes, else at the
    nearest edge of a row, the lower one of two that are equally near.  So shards differ by a row and the tolerance at
    most, and no more groups than borders are divided.

    Null texts weigh 1 and are equal to empty ones.  Null ids come first among equal texts.  Rows that agree in text
    and id stand in any order; if they are so many that a border falls among them, all rows are saved
    with a number and these tell them apart.  Other columns pass through, but for columns of the two new names,
    which are replaced.  Fewer rows than shards leave shards empty.  No rows: no rows.

    The driver holds the counts of one round: 2**14 in the first, then at most 64 for each border or
    ``MOST_PROBES``.  Borders are bounded by ``MOST_RANGES``.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")])
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    given = _keyed(docs.select(whole, F.lit(0).cast("bigint").alias("last")))
    keys = scratch.saved(given.drop("doc"), "keys")
    facts = keys.agg(F.sum("size").alias("bytes")).first()
    total = facts["bytes"] or 0
    if not total:
        return docs.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("bigint")}).limit(0)
    wanted = max(shuffle_partitions(docs), -(-total // range_bytes))
    each = max(1, min(-(-wanted // shards), MOST_RANGES // shards))
    borders = _borders(total, shards, each, tolerance)
    levels = _probe(keys, borders)
    if any(border.torn for border in borders):
        scratch.drop(keys)
        given = _keyed(scratch.saved(docs.select(whole, F.monotonically_increasing_id().alias("last")), "rows"))
        keys = scratch.saved(given.drop("doc"), "keys")
        borders = _borders(total, shards, each, tolerance)
        levels = _probe(keys, borders)
    scratch.drop(keys)

    edges = _in_order(borders, each)
    lows = [low for low, _ in edges]
    starts = [0, *(rows for _, rows in edges)]
    ranges = shards * each
    placed = _descended(given.drop("size"), [[(node, _says(node, lambda b: bisect_right(lows, b.low))) for node in level] for level in levels])
    before = docs.sparkSession.createDataFrame(
        [(r, r // each, starts[r] - starts[r - r % each]) for r in range(ranges)], "range int, shard int, before bigint"
    )
    number = F.row_number().over(Window.partitionBy("place").orderBy(*_KEYS)) - 1
    # the one exchange of whole rows: range r goes to partition r
    sorted_rows = placed.repartitionById(ranges, F.col("place")).withColumn("number", number)
    return sorted_rows.join(F.broadcast(before), F.col("place") == F.col("range")).select(
        "doc.*", F.col("shard"), (F.col("before") + F.col("number")).alias("slot")
    )


def _in_order(borders: list[_Border], each: int) -> list[tuple[int, int]]:
    """Settled places, never falling: looser borders give way to those between shards."""
    at = [b.at for b in borders]
    for i, border in enumerate(borders):
        if border.between_shards:
            for j in range(max(0, i + 1 - each), i):
                at[j] = min(at[j], at[i])
        elif i:
            at[i] = max(at[i], at[i - 1])
    return at


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """The rows of ``sharded`` as Parquet, a folder ``shard=n`` each, rows in order of slot within a file; read back."""
    sharded(docs, shards).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
