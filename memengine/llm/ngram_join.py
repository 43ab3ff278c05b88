"""N-gram Jaccard join by PartEnum signatures.

Shingle sets are compared by their symmetric difference: two sets of sizes
``a <= b`` with Jaccard similarity ``t`` or more differ in at most
``(1 - t) / (1 + t) * (a + b)`` shingles.

* Sizes fall into bands; a pair is looked for in the instance of its larger
  set, so a set signs for its own band and, where it can be the smaller one of
  a pair, for the next.
* An instance cuts the shingle domain into first-level groups of two
  second-level partitions, and a set signs every subset of one partition.  Each
  difference spoils one partition, so two similar sets must share the signature
  of at least ``filled partitions - differences`` subsets.  Only as many
  partitions are signed as that bound needs (``_signed``).  Below ``FINE_BELOW``
  shingles each shingle is a partition of its own.
* A signature of at most ``pair_limit`` sets yields its pairs, and a pair needs
  as many shared signatures as the bound says.  A signature of more sets (a
  frequent passage, a large group of near copies) yields no pairs: the bound
  tells which sets could lose a partner that way, and only those are tied by
  one edge each to the smallest of them.
* Candidates form components.  Each is compared whole, in square blocks of at
  most ``block`` sets, by counting common shingles; a block returns link counts
  and spanning edges, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, scratch
from .graph import components
from .held import let_go
from .inputs import all_columns, prepared, shuffle_partitions, texts_by_id, unused
from .words import blocked, mix, words_of

SHINGLE = 5
PERCENT = 75
FINE_BELOW = 128
DENSITY = 0.4  # partitions per shingle of the largest set of a band
PAIR_LIMIT = 10
BLOCK = 512
BLOCK_SHINGLES = 500_000
COLUMNS = 2048
ROWS_IN_TASK = 1_000_000
_SENT = np.array([*range(8), *range(9, 16)])  # bytes of (set, signature) that are sent: all but the lowest of the signature


def shingle_sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of the rows with text; shorter texts are one shingle."""
    words = words_of(batch.column("text"), lower=True)
    grams = words.grams(shingle)
    for i in range(batch.num_rows):
        a, b = int(words.first[i]), int(words.first[i + 1])
        if b - a >= shingle:
            yield i, np.unique(grams[a : b - shingle + 1])
        elif b > a:
            short = words.hashes[a:b]
            value = np.uint64(b - a)
            for h in short:
                value = mix(np.array([value]) * np.uint64(0xD6E8FEB86659FD93) + h)[0]
            yield i, np.array([value], dtype=np.uint64)


def digest(values: np.ndarray) -> bytes:
    """128 bits that name a set: its size and two sums of differently mixed members."""
    a = mix(values).sum(dtype=np.uint64)
    b = mix(values ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64)
    return len(values).to_bytes(4, "little") + int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little")


def differences(one: int, two: int, percent: int) -> int:
    """Most shingles in which two similar sets of these sizes differ."""
    return (one + two) * (100 - percent) // (100 + percent)


def band(size: int) -> int:
    """0 for the fine band, then one band per doubling."""
    return 0 if size < FINE_BELOW else size.bit_length() - FINE_BELOW.bit_length() + 1


def partitions(number: int) -> int:
    """Second-level partitions of a band: an even number, two per first-level group."""
    return 2 * math.ceil(DENSITY * (FINE_BELOW << number) / 2)


@lru_cache(maxsize=1 << 16)
def _signed(number: int, size: int, percent: int) -> int:
    """How many partitions a set of this size signs in a band, never falling with the size.

    Enough for the largest partner it can have there: filled partitions of that
    partner less its differences leave a margin for chance and for frequent
    signatures.
    """
    n, low, high = partitions(number), FINE_BELOW << (number - 1), (FINE_BELOW << number) - 1
    larger = min(max(size * 100 // percent, low), high)
    filled = 1 - math.exp(-larger / n)
    need = differences(larger, larger, percent) + 0.07 * larger + 6
    return min(n, math.ceil(need / filled))


def _parts(values: np.ndarray, number: int) -> np.ndarray:
    n = partitions(number)
    return ((mix(values ^ np.uint64(number)) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def signatures(values: np.ndarray, number: int, percent: int) -> np.ndarray:
    """Signatures of a set in one band: a hash of band, partition and what the set has there."""
    if number <= 0:
        return mix(values + np.uint64(number + 1))
    parts = _parts(values, number)
    order = np.argsort(parts, kind="stable")
    parts, inner = parts[order], mix(values[order] + np.uint64(7))
    starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])
    sums = np.add.reduceat(inner, starts)
    ids = parts[starts]
    kept = ids < _signed(number, len(values), percent)
    return mix(sums[kept] + mix(ids[kept] * np.uint64(4096) + np.uint64(number)))


def slack(values: np.ndarray, percent: int) -> int:
    """Signatures at least that the set shares with any similar set.

    Counted on the partitions both sign: as the larger one in its own band with
    the smallest partner, and as the smaller one in each band it signs.
    """
    size, own = len(values), band(len(values))
    partner = size * 100 // percent
    least = size - differences(size, partner, percent)
    for number in bands_of(size, percent):
        if number == 0:
            continue
        parts = np.unique(_parts(values, number))
        signed = _signed(number, size, percent)
        high = (FINE_BELOW << number) - 1
        filled = int((parts < signed).sum())
        least = min(least, filled - differences(size, min(partner, high), percent))
        if number == own:
            signed = min(signed, _signed(number, -(-size * percent // 100), percent))
            least = min(least, int((parts < signed).sum()) - differences(size, size, percent))
    return least


def bands_of(size: int, percent: int) -> list[int]:
    """Bands in which a set signs: its own, and the next if it can be the smaller one of a pair there.

    By chance a set may fill so few partitions that no bound holds for it
    (``slack`` below 1).  A pair needs the bound of one of its sets only, so
    such sets sign each shingle in band -1 to find one another.
    """
    own = band(size)
    upper = FINE_BELOW << own
    return [own, own + 1] if size >= -(-upper * percent // 100) else [own]


def jaccard_groups(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, pair_limit: int = PAIR_LIMIT, block: int = BLOCK
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id, n_copies, n_links.

    ``docs`` needs doc_id (whole number) and text.  Documents of equal sets
    form a class (class_id: its smallest doc_id; n_copies: its documents).
    n_links counts the other documents at ``percent`` / 100 similarity or more,
    copies included; component_id is the smallest doc_id reachable by links.

    Null, empty and blank texts have no shingles, no links and stay alone.  Rows
    of one doc_id are one document with the greatest of their texts.  Rows with
    a null doc_id are left out.  Other columns of ``docs`` are ignored.  No
    rows: no rows.
    """
    prepared(docs.sparkSession)
    docs = texts_by_id(docs)

    def keys(batches):
        let_go()
        for batch in blocked(batches, "text"):
            sizes, names, least = [0] * batch.num_rows, [None] * batch.num_rows, [0] * batch.num_rows
            for i, values in shingle_sets(batch, shingle):
                sizes[i], names[i], least[i] = len(values), digest(values), slack(values, percent)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(least, pa.int64())],
                ["doc_id", "n_shingles", "name", "slack"],
            )

    keyed = scratch.saved(
        docs.mapInArrow(keys, "doc_id bigint, n_shingles bigint, name binary, slack bigint"), "keys"
    )
    with_set = keyed.filter("name is not null")
    names = with_set.groupBy("name").agg(F.min("doc_id").alias("class_id"))
    of = scratch.saved(with_set.join(names, "name").drop("name"), "classes")
    classes = of.groupBy("class_id").agg(F.count("*").alias("n_copies"), F.first("n_shingles").alias("size"))
    candidates = _candidates(docs, of, shingle, percent, pair_limit)
    counts, edges = _verified(docs, classes, candidates, shingle, percent, block)
    roots = components(edges, "a", "b").withColumnRenamed("node", "class_id")
    found = (
        classes.join(counts, "class_id", "left")
        .join(roots, "class_id", "left")
        .select(
            "class_id", "n_copies",
            (F.col("n_copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"),
            F.coalesce("component", "class_id").alias("component_id"),
        )
    )
    zero = F.lit(0).cast("bigint")
    alone = keyed.filter("name is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"),
        (zero + 1).alias("n_copies"), zero.alias("n_links"),
    )
    return (
        of.join(found, "class_id")
        .select("doc_id", "n_shingles", "component_id", "class_id", "n_copies", "n_links")
        .unionByName(alone)
    )


def _blobs(place: np.ndarray, sigs: np.ndarray, ids: np.ndarray, kind: int) -> tuple[list, list, list]:
    """(place, kind, bytes) of signatures and their sets, which stand sorted by place.

    Sets are sorted and told by their distances, and equal bytes of all stand side by side, so that what is
    always zero costs next to nothing when the shuffle compresses it.
    """
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, dtype=np.int64)
    out = []
    for a, b in zip(starts, np.r_[starts[1:], len(place)]):
        order = np.argsort(ids[a:b], kind="stable")
        steps = np.diff(ids[a:b][order], prepend=np.int64(0))
        rows = np.concatenate([x.view(np.uint8).reshape(-1, 8) for x in (steps, sigs[a:b][order])], axis=1)
        out.append(rows[:, _SENT].T.tobytes())
    return place[starts].tolist(), [kind] * len(out), out


def _from_blobs(blobs: list) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, without their lowest byte, and sets of ``_blobs``."""
    sigs, ids = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for blob in blobs:
        sent = np.frombuffer(blob, dtype=np.uint8).reshape(len(_SENT), -1).T
        rows = np.zeros((len(sent), 16), dtype=np.uint8)
        rows[:, _SENT] = sent
        rows = rows.view(np.uint64)
        ids.append(np.cumsum(rows[:, 0].view(np.int64)))
        sigs.append(rows[:, 1] >> np.uint64(8))
    return np.concatenate(sigs), np.concatenate(ids)


def _candidates(docs: DataFrame, of: DataFrame, shingle: int, percent: int, pair_limit: int) -> DataFrame:
    """(class_id, group): candidate components of classes."""
    parts = _partition_count(of)
    firsts = of.filter("doc_id = class_id")
    signing = bloom.build(firsts, "class_id", bloom.room(firsts.count()))

    def placed(at: np.ndarray) -> np.ndarray:
        return ((at >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)

    def emit(sigs: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        """One row per place.  A signature held by more than ``pair_limit`` sets here is frequent: its sets are
        marked, at places of their own, and only one of them, to tell the others, goes to the signature's place."""
        order = np.lexsort((ids, sigs))
        sigs, ids = sigs[order], ids[order]
        starts = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]])
        lengths = np.diff(np.r_[starts, len(sigs)])
        hot = np.repeat(lengths > pair_limit, lengths)
        told = starts[lengths > pair_limit]
        away = placed(mix(ids[hot].view(np.uint64)))
        order = np.argsort(away, kind="stable")
        sent = zip(
            _blobs(placed(sigs[~hot]), sigs[~hot], ids[~hot], 0),
            _blobs(away[order], sigs[hot][order], ids[hot][order], 1),
            _blobs(placed(sigs[told]), sigs[told], ids[told], 2),
        )
        kinds = (pa.int32(), pa.int8(), pa.binary())
        return pa.record_batch([pa.array(sum(c, []), k) for c, k in zip(sent, kinds)], ["place", "kind", "rows"])

    def sign(batches):
        """Of equal sets only the first signs, but for a few that the filter takes for one: their rows do no harm."""
        let_go()
        held, ids, total = [], [], 0
        for batch in blocked(batches, "text"):
            keep = bloom.may_hold(signing, batch.column("doc_id").to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(keep))
            doc = batch.column("doc_id")
            for i, values in shingle_sets(batch, shingle):
                bands = bands_of(len(values), percent)
                for number in bands if slack(values, percent) > 0 else [*bands, -1]:
                    sigs = signatures(values, number, percent)
                    held.append(sigs)
                    ids.append(np.full(len(sigs), doc[i].as_py(), dtype=np.int64))
                    total += len(sigs)
            if total > ROWS_IN_TASK:
                yield emit(np.concatenate(held), np.concatenate(ids))
                held, ids, total = [], [], 0
        if total:
            yield emit(np.concatenate(held), np.concatenate(ids))

    def meet(batches):
        """Sets that share a signature: their pairs if they are few, else a mark for each."""
        let_go()
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for kind, rows in zip(batch.column("kind").to_pylist(), batch.column("rows").to_pylist()):
                held[kind].append(rows)
        if not any(held):
            return
        sig, who = _from_blobs(held[1])
        out = [(who, sig.view(np.int64), np.full(len(who), -1, dtype=np.int32))]
        (sig, who), (told, by) = _from_blobs(held[0]), _from_blobs(held[2])
        kind = np.repeat(np.array([0, 2], dtype=np.int8), [len(sig), len(told)])
        sig, who = np.concatenate([sig, told]).view(np.int64), np.concatenate([who, by])
        del held, told, by
        order = np.lexsort((kind, who, sig))
        sig, who, kind = sig[order], who[order], kind[order]
        if len(sig):
            starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            lengths = np.diff(np.r_[starts, len(sig)])
            hot = (lengths > pair_limit) | (np.maximum.reduceat(kind, starts) == 2)
            mark = np.repeat(hot, lengths) & (kind == 0)
            out.append((who[mark], sig[mark], np.full(mark.sum(), -1, dtype=np.int32)))
            small = np.flatnonzero(~hot & (lengths > 1))
            firsts, seconds = [], []
            for gap in range(1, pair_limit):
                reach = np.repeat(starts[small], np.maximum(lengths[small] - gap, 0))
                inner = np.arange(len(reach)) - np.repeat(
                    np.r_[0, np.cumsum(np.maximum(lengths[small] - gap, 0))[:-1]] if len(small) else [],
                    np.maximum(lengths[small] - gap, 0),
                )
                left = (reach + inner).astype(np.int64)
                firsts.append(who[left])
                seconds.append(who[left + gap])
            a, b = np.concatenate(firsts), np.concatenate(seconds)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            if len(a):
                new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                out.append((a[new], b[new], np.diff(np.r_[new, len(a)]).astype(np.int32)))
        for x in out:
            for at in range(0, len(x[0]), 100_000):
                yield pa.record_batch([pa.array(c[at : at + 100_000]) for c in x], ["a", "b", "shared"])

    rows = docs.filter("text is not null").mapInArrow(sign, "place int, kind tinyint, rows binary")
    met = scratch.saved(
        rows.repartitionById(parts, "place").mapInArrow(meet, "a bigint, b bigint, shared int"), "met"
    )
    marks = met.filter("shared < 0").select(F.col("a").alias("doc_id"), F.col("b").alias("sig"))
    bounds = scratch.saved(
        firsts.join(marks.groupBy("doc_id").agg(F.count("*").alias("hot")), "doc_id", "left")
        .select("doc_id", "class_id", "n_shingles", (F.col("slack") - F.coalesce("hot", F.lit(0))).alias("needs")),
        "bounds",
    )
    exposed = marks.join(bounds.filter("needs < 1").select("doc_id", "class_id"), "doc_id").select("sig", "class_id").distinct()
    centres = exposed.groupBy("sig").agg(F.min("class_id").alias("centre"))
    hot_edges = exposed.join(centres, "sig").select(F.col("class_id").alias("a"), F.col("centre").alias("b")).distinct()
    pairs = met.filter("shared > 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    one, two = (
        bounds.select(
            F.col("doc_id").alias(c), F.col("class_id").alias(f"{c}_class"),
            F.col("n_shingles").alias(f"{c}_size"), F.col("needs").alias(f"{c}_needs"),
        )
        for c in ("a", "b")
    )
    close = F.least("a_size", "b_size") * 100 >= F.greatest("a_size", "b_size") * percent
    pair_edges = (
        pairs.join(one, "a").join(two, "b")
        .filter(close & (F.col("shared") >= F.greatest("a_needs", "b_needs")))
        .select(F.col("a_class").alias("a"), F.col("b_class").alias("b"))
    )
    groups = scratch.saved(
        components(pair_edges.unionByName(hot_edges), "a", "b").select(
            F.col("node").alias("class_id"), F.col("component").alias("group")
        ),
        "groups",
    )
    for done in (met, bounds):
        scratch.drop(done)
    return groups


def _partition_count(of: DataFrame) -> int:
    """So many partitions that each holds some 600,000 signatures."""
    total = of.filter("doc_id = class_id").agg(F.sum("n_shingles")).first()[0] or 0
    return max(shuffle_partitions(of), math.ceil(total / 1_000_000))


def _verified(
    docs: DataFrame, classes: DataFrame, candidates: DataFrame, shingle: int, percent: int, block: int
) -> tuple[DataFrame, DataFrame]:
    """Link counts per class and spanning edges, from comparing the sets of each candidate component."""
    units = candidates.join(classes, "class_id")
    sizes = units.groupBy("group").agg(F.count("*").alias("members"), F.sum("size").alias("volume"))
    units = (
        units.join(sizes, "group")
        .withColumn("blocks", F.ceil(F.greatest(F.col("members") / block, F.col("volume") / BLOCK_SHINGLES)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
        .select("class_id", "group", "n_copies", "blocks", "own")
    )
    wanted = bloom.build(candidates, "class_id", bloom.room(candidates.count()))

    def sets(batches):
        let_go()
        for batch in blocked(batches, "text"):
            ids = batch.column("doc_id")
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            keep = valid & bloom.may_hold(wanted, ids.fill_null(0).to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(keep))
            rows = [(batch.column("doc_id")[i].as_py(), v.tobytes()) for i, v in shingle_sets(batch, shingle)]
            yield pa.record_batch(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                ["class_id", "members"],
            )

    def compare(batches):
        for key, rows in _runs(batches):
            yield from _block(key, rows, percent)

    members = docs.filter("text is not null").mapInArrow(sets, "class_id bigint, members binary")
    laid = (
        members.join(units, "class_id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "group", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"),
            "own", "class_id", "n_copies", "members",
        )
    )
    laid = laid.repartition(shuffle_partitions(docs), "group", "row", "col").sortWithinPartitions("group", "row", "col")
    found = scratch.saved(
        laid.mapInArrow(compare, "a bigint, b bigint, partners bigint"), "links"
    )
    counts = found.filter("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("partners").alias("partners"))
    return counts, found.filter("b is not null").select("a", "b")


def _runs(batches) -> Iterator[tuple[tuple, list]]:
    """Rows of one (group, row, col) after the other, from sorted batches."""
    key, rows = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for group, row, col, own, who, copies, members in zip(*columns):
            if (group, row, col) != key:
                if rows:
                    yield key, rows
                key, rows = (group, row, col), []
            rows.append((own, who, copies, np.frombuffer(members, dtype=np.uint64)))
    if rows:
        yield key, rows


def _common(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 matrices over blocks of shingles that two sets or more have."""
    sets = one + ([] if two is one else two)
    values = np.concatenate(sets)
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kept = shared[inverse]
    rows, cols = rows[kept], number[inverse[kept]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    out = np.zeros((len(one), len(two)), dtype=np.float32)
    for low in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(cols, [low, low + COLUMNS])
        grid = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        grid[rows[a:b], cols[a:b] - low] = 1
        left = grid[: len(one)]
        out += left @ (left if two is one else grid[len(one) :]).T
    return out


def _block(key: tuple, rows: list, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between the sets of two blocks of a group, or inside one."""
    _, row, col = key
    first = [r for r in rows if r[0] == row]
    second = first if row == col else [r for r in rows if r[0] == col]
    if not first or not second:
        return
    sets = [r[3] for r in first]
    common = _common(sets, sets if second is first else [r[3] for r in second])
    a, b = (np.array([len(r[3]) for r in side], dtype=np.float64) for side in (first, second))
    linked = 100.0 * common >= percent * (a[:, None] + b[None, :] - common)
    if second is first:
        np.fill_diagonal(linked, False)
    one, two = (np.array([r[1] for r in side], dtype=np.int64) for side in (first, second))
    copies_one, copies_two = (np.array([r[2] for r in side], dtype=np.int64) for side in (first, second))
    who, partners = [one], [linked @ copies_two]
    if second is not first:
        who.append(two)
        partners.append(linked.T @ copies_one)
    who, partners = np.concatenate(who), np.concatenate(partners)
    told = partners > 0
    edges = _spanning(linked, one, two, second is first)
    ends = [np.array([e[i] for e in edges], dtype=np.int64) for i in (0, 1)]
    yield pa.record_batch(
        [
            pa.array(np.concatenate([who[told], ends[0]])),
            pa.concat_arrays([pa.nulls(int(told.sum()), pa.int64()), pa.array(ends[1])]),
            pa.array(np.concatenate([partners[told], np.zeros(len(edges), dtype=np.int64)])),
        ],
        ["a", "b", "partners"],
    )


def _spanning(linked: np.ndarray, one: np.ndarray, two: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links: at most one for each set."""
    seen = (np.zeros(len(one), dtype=bool), np.zeros(len(two), dtype=bool))
    if same:
        seen = (seen[0], seen[0])
    names, edges = (one, two), []
    for start in np.flatnonzero(linked.any(axis=1)):
        if seen[0][start]:
            continue
        seen[0][start] = True
        queue = [(0, int(start))]
        while queue:
            side, i = queue.pop()
            row = linked[:, i] if side else linked[i]
            other = 0 if side or same else 1
            new = np.flatnonzero(row & ~seen[other])
            seen[other][new] = True
            edges.extend((int(names[side][i]), int(names[other][j])) for j in new)
            queue.extend((other, int(j)) for j in new)
    return edges


def first_of_groups(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its columns, one document of each group of links: the one of the smallest doc_id.

    Documents without words stay.  Of rows that share a doc_id all stay or go;
    rows with a null doc_id stay.  The rows that go are told apart by a filter
    of fixed size, so only rows it lets through are joined.
    """
    groups = jaccard_groups(docs.select("doc_id", "text"), **options)
    other, doubt = unused(docs, "gone", "doubtful")
    gone = scratch.saved(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(other)), "gone")
    found = bloom.build(gone, other)

    @F.arrow_udf("boolean")
    def doubtful(ids: pa.Array) -> pa.Array:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        return pa.array(known & bloom.may_hold(found, ids.fill_null(0).to_numpy(zero_copy_only=False)))

    kept, own = all_columns(docs), F.col("doc_id").cast("bigint")
    marked = docs.withColumn(doubt, doubtful(own))
    checked = marked.filter(F.col(doubt)).join(gone, own == F.col(other), "left_anti")
    return checked.select(*kept).unionByName(marked.filter(~F.col(doubt)).select(*kept))
