"""Words of whole texts as numpy arrays: places and 64-bit hashes, a column of an Arrow batch at a time.

A word is a run of bytes other than ASCII white space (space, and tab to
carriage return), as in ``[^\\x20\\x09-\\x0D]+``.  Hashes are polynomial sums
modulo 2**64 with a final mixing, so they depend on the words alone, never on
the batch, the task or the machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\v\f\r"
PIECE_BYTES = 1 << 20

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Fixed odd multipliers and their inverses modulo 2**64.
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            self.up, self.down = (self._table(b, size) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)


_BYTES, _WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


@dataclass
class Words:
    """Words of some texts: ``hashes[first[i]:first[i + 1]]`` are those of text ``i``.

    ``starts`` and ``ends`` are byte places in ``data``; text ``i`` begins at ``begin[i]``.
    """

    data: np.ndarray
    begin: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    def grams(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each word on; those that run past their text mean nothing."""
        total = len(self.hashes)
        out = np.zeros(total, dtype=np.uint64)
        if total >= n:
            up, down = _WORDS.take(total + 1)
            sums = np.zeros(total + 1, dtype=np.uint64)
            np.cumsum(self.hashes * up[:total], out=sums[1:])
            out[: total - n + 1] = mix((sums[n:] - sums[: total - n + 1]) * down[: total - n + 1] + np.uint64(n))
        return out


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[places[0] : places[-1]], places - places[0]


def words_of(column: pa.Array, lower: bool = False) -> Words:
    data, begin = string_parts(column)
    if lower:
        data = _LOWER[data]
    inside = _IS_WORD[data]
    n = len(data)
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[begin[:-1][begin[:-1] < n]] = False
    last = begin[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):  # a few MB of bytes at a time, cut between words
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE_BYTES)))
        low, high = starts[at], ends[to - 1]
        up, down = _BYTES.take(int(high - low))
        sums = np.zeros(int(high - low) + 1, dtype=np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        hashes[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return Words(data, begin, np.searchsorted(starts, begin), starts, ends, hashes)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one whole row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(size)
    if at < len(sizes):
        yield batch.slice(at)


def blocked(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """``pieces`` of all batches of a task; memory that they no longer need goes back when the task ends."""
    for batch in batches:
        yield from pieces(batch, column, limit)
    pa.default_memory_pool().release_unused()
