"""Token ids of whole texts with a given tokenizer file, sparing the tokenizer words it has just seen.

The byte-level pre-tokenizer never joins a character that is not white space
with white space behind it, so a text falls into parts (white space and what
follows up to the next) that can be encoded apart.  A worker keeps the ids of
parts it has met; the tokenizer runs on the new ones, many at once.  What is
done per occurrence of a part is done on whole arrays: parts are cut where a
word ends, numbered by a dictionary encoding, and their ids are gathered.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .held import held
from .words import string_parts

KEPT_PARTS = 1_200_000
LONG_PART = 64
TEXT_BYTES = 4 << 20  # of text encoded at once
_IS_MARK = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"))
_IS_LETTER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
# White space other than the space and the line feed; texts that hold any are encoded whole.
_OTHER_SPACE = r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class _Known:
    """Parts with a number each, and their ids one after the other."""

    def __init__(self):
        self.starts, self.ids = np.zeros(1024, dtype=np.int64), np.zeros(4096, dtype="<u4")
        self.clear()

    def __len__(self) -> int:
        return len(self.numbers)

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}

    def items(self) -> Iterator[tuple[str, bytes]]:
        return ((p, self.ids[self.starts[n] : self.starts[n + 1]].tobytes()) for p, n in self.numbers.items())

    def add(self, parts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Number new parts in their order; ``ids`` holds ``lengths`` ids of each."""
        n, at = len(self), int(self.starts[len(self)])
        if n + len(parts) + 1 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * (n + len(parts) + 1))
        if at + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (at + len(ids)))
        self.starts[n + 1 : n + 1 + len(parts)] = at + np.cumsum(lengths)
        self.ids[at : at + len(ids)] = ids
        self.numbers.update(zip(parts, range(n, n + len(parts))))

    def gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts of these numbers, and how many each has."""
        lengths = self.starts[numbers + 1] - self.starts[numbers]
        before = np.cumsum(lengths) - lengths
        return self.ids.take(np.repeat(self.starts[numbers] - before, lengths) + np.arange(int(lengths.sum()))), lengths


class Encoder:
    """``encode(texts)`` gives one array of unsigned 32-bit ids per text; null counts as empty.

    ``kept_parts`` bounds the parts remembered, some 200 bytes each: fewer spare memory and cost time.  They are
    two generations: when the young one holds half of them it becomes the old one, and what is met again moves over,
    so common parts are never learned twice.
    Special tokens are neither added nor read from the texts: their strings are ordinary text.
    """

    def __init__(self, path: str, kept_parts: int = KEPT_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kept_parts = kept_parts
        self.tool = Tokenizer.from_file(path)
        self.tool.encode_special_tokens = True
        self.tool.no_truncation()
        self.tool.no_padding()
        sizes = np.zeros(self.tool.get_vocab_size(), dtype=np.int64)
        for token, i in self.tool.get_vocab().items():
            sizes[i] = len(token)
        self.token_bytes = sizes
        self.known, self.older = _Known(), _Known()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, parts: list[str]) -> None:
        """Learn new parts: encode them as one text and cut its ids at their borders, which the byte lengths of the tokens give.

        White space alone would merge with the part behind it, so such parts go by themselves.
        """
        lone = [p for p in parts if p[0] not in " \n" or p[-1] in " \n"]
        if lone:
            ids = self._whole(lone)
            self.known.add(lone, np.concatenate(ids), np.array([len(x) for x in ids]))
        rest = [p for p in parts if p[0] in " \n" and p[-1] not in " \n"]
        for low in range(0, len(rest), 4096):
            some = rest[low : low + 4096]
            ids = self._whole(["".join(some)])[0]
            borders = np.cumsum([len(p.encode()) for p in some])
            cuts = np.searchsorted(np.cumsum(self.token_bytes[ids]), borders, side="left") + 1
            self.known.add(some, ids, np.diff(cuts, prepend=0))

    def _numbers(self, parts: list[str]) -> np.ndarray:
        """Numbers of distinct parts in the young generation, learning those that neither one knows."""
        if len(self.known) > self.kept_parts // 2:
            self.known, self.older = _Known(), self.known
        numbers, count = self.known.numbers, len(parts)
        found = np.fromiter(map(numbers.get, parts, repeat(-1)), dtype=np.int64, count=count)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [parts[i] for i in missing.tolist()]
            met = np.fromiter(map(self.older.numbers.get, new, repeat(-1)), dtype=np.int64, count=len(new))
            again = np.flatnonzero(met >= 0)
            if len(again):
                self.known.add([new[i] for i in again.tolist()], *self.older.gathered(met[again]))
            self._cut([new[i] for i in np.flatnonzero(met < 0).tolist()])
            found[missing] = np.fromiter(map(numbers.__getitem__, new), dtype=np.int64, count=len(new))
        return found

    def _encoded(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of texts whose only white space is spaces and line feeds."""
        data, begin = string_parts(column)
        space = (data == 32) | (data == 10)
        last = np.zeros(len(data), dtype=bool)  # the last byte of a part: a word's, or a text's
        last[:-1] = ~space[:-1] & space[1:]
        filled = begin[1:][begin[1:] > begin[:-1]]
        last[filled - 1] = True
        # marks at the end of a part are tokens of their own behind a letter, so they are a part too
        mark = np.r_[False, _IS_MARK[data], False]
        first, final = np.flatnonzero(mark[1:-1] & ~mark[:-2]), np.flatnonzero(mark[1:-1] & ~mark[2:])
        behind = first[last[final] & (first > 0)] - 1
        last[behind[_IS_LETTER[data[behind]]]] = True
        ends = np.flatnonzero(last) + 1
        offsets = np.r_[0, ends].astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        coded = parts.dictionary_encode()
        distinct, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        sizes = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
        long = np.flatnonzero(sizes > LONG_PART)
        if len(long):
            number = np.zeros(len(distinct), dtype=np.int64)
            short = np.flatnonzero(sizes <= LONG_PART)
            number[short] = self._numbers([distinct[i] for i in short.tolist()])
        else:
            number = self._numbers(distinct)
        starts = self.known.starts[number]
        lengths = self.known.starts[number + 1] - starts
        aside = dict(zip(long.tolist(), self._whole([distinct[i] for i in long.tolist()])))
        for i, ids in aside.items():  # long parts are not remembered
            starts[i], lengths[i] = 0, len(ids)
        n = lengths[codes]
        before = np.cumsum(n) - n
        total = int(n.sum())
        out = self.known.ids.take(np.repeat(starts[codes] - before, n) + np.arange(total), mode="clip")
        if aside:
            for place in np.flatnonzero(sizes[codes] > LONG_PART).tolist():
                out[before[place] : before[place] + n[place]] = aside[int(codes[place])]
        # a part never crosses a text, so a text is the parts that end in it
        first = np.searchsorted(ends, begin, side="right")
        cuts = np.r_[before, total][first]
        return [out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        column = pc.fill_null(column.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(column, _OTHER_SPACE).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [None] * len(column)
        for keep, some in (
            (~odd, self._encoded),
            (odd, lambda c: self._whole(c.to_pylist())),
        ):
            if keep.any():
                for i, ids in zip(np.flatnonzero(keep).tolist(), some(column.filter(pa.array(keep)))):
                    out[i] = ids
        return out


def encoder(path: str, kept_parts: int = KEPT_PARTS) -> Encoder:
    """The encoder of this worker process."""
    return held(("encoder", path, kept_parts), lambda: Encoder(path, kept_parts))
