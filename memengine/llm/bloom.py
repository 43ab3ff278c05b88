"""A Bloom filter of fixed size over integer ids, to spare a later join rows that cannot match.

The filter never decides a result: the join behind it does.  Its size is a
parameter, so what is sent to the tasks is bounded however large the data; with
far more ids than bits it lets everything pass and only the saving is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix

BITS = 1 << 24
MOST_BITS = 1 << 27
PROBES = 3


def room(ids: int) -> int:
    """Bits for so many ids: ten or more for each, between ``BITS`` and ``MOST_BITS``."""
    return min(MOST_BITS, max(BITS, 1 << (10 * ids).bit_length()))


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    x = mix(ids.astype(np.int64).view(np.uint64))
    step = (x >> np.uint64(33)) | np.uint64(1)
    return [((x + np.uint64(i) * step) % np.uint64(bits)).astype(np.int64) for i in range(PROBES)]


def build(df: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Packed bits of all ids; words of 64 bits are or-ed in Spark, ``bits / 64`` rows at most arrive."""

    def words(batches):
        import pyarrow as pa

        filled = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            ids = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            for at in _places(ids, bits):
                np.bitwise_or.at(filled, at >> 3, (1 << (at & 7)).astype(np.uint8))
        packed = filled.view(np.int64)
        used = np.flatnonzero(packed)
        yield pa.record_batch([pa.array(used), pa.array(packed[used])], ["at", "bits"])

    rows = (
        df.select(column)
        .mapInArrow(words, "at bigint, bits bigint")
        .groupBy("at")
        .agg(F.bit_or("bits").alias("bits"))
        .toPandas()
    )
    packed = np.zeros(bits // 64, dtype=np.int64)
    packed[rows["at"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return packed.view(np.uint8)


def may_hold(filled: np.ndarray, ids: np.ndarray) -> np.ndarray:
    found = np.ones(len(ids), dtype=bool)
    for at in _places(ids, len(filled) * 8):
        found &= (filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found
