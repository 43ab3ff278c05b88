"""Row-to-row context per key, safe for hot keys.

A plain window over a key sorts all rows of that key in one task.  Here each
key is cut into time slots, and a slot that still holds many rows into blocks of
about ``BLOCK_ROWS``, at quantiles of a sample of its rows.  Windows run inside
(key, slot, block), and one small summary row of each carries the state over the
borders.  The summary side has one row per block, never one per event, and it is
the side that moves for the join, because the rows are already spread.
Null keys are one key.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import places_below
from ..runtime import cut_lineage

DAY = 86_400
BLOCK_ROWS = 1_000_000
OVERSAMPLE = 16  # sampled rows to a block
PLACE = ["_slot", "_block"]


def _same(left: list[str], right: str = "_of_") -> Column:
    """The columns agree with those of the prefixed names, where null equals null."""
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"{right}{c}")) for c in left])


def _borders(rows: DataFrame, keys: list[str], order: list[str], block_rows: int) -> DataFrame | None:
    """(keys, slot, borders): the ``order`` values that begin the blocks of each busy slot but its first; nothing if none is busy.

    Rows are sampled by a hash of their order, so the same rows give the same borders.  There are no more borders
    than rows by ``block_rows``, a few per busy slot.
    """
    of = [*keys, "_slot"]
    busy = rows.groupBy(*of).count().filter(F.col("count") > block_rows).drop("count")
    if busy.isEmpty():
        return None
    busy = cut_lineage(busy.select(*[F.col(c).alias(f"_of_{c}") for c in of]))
    sampled = F.pmod(F.xxhash64(*order), F.lit(max(1, block_rows // OVERSAMPLE))) == 0
    picked = rows.filter(sampled).join(F.broadcast(busy), _same(of)).groupBy(*[f"_of_{c}" for c in of]).agg(
        F.sort_array(F.collect_list(F.struct(*order))).alias("_sample")
    )
    every = F.filter("_sample", lambda _, i: (i % OVERSAMPLE == 0) & (i > 0))
    return cut_lineage(picked.select(*[f"_of_{c}" for c in of], every.alias("_borders")))


def with_slot(df: DataFrame, keys: list[str], order: list[str], seconds: int = DAY, block_rows: int | None = None) -> DataFrame:
    """Add the slot of ``order[0]`` and the block of the row in it (``PLACE``).

    The functions below do it themselves, but for rows that are placed already, whose columns they keep: one placement
    can serve several of them.
    """
    rows = df.withColumn("_slot", F.floor(F.unix_micros(F.col(order[0])) / F.lit(seconds * 1_000_000)))
    borders = _borders(rows.select(*dict.fromkeys([*keys, *order]), "_slot"), keys, order, block_rows or BLOCK_ROWS)
    if borders is None:
        return rows.withColumn("_block", F.lit(0))
    of = [*keys, "_slot"]
    joined = rows.join(F.broadcast(borders), _same(of), "left")
    block = F.when(F.col("_borders").isNull(), 0).otherwise(places_below(F.col("_borders"), F.struct(*order)))
    return joined.withColumn("_block", block).drop("_borders", *[f"_of_{c}" for c in of])


def _placed(df: DataFrame, keys: list[str], order: list[str], seconds: int) -> tuple[DataFrame, list[str]]:
    """Placed rows, and the columns that this has added."""
    if set(PLACE) <= set(df.columns):
        return df, []
    return with_slot(df, keys, order, seconds), PLACE


def _slots(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(*PLACE)


def _with_carried(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on the keys, the slot and the block, where null equals null."""
    on = [*keys, *PLACE]
    renamed = carried.select(
        *[F.col(c).alias(f"_of_{c}") for c in on], *[c for c in carried.columns if c not in on]
    )
    return rows.join(renamed, _same(on), "left").drop(*[f"_of_{c}" for c in on])


def neighbour(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fields: list[str],
    out: str,
    *,
    step: int = 1,
    slot_seconds: int = DAY,
) -> DataFrame:
    """Add ``out``: a struct of ``fields`` of the previous (step=1) or next (step=-1) row.

    ``order`` starts with the timestamp and must be unique within a key.
    """
    pick, edge = (F.lag, F.max) if step == 1 else (F.lead, F.min)
    payload = F.struct(*order, *[f for f in fields if f not in order])
    rows, added = _placed(df, keys, order, slot_seconds)
    rows = rows.withColumn("_pay", payload)
    inside = Window.partitionBy(*keys, *PLACE).orderBy(*order)
    edges = rows.groupBy(*keys, *PLACE).agg(edge("_pay").alias("_edge"))
    carried = edges.select(*keys, *PLACE, pick("_edge").over(_slots(keys)).alias("_carry"))
    joined = _with_carried(rows.withColumn("_near", pick("_pay").over(inside)), carried, keys)
    return joined.withColumn(out, F.coalesce("_near", "_carry")).drop(*added, "_pay", "_near", "_carry")


def running_total(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, *, slot_seconds: int = DAY
) -> DataFrame:
    """Add ``out``: sum of ``value`` over the key's rows up to and including this one."""
    rows, added = _placed(df, keys, order, slot_seconds)
    rows = rows.withColumn("_v", value)
    inside = Window.partitionBy(*keys, *PLACE).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = _slots(keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, *PLACE).agg(F.sum("_v").alias("_sum"))
    offsets = sums.select(*keys, *PLACE, F.sum("_sum").over(before).alias("_offset"))
    joined = _with_carried(rows.withColumn("_in", F.sum("_v").over(inside)), offsets, keys)
    total = F.col("_in") + F.coalesce(F.col("_offset"), F.lit(0))
    return joined.withColumn(out, total).drop(*added, "_v", "_in", "_offset")


def last_known(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], *, slot_seconds: int = DAY
) -> DataFrame:
    """Fill nulls of ``columns`` with the key's latest earlier value (this row included)."""
    rows, added = _placed(df, keys, order, slot_seconds)
    inside = Window.partitionBy(*keys, *PLACE).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = _slots(keys).rowsBetween(Window.unboundedPreceding, -1)
    when = F.struct(*order)
    lasts = rows.groupBy(*keys, *PLACE).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), when)).alias(f"_last_{c}") for c in columns]
    )
    carried = lasts.select(
        *keys, *PLACE,
        *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns],
    )
    filled = rows
    for c in columns:
        filled = filled.withColumn(c, F.last(c, ignorenulls=True).over(inside))
    joined = _with_carried(filled, carried, keys)
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(c, f"_carry_{c}"))
    return joined.drop(*added, *[f"_carry_{c}" for c in columns])
