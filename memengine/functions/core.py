"""Column helpers shared by the expression modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a Unicode-aware strip removes; `trim` alone only removes spaces.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A lambda variable is evaluated once per row, while repeating a column
    expression may evaluate it once per mention (and, inside another lambda,
    once per element).
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def strip_long(text: Column) -> Column:
    """``strip`` for whole documents.

    Trimming a character set walks the entire text; looking at both ends first
    leaves that for the few texts that need it.
    """

    def ends(t: Column) -> Column:
        ragged = F.left(t, F.lit(1)).isin(*WHITESPACE) | F.right(t, F.lit(1)).isin(*WHITESPACE)
        return F.when(ragged, strip(t)).otherwise(t)

    return let(F.trim(text), ends)


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def rstrip_long(text: Column) -> Column:
    """``rstrip`` that walks only texts with something to remove."""
    return let(text, lambda t: F.when(F.right(t, F.lit(1)).isin(*WHITESPACE), rstrip(t)).otherwise(t))


def blank_to_null(text: Column) -> Column:
    return let(text, lambda t: F.when(strip(t) != "", t))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions)


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    return any_of(text.contains(n) for n in needles)


def where(text: Column, needles: list[str], change: Callable[[Column], Column]) -> Column:
    """``change`` of the texts that hold one of ``needles``; others stay as they are.

    For patterns that can match nowhere else: looking for bytes costs a small part of a pass of a pattern.
    """
    return let(text, lambda t: F.when(contains_any(t, needles), change(t)).otherwise(t))


def ends_with_any(text: Column, suffixes: Iterable[str]) -> Column:
    return any_of(text.endswith(s) for s in suffixes)


def string_array(values: Iterable[str]) -> Column:
    """Constant array; long ones are one folded literal instead of one per value."""
    values = list(values)
    if len(values) <= 8:
        return F.array(*[F.lit(v) for v in values])
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def string_map(pairs: dict[str, str]) -> Column:
    """Constant map as one folded literal."""
    text = "\x1e".join(f"{k}\x1f{v}" for k, v in pairs.items())
    return F.str_to_map(F.lit(text), F.lit("\x1e"), F.lit("\x1f"))


def code_point(number: Column) -> Column:
    """Character of a code point; works beyond Latin-1, unlike ``chr``."""
    padded = F.lpad(F.hex(number.cast("bigint")), 8, "0")
    return F.decode(F.unhex(padded), "UTF-32")


def places_below(entries: Column, value: Column) -> Column:
    """How many of the sorted ``entries`` are not above ``value``: halving, some twenty comparisons for a million."""
    start = F.struct(F.lit(0).alias("low"), F.size(entries).alias("high"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        up = (state["low"] < state["high"]) & (F.get(entries, middle) <= value)
        return F.struct(
            F.when(up, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(up | (state["low"] >= state["high"]), state["high"]).otherwise(middle).alias("high"),
        )

    rounds = F.sequence(F.lit(0), F.length(F.bin(F.size(entries).cast("bigint"))))
    return F.aggregate(rounds, start, halve, lambda state: state["low"])
