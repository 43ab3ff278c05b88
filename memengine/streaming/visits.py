"""Tab visits of a stream: ended at once by a close signal, or by silence.

The state of a tab holds spans: one per signal that something late may still come
before, and one for all signals before those.  A span names events, never texts: the
signals that hold them are stored once and joined when a visit is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import need_rocksdb

TEXTS = ("url", "title", "content_extract", "referrer")
_COUNTS = ("scroll_depth", "interaction_count", "word_count")
_SPAN = [
    ("start_us", "BIGINT"), ("start_id", "BIGINT"), ("end_us", "BIGINT"), ("closes", "BOOLEAN"), ("signals", "BIGINT"),
    *((c, "DOUBLE") for c in _COUNTS), ("is_app_page", "BOOLEAN"), *((f"{c}_from", "BIGINT") for c in TEXTS),
]
_NAMES = [name for name, _ in _SPAN]
_START, _ID, _END, _CLOSES, _SIGNALS, _APP = (_NAMES.index(n) for n in ("start_us", "start_id", "end_us", "closes", "signals", "is_app_page"))
_FIRST_COUNT, _FIRST_TEXT = _NAMES.index(_COUNTS[0]), _NAMES.index(f"{TEXTS[0]}_from")
_VISIT = ["opened_us", "closed_us", "ended_by", "signals", *_COUNTS, "is_app_page", *(f"{c}_from" for c in TEXTS)]


_KINDS = [{"BIGINT": int, "DOUBLE": float, "BOOLEAN": bool}[kind] for _, kind in _SPAN]


def _span(row: tuple) -> tuple:
    """A row of a frame with Python's own values; a frame has NaN for null."""
    return tuple(None if value is None or value != value else kind(value) for value, kind in zip(row, _KINDS))


def _greatest(a, b):
    return b if a is None else a if b is None else max(a, b)


def _joined(a: tuple, b: tuple) -> tuple:
    """Two spans of one visit, ``a`` before ``b``, as one."""
    counts = [_greatest(a[i], b[i]) for i in range(_FIRST_COUNT, _APP)]
    texts = [a[i] if b[i] is None else b[i] for i in range(_FIRST_TEXT, len(_NAMES))]
    return (a[_START], a[_ID], max(a[_END], b[_END]), False, a[_SIGNALS] + b[_SIGNALS], *counts, a[_APP] or b[_APP], *texts)


def settled(spans: list[tuple], gap_us: int, watermark_us: int) -> tuple[list[tuple], list[tuple], tuple[int, int] | None]:
    """(visits that are over, spans to keep, the last close) of spans in order of (time, id).

    Whatever stands before a close is over.  Behind the last close a visit is over once the watermark has passed its last
    signal by the gap.  Of the spans kept, those of one visit that the watermark has passed become one.
    """
    last_close = max((i for i, s in enumerate(spans) if s[_CLOSES]), default=-1)
    visits, now = [], None

    def end(at_us: int, by: str) -> None:
        visits.append((now[_START], at_us, by, *now[_SIGNALS:]))

    for span in spans[: last_close + 1]:
        if now and span[_START] - now[_END] > gap_us:
            end(now[_END], "silence")
            now = None
        if not span[_CLOSES]:
            now = _joined(now, span) if now else span
        elif now:
            end(span[_START], "close")
            now = None
    groups: list[list[tuple]] = []
    for span in spans[last_close + 1 :]:
        if not groups or span[_START] - max(s[_END] for s in groups[-1]) > gap_us:
            groups.append([])
        groups[-1].append(span)
    kept: list[tuple] = []
    for group in groups:
        if max(s[_END] for s in group) + gap_us <= watermark_us:
            now = group[0]
            for span in group[1:]:
                now = _joined(now, span)
            end(now[_END], "silence")
            continue
        old = [s for s in group if s[_END] <= watermark_us]
        for span in old[1:]:
            old[0] = _joined(old[0], span)
        kept += old[:1] + group[len(old) :]
    return visits, kept, spans[last_close][_START : _ID + 1] if last_close >= 0 else None


class _TabVisits(StatefulProcessor):
    """Per tab a list of spans and the last close; a timer ends a visit by silence."""

    def __init__(self, keys: list[str], gap_us: int):
        self.keys, self.gap_us = keys, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", ", ".join(f"{n} {t}" for n, t in _SPAN))
        self.closed = handle.getValueState("closed", "at_us BIGINT, id BIGINT")

    def _settle(self, key, spans: list[tuple], timerValues) -> pd.DataFrame:
        visits, kept, closed = settled(spans, self.gap_us, timerValues.getCurrentWatermarkInMs() * 1000)
        if closed:
            self.closed.update(closed)
        self.spans.put(kept) if kept else self.spans.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            first = kept[0][_END]
            for span in kept:
                if span[_START] - first > self.gap_us:
                    break
                first = max(first, span[_END])
            self.handle.registerTimer((first + self.gap_us) // 1000 + 1)
        out = pd.DataFrame(visits, columns=_VISIT, dtype=object)
        for name, value in reversed(list(zip(self.keys, key))):
            out.insert(0, name, value)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = self.closed.get() if self.closed.exists() else None
        new = []
        for frame in rows:
            for row in map(_span, frame[_NAMES].itertuples(index=False, name=None)):
                if closed is None or (row[_START], row[_ID]) > tuple(closed):
                    new.append(row)
        spans = [tuple(s) for s in self.spans.get()] + new
        yield self._settle(key, sorted(spans, key=lambda s: (s[_START], s[_ID])), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settle(key, [tuple(s) for s in self.spans.get()], timerValues)

    def close(self) -> None:
        pass


def tab_visits(signals: DataFrame, keys: dict[str, str], closes: Column, ts: str = "ts", gap_seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """Visits of tabs: the keys, opened_at, closed_at, ended_by, signals, greatest counts, and the events that hold its last texts.

    ``keys`` are names and types of what tells tabs apart.  A signal where ``closes`` holds ends the visit at its
    time, as soon as it is read, and adds nothing else; one without a visit before it is no visit.  A silence of more than
    ``gap_seconds`` ends it too, once the watermark says that nothing late can come.  Signals are taken in
    order of (``ts``, event_id).  A close may come after signals behind it: they are the next visit's.  What comes
    after a close and belongs before it is left out: the visit was reported.

    A tab's signals of one batch are in one task; a browser sends one every few seconds.  Texts: ``with_texts``.
    """
    need_rocksdb(signals.sparkSession)
    at = F.unix_micros(F.col(ts))
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("event_id"))
    spans = signals.withWatermark(ts, late).select(
        *keys, F.col(ts), at.alias("start_us"), F.col("event_id").cast("bigint").alias("start_id"), at.alias("end_us"),
        F.coalesce(closes, F.lit(False)).alias("closes"), F.lit(1).cast("bigint").alias("signals"),
        *[F.col(c).cast("double").alias(c) for c in _COUNTS], F.coalesce("is_app_page", F.lit(False)).alias("is_app_page"),
        *[filled(c).cast("bigint").alias(f"{c}_from") for c in TEXTS],
    )
    kinds = {"opened_us": "BIGINT", "closed_us": "BIGINT", "ended_by": "STRING"} | dict(_SPAN)
    visits = spans.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_TabVisits(list(keys), gap_seconds * 1_000_000),
        outputStructType=", ".join([*(f"{n} {t}" for n, t in keys.items()), *(f"{n} {kinds[n]}" for n in _VISIT)]),
        outputMode="Append", timeMode="EventTime",
    )
    moments = [F.timestamp_micros(f"{n}_us").alias(f"{n}_at") for n in ("opened", "closed")]
    return visits.select(*keys, *moments, *_VISIT[2:])


def with_texts(visits: DataFrame, signals: DataFrame, keys: list[str]) -> DataFrame:
    """Stored visits with the texts that their events hold: one join by event id, whatever the number of texts."""
    asked = visits.select(*keys, "opened_at", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_from").alias("event_id")) for c in TEXTS])).alias("_a"))
    held = signals.select("event_id", F.create_map(*[x for c in TEXTS for x in (F.lit(c), F.col(c))]).alias("_texts"))
    # no event holds the same field of two visits, so a visit gathers four short lists of one text each
    found = asked.filter("_a.event_id IS NOT NULL").select(*keys, "opened_at", "_a.*").join(held, "event_id")
    texts = found.groupBy(*keys, "opened_at").agg(*[F.max(F.when(F.col("field") == c, F.col("_texts")[c])).alias(c) for c in TEXTS])
    return visits.join(texts, [*keys, "opened_at"], "left").drop(*[f"{c}_from" for c in TEXTS])
