"""Engagement gates and validation predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .core import strip


def page_gate(dwell: Column, scroll: Column, interactions: Column, revisits: Column) -> Column:
    engaged = (
        (dwell >= K.PAGE_LONG_DWELL)
        | (scroll >= K.PAGE_MIN_SCROLL)
        | (interactions >= K.PAGE_MIN_INTERACTIONS)
        | (revisits > 0)
    )
    return F.coalesce((dwell >= K.PAGE_MIN_DWELL) & engaged, F.lit(False))


def app_page_gate(dwell: Column, interactions: Column) -> Column:
    return F.coalesce(
        (dwell >= K.PAGE_MIN_DWELL) | (interactions >= K.PAGE_MIN_INTERACTIONS), F.lit(False)
    )


def video_gate(watch: Column, triggered_by: Column, interaction: Column, is_revisit: Column) -> Column:
    by_hand = (triggered_by == "manual_interaction") & (F.coalesce(interaction, F.lit("")) != "")
    return (
        F.coalesce(watch >= K.VIDEO_MIN_WATCH, F.lit(False))
        | F.coalesce(by_hand, F.lit(False))
        | F.coalesce(is_revisit, F.lit(False))
    )


def valid_visit(
    dwell: Column, scroll: Column, interactions: Column, revisits: Column, words: Column
) -> Column:
    """Bounds of a page visit; required fields must be present, word count may be null."""
    return (
        F.coalesce(dwell >= 0, F.lit(False))
        & F.coalesce(scroll.between(0.0, 1.0), F.lit(False))
        & F.coalesce(interactions >= 0, F.lit(False))
        & F.coalesce(F.coalesce(revisits, F.lit(0)) >= 0, F.lit(False))
        & F.coalesce(words, F.lit(0)).__ge__(0)
    )


def valid_query(text: Column) -> Column:
    return F.coalesce(F.length(text).between(1, K.QUERY_MAX_CHARS), F.lit(False))


def is_live_enriched(is_deleted: Column, preprocessed: Column) -> Column:
    return ~is_deleted & preprocessed


def effective_sources(sources: Column) -> Column:
    """Source list with the 'selects everything' forms opened to all sources."""
    everything = F.array(*[F.lit(s) for s in K.SOURCES])
    opened = (
        sources.isNull()
        | (F.size(sources) == 0)
        | F.array_contains(sources, K.ALL_SOURCES_MARK)
    )
    return F.when(opened, everything).otherwise(F.array_distinct(sources))
