"""Cleaning and embeddable text per source."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions import urls
from ..functions.core import strip

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def clean_mail(df: DataFrame, body: str) -> DataFrame:
    plain = X.html_to_text(X.drop_pixels(F.col(body)))
    cleaned = X.normalize_text(X.drop_signature(X.drop_quotes(plain)))
    return df.withColumn("clean_text", cleaned).withColumn("snippet", X.truncate_words(F.col("clean_text")))


def clean_page(df: DataFrame, html: str, strategy: str = "whole") -> DataFrame:
    """Adds clean_text, headings, snippet.

    ``whole`` keeps the page as it is, ``ordered`` takes the first rich element,
    ``scored`` the element with most text, paragraphs and headings (needs a DOM).
    """
    raw = F.coalesce(F.col(html), F.lit(""))
    if strategy == "scored":
        parsed = df.withColumn("_best", _scored_content(raw))
        out = parsed.withColumn("clean_text", X.normalize_text(F.col("_best.text"))).withColumn(
            "headings", F.filter(F.transform("_best.headings", X.normalize_text), lambda h: h != "")
        ).drop("_best")
    elif strategy == "ordered":
        out = df.withColumn("clean_text", X.main_content(raw)).withColumn("headings", X.page_headings(raw))
    else:
        out = df.withColumn("clean_text", X.page_text(raw)).withColumn("headings", X.page_headings(raw))
    return out.withColumn("snippet", X.truncate_words(F.col("clean_text")))


class _Regions(HTMLParser):
    """Texts and headings of a page in order, and of each candidate element where it begins and ends in them.

    A mark is (texts, paragraphs, headings, titles) so far, so what an element holds is the difference of two
    marks, however deeply elements are nested.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None]] = []
        self.names: Counter[str] = Counter()
        self.muted = self.paragraphs = self.headings = 0
        self.texts: list[str] = []
        self.titles: list[str] = []
        self.sizes = [0]
        self.heading: list[str] | None = None
        self.regions: list[list[tuple[int, int, int, int]]] = []

    def _mark(self) -> tuple[int, int, int, int]:
        return len(self.texts), self.paragraphs, self.headings, len(self.titles)

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        region = None
        if tag in K.SCORED_NOISE_TAGS:
            self.muted += 1
        elif not self.muted:
            self.paragraphs += tag == "p"
            self.headings += tag in _HEADINGS
            if tag in K.SCORED_CANDIDATE_TAGS:
                region = len(self.regions)
                self.regions.append([self._mark()])
            if tag in _HEADINGS:
                self.heading = []
        self.names[tag] += 1
        self.open.append((tag, region))

    def handle_endtag(self, tag):
        if not self.names[tag]:
            return
        while self.open:
            name, region = self.open.pop()
            self.names[name] -= 1
            if region is not None:
                self.regions[region].append(self._mark())
            if name in K.SCORED_NOISE_TAGS:
                self.muted -= 1
            if name in _HEADINGS and self.heading is not None:
                self.titles.append(" ".join(self.heading))
                self.heading = None
            if name == tag:
                return

    def handle_data(self, data):
        word = data.strip()
        if not word or self.muted or self.names["iframe"]:
            return
        if self.heading is not None:
            self.heading.append(word)
        self.texts.append(word)
        self.sizes.append(self.sizes[-1] + len(" ".join(word.split())) + 1)


def _best_region(html: str) -> dict:
    parser = _Regions()
    parser.feed(html)
    parser.close()
    last = parser._mark()
    first, end, top = (0, 0, 0, 0), last, -1
    for start, *closed in parser.regions:
        stop = closed[0] if closed else last
        size = max(0, parser.sizes[stop[0]] - parser.sizes[start[0]] - 1)
        score = size + 50 * (stop[1] - start[1]) + 25 * (stop[2] - start[2])
        if size and score > top:
            first, end, top = start, stop, score
    return {"text": "\n".join(parser.texts[first[0] : end[0]]), "headings": parser.titles[first[3] : end[3]]}


def _scored_content(html: Column) -> Column:
    @F.pandas_udf("text string, headings array<string>")
    def score(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_best_region(h or "") for h in batch], columns=["text", "headings"])

    return score(html)


def clean_video(df: DataFrame, title: str, description: str, transcript: str) -> DataFrame:
    combined = X.join_parts(F.col(title), F.col(description), F.col(transcript))
    spoken = F.coalesce(F.nullif(F.col(transcript), F.lit("")), combined)
    return df.withColumn("clean_text", X.normalize_text(combined)).withColumn(
        "snippet", X.truncate_words(spoken)
    )


def clean_items(df: DataFrame) -> DataFrame:
    """Clean text, headings and snippet by source; other sources keep normalized text or title."""
    source, raw = F.lower("source_type"), F.coalesce(F.col("raw_text"), F.lit(""))
    spoken = F.coalesce(F.col("transcript_text"), F.lit(""))
    video = X.join_parts(F.col("title"), raw, spoken)
    plain = X.html_to_text(X.drop_pixels(raw))
    other = F.coalesce(F.nullif(raw, F.lit("")), F.col("title"), F.lit(""))
    clean = (
        F.when(source == "gmail", X.normalize_text(X.drop_signature(X.drop_quotes(plain))))
        .when(source == "chrome", X.page_text(raw))
        .when(source == "youtube", X.normalize_text(video))
        .otherwise(X.normalize_text(other))
    )
    headings = F.when(source == "chrome", X.page_headings(raw)).otherwise(F.array().cast("array<string>"))
    snippet_of = F.when((source == "youtube") & (spoken != ""), spoken).otherwise(F.col("clean_text"))
    return (
        df.withColumn("clean_text", clean)
        .withColumn("headings", headings)
        .withColumn("snippet", X.truncate_words(snippet_of))
    )


def embeddable_text(df: DataFrame) -> DataFrame:
    """Adds ``embeddable_text`` and ``auto_keywords`` by source to cleaned items."""
    source, clean = F.lower("source_type"), F.col("clean_text")
    subject = F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.col("title"))
    head = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, K.SNIPPET_CHARS)

    def first_filled(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))

    page = X.join_parts(
        F.col("title"), F.array_join("headings", " "), head(clean),
        urls.domain_hint(first_filled("domain", "canonical_url", "url")),
    )
    video = X.join_parts(
        F.col("title"), F.col("raw_text"), F.col("channel_name"),
        X.category_hint(F.col("youtube_category_id")), head(F.col("transcript_text")),
    )
    base = (
        F.when(source == "gmail", X.join_parts(subject, clean))
        .when(source == "chrome", page)
        .when(source == "youtube", video)
        .otherwise(X.join_parts(F.col("title"), clean))
    )
    keyed = df.withColumn("_base", base).withColumn("_words", X.keywords(F.col("_base"), K.KEYWORD_LIMIT))
    is_mail = source == "gmail"
    words = F.when(is_mail, F.slice("_words", 1, K.MAIL_KEYWORD_LIMIT)).otherwise(F.col("_words"))
    full = F.when(
        is_mail,
        X.join_parts(F.col("_base"), F.array_join("auto_keywords", " "), urls.sender_domain(F.col("sender"))),
    ).otherwise(F.col("_base"))
    return keyed.withColumn("auto_keywords", words).withColumn("embeddable_text", full).drop("_base", "_words")
