"""Text cleaning, tokenizing and keyword expressions (all JVM-side)."""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .. import constants as K
from .core import any_of, code_point, let, rstrip, rstrip_long, string_array, string_map, strip, strip_long, where

_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_LINE_BREAK = f"[{_BREAKS}](?:(?<=\r)\n)?"

# --- fixed values: numeric references the HTML standard remaps ---------------
_REMAPPED = {
    0x00: 0xFFFD, 0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026,
    0x86: 0x2020, 0x87: 0x2021, 0x88: 0x02C6, 0x89: 0x2030, 0x8A: 0x0160, 0x8B: 0x2039,
    0x8C: 0x0152, 0x8E: 0x017D, 0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D,
    0x95: 0x2022, 0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161,
    0x9B: 0x203A, 0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178,
}
# Names come from the standard library: the HTML 4 set plus the few names that
# may stand without a semicolon.
_NAMED = {name: chr(point) for name, point in name2codepoint.items()} | {
    "apos": "'", **{n: c for n, c in html5.items() if not n.endswith(";")}
}
_BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def normalize_text(text: Column) -> Column:
    """One space per space/tab run, at most one blank line, stripped."""
    lines = F.replace(text, F.lit("\r"), F.lit("\n"))
    # Matches only runs that change, so ordinary single spaces are skipped over.
    spaced = where(lines, ["  ", "\t"], lambda t: F.regexp_replace(t, r"[ \t](?:[ \t]+|(?<=\t))", " "))
    return strip_long(where(spaced, ["\n\n\n"], lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n")))


def truncate_words(text: Column, limit: int = K.SNIPPET_CHARS) -> Column:
    """Normalized text cut to ``limit`` characters, back to the last space."""
    return let(
        normalize_text(text),
        lambda t: F.when(F.length(t) <= limit, t).otherwise(
            strip(F.regexp_replace(F.substring(t, 1, limit), r"(?s) [^ ]*$", ""))
        ),
    )


def unescape_html(text: Column) -> Column:
    """Replace character references in one pass.

    The text is split on ``&`` so a replaced reference is never read again.
    Texts without ``&`` skip all of it.
    """
    named = string_map(_NAMED)
    remapped = string_map({str(k): str(v) for k, v in _REMAPPED.items()})
    bare = "^(" + "|".join(_BARE_NAMES) + ")"

    def numeric(number: Column) -> Column:
        bad = number.isNull() | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
        dropped = (
            number.between(0x1, 0x8)
            | (number == 0xB)
            | number.between(0xE, 0x1F)
            | number.between(0x7F, 0x9F)
            | number.between(0xFDD0, 0xFDEF)
            | (F.pmod(number, F.lit(0x10000)) >= 0xFFFE)
        )
        mapped = F.try_element_at(remapped, number.cast("string")).cast("int")
        return (
            F.when(bad, F.lit("\ufffd"))
            .when(mapped.isNotNull(), code_point(mapped))
            .when(dropped, F.lit(""))
            .otherwise(code_point(number))
        )

    def reference(token: Column) -> Column:
        digits = F.regexp_extract(token, r"^#([0-9]+)", 1)
        hexes = F.regexp_extract(token, r"^#[xX]0*([0-9a-fA-F]*)", 1)
        as_hex = F.when(F.length(hexes) <= 8, F.conv(hexes, 16, 10).try_cast("bigint"))
        number = F.when(digits != "", digits.try_cast("bigint")).otherwise(as_hex)
        closed = F.when(token.endswith(";"), F.try_element_at(named, F.rtrim(token, F.lit(";"))))
        head = F.regexp_extract(token, bare, 1)
        prefix = F.when(
            head != "",
            F.concat(F.try_element_at(named, head), F.substring(token, F.length(head) + 1, F.length(token))),
        )
        return F.when(token.startswith("#"), let(number, numeric)).otherwise(
            F.coalesce(closed, prefix, F.concat(F.lit("&"), token))
        )

    def decode(piece: Column) -> Column:
        token = F.regexp_extract(
            piece, r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)", 1
        )
        return let(
            token,
            lambda t: F.when(piece.startswith("amp;"), F.concat(F.lit("&"), F.substr(piece, F.lit(5))))
            .when(t == "", F.concat(F.lit("&"), piece))
            .otherwise(F.concat(reference(t), F.substr(piece, F.length(t) + 1))),
        )

    def whole(value: Column) -> Column:
        pieces = F.split(value, "&")
        decoded = let(
            pieces,
            lambda p: F.concat(
                F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, 2, F.size(p)), decode), "")
            ),
        )
        return F.when(value.contains("&"), decoded).otherwise(value)

    return let(text, whole)


def drop_elements(html: Column, tags: list[str], replacement: str = " ") -> Column:
    """Remove whole elements (tag, content, end tag)."""
    names = "|".join(tags)
    return where(html, ["<"], lambda t: F.regexp_replace(t, rf"(?is)<({names})\b[^>]*>.*?</\1\s*>", replacement))


def drop_comments(html: Column) -> Column:
    return where(html, ["<!--"], lambda t: F.regexp_replace(t, r"(?s)<!--.*?-->", " "))


def html_to_text(html: Column) -> Column:
    def plain(t: Column) -> Column:
        # The element pattern has no word boundary on purpose: '<styles>' counts too.
        bare = F.regexp_replace(drop_comments(t), r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
        broken = F.regexp_replace(bare, r"(?i)<br\s*/?>|</p>|</div>", "\n")
        return F.regexp_replace(broken, r"<[^>]+>", " ")

    return normalize_text(unescape_html(F.coalesce(where(html, ["<"], plain), F.lit(""))))


def drop_pixels(html: Column) -> Column:
    return where(F.coalesce(html, F.lit("")), ["<"], lambda t: F.regexp_replace(t, K.PIXEL_PATTERN, " "))


def split_lines(text: Column) -> Column:
    """Lines without terminators; one trailing terminator opens no new line."""

    def lines(t: Column) -> Column:
        ends = F.right(t, F.lit(1)).isin(*_BREAKS)
        closed = F.when(ends, F.regexp_replace(t, f"(?:{_LINE_BREAK})\\z", "")).otherwise(t)
        return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(closed, _LINE_BREAK))

    return let(text, lines)


def drop_quotes(text: Column) -> Column:
    """Remove ``>`` lines; stop at the first reply header."""

    def cut(lines: Column) -> Column:
        header = F.array_position(
            F.transform(lines, lambda line: strip_long(line).rlike(K.REPLY_HEADER_PATTERN)), True
        )
        kept = let(
            header, lambda h: F.when(h > 0, F.slice(lines, 1, h.cast("int") - 1)).otherwise(lines)
        )
        return F.array_join(F.filter(kept, lambda line: ~strip_long(line).startswith(">")), "\n")

    return let(split_lines(F.coalesce(text, F.lit(""))), cut)


def _signature_like(line: Column) -> Column:
    bare = strip(line)
    marked = any_of(F.lower(bare).startswith(m) for m in K.SIGNATURE_MARKERS)
    words = F.size(F.filter(F.split(bare, r"\s+"), lambda w: w != ""))
    named = bare.rlike(K.NAME_ONLY_PATTERN) & (words <= 4)
    return (bare != "") & (marked | bare.rlike(K.EMAIL_ONLY_PATTERN) | named)


def drop_signature(text: Column) -> Column:
    """Cut from the first signature-like line of the tail; only the tail is tested."""

    def cut(lines: Column) -> Column:
        total = F.size(lines)
        first = F.greatest(F.lit(1), total - K.SIGNATURE_TAIL_LINES)  # zero-based
        tail = F.when(
            total > first, F.transform(F.slice(lines, first + 1, F.lit(K.SIGNATURE_TAIL_LINES)), _signature_like)
        ).otherwise(F.array().cast("array<boolean>"))
        hit = F.array_position(tail, True).cast("int")
        return let(
            hit,
            lambda h: F.when(h > 0, rstrip(F.array_join(F.slice(lines, 1, first + h - 1), "\n"))).otherwise(
                F.array_join(lines, "\n")
            ),
        )

    lines = F.transform(split_lines(F.coalesce(text, F.lit(""))), rstrip_long)
    return let(lines, cut)


def join_parts(*parts: Column) -> Column:
    """Non-blank stripped parts joined by one space; null and blank parts vanish."""
    return F.concat_ws(" ", *[let(strip_long(p), lambda t: F.when(t != "", t)) for p in parts])


def tokenize(text: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case tokens without punctuation, stopwords or short words.

    A token is plain ASCII, so it is lowered after it is found: lowering whole
    multilingual texts costs far more.  Only two letters outside ASCII have an
    ASCII lower-case form, and a text holding one is lowered first.
    """
    stop = K.STOPWORDS if stopwords is None else stopwords
    value = F.coalesce(text, F.lit(""))
    value = where(value, ["\u0130", "\u212a"], F.lower)
    found = F.array_join(F.regexp_extract_all(value, F.lit(f"({K.TOKEN_PATTERN})"), F.lit(1)), " ")
    cleaned = F.split(F.translate(F.lower(found), "_+-", ""), " ")
    # A token starts with a letter, so it can never be all digits.
    return F.filter(cleaned, lambda t: (F.length(t) >= 3) & ~t.isin(stop))


def keywords(text: Column, limit: int = K.KEYWORD_LIMIT, stopwords: list[str] | None = None) -> Column:
    """Most frequent tokens, ties alphabetical.

    Sort once, find where each run of equal tokens starts, and read counts off
    the distances between starts: linear after the sort, no shuffle, any length.
    """

    def rank(tokens: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(tokens) - 1),
            lambda i: (i == 0) | (F.get(tokens, i) != F.get(tokens, i - 1)),
        )

        def runs(s: Column) -> Column:
            counted = F.transform(
                s,
                lambda at, n: F.struct(
                    (at - F.coalesce(F.get(s, n + 1), F.size(tokens))).alias("neg_count"),
                    F.get(tokens, at).alias("token"),
                ),
            )
            return F.transform(F.slice(F.sort_array(counted), 1, limit), lambda r: r["token"])

        return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(let(starts, runs))

    return let(F.sort_array(tokenize(text, stopwords)), rank)


def category_hint(category: Column) -> Column:
    hints = string_map({str(k): v for k, v in K.CATEGORY_HINTS.items()})
    return F.coalesce(F.try_element_at(hints, category.try_cast("int").cast("string")), F.lit(""))


def category_id(category: Column) -> Column:
    """Integer category from a digit string; anything else is NULL."""
    text = category.cast("string")
    return F.when(text.rlike(r"^[0-9]+$"), text.try_cast("int"))


def tolerant_json(text: Column, schema: str) -> Column:
    """Unescape and parse; ``parsed`` is NULL and ``raw`` kept when it is not JSON."""
    parsed = let(
        unescape_html(text), lambda t: F.when(F.get_json_object(t, "$").isNotNull(), F.from_json(t, schema))
    )
    return F.struct(parsed.alias("parsed"), text.alias("raw"))


def flatten_text(value: Column, kind: DataType) -> Column:
    """Texts of a nested value of a known type, joined by spaces: values of lists, maps and structs, null as empty text."""
    if isinstance(kind, ArrayType):
        parts = F.transform(value, lambda v: flatten_text(v, kind.elementType))
    elif isinstance(kind, MapType):
        parts = F.transform(F.map_values(value), lambda v: flatten_text(v, kind.valueType))
    elif isinstance(kind, StructType):
        parts = F.array(*[flatten_text(value[f.name], f.dataType) for f in kind]) if kind.fields else F.array().cast("array<string>")
    else:
        return F.coalesce(value.cast("string"), F.lit(""))
    return F.when(value.isNull(), "").otherwise(F.array_join(parts, " "))


def page_headings(html: Column) -> Column:
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>"), F.lit(2))
    texts = F.transform(raw, lambda h: _node_text(h, " "))
    return F.filter(F.transform(texts, normalize_text), lambda h: h != "")


def _node_text(html: Column, separator: str) -> Column:
    """Stripped text nodes between tags, empty ones dropped."""
    nodes = F.transform(F.split(html, r"<[^>]+>"), lambda n: strip(unescape_html(n)))
    return F.array_join(F.filter(nodes, lambda n: n != ""), separator)


def page_text(html: Column, separator: str = "\n") -> Column:
    bare = drop_elements(drop_comments(html), K.PAGE_DROPPED_TAGS)
    return normalize_text(_node_text(bare, separator))


def main_content(html: Column) -> Column:
    """Text of the first candidate element with enough text, cut at the stored length.

    Candidates in order: article, main, an element with role=main, the body.
    """

    def visible(region: Column) -> Column:
        bare = drop_elements(drop_comments(region), ["script", "style", "noscript"])
        words = F.regexp_replace(unescape_html(F.regexp_replace(bare, r"<[^>]+>", " ")), r"(?U)\s+", " ")
        return strip(words)

    regions = [
        F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1),
        F.regexp_extract(html, r"(?is)<main\b[^>]*>(.*?)</main\s*>", 1),
        F.regexp_extract(html, r"(?is)<([a-z0-9]+)\b[^>]*\brole=['\"]?main\b[^>]*>(.*?)</\1\s*>", 2),
        F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*)</body\s*>", 1),
    ]
    tried = [
        let(visible(r), lambda t: F.when(F.length(t) >= K.MAIN_CONTENT_MIN_CHARS, t)) for r in regions
    ]
    return F.substring(F.coalesce(*tried, F.lit("")), 1, K.MAIN_CONTENT_MAX_CHARS)


def attachment_extract(filename: Column, mime: Column, size: Column) -> Column:
    """Filename, type and size joined by a spaced pipe, empty and zero parts dropped."""
    size_text = F.nullif(size.cast("string"), F.lit("0"))
    parts = [F.nullif(filename, F.lit("")), F.nullif(mime, F.lit("")), F.nullif(size_text, F.lit(""))]
    return F.nullif(F.concat_ws(K.EXTRACT_SEPARATOR, *parts), F.lit(""))


