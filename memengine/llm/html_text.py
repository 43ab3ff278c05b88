"""Visible text of HTML pages, laid out: a tree builder with implied tags, visibility rules and a renderer."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Generator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inputs import prepared
from .words import blocked

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("audio canvas datalist embed head iframe noembed noframes noscript object script style template title video".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
CLOSES_P = BLOCKS - frozenset("body dd dt html li legend option optgroup".split())
# An opening tag ends open elements of these names, as far up as the boundary names.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
TABLE_PARTS = frozenset("caption tbody td tfoot th thead tr".split())
# Levels of lists, quotes and tables inside each other that are indented and aligned; below, lines are only broken.
DEEPEST = 150
_SPACE = re.compile(r"[ \t\n\r\f]+")
_TELLING = re.compile(r"display|visibility|\\", re.I)
# A cell with a longer line is not padded to, nor is a table of more columns, or one that padding would blow up so many times.
WIDEST_LINE, MOST_COLUMNS, MOST_PADDING = 120, 200, 16


def declarations(style: str) -> dict[str, str]:
    """The declarations of a style attribute by name, in lower case; of several of one name the last that is not less important.

    Semicolons inside strings, brackets and comments end nothing, as in CSS.
    """
    parts, now, quote, depth, i = [], [], "", 0, 0
    while i < len(style):
        c = style[i]
        if c == "\\":
            now.append(style[i : i + 2])
            i += 2
            continue
        if quote:
            quote = "" if c == quote else quote
        elif style.startswith("/*", i):
            end = style.find("*/", i + 2)
            i = len(style) if end < 0 else end + 2
            continue
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        elif c == ";" and not depth:
            parts.append("".join(now))
            now = []
            i += 1
            continue
        now.append(c)
        i += 1
    parts.append("".join(now))
    out, important = {}, set()
    for part in parts:
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        urgent = value.replace(" ", "").endswith("!important")
        if colon and (urgent or name not in important):
            out[name] = value.rpartition("!")[0].strip() if urgent else value
            if urgent:
                important.add(name)
    return out


class Node:
    """An element.  ``gone``: it is not rendered, nor is anything in it; ``seen``: what it says of its visibility, null if nothing;
    ``size``: characters of text and elements in it."""

    __slots__ = ("tag", "attrs", "children", "gone", "seen", "size")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children, self.size = tag, attrs, [], 0
        style = attrs.get("style") or ""
        said = declarations(style) if _TELLING.search(style) else {}
        self.gone = tag in HIDDEN or "hidden" in attrs or said.get("display") == "none" or tag == "dialog" and "open" not in attrs
        self.seen = {"visible": True, "hidden": False, "collapse": False}.get(said.get("visibility", ""))


def _measure(root: Node) -> None:
    """Set the sizes, children before their parents."""
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        order.append(node)
        waiting.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        node.size = 8 + sum(len(c) if isinstance(c, str) else c.size for c in node.children)


class Tree(HTMLParser):
    """Open elements are a stack of any depth; ``places`` has the places of each name in it, in rising order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.stack = [self.root]
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.feed(html)
        self.close()

    def _last(self, names: set[str]) -> int:
        return max((self.places[name][-1] for name in names if self.places.get(name)), default=0)

    def _close(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()

    def _end(self, names: set[str], limits: set[str]) -> None:
        """Close the open elements from the outermost of ``names`` that no element of ``limits`` encloses."""
        low = self._last(limits)
        found = [places[bisect_right(places, low)] for n in names if (places := self.places.get(n)) and places[-1] > low]
        if found:
            self._close(min(found))

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag in IMPLIED_END:
            self._end(*IMPLIED_END[tag])
        if tag in CLOSES_P:
            self._end({"p"}, {"td", "th", "table", "button", "li", "div", "section", "article"})
        node = Node(tag, dict(attrs))
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.places[tag].append(len(self.stack))
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        limits = set() if tag in ("table", "td", "th", "tr") else {"td", "th", "table"} - {tag}
        at = self._last({tag})
        if at > self._last(limits):
            self._close(at)

    def handle_data(self, data):
        self.stack[-1].children.append(data)

    def unknown_decl(self, data):
        """CDATA sections and the like are no text."""


class Lines:
    """Lines under construction: inline text collapses white space, blocks ask for line breaks."""

    def __init__(self):
        self.lines: list[str] = []
        self.now, self.gap, self.space = "", 0, False

    def text(self, data: str, keep: bool) -> None:
        if keep:
            first, *rest = data.expandtabs(8).split("\n")
            self._add(first)
            for line in rest:
                self.lines.append(self.now)
                self.now = line
            return
        parts = _SPACE.split(data)
        if parts[0] == "" and len(parts) > 1:
            self.space = True
        body = " ".join(p for p in parts if p)
        if body:
            self._add(body)
            self.space = parts[-1] == ""

    def _add(self, body: str) -> None:
        if not self.now:
            if self.gap and self.lines:
                self.lines.extend([""] * (self.gap - 1))
            self.gap = 0
        elif self.space:
            self.now += " "
        self.now, self.space = self.now + body, False

    def feed(self) -> None:
        """A forced line break."""
        if not self.now and self.gap and self.lines:
            self.lines.extend([""] * (self.gap - 1))
            self.gap = 0
        self.lines.append(self.now.rstrip())
        self.now, self.space = "", False

    def block(self, blank: bool) -> None:
        if self.now:
            self.lines.append(self.now.rstrip())
            self.now = ""
        self.space = False
        self.gap = max(self.gap, 2 if blank else 1)

    def place(self, lines: list[str], first: str = "", other: str = "") -> None:
        """A finished block of lines, indented."""
        if not lines:
            return
        if self.gap and self.lines:
            self.lines.extend([""] * (self.gap - 1))
        self.gap = 0
        self.lines.extend((first if i == 0 else other if line else "") + line for i, line in enumerate(lines))

    def done(self) -> list[str]:
        self.block(False)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        start = next((i for i, line in enumerate(self.lines) if line), len(self.lines))
        return self.lines[start:]


def _run(work: Generator):
    """Result of a generator that yields the generators it waits for: calls of any depth without recursion."""
    waiting, value = [work], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(value))
            value = None
        except StopIteration as end:
            waiting.pop()
            value = end.value
    return value


def _block(node: Node, keep: bool = False, level: int = 0, seen: bool = True) -> Generator:
    """Lines of an element; ``seen`` is the visibility that it inherits."""
    out = Lines()
    yield _inside(node, out, keep, level, seen)
    return out.done()


def _inside(node: Node, out: Lines, keep: bool, level: int, seen: bool) -> Generator:
    counter, flat = 0, level >= DEEPEST
    seen = seen if node.seen is None else node.seen
    if node.tag == "ol":
        start = node.attrs.get("start") or "1"
        counter = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    closed = node.tag == "details" and "open" not in node.attrs
    for child in node.children:
        if isinstance(child, str):
            if seen and not closed:
                out.text(child, keep)
            continue
        if child.gone or closed and child.tag != "summary":
            continue
        tag, shown = child.tag, seen if child.seen is None else child.seen
        if tag in ("br", "hr", "img", "input") and not shown:
            continue
        if tag == "br":
            out.feed()
        elif tag == "hr":
            out.block(True)
        elif tag == "img":
            out.text(child.attrs.get("alt") or "", keep)
        elif tag == "input":
            if (child.attrs.get("type") or "text").lower() in ("button", "submit", "reset", "text", "search", "email", "url"):
                out.text(child.attrs.get("value") or "", keep)
        elif tag == "table":
            out.block(True)
            if flat:
                yield _inside(child, out, False, level, seen)
            else:
                out.place((yield _table(child, level + 1, shown)))
            out.block(True)
        elif tag == "li":
            mark = f"{counter}. " if node.tag == "ol" else "- "
            counter += 1
            out.block(False)
            if flat:
                if shown:
                    out.text(mark, False)
                yield _inside(child, out, keep, level, seen)
            else:
                mark = mark if shown else ""
                out.place((yield _block(child, keep, level + 1, seen)), mark, " " * len(mark))
            out.block(False)
        elif tag in ("blockquote", "dd"):
            out.block(tag in SPACED)
            if flat:
                yield _inside(child, out, keep, level, seen)
            else:
                out.place((yield _block(child, keep, level + 1, seen)), "  ", "  ")
            out.block(tag in SPACED)
        elif tag in BLOCKS or flat and tag in TABLE_PARTS:
            nested = tag in ("ul", "ol", "menu") and node.tag == "li"
            out.block(tag in SPACED and not nested)
            yield _inside(child, out, keep or tag in ("pre", "textarea"), level, seen)
            out.block(tag in SPACED and not nested)
        else:
            yield _inside(child, out, keep or tag == "textarea", level, seen)


def _span(cell: Node, name: str, least: int, most: int) -> int:
    span = cell.attrs.get(name) or "1"
    return min(most, max(least, int(span))) if re.fullmatch(r"\d{1,5}", span) else 1


def _rows(node: Node, captions: list[list[str]], rows: list, level: int, seen: bool) -> Generator:
    """Append (group, cells) per row of a table to ``rows``, a cell being (lines, columns, rows; 0: to the end of the group).

    Content outside cells makes a row of its own, with no group.  ``seen`` is the visibility of ``node``.
    """
    for child in node.children:
        if isinstance(child, str):
            if seen and child.strip():
                rows.append((None, [([" ".join(child.split())], 1, 1)]))
        elif child.gone or child.tag in ("col", "colgroup"):
            continue
        elif child.tag in ("thead", "tbody", "tfoot"):
            yield _rows(child, captions, rows, level, seen if child.seen is None else child.seen)
        elif child.tag == "caption":
            captions.append((yield _block(child, level=level, seen=seen)))
        elif child.tag == "tr":
            cells, shown = [], seen if child.seen is None else child.seen
            for cell in child.children:
                if isinstance(cell, Node) and not cell.gone:
                    lines = yield _block(cell, level=level, seen=shown)
                    cells.append((lines, _span(cell, "colspan", 1, 100), _span(cell, "rowspan", 0, 65534)))
                elif isinstance(cell, str) and shown and cell.strip():
                    cells.append(([" ".join(cell.split())], 1, 1))
            rows.append((id(node), cells))
        else:
            rows.append((None, [((yield _block(child, level=level, seen=seen)), 1, 1)]))


def _placed(rows: list) -> list[list[tuple[int, list[str], int]]] | None:
    """Rows of cells (column, lines, columns): a cell stands in the first columns that no cell of a row above spans.

    Nothing if there are more than ``MOST_COLUMNS``.
    """
    out, now, taken = [], None, {}
    for group, cells in rows:
        if group is not None and group != now:
            now, taken = group, {}
        above = taken if group is not None else {}
        at, placed, below = 0, [], {c: n - 1 for c, n in above.items() if n > 1}
        for lines, span, down in cells:
            while clash := [c for c in range(at, at + span) if c in above]:
                at = clash[-1] + 1
            if at + span > MOST_COLUMNS:
                return None
            placed.append((at, lines, span))
            if down != 1:
                below.update(dict.fromkeys(range(at, at + span), down - 1 if down else 65534))
            at += span
        if group is not None:
            taken = below
        out.append(placed)
    return out


def _stacked(cells: list[list[str]]) -> list[str]:
    """A row without columns: cells of one line side by side, others one below the other."""
    if all(len(lines) <= 1 for lines in cells):
        return ["  ".join(lines[0] for lines in cells if lines)] if any(cells) else []
    return [line for lines in cells for line in lines]


def _table(node: Node, level: int, seen: bool) -> Generator:
    """Cells one below the other in columns of equal width, two spaces apart; captions above.

    A row in which a cell before the last has a line above ``WIDEST_LINE`` is stacked, and so is every row of a table that
    has too many columns or in which the padding would be many times what the table holds.  So
    the lines of a table are in proportion to its source, and no text is left out.
    """
    captions: list[list[str]] = []
    found: list = []
    yield _rows(node, captions, found, level, seen)
    out = [line for caption in captions for line in caption]
    rows = _placed(found)
    stacked = [max((len(line) for lines, _, _ in cells[:-1] for line in lines), default=0) > WIDEST_LINE for _, cells in found]
    widths: list[int] = []
    for row, own in zip(rows or [], stacked):
        for k, (at, lines, span) in enumerate(row):
            widths.extend([0] * (at + span - len(widths)))
            if span == 1 and not own and (k < len(row) - 1 or max(map(len, lines), default=0) <= WIDEST_LINE):
                widths[at] = max(widths[at], max(map(len, lines), default=0))
    ends = [0]  # characters before a column
    for width in widths:
        ends.append(ends[-1] + width + 2)
    padded = sum(len(lines) * ends[at] for row, own in zip(rows or [], stacked) if not own for at, lines, _ in row)
    if rows is None or padded > MOST_PADDING * node.size:
        stacked = [True] * len(found)
    for number, (_, cells) in enumerate(found):
        if stacked[number]:
            out += _stacked([lines for lines, _, _ in cells])
            continue
        row = rows[number]
        for i in range(max((len(lines) for _, lines, _ in row), default=0)):
            line = ""
            for at, lines, _ in row:
                if i < len(lines) and lines[i]:
                    line = line.ljust(ends[at]) + ("  " if len(line) > ends[at] else "") + lines[i]
            out.append(line)
    return out


def visible_text(html: str | None) -> str:
    """All text of a page that a reader sees, in lines."""
    if not html:
        return ""
    root = Tree(html).root
    _measure(root)
    return "\n".join(_run(_block(root)))


def rendered(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` instead of the html column: the visible text, laid out.

    Blocks stand on lines of their own, paragraphs, headings, lists and tables between empty lines; list items
    have a dash or their number and are indented below each other; table cells are aligned in columns, below a
    cell that spans rows in the columns beside it; from ``DEEPEST`` lists, quotes and tables inside each other on,
    lines are broken but no longer indented or aligned;
    preformatted text keeps its white space.  What is hidden by element, attribute or inline style is left out.
    Null and empty pages give an empty text; broken markup is repaired as browsers do, nothing is cut off.
    Rows are rendered one by one, so ties, repeated rows and null ids change nothing; other columns pass
    through, one named ``text`` is replaced.  No rows: no rows.
    """
    prepared(pages.sparkSession)

    @F.arrow_udf("string")
    def render(column: pa.Array) -> pa.Array:
        batch = pa.record_batch([column.cast(pa.large_string())], ["html"])
        texts = [visible_text(x) for part in blocked(iter([batch]), "html") for x in part.column("html").to_pylist()]
        return pa.array(texts, pa.string())

    return pages.withColumn("text", render(F.col(html).cast("string"))).drop(html)
