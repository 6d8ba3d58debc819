"""Visible text of scraped pages, laid out as a reader sees it."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from unicodedata import category, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role in the layout.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("audio canvas datalist head iframe noscript object script style svg template title video".split())
SPACED = frozenset("blockquote dl figure form h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog div dt fieldset figcaption footer header hgroup html legend li main menu nav section summary tr caption tbody thead tfoot".split())
CELLS = frozenset(("td", "th"))
#: What a head can hold; anything else ends it. Elements whose content is text up to their end tag.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
TEXT = frozenset(("textarea", "title"))
KEPT = frozenset(("pre", "textarea"))
#: What an opening tag ends, and what keeps it from looking further up.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **{s: ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}) for s in ("tbody", "thead", "tfoot")}, "body": ({"head"}, set()),
}
TABLE_PARTS = frozenset("table tbody tfoot thead tr".split())
#: Form fields whose value is not text that a reader sees.
NO_VALUE = frozenset("checkbox color file hidden image password radio range".split())
#: Limits of spans that HTML sets.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\f\r]+")
#: Columns of a table are padded to this width at most, so that one long line does not widen every row.
ALIGNED = 200


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs=()):
        self.tag, self.attrs, self.children = tag, dict(attrs), []

    def hidden(self) -> bool:
        return self.tag in HIDDEN or "hidden" in self.attrs or bool(UNSHOWN.search(self.attrs.get("style") or ""))

    def visible(self, inherited: bool) -> bool:
        told = VISIBILITY.findall(self.attrs.get("style") or "")
        return told[-1].lower() == "visible" if told else inherited

    def number(self, name: str, least: int, most: int) -> int:
        told = re.match(r"\s*\+?(\d{1,9})", self.attrs.get(name) or "")
        return min(int(told[1]), most) if told and int(told[1]) >= least else 1


def shown_options(select: Node) -> list[Node]:
    """The options that a reader sees: all of a list, else the chosen one, which is the first unless said otherwise."""
    options, todo = [], list(reversed(select.children))
    while todo:
        node = todo.pop()
        if isinstance(node, Node) and not node.hidden():
            if node.tag == "option":
                options.append(node)
            todo.extend(reversed(node.children))
    size = (select.attrs.get("size") or "").strip()
    if "multiple" in select.attrs or size.isdecimal() and int(size) > 1:
        return options
    chosen = [o for o in options if "selected" in o.attrs][-1:]
    return chosen or [o for o in options if "disabled" not in o.attrs][:1]


class TreeBuilder(HTMLParser):
    """Tags to a tree, with implied ends; stray end tags are ignored and open elements end with the text."""

    CDATA_CONTENT_ELEMENTS = (*HTMLParser.CDATA_CONTENT_ELEMENTS, *sorted(TEXT))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.places = defaultdict(list)  # of the open elements by name, so that no tag walks the stack

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.open))
        self.open.append(node)

    def cut(self, i: int) -> None:
        for node in self.open[i:]:
            self.places[node.tag].pop()
        del self.open[i:]

    def last(self, tags) -> int:
        most = 0
        for t in tags:
            at = self.places.get(t)
            if at and at[-1] > most:
                most = at[-1]
        return most

    def end_implied(self, tag: str) -> None:
        ends, fence = IMPLIED.get(tag, ({"p"}, {"td", "th", "li", "div", "button", "article", "section"}) if tag in BLOCK else (set(), set()))
        i = self.last(ends)
        if i and i > self.last(fence) and (tag in IMPLIED or i > self.last(CELLS)):
            while i > 1 and self.open[i - 1].tag in ends:
                i -= 1
            self.cut(i)

    def parse_marked_section(self, i, report=1):
        """Declarations that the parser does not know or that never end are comments."""
        try:
            k = super().parse_marked_section(i, report)
        except AssertionError:
            k = -1
        return k if k >= 0 else self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def close(self):
        super().close()
        if self.rawdata and self.cdata_elem in TEXT:  # never ended
            self.handle_data(self.rawdata)

    def handle_starttag(self, tag, attrs):
        if self.open[-1].tag == "head" and tag not in HEAD:
            self.cut(len(self.open) - 1)
        self.end_implied(tag)
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.push(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        i = self.last((tag,))
        if i and (tag in TABLE_PARTS or i >= self.last(CELLS)):
            self.cut(i)

    def handle_data(self, data):
        if self.cdata_elem in TEXT:
            data = unescape(data)
        if self.open[-1].tag == "head" and data.strip(" \t\n\f\r"):
            self.cut(len(self.open) - 1)
        self.open[-1].children.append(data)


class Canvas:
    """Lines of text with collapsed spaces, asked-for breaks and the indent of lists."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.mark, self.indent = "", False, "", 0

    def text(self, data: str, keep: bool) -> None:
        if keep:
            first, *more = data.split("\n")
            self.put(first)
            for part in more:
                self.end(True)
                self.put(part)
            return
        data = SPACE.sub(" ", data)
        if not self.line or self.line.endswith(" "):
            data = data.lstrip(" ")
        self.put(data)

    def put(self, data: str) -> None:
        if data and not self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.line = " " * (self.indent - len(self.mark)) + self.mark if self.indent else self.mark
            self.mark = ""
        self.line += data

    def end(self, even_empty: bool = False) -> None:
        if self.line or even_empty:
            self.lines.append(self.line.rstrip())
        self.line = ""

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap |= spaced


class Table:
    """Rows of (lines, columns, rows) cells; row groups begin at ``groups``."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.groups: set[int] = set()

    def placed(self, spans: bool = True) -> list[list[tuple[int, int, list[str] | None]]]:
        """Per row (from, to, lines) in order of columns; lines are None where a cell from above reaches in.

        Rows that reach far down in very many columns would fill an area out of proportion to the cells;
        beyond 64 places a cell every cell counts as one row high. No text depends on it.
        """
        out, held, area = [], [], 64 * sum(map(len, self.rows)) + 1000
        for r, row in enumerate(self.rows):
            held = [] if r in self.groups else [h for h in held if h[2] > r]
            places, k, at = [], 0, 0
            for lines, columns, rows in row:
                while k < len(held) and held[k][0] <= at:
                    at, k = max(at, held[k][1]), k + 1
                end = min(at + columns, held[k][0] if k < len(held) else at + columns)
                places.append((at, end, lines, r + rows if rows else len(self.rows)))
                at = end
            out.append(sorted([(a, b, None) for a, b, _ in held] + [p[:3] for p in places], key=lambda p: p[0]))
            area -= len(out[-1])
            if area < 0 and spans:
                return self.placed(False)
            held = sorted(held + [(a, b, last) for a, b, _, last in places if spans and last > r + 1])
        return out

    def lines(self) -> list[str]:
        """Cells side by side. A column is as wide as its widest line, up to ``ALIGNED``; a spanning cell widens its last one."""
        rows = self.placed()
        starts = sorted({p[0] for row in rows for p in row})  # columns in which nothing starts have no width
        at = {a: i for i, a in enumerate(starts)}
        rows = [[(at[a], bisect_left(starts, b), lines) for a, b, lines in row] for row in rows]
        widths, spanning = [0] * len(starts), []
        for row in rows:
            for i, j, lines in row:
                need = min(max(map(shown_width, lines or ()), default=0), ALIGNED)
                if j - i == 1:
                    widths[i] = max(widths[i], need)
                elif need:
                    spanning.append((i, j, need))
        for i, j, need in spanning:
            widths[j - 1] += max(need - sum(widths[i:j]) - 3 * (j - i - 1), 0)
        offsets = [0]
        for w in widths:
            offsets.append(offsets[-1] + w + 3)
        out = []
        for row in rows:
            while row and row[-1][2] is None:
                row.pop()
            for n in range(max((len(lines or ()) for _, _, lines in row), default=0)):
                parts, done = [], 0
                for i, j, lines in row:
                    if i > done:
                        parts.append(" " * (offsets[i] - offsets[done] - 3))
                    text, done = lines[n] if lines and n < len(lines) else "", j
                    parts.append(text + " " * (offsets[j] - offsets[i] - 3 - shown_width(text)))
                out.append(" | ".join(parts).rstrip())
        return out


def shown_width(text: str) -> int:
    """Columns that a terminal gives the text: two for wide characters, none for marks."""
    if text.isascii():
        return len(text)
    return sum(2 if east_asian_width(c) in "WF" else 0 if category(c) in ("Mn", "Me", "Cf") else 1 for c in text)


def visible_text(html: str | None) -> str:
    """All visible text of a page in reading order."""
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    canvases, tables, lists, keep, shown = [Canvas()], [], [], 0, [True]
    todo: list[tuple[Node | str, bool]] = [(builder.root, False)]
    while todo:
        node, leaving = todo.pop()
        c = canvases[-1]
        if isinstance(node, str):
            if shown[-1]:
                c.text(node, keep > 0)
            continue
        tag = node.tag
        if not leaving:
            if node.hidden():
                continue
            seen = node.visible(shown[-1])
            if tag == "br":
                if seen:
                    c.end(True)
                continue
            if tag == "hr":
                c.block(True)
                continue
            if tag == "img":
                c.text(node.attrs.get("alt") or "" if seen else "", False)
                continue
            if tag == "input":
                if seen and (node.attrs.get("type") or "").strip().lower() not in NO_VALUE:
                    c.text(node.attrs.get("value") or "", False)
                continue
            if tag == "select":
                node.children = shown_options(node)
            if tag in CELLS and tables:
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                canvases.append(Canvas())
            elif tag in BLOCK:
                c.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            elif tag == "option":
                c.text(" ", False)
            elif tag == "textarea":
                node.children = ["".join(node.children).removeprefix("\n")]
            if tag == "table":
                tables.append(Table())
                canvases.append(Canvas())
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in ("tbody", "thead", "tfoot") and tables:
                tables[-1].groups.add(len(tables[-1].rows))
            elif tag in ("ul", "ol", "menu"):
                lists.append(0 if tag == "ol" else None)
                c.indent += 4 if tag == "ol" else 2
            elif tag == "li":
                if lists and lists[-1] is not None:
                    lists[-1] += 1
                c.mark = f"{lists[-1]}. " if lists and lists[-1] is not None else "- "
            keep += tag in KEPT
            shown.append(seen)
            todo.append((node, True))
            todo.extend((child, False) for child in reversed(node.children))
            continue
        keep -= tag in KEPT
        shown.pop()
        if tag in CELLS and tables:
            c.end()
            canvases.pop()
            tables[-1].rows[-1].append((c.lines, node.number("colspan", 1, MOST_COLUMNS), node.number("rowspan", 0, MOST_ROWS)))
        elif tag == "table":
            c.end()
            canvases.pop()
            outer = canvases[-1]
            for line in c.lines + tables.pop().lines():  # a caption and strays stand above the cells
                outer.put(line)
                outer.end(True)
            outer.block(True)
        elif tag in BLOCK:
            if tag in ("ul", "ol", "menu") and lists:
                c.indent -= 4 if lists.pop() is not None else 2
            c.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            c.mark = "" if tag == "li" else c.mark
    canvases[0].end()
    return "\n".join(canvases[0].lines).strip("\n")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [visible_text(h) for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])


def render_pages(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, text): everything a reader of a scraped page sees, whole, one row per page.

    A tree is built with the ends that HTML implies; scripts, styles, heads and what ``hidden`` or an
    inline style hides give nothing, but a visible part of an invisible element is shown. Style sheets are
    not read, and details count as opened. A head ends where something stands that it cannot hold. Text areas
    give their text, fields their value, a select its chosen option or, if it is a list, all of them. Unknown declarations
    are comments. Blocks start lines, paragraphs, headings, lists and tables stand
    apart by a blank line, list items are marked and indented, table cells are padded to columns by
    their spans and shown width (lines beyond 200 columns run over; missing and spanned last cells leave nothing),
    preformatted text keeps its spaces, images give their alternative text.

    Null, empty and text-free html gives an empty text; unclosed tags end with the page. Null and
    repeated ids are kept; empty tables give none; other columns are ignored.
    """
    rows = pages.select(F.col(page_id).alias("id"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(_rendered, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", page_id)
