"""HTML extraction by layout-aware rendering.

A tree is built from the tags of a page, closing elements whose end tags are implied (paragraphs before blocks, list
items, table parts, options); the tree is then rendered as a page would show it: invisible parts are left out (an element
without display goes with all in it, a hidden one may hold visible ones), white space collapses except in preformatted
text, blocks stand apart, list items carry bullets or numbers by depth, and the cells of a table are padded to columns,
with cells that span columns or rows in their places. All visible text is kept, navigation, footers, formulas and texts of
drawings included. A line of a cell that is longer than WIDEST characters does not widen its column, and a table that would take over
MOST_PADDING times its text is not padded, so that a text is in proportion to its page.

Rendering works page by page in Arrow batches; nothing is shuffled, depth costs no recursion, and end tags find their
element by its name, so that time is in proportion to the page, however long it is and however it is nested.

Defined results: a null page gives a null text, an empty one an empty text; unclosed and stray tags are tolerated; of
repeated attributes the first counts; repeated rows are rendered one by one; an empty table gives an empty result; other
columns stay, and one already named like the output is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element kinds of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INVISIBLE = set("head script style template noscript title datalist desc defs metadata symbol clippath annotation annotation-xml iframe object canvas audio video".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul caption".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure article section".split())
#: Open elements that a start tag closes, and the elements that bar the way.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tr", "td", "th", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
ENDS_P = BLOCK - {"body", "html", "li", "dd", "dt", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "legend", "summary"}
SPACE = re.compile(r"[ \t\n\r\f\x0b]+")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
#: The largest spans of the HTML standard.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
WIDEST, MOST_PADDING = 80, 8


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Builds the tree; `open` holds the path from the root to the element that is open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # of each name, where its open elements stand in `open`

    def _cut(self, at: int) -> None:
        for node in self.open[at:]:
            self.places[node.tag].pop()
        del self.open[at:]

    def _bar(self, bars: set[str]) -> int:
        """Place of the innermost open bar, or 0."""
        return max((self.places[b][-1] for b in bars if self.places.get(b)), default=0)

    def _close(self, tags: set[str], bars: set[str]) -> None:
        """Close the outermost open element of `tags` on this side of a bar, with all in it."""
        own = [self.places[t] for t in tags if self.places.get(t)]
        if own:
            bar = self._bar(bars)
            cut = min((p[k] for p in own if (k := bisect_right(p, bar)) < len(p)), default=None)
            if cut is not None:
                self._cut(cut)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close({"p"}, {"td", "th", "li", "div", "article", "section", "table", "button", "caption"})
        if tag in CLOSED_BY:
            self._close(*CLOSED_BY[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})  # of repeated attributes the first counts
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash on a non-void element does not close it

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
            return
        own = self.places.get(tag)
        if own and (tag in ("table", "body", "html") or own[-1] > self._bar({"table"})):
            self._cut(own[-1])

    def handle_data(self, data):
        self.open[-1].children.append(data)


def displayed(node: Node) -> bool:
    if node.tag in INVISIBLE or "hidden" in node.attrs or NO_DISPLAY.search(node.attrs.get("style", "")):
        return False
    return not (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden")


def shown(node: Node, before: bool) -> bool:
    """Whether the element's own text is visible, given that of its parent."""
    found = VISIBILITY.search(node.attrs.get("style", ""))
    return before if found is None or found[1].lower() not in ("visible", "hidden", "collapse") else found[1].lower() == "visible"


class Canvas:
    """Lines of text in the making. `gap` is how many line ends must stand before the next text."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.gap = 0
        self.space = False
        self.indent = ""
        self.bullet = ""
        self.fresh = True

    def block(self, ends: int) -> None:
        self.gap = max(self.gap, ends)
        self.space = False

    def _begin(self) -> None:
        if self.gap:
            if self.parts:
                self.parts.append("\n" * self.gap)
            self.gap, self.fresh = 0, True
        if self.fresh:
            self.parts.append(self.bullet or self.indent)
            self.bullet, self.fresh, self.space = "", False, False

    def text(self, data: str) -> None:
        data = SPACE.sub(" ", data)
        if data == " ":
            self.space = not self.fresh and not self.gap or self.space
            return
        lead = data[0] == " "
        self.space |= lead and not self.fresh and not self.gap
        space = self.space
        self._begin()
        if space and self.parts and not self.parts[-1].endswith((" ", "\n")):
            self.parts.append(" ")
        self.parts.append(data.strip(" "))
        self.space = data[-1] == " "

    def lines(self, rows: list[str]) -> None:
        """Lines as they are."""
        for row in rows:
            self._begin()
            self.parts.append(row)
            self.gap = 1

    def line_end(self) -> None:
        self._begin()
        self.gap, self.space = 1, False
        self.parts.append("")

    def result(self) -> str:
        return "\n".join(x.rstrip(" ") for x in "".join(self.parts).split("\n")).strip("\n")


def _placed(rows: list[list[tuple[str, int, int]]]) -> tuple[list[list[tuple[int, int, str]]], int]:
    """Of each row its cells as (first column, columns, text), and the number of columns: a cell takes the first columns that no
    cell of a row above still spans. Columns in which no cell begins are left out."""
    busy: list[tuple[int, int, int]] = []  # columns from, to, and how many more rows take them, ascending
    placed, starts = [], set()
    for row in rows:
        at, k, own, taken = 0, 0, [], []
        for text, columns, height in row:
            while k < len(busy) and busy[k][0] <= at:  # a cell that is wider than the gap reaches over what is taken
                at = max(at, busy[k][1])
                k += 1
            own.append((at, columns, text))
            starts.add(at)
            if height > 1:
                taken.append((at, at + columns, height))
            at += columns
        placed.append(own)
        left: list[tuple[int, int, int]] = []
        for lo, hi, n in sorted([*busy, *taken]):
            if n > 1 and left and left[-1][1:] == (lo, n - 1):
                left[-1] = (left[-1][0], hi, n - 1)
            elif n > 1:
                left.append((lo, hi, n - 1))
        busy = left
    order = sorted(starts)
    number = {c: i for i, c in enumerate(order)}
    return [[(number[at], bisect_left(order, at + n) - number[at], text) for at, n, text in own] for own in placed], len(order)


def _laid_out(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table: cells padded to the width of their column, cells of several lines on several lines."""
    placed, n = _placed(rows)
    widths = [0] * n
    for own in placed:
        for at, columns, text in own:
            if columns == 1:
                widths[at] = max(widths[at], *(len(x) if len(x) <= WIDEST else 0 for x in text.split("\n")))
    ends = list(accumulate((w + 3 for w in widths), initial=0))
    lines_of = [max((text.count("\n") + 1 for _, _, text in own), default=0) for own in placed]
    if sum(lines_of) * ends[-1] > MOST_PADDING * sum(len(text) + 3 for own in placed for _, _, text in own) + 10_000:
        widths, ends = [0] * n, [0] * (n + 1)
    out = []
    for own in placed:
        cells = [(at, columns, text.split("\n")) for at, columns, text in own]
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line, next_ = [], 0
            for at, columns, lines in cells:
                line += [" " * widths[c] for c in range(next_, at) if ends[-1]]  # columns of cells from above
                text = lines[k] if k < len(lines) else ""
                line.append(text.ljust(ends[at + columns] - ends[at] - 3))
                next_ = at + columns
            out.append(" | ".join(line).rstrip())
    return out


def _span(node: Node, name: str, most: int) -> int:
    digits = re.match(r"\s*\+?(\d{1,9})", node.attrs.get(name, ""))
    return 1 if digits is None else min(int(digits[1]), most)


def render(html: str) -> str:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    canvases, tables, lists, pre = [Canvas()], [], [], 0
    work: list[tuple[str, object, bool]] = [("in", builder.root, True)]
    while work:
        step, node, seen = work.pop()
        c = canvases[-1]
        if isinstance(node, str):
            if not seen:
                continue
            if pre:
                for i, line in enumerate(node.split("\n")):
                    if i:
                        c.line_end()
                    if line:
                        c._begin()
                        c.parts.append(line)
            else:
                c.text(node)
            continue
        tag = node.tag
        if step == "in":
            if tag != "#root" and not displayed(node):
                continue
            seen = shown(node, seen)
            if tag == "br":
                c.line_end()
            elif tag == "img" and node.attrs.get("alt") and seen:
                c.text(node.attrs["alt"])
            elif tag == "hr":
                c.block(2)
            elif tag in BLOCK:
                c.block(2 if tag in SPACED and not lists else 1)
            if tag in ("ul", "ol", "menu"):
                lists.append([tag, 0, c.indent])
            elif tag == "li":
                depth = max(len(lists) - 1, 0)
                mark = "- "
                if lists:
                    lists[-1][1] += 1
                    if lists[-1][0] == "ol":
                        mark = f"{lists[-1][1]}. "
                c.bullet, c.indent = "  " * depth + mark, "  " * (depth + 1)
            elif tag == "pre":
                pre += 1
            elif tag == "blockquote":
                c.indent += "  "
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                canvases.append(Canvas())
            if tag not in VOID:
                work.append(("out", node, seen))
                work += [("in", x, seen) for x in reversed(node.children)]
            continue
        if tag in ("ul", "ol", "menu") and lists:
            c.indent = lists.pop()[2]
            c.bullet = ""
        elif tag == "li":
            if c.bullet:
                c.bullet = ""
            c.indent = "  " * max(len(lists) - 1, 0)
        elif tag == "pre":
            pre -= 1
        elif tag == "blockquote":
            c.indent = c.indent[:-2]
        elif tag in ("td", "th") and tables:
            text = canvases.pop().result()
            c = canvases[-1]
            if not tables[-1]:
                tables[-1].append([])
            height = _span(node, "rowspan", MOST_ROWS)
            tables[-1][-1].append((text, max(_span(node, "colspan", MOST_COLUMNS), 1), height or MOST_ROWS))  # 0: to the end
        elif tag == "table" and tables:
            c.lines(_laid_out(tables.pop()))
        if tag in BLOCK:
            c.block(2 if tag in SPACED and not lists else 1)
    return canvases[0].result()


def _rendered(html: pd.Series) -> pd.Series:
    return html.map(lambda x: None if x is None else render(x))


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """df with column `out`: the visible text of the page; a column of that name is replaced."""
    rendered = F.pandas_udf(_rendered, "string")
    return df.withColumn(out, rendered(F.col(f"`{html}`").cast("string")))
