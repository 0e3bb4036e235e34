"""Text of HTML pages as it would be laid out.

A tokenizer and a tree builder with implied tags (end tags of p, li, dt, dd,
option, table parts; rows that cells imply) make a tree; visibility rules drop
what a browser doesn't show (head, scripts, styles, templates, hidden or
display:none elements, options not selected); a renderer emits all other text:
blocks on lines of their own, an empty line around paragraphs and headings,
bullets and numbers with hanging indents for lists, cells of a table row side
by side in aligned columns, line breaks, and preformatted text as it stands.
Nothing recurses, and the work is in proportion to the page, whatever its
nesting and however broken: tags are scanned without going back, and the open
elements of each kind are kept by their place on the stack. A tag that the page
ends in is text.

Fixed limits of the layout, none of which drops text: columns are aligned to
the width of cells of up to WIDEST characters, indents stop growing and tables
in tables become blocks at DEEPEST levels, and spans are clamped as in the HTML standard (1,000 columns, 65,534
rows). A cell's text stands in the first of the rows that it spans.

Each page is independent: batches are mapped, without a shuffle. Defined
results: null and empty pages give an empty text; broken markup gives the tree
of the rules above; repeated rows give a row each; extra columns are ignored.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, vec

_DECLARATION = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^>]*>?", re.S)
#: Quotes count after = only. Possessive: no part is ever tried twice.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)>")
_ATTR = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+")
_STYLE = re.compile(r"(?:\A|;)\s*+(display|visibility)\s*+:\s*+([a-z-]++)")
WIDEST, DEEPEST = 80, 40
_GAPS = re.compile(r"[ \t\n\r\f\v]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title meta link base iframe noembed noframes object audio video canvas svg datalist rp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"html", "body", "li", "dd", "dt", "legend", "summary"} | {"li", "dd", "dt"}
LISTS = frozenset(("ul", "ol", "menu", "dir"))
CELLS = frozenset(("td", "th"))
#: An end is implied for the second kind when the first opens, unless one of the third stands between.
IMPLIED = {
    "li": (("li",), LISTS), "dt": (("dt", "dd"), {"dl"}), "dd": (("dt", "dd"), {"dl"}), "option": (("option",), {"select"}), "optgroup": (("optgroup", "option"), {"select"}),
    "tr": (("tr", "td", "th", "caption"), {"table"}), "td": (("td", "th"), {"tr", "table"}), "th": (("td", "th"), {"tr", "table"}),
    "tbody": (("tbody", "thead", "tfoot", "caption"), {"table"}), "thead": (("tbody", "thead", "tfoot", "caption"), {"table"}), "tfoot": (("tbody", "thead", "tfoot", "caption"), {"table"}),
    "body": (("head",), {"html"}), "a": (("a",), {"td", "th", "table"}),
}
SCOPE = frozenset(("table", "td", "th", "caption", "html", "template", "button"))


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(text):
        if value[:1] in ('"', "'"):
            value = value[1:-1]
        out.setdefault(name.lower(), html.unescape(value))
    return out


class Open:
    """The stack of open elements, and where on it each kind stands."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.stack[-1].kids.append(node)
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, kinds) -> int:
        """The place of the innermost open element of some kinds, 0 if there is none."""
        return max((p[-1] for k in kinds if (p := self.places.get(k))), default=0)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def close(self, kinds, barrier=()) -> bool:
        """Closes the innermost element of some kinds and all in it, unless one of the barrier's kinds stands in it."""
        place = self.last(kinds)
        if not place or self.last(barrier) > place:
            return False
        self.cut(place)
        return True


def parse(page: str) -> Node:
    root = Node("html", {})
    tree = Open(root)
    stack = tree.stack

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and not s.isspace():
                tree.cut(len(stack) - 1)
            stack[-1].kids.append(html.unescape(s))

    at = begun = 0  # of the text that isn't taken yet; of the search
    while (lt := page.find("<", begun)) >= 0:
        m = _TAG.match(page, lt)
        if not m:
            after = page[lt + 1 : lt + 3]
            if after[:1] in ("!", "?") or after[:1] == "/" and not after[1:].isalpha():
                d = _DECLARATION.match(page, lt)
                text(page[at:lt])
                if d[0].startswith("<![CDATA["):
                    text(html.escape(d[0][9:].removesuffix("]]>"), quote=False))
                at = begun = d.end()
            elif after[: 1 + (after[:1] == "/")].lstrip("/").isascii() and after.lstrip("/")[:1].isalpha():
                break  # the page ends in a tag
            else:
                begun = lt + 1
            continue
        text(page[at:lt])
        at = begun = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].kids.append(Node("br", {}))
            elif tag in HEADINGS:
                tree.close(HEADINGS, SCOPE)
            elif tag in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"):
                tree.close((tag,), () if tag == "table" else ("table",))
            elif not tree.close((tag,), SCOPE - {tag}) and tag == "p":
                stack[-1].kids.append(Node("p", {}))
            continue
        attrs = _attributes(m[3]) if m[3] else {}
        if tag == "html":
            root.attrs = attrs | root.attrs
            continue
        if tag not in HIDDEN and len(stack) > 1 and stack[1].tag == "head" and tag not in ("noscript", "head"):
            tree.cut(1)
        if tag in CLOSES_P:
            tree.close(("p",), SCOPE)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            tree.cut(len(stack) - 1)
        if tag in IMPLIED:
            while tree.close(*IMPLIED[tag]):
                pass
        if tag in CELLS and tree.last(("tr",)) <= tree.last(("table",)):
            tree.push(Node("tr", {}))
        node = Node(tag, attrs)
        if tag in VOID or (m[3].endswith("/") and tag in ("svg", "path", "circle", "rect", "use", "line", "g")):
            stack[-1].kids.append(node)
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+>?", re.I | re.A).search(page, at)
            inside = page[at : end.start() if end else len(page)]
            node.kids.append(html.unescape(inside) if tag in ("textarea", "title") else inside)
            stack[-1].kids.append(node)
            at = begun = end.end() if end else len(page)
        else:
            tree.push(node)
    text(page[at:])
    return root


def visible(node: Node, inherited: bool) -> bool | None:
    """Whether the text in an element shows; None if nothing in it ever does."""
    if node.tag in HIDDEN or "hidden" in node.attrs:
        return None
    if node.attrs and (style := node.attrs.get("style")):
        style = dict(_STYLE.findall(style.lower()))
        if style.get("display") == "none":
            return None
        if kind := style.get("visibility"):
            return kind not in ("hidden", "collapse") and (kind == "visible" or inherited)
    return inherited


class Box:
    """Lines of a page or cell, and the line that is being filled. Parts that are indented share it."""

    def __init__(self):
        self.lines: list[str] = []
        self.words: list[str] = []
        self.space = False
        self.gap = 0
        #: indented parts: first line, markers until that line is put, indent of further lines
        self.parts: list[list] = [[0, "", ""]]

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.words.append(first)
            for x in rest:
                self.line(True)
                self.words.append(x)
            return
        parts = _GAPS.split(s)
        if len(parts) > 1 and not parts[0]:
            self.space = True
        for i, w in enumerate(parts):
            if w:
                if (self.space or i) and self.words:
                    self.words.append(" ")
                self.words.append(w)
                self.space = False
        if len(parts) > 1 and not parts[-1]:
            self.space = True

    def _put(self, s: str) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = 0
        part = self.parts[-1]
        if s:
            s, part[1] = (part[1] or part[2]) + s, ""
        self.lines.append(s)

    def line(self, force: bool = False) -> None:
        """Ends the line."""
        s = "".join(self.words).rstrip()
        if s or force and len(self.lines) > self.parts[-1][0]:
            self._put(s)
        self.words, self.space = [], False

    def block(self, gap: int) -> None:
        self.line()
        if len(self.lines) > self.parts[-1][0]:
            self.gap = max(self.gap, gap)

    def indent(self, marker: str) -> None:
        self.line()
        _, wait, before = self.parts[-1]
        self.parts[-1][1] = ""
        after = before + " " * len(marker) if len(self.parts) <= DEEPEST else before
        self.parts.append([len(self.lines), (wait or before) + marker, after])

    def dedent(self) -> None:
        self.line()
        first = self.parts.pop()[0]
        while len(self.lines) > first and not self.lines[-1]:
            self.lines.pop()
        if len(self.lines) > first:
            self.gap = 0

    def add(self, lines: list[str]) -> None:
        self.line()
        for s in lines:
            self._put(s)

    def done(self) -> list[str]:
        self.line()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return lines


def grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns and rows that it spans) as lines with aligned columns. Columns that no cell begins in have no width."""
    placed: list[list[tuple[int, list[str]]]] = []
    taken: list[tuple[int, int, int]] = []  # columns (from, to) that cells of rows above span, and in how many rows more
    width: dict[int, int] = {}
    for r in rows:
        col, k, out, below = 0, 0, [], []
        for lines, span, down in r:
            while k < len(taken) and taken[k][0] <= col:
                col, k = max(col, taken[k][1]), k + 1
            out.append((col, lines))
            if down > 1:
                below.append((col, col + span, down))
            width[col] = max([width.get(col, 0), *(len(x) for x in lines if len(x) <= WIDEST and span == 1)])
            col += span
        placed.append(out)
        if taken or below:
            taken = sorted((a, b, n - 1) for a, b, n in taken + below if n > 1)
    columns = sorted(width)
    at = dict(zip(columns, itertools.accumulate((width[c] + 2 for c in columns), initial=0), strict=False))
    out = []
    for r in placed:
        if len(r) == 1 and r[0][0] == 0:
            out += r[0][1]
            continue
        for i in range(max((len(lines) for _, lines in r), default=0)):
            line = ""
            for col, lines in r:
                if i < len(lines) and lines[i]:
                    line += " " * max(at[col] - len(line), 2 if line else 0) + lines[i]
            out.append(line)
    return out


def _number(node: Node, name: str, most: int) -> int:
    s = node.attrs.get(name, "1").strip()
    return min(int(s[:9]), most) if s.isdecimal() and s.isascii() else 1


def _chosen(node: Node) -> None:
    """Leaves a select only the options that show: those selected, or the first."""
    options, todo = [], [node]
    while todo:
        x = todo.pop()
        for k in reversed(x.kids):
            if isinstance(k, Node):
                options.append(k) if k.tag == "option" else todo.append(k)
    options.sort(key=lambda k: "selected" not in k.attrs)
    node.kids = [x for x in options if "selected" in x.attrs] or options[-1:]


def render(root: Node) -> str:
    boxes = [Box()]
    tables: list[list] = []
    lists: list[list] = []
    shown = [True]
    pre = 0
    todo: list[tuple[object, bool]] = [(root, False)]
    while todo:
        x, closing = todo.pop()
        box = boxes[-1]
        if isinstance(x, str):
            if shown[-1]:
                box.text(x, pre > 0)
            continue
        tag = x.tag
        spaced = 1 if tag in SPACED and not (tag in LISTS and lists) else 0
        if not closing:
            show = visible(x, shown[-1])
            if show is None:
                continue
            if tag == "br":
                box.line(True)
                continue
            if tag == "hr":
                box.block(1)
                if show:
                    box.add(["---"])
                    box.gap = 1
                continue
            if tag in VOID:
                if tag == "input" and show and x.attrs.get("type", "text").lower() not in ("hidden", "checkbox", "radio", "image", "password", "file", "color", "range") and x.attrs.get("value"):
                    box.text(f" {x.attrs['value']} ", False)
                continue
            if tag == "select":
                _chosen(x)
            if tag in BLOCK:
                box.block(spaced)
            elif tag == "option":
                box.space = True
            if tag in LISTS:
                start = x.attrs.get("start", "1")
                lists.append([tag, int(start) if start.isdecimal() and len(start) < 9 else 1])
            elif tag == "table":
                tables.append([] if len(tables) < DEEPEST else None)
            elif tag == "tr" and tables and tables[-1] is not None:
                tables[-1].append([])
            if tag == "pre":
                pre += 1
            if tag in CELLS or tag == "caption":
                if tables and tables[-1] is None:
                    box.block(0)
                else:
                    boxes.append(Box())
            elif tag == "li":
                mark = "* "
                if lists and lists[-1][0] == "ol":
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                box.indent(mark)
            elif tag in ("dd", "blockquote"):
                box.indent("  " if tag == "blockquote" else "    ")
            shown.append(show)
            todo.append((x, True))
            todo += [(k, False) for k in reversed(x.kids)]
            continue
        shown.pop()
        if (tag in CELLS or tag == "caption") and tables and tables[-1] is None:
            box.block(0)
        elif tag in CELLS or tag == "caption":
            lines = boxes.pop().done()
            box = boxes[-1]
            if tag in CELLS and tables:
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((lines, _number(x, "colspan", 1000) or 1, _number(x, "rowspan", 65534) or 65534))
            else:
                box.add(lines)
        elif tag in ("li", "dd", "blockquote"):
            box.dedent()
        if tag == "pre":
            pre -= 1
        if tag in LISTS:
            lists.pop()
        elif tag == "table":
            box.add(grid(tables.pop() or []))
        if tag in BLOCK:
            box.block(1 if tag in SPACED and not (tag in LISTS and lists) else 0)
    return "\n".join(boxes[0].done())


def extract_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """key, text"""
    common.batches(pages.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in vec.slices(batch, column=column):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([extract_text(x.as_py()) for x in part.column(1)], pa.string())], names=[key, "text"])

    base = pages.select(key, column)
    return base.mapInArrow(run, f"`{key}` {base.schema[key].dataType.simpleString()}, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages")).selectExpr("page_id", "text", "CAST(length(text) AS BIGINT) AS n_chars", "CAST(CASE WHEN text = '' THEN 0 ELSE size(split(text, '\\n')) END AS BIGINT) AS n_lines")
