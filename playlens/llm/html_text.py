"""HTML extraction by layout-aware rendering.

A page is tokenised, a tree is built with the implied tags (an open paragraph ends
at a block, list items, table rows, cells and options end at the next of their
kind, cells outside a row get one, body content ends the head), and the tree is
walked to emit all visible text:

* blocks on lines of their own, paragraphs, headings, lists and tables set off by
  an empty line; white space collapsed except in ``pre`` and ``textarea``;
* list items with "- " or their number, indented by depth;
* table cells in columns padded to the widest cell, two spaces apart, cells of
  several lines and of several columns included; nested tables inside their cell;
* nothing of head, script, style, template, noscript, hidden inputs, comments,
  ``hidden`` attributes and inline ``display:none`` or ``visibility:hidden``.

The walk uses its own stack, so the depth of a page does not matter. Pages are
independent: nothing is shuffled.

Nulls: a null page gives null, an empty one the empty text. Broken markup gives
the text that can be seen: an unclosed tag at the end is dropped, an unclosed
comment hides the rest. Repeated rows are rendered each. Extra columns are kept
by ``extract``, where its own column replaces one of the same name.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from playlens.llm.common import prepare

# Element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe object audio video canvas svg math datalist noembed noframes".split())
IN_HEAD = frozenset("base link meta title script style template noscript head html".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
                   "h5 h6 header hgroup hr legend li main menu nav ol option optgroup p pre search section summary table ul "
                   "caption tr body html".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table blockquote pre figure hr fieldset".split())
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_OPENED = re.compile(r"<[/a-zA-Z]")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_CLOSE = {t: re.compile(rf"</{t}\s*/?>", re.I) for t in RAW}

#: A start tag that ends open elements: name -> (those it ends, those that shield them).
_TABLE = frozenset(("table",))
_ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "table", "td", "th"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (frozenset(("td", "th")), _TABLE),
    "th": (frozenset(("td", "th")), _TABLE),
    "tr": (frozenset(("td", "th", "tr", "caption")), _TABLE),
    "tbody": (frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "caption")), _TABLE),
    "thead": (frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "caption")), _TABLE),
    "tfoot": (frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "caption")), _TABLE),
    "caption": (frozenset(("caption",)), _TABLE),
}
_P = frozenset(("p",))
#: An end tag doesn't reach out of a cell, but for these.
_CELLS = frozenset(("td", "th", "table"))
_ANYWHERE = frozenset(("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html"))
_P_SHIELD = frozenset(("table", "td", "th", "caption", "button", "html", "body"))


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


class _Ends:
    """Where tags end: at the first ``>`` that is not quoted.

    A tag is scanned forward from its name. If a scan meets the end of the page, the
    ends for all later places are worked out at once, from the last quote or ``>`` of
    the page back to the first, so that no part of a page is scanned over and over."""

    def __init__(self, html: str):
        self.html, self.stops, self.ends = html, None, None

    def after(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose attributes begin at ``at``, or -1."""
        if self.stops is not None:
            k = bisect_left(self.stops, at)
            return self.ends[k] if k < len(self.ends) else -1
        html = self.html
        while True:
            m = _STOP.search(html, at)
            if m is None:
                break
            if m.group() == ">":
                return m.start()
            at = html.find(m.group(), m.end()) + 1
            if not at:
                break
        self._table()
        return -1

    def _table(self) -> None:
        self.stops = [m.start() for m in _STOP.finditer(self.html)]
        self.ends = [-1] * (len(self.stops) + 1)
        later = {'"': -1, "'": -1}
        for k in range(len(self.stops) - 1, -1, -1):
            c = self.html[self.stops[k]]
            if c == ">":
                self.ends[k] = self.stops[k]
            else:
                if later[c] >= 0:  # goes on behind the closing quote
                    self.ends[k] = self.ends[later[c] + 1]
                later[c] = k


class _Stack:
    """The open elements, with the places of each name's, so that no question about
    them walks the stack."""

    def __init__(self, root: "Node"):
        self.nodes, self.places = [root], {}

    @property
    def top(self) -> "Node":
        return self.nodes[-1]

    def push(self, node: "Node") -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, size: int) -> None:
        while len(self.nodes) > size:
            self.places[self.nodes.pop().tag].pop()

    def last(self, names) -> int:
        """The place of the innermost open element of one of the names; the root is none."""
        return max((p[-1] for p in map(self.places.get, names) if p), default=0)


def _attrs(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if raw and not raw.isspace():
        for name, a, b, c in _ATTR.findall(raw):
            out.setdefault(name.lower(), unescape(a or b or c))
    return out


def parse(html: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    stack = _Stack(root)
    ends = _Ends(html)

    def end(names: frozenset, shield: frozenset) -> None:
        i = stack.last(names)
        if i and i > stack.last(shield):
            # the outermost of the names above the shield
            while i > 1 and stack.nodes[i - 1].tag in names:
                i -= 1
            stack.cut(i)

    def inside(names: tuple[str, ...], shield: tuple[str, ...]) -> bool:
        i = stack.last(names)
        return i > 0 and i > stack.last(shield)

    def text(s: str) -> None:
        if not s:
            return
        if stack.top.tag == "head" and not s.isspace():
            stack.cut(len(stack.nodes) - 1)
        stack.top.kids.append(unescape(s) if "&" in s else s)

    def start(tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag == "html":
            for k, v in attrs.items():
                root.attrs.setdefault(k, v)
            return
        if stack.top.tag == "head" and tag not in IN_HEAD:
            stack.cut(len(stack.nodes) - 1)
        if tag in ENDS_P:
            end(_P, _P_SHIELD)
        if tag in _ENDS:
            end(*_ENDS[tag])
        if tag in ("td", "th") and inside(("table",), ()) and not inside(("tr",), ("table",)):
            start("tr", {}, False)
        node = Node(tag, attrs)
        stack.top.kids.append(node)
        if tag not in VOID and not (closed and tag in ("svg", "math")):
            stack.push(node)

    at = look = 0  # the text not taken yet, and where a tag is looked for
    while True:
        look = html.find("<", look)
        if look < 0:
            cut = _OPENED.search(html, max(at, html.rfind(">") + 1))  # a tag that never ends
            text(html[at:cut.start()] if cut else html[at:])
            break
        if html.startswith("<!--", look):
            text(html[at:look])
            close = html.find("-->", look + 4)
            at = look = close + 3 if close >= 0 else len(html)
            continue
        if html.startswith(("<!", "<?"), look):
            text(html[at:look])
            close = html.find(">", look)
            at = look = close + 1 if close >= 0 else len(html)
            continue
        m = _NAME.match(html, look)
        close = ends.after(m.end()) if m else -1
        if close < 0:
            look += 1  # no tag: the character stands for itself
            continue
        text(html[at:look])
        rest, at, closing = html[m.end():close], close + 1, html[look + 1] == "/"
        look, tag = at, m.group(1).lower()
        if closing:
            if tag == "p" and not inside(("p",), ("table",)):
                continue
            i = stack.last((tag,))
            if i and (tag in _ANYWHERE or i > stack.last(_CELLS)):
                stack.cut(i)
            continue
        start(tag, _attrs(rest[:-1] if rest.endswith("/") else rest), rest.endswith("/"))
        if tag in RAW:
            close = _CLOSE[tag].search(html, at)
            body = html[at:close.start()] if close else html[at:]
            if body:
                stack.top.kids.append(unescape(body) if tag in ("textarea", "title") else body)
            stack.cut(len(stack.nodes) - 1)
            at = look = close.end() if close else len(html)
    return root


def visible(node: Node) -> bool:
    if node.tag in UNSEEN:
        return False
    a = node.attrs
    if not a:
        return True
    if "hidden" in a or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False
    return not ("style" in a and _HIDDEN.search(a["style"]))


class Page:
    """Lines in the making: collapses white space, indents, keeps the gaps."""

    def __init__(self):
        self.lines: deque[str] = deque()
        self.parts: list[str] = []
        self.gap = 0  # empty lines wanted before the next text
        self.space = False
        self.prefix: list[str] = []
        self.marker: str | None = None

    def text(self, s: str) -> None:
        t = _SPACE.sub(" ", s)
        if not t:
            return
        if t == " ":
            self.space = bool(self.parts)
            return
        if t[0] == " ":
            self.space = bool(self.parts)
            t = t[1:]
        if self.space and self.parts:
            self.parts.append(" ")
        self.space = t[-1] == " "
        self.parts.append(t[:-1] if self.space else t)

    def _indent(self) -> str:
        head = "".join(self.prefix)
        if self.marker is not None:
            head, self.marker = head[:len(head) - len(self.marker)] + self.marker, None
        return head

    def _gap(self) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0

    def line(self) -> None:
        """End the line under way."""
        if self.parts:
            self._gap()
            self.lines.append((self._indent() + "".join(self.parts)).rstrip(" "))
            self.parts = []
        self.space = False

    def block(self, gap: int) -> None:
        self.line()
        self.gap = max(self.gap, gap)

    def raw(self, lines: deque[str]) -> None:
        self.line()
        if lines:
            self._gap()
            if not self.prefix and self.marker is None:
                self.lines = _joined([self.lines, lines])
                return
            for x in lines:
                self.lines.append((self._indent() + x).rstrip(" "))

    def done(self) -> deque[str]:
        self.line()
        if self.marker is not None:  # an item without text
            self._gap()
            self.lines.append(self._indent().rstrip(" "))
        return self.lines


def _width(s: str) -> int:
    return len(s) if s.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in s)


def _span(value: str | None) -> int:
    return min(1000, max(1, int(value))) if value and value.strip().isdecimal() else 1


def _joined(parts: list[deque[str]]) -> deque[str]:
    """The parts one after the other, put around the longest one, whose lines are not
    copied: tables within tables hand their lines on from cell to cell."""
    k = max(range(len(parts)), key=lambda i: len(parts[i]))
    out = parts[k]
    for p in reversed(parts[:k]):
        out.extendleft(reversed(p))
    for p in parts[k + 1:]:
        out.extend(p)
    return out


def table_lines(rows: list[list[tuple[deque[str], int]]]) -> deque[str]:
    """Aligned lines of rows of (cell lines, columns)."""
    if rows and all(len(r) == 1 and r[0][1] == 1 for r in rows):
        return _joined([r[0][0] for r in rows])  # one column: nothing to align
    rows = [[(list(lines), span) for lines, span in r] for r in rows]
    widths: list[int] = []
    for wide in (False, True):
        for row in rows:
            at = 0
            for lines, span in row:
                widths += [0] * (at + span - len(widths))
                need = max(map(_width, lines), default=0)
                if span == 1 and not wide:
                    widths[at] = max(widths[at], need)
                elif span > 1 and wide:
                    have = sum(widths[at:at + span]) + 2 * (span - 1)
                    widths[at + span - 1] += max(0, need - have)
                at += span
    out: deque[str] = deque()
    for row in rows:
        for i in range(max((len(lines) for lines, _ in row), default=0)):
            at, line = 0, ""
            for lines, span in row:
                own = sum(widths[at:at + span]) + 2 * (span - 1)
                s = lines[i] if i < len(lines) else ""
                line += s + " " * (own - _width(s) + 2)
                at += span
            out.append(line.rstrip(" "))
    return out


def render(html: str | None) -> str | None:
    """The visible text of a page."""
    if html is None:
        return None
    page = Page()
    pages = [page]  # the page, and one for each open cell or caption
    tables: list[list] = []
    lists: list[list] = []
    pre = 0
    todo: list[tuple] = [(parse(html), True)]
    while todo:
        node, entering = todo.pop()
        page = pages[-1]
        if isinstance(node, str):
            if pre:
                first, *rest = node.replace("\r\n", "\n").split("\n")
                page.parts.append(first)
                for x in rest:
                    _end_pre(page)
                    page.parts.append(x)
            else:
                page.text(node)
            continue
        tag = node.tag
        if entering:
            if not visible(node):
                continue
            todo.append((node, False))
            todo.extend((k, True) for k in reversed(node.kids))
            if tag == "br":
                if page.parts:
                    page.line()
                else:
                    page.gap += 1 if page.lines else 0
            elif tag == "wbr" or tag in VOID:
                if tag == "hr":
                    page.block(1)
            elif tag == "table":
                page.block(1)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables and tables[-1]:
                pages.append(Page())
            elif tag in BLOCKS:
                page.block(1 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 0)
                if tag in ("ul", "ol", "menu"):
                    start = node.attrs.get("start", "1")
                    lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                elif tag == "li":
                    mark = "- "
                    if lists and lists[-1][0]:
                        own = node.attrs.get("value", "")
                        if re.fullmatch(r"-?\d{1,9}", own):
                            lists[-1][1] = int(own)
                        mark = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                    page.prefix.append(" " * len(mark))
                    page.marker = mark
                elif tag in ("dd", "blockquote"):
                    page.prefix.append("  ")
                elif tag == "pre":
                    pre += 1
            elif tag == "textarea":
                pre += 1
            continue
        if tag == "table":
            rows = tables.pop()
            page.raw(table_lines([r for r in rows if any(lines for lines, _ in r)]))
            page.block(1)
        elif tag in ("td", "th") and tables and tables[-1] and len(pages) > 1:
            cell = pages.pop()
            tables[-1][-1].append((cell.done(), _span(node.attrs.get("colspan"))))
        elif tag in BLOCKS and tag != "hr" and tag != "tr":
            if tag == "pre":
                pre -= 1
            if tag == "li":
                if page.parts or page.marker is None:
                    page.line()
                else:
                    page.raw(deque([""]))
                page.prefix.pop()
                page.marker = None
            page.block(1 if tag in SPACED and not (tag in ("ul", "ol", "menu") and len(lists) > 1) else 0)
            if tag in ("dd", "blockquote"):
                page.prefix.pop()
            if tag in ("ul", "ol", "menu"):
                lists.pop()
        elif tag == "textarea":
            pre -= 1
    return "\n".join(pages[0].done())


def _end_pre(page: Page) -> None:
    """A line end in preformatted text: empty lines are kept."""
    if page.parts and any(page.parts):
        page.line()
    else:
        page.parts = []
        if page.lines:
            page.gap += 1


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the visible text as ``out_col``."""
    prepare(pages.sparkSession)
    pages = pages.drop(out_col) if out_col != html_col else pages

    def run(batches):
        for b in batches:
            got = pa.array([render(x) for x in b.column(html_col).to_pylist()], pa.string())
            yield b.append_column(out_col, got)

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField(out_col, StringType())]))


