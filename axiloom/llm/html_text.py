"""Layout-aware text of HTML pages.

A tokenizer cuts a page into tags and text by the rules that browsers share: comments and declarations of any form,
raw text of scripts, attributes with or without quotes. A tree builder makes sense of tags as they come: it closes what
a new tag implies is over, opens what it implies is there, and ignores end tags without a start. The renderer walks the
tree, leaves out what a browser would not show, and sets the rest: blocks on lines of their own with a blank line
between paragraphs, list items with bullets or numbers and indentation, preformatted text as it is, tables with columns
aligned, each cell with its own lines.

Not shown: elements that browsers don't paint, ``hidden``, ``display: none`` and ``visibility: hidden`` in a style
attribute (with ``visible`` inside it shown again), closed ``details`` but for their summary, closed ``dialog``, options
that are not selected. Style sheets are not read, and ``aria-hidden`` hides from readers only, so it hides nothing here.

Defined results: null or empty html gives empty text; text without tags comes out with its white space collapsed; broken
markup never fails; rows that repeat a page_id, or have none, are rendered each; an empty table gives no rows; columns
other than page_id and html are left alone. Nesting may be of any depth, is walked without recursion, and changes
nothing of what is shown; only layout has bounds, so that no page grows by more than a factor: indentation stops at
INDENT columns, a column of a table is padded to WIDEST at most, and tables more than NESTED deep in tables are set
without alignment.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Generator, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiloom.llm.common import map_arrow

INDENT, WIDEST, NESTED = 80, 120, 8

# Element names, as the HTML standard groups them.
VOID = frozenset("area base basefont bgsound br col embed hr img input keygen link meta param source track wbr".split())
ESCAPABLE = frozenset("title textarea".split())
RAW = ESCAPABLE | frozenset("script style xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head title script style noscript noembed noframes template iframe object canvas audio video datalist colgroup col rp desc defs metadata symbol clippath marker annotation annotation-xml".split())
#: Blocks set off by a blank line, and blocks that only begin a new line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre xmp listing ul ol dl menu dir table figure article section fieldset form".split())
PLAIN = frozenset("html body div main header footer nav aside address hgroup search details summary dialog li dt dd figcaption legend optgroup caption tr thead tbody tfoot td th center plaintext text foreignobject".split())
BLOCKS = SPACED | PLAIN | {"hr"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: A start tag on the left ends an open element on the right, unless one in _FENCE lies between.
IMPLIED = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)), "optgroup": frozenset(("option", "optgroup")),
    "rt": frozenset(("rt", "rp", "rb")), "rp": frozenset(("rt", "rp", "rb")), "rb": frozenset(("rt", "rp", "rb")),
    "body": frozenset(("head",)), "button": frozenset(("button",)),
}
#: What ends the search for an element to close; a part of a table is looked for inside its table only.
SCOPE = ("table", "td", "th", "caption", "marquee", "applet", "object", "template", "noscript", "svg", "math", "select")
_FENCE = {"li": ("ul", "ol", "menu", *SCOPE), "dt": ("dl", *SCOPE), "dd": ("dl", *SCOPE), "option": ("select", "datalist"), "optgroup": ("select",), "body": ()}
#: All that may stand in a head; any other tag, or text, ends it.
METADATA = frozenset("title meta link script style base noscript template noframes basefont bgsound".split())
#: What each part of a table stands in, from the table down. A part ends all else in its table and implies what it lacks.
_SECTION = frozenset(("thead", "tbody", "tfoot"))
PLACES = {
    "td": (_SECTION, frozenset(("tr",))), "th": (_SECTION, frozenset(("tr",))), "tr": (_SECTION,),
    "thead": (), "tbody": (), "tfoot": (), "caption": (), "colgroup": (), "col": (),
}
#: Elements whose tags are not the page's own; a table part inside stays there.
_APART = ("template", "noscript", "iframe", "svg", "math", "select", "object")
#: HTML tags that end an open svg or math element, and elements in which these may hold HTML.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_HTML_INSIDE = ("foreignobject", "desc", "mi", "mo", "mn", "ms", "mtext", "annotation-xml")
#: Types of input whose value is on show, and what a button shows that has none.
SHOWN_INPUT = frozenset("text search email url tel number date time month week datetime-local button submit reset".split())
BUTTON_TEXT = {"submit": "Submit", "reset": "Reset"}

_MARK = re.compile(r"<(?:(/?)([a-zA-Z][^\t\n\f\r />\x00]*)|(!--)|([!?/]))")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)|(["'])))?""", re.A)
_TAG_END = re.compile(r"[\s/]*>", re.A)
_COMMENT_END, _EMPTY_COMMENT = re.compile(r"--!?>"), re.compile(r"-?>")
_REFERENCE = re.compile(r"&#0*([0-9]*)")
_SPACES = re.compile(r"[ \t\n\r\f\v]+")
_INTEGER = re.compile(r"[ \t\n\f\r]*([+-]?[0-9]{1,9})(?![0-9])")
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)


def integer(value: str | None) -> int | None:
    """The number an attribute begins with, if it is one of at most nine digits."""
    m = _INTEGER.match(value or "")
    return int(m[1]) if m else None


def unescaped(s: str) -> str:
    """Text with its character references replaced; a number of more than eight digits is no character."""
    if "&" not in s:
        return s
    if "&#" in s:
        s = _REFERENCE.sub(lambda m: "&#" + (m[1] if len(m[1]) <= 8 else "99999999") if m[0] != "&#" else m[0], s)
    return html.unescape(s)


def tokens(page: str, foreign) -> Iterator[tuple]:
    """("text", s), ("start", name, attributes, closed) and ("end", name) in order; each character is looked at a
    bounded number of times. ``foreign()`` says whether the builder is in svg or math, where no text is raw."""
    at, n = 0, len(page)
    while at < n:
        m = _MARK.search(page, at)
        if m is None:
            yield "text", unescaped(page[at:])
            return
        if m.start() > at:
            yield "text", unescaped(page[at : m.start()])
        if m[3]:  # a comment; <!--> and <!---> are empty ones
            short = _EMPTY_COMMENT.match(page, m.end())
            end = short or _COMMENT_END.search(page, m.end())
            at = end.end() if end else n
            continue
        if m[4]:
            if page.startswith("<![CDATA[", m.start()) and foreign():
                end = page.find("]]>", m.end())
                yield "text", page[m.start() + 9 : end if end >= 0 else n]
                at = end + 3 if end >= 0 else n
            else:  # declarations, processing instructions and end tags without a name: up to the next >
                end = page.find(">", m.end())
                at = end + 1 if end >= 0 else n
            continue
        name, at = m[2].lower(), m.end()
        attributes: dict[str, str] = {}
        while (end := _TAG_END.match(page, at)) is None:
            a = _ATTRIBUTE.match(page, at)
            if a is None or a[5]:  # the page ends inside the tag, or inside a quote
                return
            if not m[1]:
                attributes.setdefault(a[1].lower(), unescaped(a[2] or a[3] or a[4] or ""))
            at = a.end()
        at = end.end()
        if m[1]:
            yield "end", name
            continue
        was_foreign = foreign()
        yield "start", name, attributes, "/" in end[0]
        if name in RAW and not was_foreign:
            close = None if name == "plaintext" else re.compile(rf"</{name}(?=[\t\n\f\r />])", re.I).search(page, at)
            body = page[at : close.start() if close else n]
            yield "text", unescaped(body) if name in ESCAPABLE else body
            at = close.start() if close else n


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def style(self, name: str) -> str:
        """The value of a property in the style attribute: the last one given, one marked important first."""
        found, sure = "", False
        for part in _CSS_COMMENT.sub(" ", self.attrs.get("style", "")).split(";"):
            key, _, value = part.partition(":")
            if key.strip().lower() == name:
                value = value.strip().lower()
                important = value.endswith("important") and "!" in value
                if important or not sure:
                    found, sure = value.split("!")[0].strip(), sure or important
        return found

    def unseen(self) -> bool:
        """Whether nothing in it is shown."""
        a = self.attrs
        if self.tag in UNSEEN or "hidden" in a or self.tag == "dialog" and "open" not in a:
            return True
        return "style" in a and self.style("display") == "none"


class TreeBuilder:
    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}  # where in open the elements of a tag are, so that depth costs no search
        self.solid: list[int] = [0]  # where the open elements are that an inline end tag does not reach across

    def foreign(self) -> bool:
        k = self._last(("svg", "math"))
        return k > 0 and self._last(_HTML_INSIDE) < k

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.at.setdefault(node.tag, []).append(len(self.open))
        if node.tag in BLOCKS or node.tag in SCOPE or node.tag == "button":
            self.solid.append(len(self.open))
        self.open.append(node)

    def _cut(self, k: int) -> None:
        """Close the open elements from k on."""
        while len(self.open) > k:
            self.at[self.open.pop().tag].pop()
        while self.solid[-1] >= k and len(self.solid) > 1:
            self.solid.pop()

    def _last(self, tags) -> int:
        """Where the innermost open element of tags is; 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _end(self, tags, fence) -> None:
        """Close open elements down to the lowest one of tags, unless a fence lies above it."""
        limit = self._last(fence)
        while (k := self._last(tags)) > limit:
            self._cut(k)

    def _in_table(self, tag: str) -> bool:
        """Close and open what puts the table part ``tag`` in its place; false outside a table."""
        k = self._last(("table", *_APART))
        if self.open[k].tag != "table":
            return False
        for parents in PLACES[tag]:
            if k + 1 < len(self.open) and self.open[k + 1].tag in parents:
                k += 1
                continue
            self._cut(k + 1)
            self._push(Node("tr" if "tr" in parents else "tbody", {}))
            k += 1
        self._cut(k + 1)
        return True

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if self.foreign():
            if tag in BREAKOUT:
                self._cut(self._last(("svg", "math")))
            else:
                self._push(Node(tag, attrs))
                if closed:
                    self._cut(len(self.open) - 1)
                return
        if tag == "image":
            tag = "img"
        if tag == "html" or tag == "body" and self.at.get("body"):
            return
        if self.open[-1].tag == "head" and tag not in METADATA:
            self._cut(len(self.open) - 1)
        if tag in ("select", "input", "textarea", "keygen") and (k := self._last(("select",))) > self._last(("table", "template")):
            self._cut(k)
            if tag == "select":
                return
        if tag in PLACES and self._in_table(tag):
            pass
        elif tag in IMPLIED:
            self._end(IMPLIED[tag], _FENCE.get(tag, SCOPE))
        elif tag in ("a", "nobr") and (k := self._last((tag,))) > self.solid[-1]:
            self._cut(k)
        if tag in BLOCKS and tag not in ("td", "th", "optgroup"):
            self._end(("p",), ("button", *SCOPE))
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._cut(len(self.open) - 1)
        if tag == "form" and self._last(("form",)) > self._last(("template",)):
            return  # a form holds no other
        self._push(Node(tag, attrs))
        if tag in VOID or closed and tag in ("svg", "math"):
            self._cut(len(self.open) - 1)

    def end(self, tag: str) -> None:
        if tag == "br":
            return self.start("br", {}, False)
        if tag in ("html", "body"):
            return None  # what follows still belongs to the body
        k = self._last(HEADINGS if tag in HEADINGS else (tag,))
        if not k:
            return None
        if tag in _APART:
            limit = 0
        elif tag in PLACES or tag == "table":
            limit = self._last(_APART if tag == "table" else ("table", *_APART))
        elif tag in BLOCKS or tag in FORMATTING or tag in ("button", "option"):
            limit = self._last(t for t in SCOPE if t != tag)
        else:
            limit = self.solid[-1]  # an ordinary inline element: it does not close across a block
        if k > limit:
            self._cut(k)
        return None

    def text(self, data: str) -> None:
        if self.open[-1].tag in ("head", "colgroup") and data.strip(" \t\n\r\f"):
            self._cut(len(self.open) - 1)
        self.open[-1].children.append(data)


def parse(page: str) -> Node:
    builder = TreeBuilder()
    for kind, *rest in tokens(page, builder.foreign):
        getattr(builder, kind)(*rest)
    return builder.root


def width(s: str) -> int:
    """How many columns a text takes: none for combining marks, two for wide characters."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class _Page:
    """Lines under construction. A pending gap is written only once text follows."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line that is being written
        self.gap = 0
        self.space = False
        self.indent: list[int] = [0]
        self.mark = ""

    def text(self, s: str) -> None:
        s = _SPACES.sub(" ", s)
        body = s.strip(" ")
        if not body:
            self.space |= bool(s) and bool(self.parts)
            return
        lead = " " if (self.space or s[0] == " ") and self.parts else ""
        self.start()
        self.parts.append(lead + body)
        self.space = s[-1] == " "

    def start(self) -> None:
        if not self.parts:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            prefix = " " * min(self.indent[-1], INDENT)
            self.parts.append(prefix[: max(0, len(prefix) - len(self.mark))] + self.mark if self.mark else prefix)
            self.space = False
            self.mark = ""

    def end(self, gap: int) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip())
            self.parts = []
        self.space = False
        self.gap = max(self.gap, gap)

    def line(self, s: str) -> None:
        """A line that is set already."""
        if s:
            self.start()
            self.parts.append(s)
            self.end(0)
        else:
            self.gap = 1

    def raw(self, s: str) -> None:
        for k, part in enumerate(s.split("\n")):
            if k:
                self.start()
                self.lines.append("".join(self.parts).rstrip())
                self.parts = []
            if part:
                self.start()
                self.parts.append(part)


#: A step of rendering: it yields the steps it needs, and is sent what each returns.
Step = Generator[Any, Any, Any]


def _run(step: Step) -> Any:
    """What a step returns. Steps wait on a stack of their own, so that no depth is too deep."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def _rows(table: Node) -> tuple[list[Node], list[list[Node]]]:
    """The captions and the rows of cells of a table, heads first and feet last."""
    captions, heads, bodies, feet = [], [], [], []
    for part in table.children:
        if isinstance(part, str) or part.unseen():
            continue
        if part.tag == "caption":
            captions.append(part)
        elif part.tag in _SECTION:
            into = heads if part.tag == "thead" else feet if part.tag == "tfoot" else bodies
            into += [r for r in part.children if not isinstance(r, str) and r.tag == "tr" and not r.unseen()]
    return captions, [[c for c in r.children if not isinstance(c, str) and c.tag in ("td", "th")] for r in (*heads, *bodies, *feet)]


def _set(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table of cells (lines, columns, rows). A cell that spans columns widens the last one if need be; one
    that spans rows is written in its first, and keeps its columns free in the others."""
    placed: list[list[tuple[int, int, list[str]]]] = []
    busy: dict[int, int] = {}  # rows for which a column is still taken from above
    widths: dict[int, int] = {}
    for row in rows:
        out, at = [], 0
        taken = busy
        busy = {k: n - 1 for k, n in busy.items() if n > 1}
        for lines, across, down in row:
            while at in taken:
                at += 1
            out.append((at, across, lines))
            for k in range(at, at + across):
                widths.setdefault(k, 0)
                if down > 1:
                    busy[k] = down - 1
            if across == 1:
                widths[at] = max(widths[at], min(WIDEST, max(map(width, lines), default=0)))
            at += across
        placed.append(out)
    for out in placed:
        for at, across, lines in out:
            if across > 1:
                *before, last = range(at, at + across)
                rest = sum(widths[k] + 2 for k in before if widths[k])
                widths[last] = max(widths[last], min(WIDEST, max(map(width, lines), default=0) - rest))
    starts, x = {}, 0
    for k in sorted(widths):
        starts[k] = x
        x += widths[k] + 2 if widths[k] else 0
    result = []
    for out in placed:
        for n in range(max((len(lines) for _, _, lines in out), default=0)):
            parts, x = [], 0
            for at, _, lines in out:
                if n < len(lines) and lines[n]:
                    pad = max(starts[at] - x, 2 if parts else 0)
                    parts.append(" " * pad + lines[n])
                    x += pad + width(lines[n])
            result.append("".join(parts))
    return result


def _table(node: Node, visible: bool, depth: int) -> Step:
    """The lines of a table."""
    captions, rows = _rows(node)
    out: list[str] = []
    for c in captions:
        out += yield _rendered(c, visible, depth)
    cells: list[list[tuple[list[str], int, int]]] = []
    area = 0
    for k, row in enumerate(rows):
        cells.append([])
        for c in row:
            if not c.unseen():
                lines = yield _rendered(c, visible, depth + 1)
                across = max(1, min(integer(c.attrs.get("colspan")) or 1, 1000))
                down = max(1, min(integer(c.attrs.get("rowspan")) or 1, len(rows) - k))
                area += across * down
                cells[-1].append((lines, across, down))
    if area > 20 * (10 + sum(map(len, cells))):  # spans over nothing
        cells = [[(lines, 1, 1) for lines, _, _ in row] for row in cells]
    return out + _set(cells)


def _flowing(node: Node, page: _Page, visible: bool, depth: int) -> Step:
    """A table without alignment: a line or more for each row, into the page itself."""
    captions, rows = _rows(node)
    for row in ([c] for c in captions), rows:
        for cells in row:
            page.end(0)
            for c in cells:
                if not c.unseen():
                    page.space = True
                    yield _walk(_alone(c, "span"), page, False, visible, depth)
    page.end(0)


def _stray(node: Node) -> list[Node | str]:
    """What stands in a table but in no cell: a browser shows it before the table."""
    out: list[Node | str] = []
    for c in node.children:
        if isinstance(c, str):
            out.append(c)
        elif c.tag in _SECTION or c.tag == "tr":
            if not c.unseen():
                out += _stray(c)
        elif c.tag not in ("td", "th", "caption", "colgroup", "col"):
            out.append(c)
    return out


def _options(node: Node) -> list[Node]:
    """The options of a select that are on show: all of a list, else the one selected or the first."""
    found, queue = [], [node]
    while queue:
        x = queue.pop()
        if x.tag == "option":
            found.append(x)
        else:
            queue += [c for c in reversed(x.children) if not isinstance(c, str) and not c.unseen()]
    if "multiple" in node.attrs or (integer(node.attrs.get("size")) or 0) > 1:
        return found
    chosen = [x for x in found if "selected" in x.attrs][-1:] or [x for x in found if "disabled" not in x.attrs][:1]
    return chosen or found[:1]


def _label(node: Node) -> str:
    """What an input shows."""
    kind = (node.attrs.get("type") or "text").strip().lower()
    return (node.attrs.get("value") or BUTTON_TEXT.get(kind, "")) if kind in SHOWN_INPUT else ""


def _walk(node: Node, page: _Page, pre: bool, visible: bool, depth: int) -> Step:
    tag = node.tag
    if "style" in node.attrs and (how := node.style("visibility")) in ("hidden", "collapse", "visible"):
        visible = how == "visible"
    if tag == "br":
        if page.parts:
            page.end(0)
        else:
            page.gap = 1
        return
    if tag == "hr":
        page.end(1)
        if visible:
            page.text("---")
        page.end(1)
        return
    if tag == "input":
        if visible:
            page.text(_label(node))
        return
    if tag == "table":
        page.end(1)
        for c in _stray(node):
            if isinstance(c, str):
                if visible:
                    page.text(c)
            elif not c.unseen():
                yield _walk(c, page, False, visible, depth)
        page.end(1)
        if depth < NESTED:
            for line in (yield _table(node, visible, depth)):
                page.line(line)
        else:
            yield _flowing(node, page, visible, depth)
        page.end(1)
        return
    if tag == "select":
        shown = _options(node)
        for c in shown:
            page.space = True
            yield _walk(c, page, False, visible, depth)
            if len(shown) > 1:
                page.end(0)
        page.space = True
        return
    inner = node.children
    if tag == "details" and "open" not in node.attrs:
        inner = [c for c in inner if not isinstance(c, str) and c.tag == "summary"][:1]
    listing = tag in ("ul", "ol", "menu", "dir")
    spaced = tag in SPACED and not (listing and len(page.indent) > 1)
    if tag in BLOCKS:
        page.end(int(spaced))
    pre = pre or tag in ("pre", "xmp", "listing", "plaintext", "textarea") or "style" in node.attrs and node.style("white-space") in ("pre", "pre-wrap", "pre-line", "break-spaces")
    if tag in ("pre", "listing", "textarea") and inner and isinstance(inner[0], str) and inner[0][:1] == "\n":
        inner = [inner[0][1:], *inner[1:]]
    if listing or tag == "blockquote":
        page.indent.append(page.indent[-1] + (2 if tag == "blockquote" else 0))
    step, number = 1, integer(node.attrs.get("start")) if tag == "ol" else None
    if tag == "ol" and "reversed" in node.attrs:
        step = -1
        number = sum(not isinstance(c, str) and c.tag == "li" for c in inner) if number is None else number
    number = 1 if number is None else number
    for c in inner:
        if isinstance(c, str):
            if visible:
                page.raw(c) if pre else page.text(c)
        elif c.unseen():
            continue
        elif c.tag == "li":
            if tag == "ol" and (own := integer(c.attrs.get("value"))) is not None:
                number = own
            mark = f"{number}. " if tag == "ol" else "- "
            number += step
            page.end(0)
            page.indent.append(page.indent[-1] + len(mark))
            page.mark = mark
            yield _walk(c, page, pre, visible, depth)
            page.end(0)
            page.mark = ""
            page.indent.pop()
        else:
            yield _walk(c, page, pre, visible, depth)
    if listing or tag == "blockquote":
        page.indent.pop()
    if tag in BLOCKS:
        page.end(int(spaced))


def _alone(node: Node, tag: str) -> Node:
    """A node's content and style, under a tag that sets it otherwise."""
    out = Node(tag, {k: v for k, v in node.attrs.items() if k == "style"})
    out.children = node.children
    return out


def _rendered(node: Node, visible: bool = True, depth: int = 0) -> Step:
    """The lines of what is in a node."""
    page = _Page()
    yield _walk(_alone(node, "div"), page, False, visible, depth)
    page.end(0)
    return page.lines


def render(page: str | None) -> str:
    """The visible text of a page."""
    return "\n".join(_run(_rendered(parse(page or ""))))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text of each row of pages (page_id, html)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([render(h.as_py()) for h in b.column(1)], pa.string())], ["page_id", "text"])

    return map_arrow(pages.select(F.col("page_id").cast("long"), F.col("html")), run, "page_id long, text string")
