import random
import time

import pytest

from axiloom.llm.html_text import NESTED, render, tokens

PAGES = {
    # what used to break parsers
    '<ol start="--5"><li>a</ol>': "1. a", '<ol start="²"><li>a</ol>': "1. a", f'<ol start="{"9" * 5000}"><li>a</ol>': "1. a", '<ol start=" 7x"><li>a<li>b</ol>': "7. a\n8. b",
    "<![foo bar]>x": "x", "<![x[": "", "a<!x>b<?y>c</ z>d</>e<3 < 4": "abcde<3 < 4", "<!-->a<!--->b<!-- x --!>c<!-- x": "abc", "&#" + "9" * 5000 + ";x&#0065;": "�xA",
    # numbering
    "<ol start=0><li>a<li value=7>b<li>c</ol>": "0. a\n7. b\n8. c", "<ol reversed><li>a<li>b</ol>": "2. a\n1. b",
    # cells keep their blocks, columns their places
    "<table><tr><td><p>One</p><p>Two</p><ul><li>a<li>b</ul><td>x<br>y</table>": "One  x\n     y\nTwo\n\n- a\n- b",
    "<table><tr><td colspan=2>a<td>z<tr><td>one<td>two<td>c</table>": "a         z\none  two  c",
    "<table><tr><td rowspan=2>r<td>s<tr><td>u<tr><td>v<td>w</table>": "r  s\n   u\nv  w",
    "<table><tr><td colspan=1000 rowspan=60000>a<td>b</table>": "a  b", "<table><tr><td>漢字<td>b<tr><td>abcdef<td>c</table>": "漢字    b\nabcdef  c",
    "<table><tfoot><tr><td>f<tbody><tr><td>b<thead><tr><td>h</table>": "h\nb\nf",
    # what is on show
    "<svg><text>in svg</text><title>no</title><style>no</style></svg><math><mi>x</mi><mo>=</mo><mn>1</mn></math>": "in svg\nx=1",
    "<textarea>\nan <b>x\n y</textarea>": "an <b>x\n y", "<select><option>a<option selected>b<option>c</select>": "b", "<select multiple><option>a<option>b</select>": "a\nb",
    "<input value=v><input type=hidden value=no><input type=submit>": "vSubmit", "<i aria-hidden=true>icon</i>": "icon",
    # what is not
    "<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details><dialog>no</dialog>": "S\nT\nyes",
    '<p style="visibility:hidden">no<b style="visibility:visible">yes</b>no</p>z': "yes\n\nz",
    '<div style="display:none;display:block">y</div><i style="display:none!important;display:block">no</i>': "y",
    "<span hidden>no<div>no</span>no</div>no": "", "<div hidden/>no": "", "<table hidden><tr><td>no</table>a": "a", "<table><tr hidden><td>no<tr><td hidden>no<td>a</table>": "a",
    "<noscript><table><tr><td>no</noscript>yes": "yes", "<script><!-- </p> if (a<b) </scriptx> </script >yes": "yes", "<style>p</style><xmp><b></xmp>": "<b>",
    "<svg><path/><g><p>out</p></g></svg>": "out", "<svg><![CDATA[<b>]]></svg><![CDATA[x>]]>": "<b>]]>",
    "<pre>\n\n x\n\ty</pre>": "\n x\n\ty", "<p style='white-space:pre'>a  b\n c</p>": "a  b\n c", "<p>a<p hidden>no<p>b": "a\n\nb", "a</p>b</br>c": "ab\nc",
    "<h1>a<h2>b</h1>c": "a\n\nb\n\nc", "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\nd\nu\ne", "<button>a<button>b": "ab", "<form>a<form>b</form>c": "ab\n\nc",
}


@pytest.mark.parametrize("page", list(PAGES), ids=range(len(PAGES)))
def test_page(page):
    assert render(page) == PAGES[page]


class Maker:
    """Pages made from a plan together with the text they must show; end tags that may be left out often are."""

    def __init__(self, seed):
        self.r = random.Random(seed)

    def words(self, most=5):
        return " ".join("".join(self.r.choices("abcdefgé", k=self.r.randint(1, 7))) for _ in range(self.r.randint(1, most)))

    def inline(self):
        """(markup, text) of one line."""
        text, out = self.words(), []
        for w in text.split():
            tag = self.r.choice(("", "", "b", "span", "A"))
            w = self.r.choice((w, w, "&#" + str(ord(w[0])) + ";" + w[1:]))
            noise = self.r.choice(("", "", "<!-- <p> -->", "<i hidden>no</i>", "<script>'<p>no'</script>", "<b style='color:red; display : none'>no</b>"))
            out.append((f"<{tag} x='>'>{w}</{tag}>" if tag else w) + noise)
        return self.r.choice((" ", "\n ", "\t")).join(out), text

    def end(self, tag):
        return self.r.choice(("", f"</{tag}>", f"</{tag.upper()} >"))

    def block(self, depth):
        """(markup, lines, spaced)."""
        kind = self.r.choice(("p", "h2", "div", "ul", "table", "pre", "hidden") if depth < 3 else ("p", "pre"))
        if kind in ("p", "h2"):
            m, t = self.inline()
            return f"<{kind}>{m}" + (self.end("p") if kind == "p" else "</h2>"), [t], True
        if kind == "pre":
            lines = [self.words() + "  " * self.r.randint(0, 2) + self.words() for _ in range(self.r.randint(1, 3))]
            return "<pre>" + "\n".join(lines) + "</pre>", lines, True
        if kind == "hidden":
            return self.r.choice(("<div hidden>{}</div>", "<section style='display:none'>{}</section>", "<template>{}</template>", "<noscript>{}</noscript>")).format(self.blocks(depth + 1)[0]), [], False
        if kind == "div":
            m, lines = self.blocks(depth + 1)
            return f"<div>{m}</div>", lines, False
        if kind == "ul":
            m, lines = self.listing(depth)
            return m, lines, True
        rows = [[self.words(2) for _ in range(self.r.randint(1, 3))] for _ in range(self.r.randint(1, 3))]
        wide = [max((len(r[k]) for r in rows if k < len(r)), default=0) for k in range(3)]
        lines = ["  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in rows]
        return "<table>" + "".join("<tr>" + "".join("<td>" + c + self.end("td") for c in r) + self.end("tr") for r in rows) + "</table>", lines, True

    def listing(self, depth):
        ordered = self.r.random() < 0.5
        out, lines, number = [], [], self.r.choice((1, 1, 5))
        start = f" start={number}" if ordered and number > 1 else ""
        for _ in range(self.r.randint(1, 3)):
            m, t = self.inline()
            mark = f"{number}. " if ordered else "- "
            number += 1
            inner, below = self.listing(depth + 1) if depth < 2 and self.r.random() < 0.3 else ("", [])
            out.append("<li>" + m + inner + self.end("li"))
            lines += [mark + t, *(" " * len(mark) + x for x in below)]
        tag = "ol" if ordered else "ul"
        return f"<{tag}{start}>" + "".join(out) + f"</{tag}>", lines

    def blocks(self, depth=0):
        parts, lines, gap = [], [], None
        for _ in range(self.r.randint(1, 4)):
            m, own, spaced = self.block(depth)
            parts.append(m)
            if own:
                if lines and (spaced or gap):
                    lines.append("")
                lines += own
                gap = spaced
            elif spaced:
                gap = True
        # what a div holds keeps the distance of its first and last block from its neighbours
        return "".join(parts), lines


def flat(lines):
    return [x for x in lines if x]


@pytest.mark.parametrize("seed", range(300))
def test_made_pages_show_what_was_put_in(seed):
    m, lines = Maker(seed).blocks()
    got = render(f"<!doctype html><html><head><title>no</title></head><body>{m}</body></html>")
    assert flat(got.split("\n")) == flat(lines)
    if "<div" not in m and "<section" not in m:
        assert got == "\n".join(lines)


PIECES = ["<", ">", "</", "<!", "<![", "<!--", "-->", "<?", "&", "&#", ";", "'", '"', "=", "/", " ", "\n", "x", "ü", "\x00", "]]>", "9" * 30, "p", "hidden"]
PIECES += [f"<{t}>" for t in ("p", "table", "td", "tr", "li", "ol start=-", "select", "option", "svg", "math", "script", "style", "textarea", "form", "a", "b hidden", "div style='", "body", "head", "template", "frameset", "col", "caption", "td colspan=99999 rowspan=99999")]
PIECES += [f"</{t}>" for t in ("p", "table", "td", "tr", "ol", "select", "svg", "script", "a", "b", "div", "body", "html", "template", "br")]


@pytest.mark.parametrize("seed", range(40))
def test_no_markup_fails(seed):
    r = random.Random(seed)
    for _ in range(50):
        page = "".join(r.choices(PIECES, k=r.randint(1, 60)))
        assert isinstance(render(page), str)
        assert all(t[0] in ("text", "start", "end") for t in tokens(page, lambda: r.random() < 0.5))


@pytest.mark.parametrize("piece", ["<", "<!--", "<a ", "<a x='", "&#", "<table>", "<table><tr><td>x<td>", "<ul><li>y", "<b>", "<svg>", "</p>", "<script>", "<![CDATA[", "<td rowspan=65534>", "<p>x", "<select><option>z", "<a b=c "])
def test_long_pages_take_time_and_room_in_proportion(piece):
    def took(n):
        began = time.process_time()
        size = len(render(piece * n))
        return time.process_time() - began, size

    took(1000)
    (a, x), (b, y) = took(3000), took(24_000)
    assert b < 40 * max(a, 0.02) and y < 40 * max(x, 1000)


def test_tables_in_tables():
    deep = "<table><tr><td>x<td>" * 50 + "y" + "</table>" * 50
    lines = render(deep).split("\n")
    assert [x for line in lines for x in line.split()] == ["x"] * 50 + ["y"] and lines[0] == "x  x  x  x  x  x  x  x  x" and NESTED == 8
