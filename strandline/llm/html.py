"""Visible text of HTML pages by layout-aware rendering.

A tree is built with the tags that HTML implies (p, li, dt, dd, option, table rows, bodies and cells end where
another begins; a cell gets its row). Of a select the options shown are rendered (the selected or first one, all of a list
box), of svg the text elements, of math all but annotations. Not rendered: head, script, style, template and the like, elements
with ``hidden``, what style sheets and attributes hide (``sheets``: display:none with all below, visibility:hidden but for the
visible below it), and closed details but for their summary. Blocks stand on lines of their own, those with margins between blank
lines; a line break on an empty line keeps that line; white space collapses outside pre, which drops a first line feed; list items are
indented and marked (ol: start, reversed, type, and the value of an item); the cells of a table stand in columns as wide as their widest
line; a cell that spans columns takes their width together. Spans are as long as the HTML standard lets them be. With ``wrap``
a cell with others to its right is wrapped at so many characters, at white space (a longer word is kept whole and moves what
follows it on its line). Without it only a table whose columns would take more than BLANKS blanks a character of its text is
wrapped, at PAD: aligned as it is it could outgrow the page without bound. All else that is visible is emitted, in order.

Null and empty html give ''. Unclosed and misnested tags, comments and quotes end where a browser would end them or at the
end of the page (comments: ``-->``, ``--!>``, and at once in ``<!-->`` and ``<!--->``). Nesting has no limit in depth or time: open
tags are found by their places, inner tables are rendered before the tables that hold them, and nothing calls itself. Very long
pages are whole. Ids may be null or repeat: a row gives a row. An empty table gives no rows. Extra columns are not used, whatever their
names.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import sheets
from strandline.llm.common import table

PAD = 48
#: Blanks a character of its text that a table may take, beyond 65536, before its cells are wrapped.
BLANKS = 64
#: The longest spans of the HTML standard, columns and rows; a row span of 0 is as many as there are.
SPANS = 1000, 65534
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe".split())
UNSEEN = frozenset("head script style template noscript iframe object audio video canvas datalist title annotation annotation-xml mphantom noframes area param map".split())
#: Parts of svg that are not drawn, and parents of math whose children stand apart.
UNDRAWN = frozenset("defs symbol clippath mask pattern marker desc metadata lineargradient radialgradient filter".split())
APART = frozenset("mfrac msub msup msubsup munder mover munderover mroot mtable mtr mmultiscripts".split())
CHOOSY = APART | {"details", "select", "svg"}
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset form".split())
BLOCK = MARGIN | frozenset("html body div article section main nav header footer aside address li dt dd center details summary dialog figcaption legend tr caption thead tbody tfoot menu hgroup search optgroup".split())
#: The tags inside svg and math that end at once by a slash, and where styles do not count.
FOREIGN, IDLE = ("svg", "math"), ("noscript", "template")
CLOSES_P = BLOCK - {"html", "body", "tr", "caption", "thead", "tbody", "tfoot", "legend", "optgroup"} | {"hr"}
#: tag -> (open tags it ends, tags that end the search)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""\s*/*([^\s=>"'/][^\s=>/]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_END = re.compile(r"--!?>")
_WHOLE = re.compile(r"\s*([+-]?\d{1,9})")


class Node:
    __slots__ = ("tag", "attrs", "kids", "lines", "none", "dim", "mark")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids, self.lines, self.none, self.dim, self.mark = tag, attrs, [], None, False, False, "- "


def parse(html: str) -> tuple[Node, sheets.Sheet]:
    """The tree, and the rules of its style sheets."""
    root = Node("html", {})
    stack, sheet, at, n = [root], sheets.Sheet(), 0, len(html)
    places: dict[str, list[int]] = {}  # of the open tags, in the stack

    def last(tags) -> int:
        return max((places[x][-1] for x in tags if places.get(x)), default=0)

    def cut(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()

    def push(x: Node) -> None:
        places.setdefault(x.tag, []).append(len(stack))
        stack.append(x)

    def end(tags: set[str], stop: set[str]) -> None:
        stopped = last(stop)
        while (i := last(tags)) > stopped:
            cut(i)

    def put(text: str) -> None:
        if text:
            stack[-1].kids.append(unescape(text))

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            put(html[at:])
            break
        put(html[at:lt])
        if html.startswith("<!--", lt):
            m = re.compile("-?>").match(html, lt + 4) or _END.search(html, lt + 4)
            at = m.end() if m else n
            continue
        if html[lt + 1 : lt + 2] in ("!", "?"):
            close = html.find(">", lt)
            at = n if close < 0 else close + 1
            sheet.quirks = sheet.quirks and html[lt + 2 : lt + 9].lower() != "doctype"
            continue
        m = _TAG.match(html, lt)
        if not m:
            put("<")
            at = lt + 1
            continue
        tag, attrs, at = m[1].lower(), {}, m.end()
        while at < n:
            a = _ATTR.match(html, at)
            if not a:
                break
            at = a.end()
            v = a[2] or ""
            attrs.setdefault(a[1].lower(), unescape(v[1:-1] if v[:1] in "\"'" and v[-1:] == v[:1] and len(v) > 1 else v))
        close = html.find(">", at)
        closed = close > at - 1 and html[close - 1] == "/" and close - 1 >= at
        at = n if close < 0 else close + 1
        if html[lt + 1] == "/":
            if tag == "br":
                stack[-1].kids.append(Node("br", {}))
                continue
            i = last((tag,))
            if i and (tag == "table" or i > last(("table",))):
                cut(i)
            continue
        if tag in ("html", "body"):
            root.attrs.update(attrs)
            if tag == "body":
                end({"head"}, set())
            continue
        if tag in CLOSES_P:
            end({"p"}, {"table", "td", "th", "button", "caption", "object"})
        if tag in IMPLIED:
            end(*IMPLIED[tag])
        for above, own in (("table",), "tbody"), (("thead", "tbody", "tfoot"), "tr"):
            if tag in ("td", "th") or tag == "tr" != own:
                if stack[-1].tag in above:
                    stack[-1].kids.append(Node(own, {}))
                    push(stack[-1].kids[-1])
        if stack[-1].tag == "head" and tag not in ("title", "meta", "link", "style", "script", "base", "noscript", "template"):
            cut(len(stack) - 1)
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in VOID or closed and (tag in FOREIGN or last(FOREIGN)):
            continue
        if tag in RAW:
            m = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.IGNORECASE).search(html, at)
            body = html[at : m.start() if m else n]
            if tag == "style":
                if not last(IDLE) and sheets.on_screen(attrs.get("media", "")):
                    sheet.add(body)
            else:
                body = body[body.startswith("\n") :] if tag == "textarea" else body
                node.kids.append(unescape(body) if tag in ("textarea", "title") else body)
            close = html.find(">", m.end()) if m else -1
            at = n if close < 0 else close + 1
            continue
        push(node)
        if tag in ("pre", "listing"):
            at += html.startswith("\n", at) or 2 * html.startswith("\r\n", at)
    return root, sheet


def visible(node: Node) -> bool:
    return node.tag not in UNSEEN and not node.none


def numbered(node: Node) -> None:
    """Give the items of an ol their marks."""
    items = [x for x in node.kids if isinstance(x, Node) and x.tag == "li" and not x.none]
    back = "reversed" in node.attrs
    m = _WHOLE.match(node.attrs.get("start", ""))
    i = int(m[1]) if m else len(items) if back else 1
    for x in items:
        m = _WHOLE.match(x.attrs.get("value", ""))
        i = int(m[1]) if m else i
        x.mark = f"{written(i, x.attrs.get('type', node.attrs.get('type', '1')))}. "
        i += -1 if back else 1


def written(i: int, kind: str) -> str:
    """A number as digits, letters (a, A) or Roman numerals (i, I); what these cannot write stays digits."""
    out = ""
    if kind in ("a", "A") and i > 0:
        while i:
            i, k = divmod(i - 1, 26)
            out = chr(97 + k) + out
    elif kind in ("i", "I") and 0 < i < 4000:
        for power, (one, five, ten) in zip((1000, 100, 10, 1), ("m  ", "cdm", "xlc", "ivx"), strict=True):
            d = i // power % 10
            out += one + ten if d == 9 else one + five if d == 4 else five * (d > 4) + one * (d % 5)
    return (out if kind.islower() else out.upper()) or str(i)


def below(node: Node, tags: tuple[str, ...], skip: frozenset[str]) -> list[Node]:
    """The topmost visible nodes of these tags."""
    out, stack = [], list(reversed(node.kids))
    while stack:
        x = stack.pop()
        if isinstance(x, Node) and x.tag not in skip and visible(x):
            if x.tag in tags:
                out.append(x)
            else:
                stack += reversed(x.kids)
    return out


def shown(node: Node) -> list:
    """The kids of a node that are rendered."""
    kids, a = node.kids, node.attrs
    if node.tag == "details" and "open" not in a:
        return [x for x in kids if isinstance(x, Node) and x.tag == "summary"]
    if node.tag == "select":
        found = below(node, ("option",), frozenset())
        if "multiple" not in a and not (a.get("size", "").isdecimal() and int(a["size"]) > 1):
            chosen = [x for x in found if "selected" in x.attrs]
            found = chosen[-1:] or [x for x in found if "disabled" not in x.attrs][:1]
        return [y for x in found for y in (" ", x.attrs.get("label") or x, " ")]
    if node.tag == "svg":
        return [y for x in below(node, ("text", "foreignobject"), UNDRAWN) for y in (" ", x, " ")]
    if node.tag in APART:
        return [y for x in kids for y in (x, " ")]
    return kids


class Lines:
    """Collects lines: text collapses into the open one, breaks and margins end it."""

    def __init__(self):
        self.out: list[str] = []
        self.open: list[str] = []
        self.gap = False
        self.indent = 0
        self.mark = ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            parts = s.split("\n")
            for i, x in enumerate(parts):
                if i:
                    self.flush(keep=True)
                if x:
                    self.open.append(x)
        elif s := _SPACE.sub(" ", s):
            if s[0] == " " and (not self.open or self.open[-1][-1] == " "):
                s = s[1:]
            if s:
                self.open.append(s)

    def flush(self, keep: bool = False) -> None:
        line = "".join(self.open)
        line = line.rstrip() if keep else line.strip(" ")
        self.open.clear()
        if not line and not keep:
            return
        if self.gap and self.out and (line or self.mark):
            self.out.append("")
        if line or self.mark:
            self.gap = False
        self.out.append((" " * self.indent + self.mark + line).rstrip() if line or self.mark else "")
        if self.mark:
            self.indent += len(self.mark)
            self.mark = ""

    def margin(self) -> None:
        self.flush()
        self.gap = True


def render(root: Node) -> list[str]:
    """Lines of the visible text below a node; those of its tables are known."""
    lines = Lines()
    stack: list[tuple] = [(root, 0, False, None)]
    while stack:
        node, k, pre, state = stack.pop()
        if isinstance(node, str):
            lines.text(node, pre)
            continue
        tag = node.tag
        if k == 0:
            if node is not root and not visible(node):
                continue
            if tag == "br":
                lines.flush(keep=not lines.open)
                continue
            if tag == "img":
                if node.attrs.get("alt") and not node.dim:
                    lines.text(node.attrs["alt"], False)
                continue
            if tag == "input":
                if node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search") and node.attrs.get("value") and not node.dim:
                    lines.text(node.attrs["value"], False)
                continue
            if tag == "hr":
                lines.margin()
                continue
            if tag == "table" and node is not root:
                lines.margin()
                for x in node.lines:
                    lines.open.append(x)
                    lines.flush(keep=True)
                lines.margin()
                continue
            state = (lines.indent, lines.mark)
            if tag == "li":
                lines.flush()
                lines.mark = "" if node.dim else node.mark
            elif tag in MARGIN:
                nested = tag in ("ul", "ol") and lines.indent
                lines.flush() if nested else lines.margin()
                if tag in ("blockquote", "dd"):
                    lines.indent += 2
                if tag == "ol":
                    numbered(node)
            elif tag in BLOCK:
                lines.flush()
                if tag == "dd":
                    lines.indent += 2
            elif tag in ("td", "th") and lines.open:
                lines.text(" ", False)
            pre = pre or tag in ("pre", "textarea", "xmp")
        if k == 0 and tag in CHOOSY:
            kids = shown(node)
            if kids is not node.kids:
                node.kids = kids
        kids = node.kids
        if k < len(kids):
            stack.append((node, k + 1, pre, state))
            if not (node.dim and isinstance(kids[k], str)):
                stack.append((kids[k], 0, pre, None))
            continue
        if tag in BLOCK and node is not root:
            if pre and tag == "pre":
                if lines.open:
                    lines.flush(keep=True)
                lines.gap = True
            elif tag in MARGIN and not (tag in ("ul", "ol") and state[0]):
                lines.margin()
            else:
                lines.flush()
            lines.indent, lines.mark = state[0], "" if tag == "li" else lines.mark
    lines.flush()
    while lines.out and not lines.out[-1]:
        lines.out.pop()
    return lines.out


def span(node: Node, name: str, most: int) -> int:
    v = node.attrs.get(name, "1")
    n = int(v[:9]) if v.isascii() and v.isdecimal() else 1
    return min(n, most) if n else most if name == "rowspan" else 1


def wrapped(lines: list[str], most: int) -> list[str]:
    """Lines cut at white space to at most so many characters, or to one word."""
    out = []
    for x in lines:
        while len(x) > most:
            at = x.rfind(" ", 1, most + 1)
            at = at if at > 0 and x[:at].strip() else x.find(" ", most)
            if at < 0:
                break
            out.append(x[:at].rstrip())
            x = x[at:].lstrip()
        out.append(x)
    return out


def rows_of(node: Node, wrap: int | None = None) -> list[str]:
    """A table's lines, its cells aligned; the lines of tables in it are known."""
    out, grid, stack = [], [], [x for x in reversed(node.kids)]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if x.strip() and not node.dim:
                out.append(_SPACE.sub(" ", x).strip())
        elif not visible(x):
            continue
        elif x.tag in ("thead", "tbody", "tfoot"):
            stack += [y for y in reversed(x.kids) if not (x.dim and isinstance(y, str))]
        elif x.tag == "tr":
            grid.append([y for y in x.kids if isinstance(y, Node) and y.tag in ("td", "th") and visible(y)])
            rest = [y for y in x.kids if not (isinstance(y, Node) and y.tag in ("td", "th"))]
            holder = Node("div", {})
            holder.kids, holder.dim = rest, x.dim
            if any(isinstance(y, Node) or y.strip() for y in rest):
                out += render(holder)
        else:
            out += render(x)
    cells: list[list[tuple[int, int, list[str]]]] = []
    down: list[tuple[int, int, int]] = []  # columns from, to, and the row at which a cell from above ends
    for r, row in enumerate(grid):
        down = sorted(x for x in down if x[2] > r)
        line, c, k = [], 0, 0
        for y in row:
            while k < len(down) and down[k][0] <= c:
                c, k = max(c, down[k][1]), k + 1
            wide, high = span(y, "colspan", SPANS[0]), span(y, "rowspan", SPANS[1])
            line.append((c, wide, render(y)))
            if high > 1:
                down.append((c, c + wide, r + high))
            c += wide
        cells.append(line)
    if wrap is None:
        start = columns_of(cells, None)
        blanks = sum(max((start[c] for c, _, text in line if i < len(text) and text[i]), default=0) for line in cells for i in range(max((len(text) for _, _, text in line), default=0)))
        wrap = PAD if blanks > 65536 + BLANKS * sum(len(x) for line in cells for _, _, text in line for x in text) else None
    if wrap is not None:
        end = max((c for line in cells for c, _, text in line if text), default=0)
        cells = [[(c, wide, wrapped(text, wrap) if c + wide - 1 < end else text) for c, wide, text in line] for line in cells]
        start = columns_of(cells, wrap)
    for line in cells:
        for i in range(max((len(text) for _, _, text in line), default=0)):
            s = ""
            for c, _, text in line:
                if i < len(text) and text[i]:
                    s = (s + "  " if len(s) + 2 > start[c] and s else s.ljust(start[c])) + text[i]
            out.append(s.rstrip())
    return out


def columns_of(cells: list[list[tuple[int, int, list[str]]]], most: int | None) -> dict[int, int]:
    """Where each column starts: columns are as wide as their cells' lines, those beyond ``most`` left out."""
    width = dict.fromkeys((k for line in cells for c, wide, _ in line for k in (c, c + wide - 1)), 0)
    size = lambda text: max((len(x) for x in text if most is None or len(x) <= most), default=0)
    for line in cells:
        for c, wide, text in line:
            if wide == 1:
                width[c] = max(width[c], size(text))
    columns = sorted(width)
    at = {c: k for k, c in enumerate(columns)}
    for line in cells:
        for c, wide, text in line:
            if wide > 1:
                over = columns[at[c] : at[c + wide - 1] + 1]
                have = sum(width[k] + 2 for k in over if width[k]) - 2
                width[over[-1]] += max(0, size(text) - max(0, have) - 2 * (have > 0 and not width[over[-1]]))
    start, x = {}, 0
    for c in columns:
        start[c], x = x, x + (width[c] + 2 if width[c] else 0)
    return start


def laid_out(root: Node, wrap: int | None = None) -> list[str]:
    """Lines of a page: its tables first, the innermost of them foremost."""
    stack, tables = [root], []
    while stack:
        x = stack.pop()
        if x.tag == "table" and x is not root:
            tables.append(x)
        stack += [y for y in x.kids if isinstance(y, Node)]
    for x in reversed(tables):
        x.lines = rows_of(x, wrap)
    return render(root)


def text_of(html: str | None, wrap: int | None = None) -> str:
    root, sheet = parse(html or "")
    sheets.apply(root, sheet)
    return "" if root.none else "\n".join(laid_out(root, wrap))


def visible_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", wrap: int | None = None) -> DataFrame:
    """A row a page: page_id, text, n_lines."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [text_of(x, wrap) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(x.split("\n")) if x else 0 for x in texts], pa.int64())], ["page_id", "text", "n_lines"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, text string, n_lines long")


def query(spark, sf_dir: str) -> DataFrame:
    return visible_text(table(spark, sf_dir, "pages"))
