"""Visible text of HTML pages, laid out.

Each page is cut into tags and text by one pattern, built into a tree with the
implied end tags of HTML (a new ``li``, ``p``, ``tr``, ``td``, ``option``, ...
closes the open one; void elements never open), and rendered: hidden parts are
left out, blocks stand on lines of their own, paragraphs and headings keep a
blank line between them, list items get a bullet or number and their depth's
indent, ``pre`` keeps its white space, and the cells of a table are padded to
columns, over which cells may span (column widths count up to ``PADDED``
characters, spans up to ``SPANNED`` columns or grid cells in all, tables and lists inside each
other up to ``DEEP``; beyond, text is kept but no longer aligned or indented).  All visible text is kept, navigation and footers too.

Spark spreads the pages; a page is rendered by itself, without recursion.
Where the open elements of a name are is kept beside the stack, so tag soup
takes time proportional to its length.

Visibility is inherited, lists begin at ``start`` and go on from ``value``, the texts
of input buttons are shown, a line feed right behind ``pre`` is not, and a stray
end of a paragraph makes an empty one.

Defined cases: null or empty HTML gives empty text; unclosed comments, tags and
raw-text elements run to the end, a quote that is never closed is a character
like others; other stray end tags are ignored; rows that repeat a
page_id each give a row; other columns are ignored.  An open head ends at the
first tag or text that may not stand in it.  All options of a select are kept.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes canvas audio video object datalist title".split())
UNSEEN_SVG = frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split())
#: what may stand in head; another start tag, or text, closes it
IN_HEAD = frozenset("head base basefont bgsound link meta title style script noscript noframes template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
ENDS_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption li dd dt legend summary figcaption option optgroup".split()) | {"li", "dd", "dt"}
# a start tag of the key closes an open element of the values, up to the nearest of the last set
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}

#: what shields an open paragraph from an end tag
P_SCOPE = {"table", "td", "th", "button", "object"}
#: a line feed right behind these start tags is not text
KEEPS_LINES = frozenset("pre textarea listing".split())
#: inputs whose value is the text of a button
BUTTONS = frozenset("submit button reset".split())

#: widest column that cells are padded to, and most columns (and grid cells beside a page's own) that spans may add
PADDED, SPANNED = 120, 1000
DEEP = 24

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*)))?")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SPACE = re.compile(r"[ \t\n\r\f]+")


def attributes(raw: str) -> dict[str, str]:
    """Names (lower case) and values; the first of a name counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def shown(raw: str, inherited: bool) -> bool | None:
    """Whether the text of an element with these attributes is on the screen; None if nothing inside it can be.

    Visibility is inherited and may be turned on again inside; ``hidden`` and
    ``display: none`` take the whole subtree away.
    """
    found = attributes(raw)
    if "hidden" in found:
        return None
    style = {}
    for rule in COMMENT.sub("", found.get("style", "")).lower().split(";"):
        name, _, value = rule.partition(":")
        style[name.strip()] = value.partition("!")[0].strip()
    if style.get("display") == "none":
        return None
    return {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(style.get("visibility", ""), inherited)


def whole_number(text: str | None) -> int | None:
    """The number that an attribute begins with."""
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return int(m[1]) if m else None


SCRIPT = re.compile(r"<!--(?:-?>)?|-->|<(/?)script(?=[\s/>])", re.I)


def script_end(page: str, at: int) -> tuple[int, int]:
    """Where the text of a script that begins at ``at`` ends, and its end tag: inside a comment, a script tag shields the next end tag."""
    state = 0  # outside a comment, inside one, inside one behind a script tag
    for m in SCRIPT.finditer(page, at):
        if m[0].startswith("<!"):
            state = state if m[0].endswith(">") else max(state, 1)
        elif m[0] == "-->":
            state = 0
        elif not m[1]:
            state = 2 if state else 0
        elif state == 2:
            state = 1
        else:
            end = page.find(">", m.end())
            return m.start(), end + 1 if end >= 0 else len(page)
    return len(page), len(page)


class Node:
    """An element: its name, attributes and children (elements and strings)."""

    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.attributes, self.children = name, attributes, []


def build(page: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    stack = [root]
    places: dict[str, list[int]] = {}  # of the open elements of each name
    at, n = 0, len(page)
    svg, svg_at = None, 0  # the outermost open svg and its place

    def cut(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().name].pop()

    def last(names: set[str]) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def add(text: str) -> None:
        if stack[-1].name == "head" and text.strip():
            cut(len(stack) - 1)
        stack[-1].children.append(text)

    def close(names: set[str], stop: set[str]) -> bool:
        """End the innermost open element of ``names`` that no element of ``stop`` shields; whether there is one."""
        if found := (i := last(names)) > last(stop):
            cut(i)
        return found

    def close_all(names: set[str], stop: set[str]) -> None:
        """End the outermost such element."""
        above = last(stop)
        if found := [x[k] for x in map(places.get, names) if x and (k := bisect_right(x, above)) < len(x)]:
            cut(min(found))

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in VOID:
                if name == "br":
                    stack[-1].children.append(Node("br"))
                continue
            stop = {"table"} if name not in ("table", "body", "html") else set()
            if not close({name}, stop | P_SCOPE if name == "p" else stop) and name == "p":
                stack[-1].children.append(Node("p"))  # an empty paragraph
            continue
        if stack[-1].name == "head" and name not in IN_HEAD:
            cut(len(stack) - 1)
        if name in ENDS_P:
            close({"p"}, P_SCOPE)
        if name in IMPLIED:
            close_all(*IMPLIED[name])
        in_svg = svg is not None and svg_at < len(stack) and stack[svg_at] is svg
        node = Node(name, "hidden" if in_svg and name in UNSEEN_SVG else m[3])
        stack[-1].children.append(node)
        if name in VOID or m[3].endswith("/") and (in_svg or name in ("svg", "path")):
            continue
        if name == "svg" and not in_svg:
            svg, svg_at = node, len(stack)
        if name in KEEPS_LINES and page.startswith(("\n", "\r\n"), at):
            at = page.index("\n", at) + 1
        if name == "script":
            stop_at, after = script_end(page, at)
            node.children.append(page[at:stop_at])
            at = after
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        places.setdefault(name, []).append(len(stack))
        stack.append(node)
    return root


class Lines:
    """Rendered lines: words of a line are collected, blank lines between blocks are not doubled."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False
        self.lead = ""

    def text(self, raw: str, pre: bool) -> None:
        raw = html.unescape(raw) if "&" in raw else raw
        if pre:
            first, *rest = raw.split("\n")
            self.line.append(first)
            for x in rest:
                self.end(True)
                self.line.append(x)
        else:
            self.line.append(SPACE.sub(" ", raw))

    def end(self, pre: bool = False) -> None:
        text = "".join(self.line)
        text = text.rstrip() if pre else re.sub(r" {2,}", " ", text).strip(" ")
        self.line = []
        if text or pre:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(self.lead + text)
            self.lead = " " * len(self.lead)

    def space(self) -> None:
        self.end()
        self.gap = True


def render(root: Node) -> str:
    """The visible text of a tree."""
    out = Lines()
    # work: (element or text, or None with what to do at an element's end), state is kept beside it
    work: list = [(c, False, 0, True) for c in reversed(root.children)]
    counters: list[list] = []
    tables: list[list] = []
    while work:
        node, pre, depth, seen = work.pop()
        if isinstance(node, str):
            if seen:
                out.text(node, pre)
            continue
        if isinstance(node, tuple):
            _leave(node[0], out, counters, tables, depth)
            if tables and tables[-1][0] == "cell done":
                out = tables.pop()[1]
            elif tables and tables[-1][0] == "table done":
                out = tables.pop()[1]
            continue
        name = node.name
        if name in UNSEEN:
            continue
        if node.attributes and (seen := shown(node.attributes, seen)) is None:
            continue
        if name == "br":
            out.end(True) if pre else _break(out)
            continue
        if name in VOID:
            if name == "hr":
                out.space()
            elif name == "input" and seen:
                found = attributes(node.attributes)
                if found.get("type", "").strip().lower() in BUTTONS:
                    out.text(html.escape(f" {found.get('value', '')} "), False)
            continue
        if name in BLOCKS:
            out.space() if name in SPACED and depth == 0 else out.end()
        if name == "table" and len(tables) < 2 * DEEP:
            tables.append(["table", out, [], node])
            out = Lines()
        elif name == "tr" and tables and tables[-1][0] == "table":
            tables[-1][2].append([])
        elif name in ("td", "th") and tables and tables[-1][0] == "table":
            if not tables[-1][2]:
                tables[-1][2].append([])
            tables.append(["cell", out, node])
            out = Lines()
        elif name in ("ul", "ol"):
            first = whole_number(attributes(node.attributes).get("start")) if name == "ol" and node.attributes else None
            counters.append([name, (1 if first is None else first) - 1])
            depth += 1
        elif name == "li":
            mark = "- "
            if counters:
                told = whole_number(attributes(node.attributes).get("value")) if node.attributes else None
                counters[-1][1] = counters[-1][1] + 1 if told is None else told
                mark = f"{counters[-1][1]}. " if counters[-1][0] == "ol" else "- "
            out.end()
            out.lead = "  " * min(DEEP, max(0, len(counters) - 1)) + (mark if seen else "")
        work.append(((node,), pre, depth, seen))
        pre = pre or name in ("pre", "textarea")
        work += [(c, pre, depth, seen) for c in reversed(node.children) if name not in ("svg", "g") or not isinstance(c, str)]  # svg shows the text of its text elements
    out.end()
    return "\n".join(out.lines).strip("\n")


def _break(out: Lines) -> None:
    lead = out.lead
    out.end()
    out.lead = out.lead or lead


def _leave(node: Node, out: Lines, counters: list, tables: list, depth: int) -> None:
    name = node.name
    if name in ("td", "th") and tables and tables[-1][0] == "cell" and tables[-1][2] is node:
        out.end()
        outer = tables.pop()[1]
        tables[-1][2][-1].append((out.lines, *spans(node.attributes)))
        tables.append(["cell done", outer])
        return
    if name == "table" and tables and tables[-1][0] == "table" and tables[-1][3] is node:
        out.end()
        _, outer, rows, _ = tables.pop()
        for line in out.lines:  # a caption or text between the cells
            outer.line.append(line)
            outer.end()
        for line in aligned(rows):
            outer.line.append(line)
            outer.end(True)
        outer.gap = True
        tables.append(["table done", outer])
        return
    if name in BLOCKS:
        out.end(name == "pre" and any(out.line))
    if name == "li":
        out.lead = ""
    if name in ("ul", "ol") and counters:
        counters.pop()
    if name in SPACED and not counters:
        out.gap = True


def spans(raw: str) -> tuple[int, int]:
    """Columns and rows that a cell spans (0 rows: all that follow)."""
    found = attributes(raw) if "span" in raw.lower() else {}
    number = lambda k: int(m[0]) if (m := re.match(r"\d{1,5}", found.get(k, "1").strip())) else 1
    return max(1, number("colspan")), number("rowspan")


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> Iterator[str]:
    """Rows of cells (lines, columns, rows) as lines, columns padded to the widest cell."""
    grid: list[list[tuple[int, int, list[str]]]] = []  # of each row: (column, columns, lines) in their order
    below: dict[int, tuple[int, int]] = {}  # column: (columns, last row) of a cell that reaches down
    budget = SPANNED + 10 * sum(map(len, rows))
    for r, row in enumerate(rows):
        below = {c: x for c, x in below.items() if x[1] >= r}
        taken = sorted(below.items()) if budget > 0 else []
        budget -= len(taken)
        line, column, extra = [], 0, SPANNED
        for lines, wide, tall in row:
            while taken and taken[0][0] <= column:
                c, (k, _) = taken.pop(0)
                line.append((c, k, []))
                column = c + k
            wide = min(wide, 1 + extra)
            if taken:
                wide = min(wide, taken[0][0] - column)
            extra -= wide - 1
            line.append((column, wide, lines))
            if tall != 1:
                below[column] = (wide, r + tall - 1 if tall else len(rows))
            column += wide
        grid.append(line)
    widths = [0] * max((c + k for line in grid for c, k, _ in line), default=0)
    need = lambda lines: min(PADDED, max(map(len, lines), default=0))
    for several in (False, True):
        for line in grid:
            for c, k, lines in line:
                if (k > 1) == several:
                    widths[c + k - 1] += max(0, need(lines) - sum(widths[c : c + k]) - 3 * (k - 1))
    for line in grid:
        for i in range(max((len(lines) for _, _, lines in line), default=0)):
            yield " | ".join((lines[i] if i < len(lines) else "").ljust(sum(widths[c : c + k]) + 3 * (k - 1)) for c, k, lines in line).rstrip()


def visible_text(page: str | None) -> str:
    return render(build(page)) if page else ""


def extract(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """(page_id, text) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [visible_text(h) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    return pages.select(F.col(id_column).cast("long").alias(id_column), F.col("html").cast("string").alias("html")).mapInArrow(run, f"{id_column} long, text string")
