"""Layout-aware text of HTML pages: a tree with implied tags, visibility, then blocks, lists and aligned tables.

All visible text comes out once, in document order. Paragraph-like blocks are set apart by an empty line, other
blocks by a line end; list items have a bullet or number and the indent of their depth; cells start in their column, whatever
rows and columns they and their neighbours span, and have their own lines, blocks, lists and tables inside them. Each page is
parsed in one pass, and tables are laid out from the innermost out, by explicit stacks, so that neither its
length nor its depth matters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist rp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure form fieldset".split())
BLOCK = frozenset("""address article aside body caption center dd details dialog dir div dt fieldset figcaption footer header hgroup hr html legend
li main menu nav option search section summary tr tbody thead tfoot""".split()) | SPACED
HEAD = frozenset("html head title meta link base script style noscript template".split())
LISTS = frozenset("ul ol menu dir".split())
#: A start tag, the open elements that it ends, and the elements beyond which it ends none.
IMPLIED = {t: (("p",), ("table", "td", "th", "button")) for t in BLOCK - {"html", "body", "tr", "tbody", "thead", "tfoot", "caption", "option", "li", "dd", "dt"}}
IMPLIED |= {
    "li": (("li", "p"), ("ul", "ol", "menu", "dir", "table", "td", "th")), "dd": (("dd", "dt", "p"), ("dl", "table", "td", "th")),
    "dt": (("dd", "dt", "p"), ("dl", "table", "td", "th")), "option": (("option",), ("select",)), "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th", "caption"), ("table", "tr")), "th": (("td", "th", "caption"), ("table", "tr")), "body": (("head",), ()),
} | {t: (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)) for t in ("tbody", "thead", "tfoot")}
#: An end tag ends nothing outside the nearest of these.
HELD = {"table": (), "td": ("table",), "th": ("table",), "tr": ("table",)}
#: A quote opens a value right after an equals sign only; elsewhere it is a character like any other.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)>?|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
#: Cells are wrapped at spaces to lines of this width; a longer word widens its column, and is cut into lines from LONG_WORD on.
WRAP, LONG_WORD = 100, 1000
#: Fixed limits of HTML: columns and rows that a cell may span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class Node:
    """seen: displayed at all. shown: its own text is visible, which elements inside may turn on or off again."""

    __slots__ = ("tag", "attrs", "children", "seen", "shown", "lines")

    def __init__(self, tag: str, attrs: dict[str, str], seen: bool, shown: bool = True) -> None:
        self.tag, self.attrs, self.children, self.seen, self.shown, self.lines = tag, attrs, [], seen, shown, []


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(source)} if source.strip(" /\n\t") else {}


def _visible(tag: str, attrs: dict[str, str]) -> bool:
    return not (tag in UNSEEN or (tag == "dialog" and "open" not in attrs) or "hidden" in attrs or _NONE.search(attrs.get("style", "")))


def parse(html: str) -> Node:
    """The tree of a page. Unknown ends are ignored, open elements end where HTML implies it."""
    root = Node("#root", {}, True)
    stack, places = [root], {}

    def close(to: int) -> None:
        while len(stack) > to:
            places[stack.pop().tag].pop()

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        name = m[2]
        if not name:
            if m[0][0] != "<" or m[0] == "<":
                stack[-1].children.append(unescape(m[0]))
            continue
        name = name.lower()
        if m[1]:
            if (k := last((name,))) > last(HELD.get(name, ("table", "td", "th"))) or (name == "table" and k):
                close(k)
            continue
        ended, bound = IMPLIED.get(name, ((), ()))
        limit = last(bound)
        if inner := [places[t][-1] for t in ended if places.get(t) and places[t][-1] > limit]:
            close(min(inner))
        if name not in HEAD and places.get("head"):
            close(places["head"][-1])  # content that a head can't hold begins the body
        attrs = _attributes(m[3])
        own = _VISIBILITY.findall(attrs.get("style", ""))
        node = Node(name, attrs, _visible(name, attrs), own[-1].lower() == "visible" if own else stack[-1].shown)
        stack[-1].children.append(node)
        if name in RAW:
            close_tag = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            body = html[at : close_tag.start()] if close_tag else html[at:]
            node.children.append(unescape(body) if name in ("textarea", "title") else body)
            at = close_tag.end() if close_tag else end
        elif name not in VOID:
            places.setdefault(name, []).append(len(stack))
            stack.append(node)
    return root


class Lines:
    """Text as it is laid out: runs of white space are one space, line ends that are due come before the next text."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.due, self.space, self.lead = 0, False, ""

    def block(self, lines: int) -> None:
        self.due, self.space = max(self.due, lines), False

    def add(self, text: str, kept: bool = False) -> None:
        if kept:
            self._put(text)
            return
        if parts := text.split():
            self.space = self.space or text[0].isspace()
            self._put((" " if self.space and not self.due and self.out and not self.out[-1].endswith("\n") else "") + " ".join(parts))
            self.space = text[-1].isspace()
        elif text:
            self.space = True

    def _put(self, text: str) -> None:
        if self.due and self.out:
            while self.out and self.out[-1] == "\n":  # a line end before a block is the block's own
                self.out.pop()
            self.out.append("\n" * self.due)
        self.out.append(self.lead + text.lstrip(" ") if self.lead else text)
        self.due, self.lead = 0, ""

    def text(self) -> str:
        return "".join(self.out).strip("\n")


def _number(text: str, default: int) -> int:
    return int(text) if re.fullmatch(r"-?\d{1,6}", text.strip()) else default


def _wrapped(line: str) -> list[str]:
    """A line cut at spaces into lines of WRAP characters or fewer, but for longer words."""
    if len(line) <= WRAP:
        return [line]
    out, now = [], ""
    for word in line.split(" "):
        if now and len(now) + 1 + len(word) > WRAP:
            out.append(now)
            now = word
        else:
            now = f"{now} {word}" if now or out else word
        while len(now) > LONG_WORD:
            out.append(now[:LONG_WORD])
            now = now[LONG_WORD:]
    return [*out, now]


def _cells(table: Node) -> tuple[list[str], list[list[tuple[int, int, Node]]]]:
    """The table's own text outside of cells, and its rows of (column, columns spanned, cell), placed as HTML's table model does."""
    rows, loose, todo, held = [], [], [table], {}
    while todo:
        x = todo.pop()
        if x is None:  # the end of a row group, beyond which no cell spans
            held = {}
        elif isinstance(x, str):
            loose.append(x)
        elif not x.seen:
            continue
        elif x.tag in ("tr", "td", "th"):
            row, at = [], 0
            for c in x.children if x.tag == "tr" else [x]:
                if isinstance(c, str):
                    loose.append(c if x.shown else "")
                elif c.tag not in ("td", "th"):
                    loose.append(" ".join(["", *layout(c), ""]))
                elif c.seen:
                    while held.get(at):
                        at += 1
                    wide = min(max(1, _number(c.attrs.get("colspan", ""), 1)), MOST_COLUMNS)
                    deep = _number(c.attrs.get("rowspan", ""), 1)
                    deep = min(deep, MOST_ROWS) if deep > 0 else MOST_ROWS if deep == 0 else 1
                    for i in range(at, at + wide):  # a cell may span one that comes down from above
                        held[i] = max(deep, held.get(i, 0))
                    row.append((at, wide, c))
                    at += wide
            held = {i: n - 1 for i, n in held.items() if n > 1}
            rows.append(row)
        elif x.tag in ("table", "tbody", "thead", "tfoot", "colgroup") and (x is table or x.tag != "table"):
            if x.tag != "table":
                held = {}
                todo.append(None)
            todo += [c for c in reversed(x.children) if x.shown or not isinstance(c, str)]
        else:
            loose.append(" ".join(["", *layout(x), ""]))
    return loose, rows


def table_lines(table: Node) -> list[str]:
    """The lines of a table, its own text outside of cells first. A cell's lines begin in its column; a row without text is left out."""
    loose, rows = _cells(table)
    laid = [[(at, wide, [part for line in layout(c) for part in _wrapped(line)]) for at, wide, c in row] for row in rows]
    width: dict[int, int] = {}
    for row in laid:
        for at, wide, lines in row:
            for i in range(at, at + wide):
                width.setdefault(i, 0)
            if wide == 1:
                width[at] = max(width[at], max(map(len, lines), default=0))
    for at, wide, lines in sorted((c for row in laid for c in row if c[1] > 1), key=lambda c: c[1]):
        width[at + wide - 1] += max(0, max(map(len, lines), default=0) - sum(width[i] for i in range(at, at + wide)))
    starts, total = {}, 0
    for i in range(max(width, default=-1) + 1):
        starts[i] = total
        total += width.get(i, 0) + 2
    first = " ".join("".join(loose).split())
    out = [first] if first else []
    for row in laid:
        if not any(any(lines) for _, _, lines in row):
            continue
        for i in range(max(len(lines) for _, _, lines in row)):
            line = ""
            for at, _, lines in row:
                if i < len(lines) and lines[i]:
                    line = line.ljust(starts[at]) + lines[i]
            out.append(line)
    return out


def layout(top: Node) -> list[str]:
    """The lines of what is inside an element; tables inside it have been laid out before."""
    lines, todo, lists, pre = Lines(), [(top, False)], [], 0
    while todo:
        x, done = todo.pop()
        if isinstance(x, str):
            lines.add(x, kept=pre > 0)
            continue
        if not x.seen:
            continue
        gap = 2 if x.tag in SPACED and not (x.tag in LISTS and lists and (not done or len(lists) > 1)) else 1
        if done:
            lines.block(gap)
            if x.tag in LISTS:
                lists.pop()
            pre -= x.tag == "pre"
            continue
        if x.tag == "br":
            lines.add("\n", kept=True) if lines.out and not lines.due else None
            lines.space = False
        elif x.tag == "table":
            lines.block(2)
            for line in x.lines:
                lines.add(line, kept=True) if line else None
                lines.block(1 if line else 2)
            lines.block(2)
        else:
            if x.tag in BLOCK:
                lines.block(gap)
                todo.append((x, True))
            if x.tag in ("td", "th"):
                lines.add(" ")
            if x.tag in LISTS:
                items = sum(not isinstance(c, str) and c.tag == "li" and c.seen for c in x.children)
                back = "reversed" in x.attrs and x.tag == "ol"
                lists.append([x.tag, _number(x.attrs.get("start", ""), items if back else 1), -1 if back else 1])
            elif x.tag == "li":
                kind = lists[-1] if lists else ["ul", 1, 1]
                kind[1] = _number(x.attrs.get("value", ""), kind[1])
                if x.shown:
                    lines.lead = "  " * max(0, len(lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- ")
                kind[1] += kind[2]
            pre += x.tag == "pre"
            todo += [(c, False) for c in reversed(x.children) if x.shown or not isinstance(c, str)]
    return "\n".join(line.rstrip() for line in lines.text().split("\n")).strip("\n").split("\n")


def render(root: Node) -> str:
    tables, todo = [], [root]
    while todo:
        x = todo.pop()
        if not isinstance(x, str) and x.seen:
            if x.tag == "table":
                tables.append(x)
            todo += reversed(x.children)
    for t in reversed(tables):  # those inside others come later in the page
        t.lines = table_lines(t)
    return "\n".join(layout(root)).strip("\n")


def html_to_text(html: str | None) -> str:
    return render(parse(html or ""))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text of every row. A null or empty page has an empty text; anything that isn't well-formed is read
    as far as tags can be told. Repeated rows and null ids stay, other columns aren't read, an empty table gives
    an empty result. A map over rows: no shuffle."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([html_to_text(h.as_py()) for h in b.column(1)], pa.string())], ["page_id", "text"])

    return pages.select(F.col(id_col), F.col(html_col)).mapInArrow(run, f"page_id {kind}, text string")
