"""Layout-aware rendering of HTML to text: a tree builder with implied tags, visibility rules, a renderer.

The builder reads tags, text and raw elements in one pass and closes elements that HTML ends implicitly
(paragraphs, list items, table parts, options). A second pass takes out what can't be seen: scripts, styles,
head, comments, ``hidden``, ``display:none`` and ``visibility``, inherited and taken back, from style
attributes and from a page's own style rules with simple selectors, and closed ``details``. The renderer
walks the tree: blocks are set apart by line breaks (paragraphs and headings by a blank line), lists get
bullets or numbers and indents, tables are laid out in columns with row and column spans, ``pre`` keeps its
white space, other white space collapses. Everything visible is emitted, navigation and footers included.

Layout never makes much of little: cells wider than CELL_WIDTH stand out of their column instead of widening
it, tables wider than TABLE_WIDTH have two spaces between cells, and lists, quotes and tables nested deeper
than LEVELS are plain blocks. All text stays.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL_WIDTH, TABLE_WIDTH, LEVELS = 60, 400, 40
# The most columns and rows that the HTML standard lets a cell span.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534
DEPTH = 1 << 20  # the interpreter's recursion limit while a page is rendered; pages are bounded by their length

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title datalist object audio video canvas annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
CLOSES_P = BLOCK - frozenset("body html dd dt li option optgroup summary legend figcaption".split()) | {"dd", "dt", "li"}
# What a start tag ends: the elements that close, and the elements that the search for them stops at.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
    "select": ({"select"}, {"table"}),
    "input": ({"select"}, {"table"}),
    "textarea": ({"select"}, {"table"}),
}
FORMATTING = frozenset("a abbr b big cite code em font i label q s small span strike strong sub sup tt u".split())
ENDS = BLOCK | frozenset("thead tbody tfoot tr td th caption".split())
P_SCOPE = frozenset("table td th caption button object html body".split())
SECTIONS = frozenset("thead tbody tfoot".split())
DRAWN_LATER = frozenset("defs symbol clippath mask pattern marker desc metadata title style script".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())

_TOKEN = re.compile(r"<!--(?:.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*))>?", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
_AT_RULE = re.compile(r"@[^{};]*(?:;|\{(?:[^{}]|\{[^{}]*\})*\})")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SIMPLE = re.compile(r"([A-Za-z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_WHITE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def visible(self) -> bool:
        return self.tag not in HIDDEN and "hidden" not in self.attrs and not (self.tag == "dialog" and "open" not in self.attrs)


def _declared(style: str) -> tuple[str | None, str | None]:
    """The last ``display`` and ``visibility`` of some declarations."""
    display, visibility = _DISPLAY.findall(style), _VISIBILITY.findall(style)
    return display[-1].lower() if display else None, visibility[-1].lower() if visibility else None


class Rules:
    """Style rules that show or hide, by simple selectors: a tag, classes and an id. Rules under conditions (``@media``) are left out."""

    def __init__(self, sheets: list[str]) -> None:
        self.by: dict[str, list[tuple]] = {}
        for sheet in sheets:
            for selectors, body in _RULE.findall(_AT_RULE.sub("", _COMMENT.sub("", sheet))):
                display, visibility = _declared(body)
                if display or visibility:
                    for selector in selectors.split(","):
                        self._add(selector.strip(), display, visibility)

    def _add(self, selector: str, display: str | None, visibility: str | None) -> None:
        m = _SIMPLE.fullmatch(selector)
        if not m or not selector:
            return
        tag = "" if m[1] in (None, "*") else m[1].lower()
        marks = re.findall(r"[.#][\w-]+", m[2])
        weight = (sum(x[0] == "#" for x in marks), sum(x[0] == "." for x in marks), bool(tag), len(self.by))
        self.by.setdefault(marks[0] if marks else tag, []).append((weight, tag, frozenset(marks), display, visibility))

    def of(self, node: Node) -> tuple[str | None, str | None]:
        marks = {"." + c for c in node.attrs.get("class", "").split()}
        if "id" in node.attrs:
            marks.add("#" + node.attrs["id"])
        fits = [r for k in (*marks, node.tag, "") for r in self.by.get(k, ()) if r[1] in ("", node.tag) and r[2] <= marks]
        display = visibility = None
        for _, _, _, d, v in sorted(fits, key=lambda r: r[0]):
            display, visibility = d or display, v or visibility
        return display, visibility


def take_out_hidden(root: Node, sheets: list[str]) -> None:
    """Leave only what can be seen: elements that aren't displayed go whole, invisible ones lose their own text."""
    rules = Rules(sheets)
    todo = [(root, True)]
    while todo:
        node, shown = todo.pop()
        kept: list = []
        for c in node.children:
            if isinstance(c, str):
                if shown:
                    kept.append(c)
                continue
            if not c.visible():
                continue
            display, visibility = _declared(c.attrs["style"]) if "style" in c.attrs else (None, None)
            if rules.by and not (display and visibility):
                d, v = rules.of(c)
                display, visibility = display or d, visibility or v
            if display == "none":
                continue
            seen = visibility not in ("hidden", "collapse") if visibility in ("hidden", "collapse", "visible") else shown
            if seen or c.tag not in ("img", "input"):
                kept.append(c)
                todo.append((c, seen))
        node.children = kept


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(html: str) -> Node:
    """The tree of what can be seen. Anything is accepted: stray end tags are ignored, open elements end with the text."""
    root = Node("html")
    stack, is_open = [root], Counter()  # how many of a tag are open, so that a search for none is none
    sheets: list[str] = []

    def push(node: Node) -> None:
        stack.append(node)
        is_open[node.tag] += 1

    def cut(i: int) -> None:
        is_open.subtract(n.tag for n in stack[i:])
        del stack[i:]

    def close(tags: frozenset[str], stop: frozenset[str]) -> None:
        i = len(stack) - 1
        while i > 0 and any(is_open[t] for t in tags) and stack[i].tag not in stop:
            if stack[i].tag in tags:
                cut(i)
            i -= 1

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            stack[-1].children.append(unescape(html[at:]))
            break
        if m.start() > at:
            text = unescape(html[at : m.start()])
            if stack[-1].tag in ("head", "colgroup") and not text.isspace():
                cut(len(stack) - 1)
            stack[-1].children.append(text)
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "form" and (stack[-1].tag in SECTIONS or stack[-1].tag in ("table", "tr")):
                continue
            # A formatting element's end tag never ends a block that was opened inside it.
            at_tag = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag or (tag in FORMATTING and stack[i].tag in ENDS)), 0) if is_open[tag] else 0
            if at_tag and stack[at_tag].tag == tag:
                cut(at_tag)
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            continue
        if tag == "html":
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY and tag != "head":
            cut(len(stack) - 1)
        if stack[-1].tag == "colgroup" and tag not in ("col", "template"):
            cut(len(stack) - 1)
        if tag in CLOSES_P:
            close(frozenset({"p"}), P_SCOPE)
        if tag in IMPLIED:
            close(*map(frozenset, IMPLIED[tag]))
        if tag in ("td", "th") and (stack[-1].tag == "table" or stack[-1].tag in SECTIONS):
            row = Node("tr")
            stack[-1].children.append(row)
            push(row)
        node = Node(tag, _attributes(m[3]) if m[3] and not m[3].isspace() else None)
        stack[-1].children.append(node)
        # A form between the parts of a table holds nothing: the rows stay the table's.
        if tag in VOID or (tag == "form" and (stack[-1].tag in SECTIONS or stack[-1].tag in ("table", "tr"))):
            continue
        if tag in RAW or tag in RCDATA:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            body = html[at : end.start() if end else size]
            node.children.append(unescape(body) if tag in RCDATA else body)
            if tag == "style":
                sheets.append(body)
            at = end.start() if end else size
            at = (html.find(">", at) + 1 or size) if end else size
            continue
        push(node)
    take_out_hidden(root, sheets)
    return root


class _Text:
    """Lines under construction: inline text collects until a break; blank lines never double."""

    def __init__(self, level: int = 0) -> None:
        self.level = level  # lists, quotes and tables around
        self.lines: list[str] = []
        self.now: list[str] = []

    def inline(self, text: str) -> None:
        text = _WHITE.sub(" ", text)
        if text.startswith(" ") and (not self.now or self.now[-1].endswith((" ", "\n"))):
            text = text[1:]
        if text:
            self.now.append(text)

    def br(self) -> None:
        self.now.append("\n")

    def flush(self) -> None:
        if self.now:
            text = "".join(self.now)
            self.now = []
            if text.strip(" \n"):
                self.lines += [x.strip(" ") for x in text.strip("\n").split("\n")]

    def blank(self) -> None:
        self.flush()
        if self.lines and self.lines[-1]:
            self.lines.append("")

    def done(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _rows(table: Node) -> Iterator[Node]:
    for part in table.children:
        if isinstance(part, Node):
            if part.tag == "tr":
                yield part
            elif part.tag in SECTIONS:
                yield from (r for r in part.children if isinstance(r, Node) and r.tag == "tr")


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attrs.get(name, "1")
    return min(int(value[:6]), most) if value.isascii() and value.isdigit() and int(value[:6]) else 1


def _placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, int, list[str]]]]:
    """(column, span, lines) of every cell: a cell goes right of those that reach down from rows above.

    Cells that reach down side by side, none shorter than the one to its left, are one run of columns: it is passed in one step,
    and loses its first cells as they end.
    """
    out: list = []
    runs: list[tuple[deque, list[int]]] = []  # cells (column, row where it has ended), and the column after the last
    for r, cells in enumerate(rows):
        at, k, now = 0, 0, []
        for lines, wide, high in cells:
            while k < len(runs):
                held, after = runs[k]
                while held and held[0][1] <= r:
                    held.popleft()
                if not held:
                    del runs[k]
                elif held[0][0] <= at:
                    at, k = max(at, after[0]), k + 1
                else:
                    break
            now.append((at, wide, lines))
            end = min(r + high, len(rows))
            if end > r + 1:
                if k and runs[k - 1][1][0] == at and runs[k - 1][0][-1][1] <= end:
                    runs[k - 1][0].append((at, end))
                    runs[k - 1][1][0] = at + wide
                else:
                    runs.insert(k, (deque([(at, end)]), [at + wide]))
                    k += 1
            at += wide
        out.append(now)
    return out


def _table(node: Node, out: _Text) -> None:
    """Cells of a column start at the same place; a cell with several lines takes as many lines."""
    for c in node.children:
        if isinstance(c, Node) and c.tag in SECTIONS:
            _into([x for x in c.children if not (isinstance(x, Node) and x.tag == "tr")], out)
        elif not (isinstance(c, Node) and c.tag == "tr"):
            _into([c], out)
    out.flush()
    rows = []
    for row in _rows(node):
        cells = [(_lines(c.children, out.level + 1), _span(c, "colspan", MOST_COLUMNS), _span(c, "rowspan", MOST_ROWS)) for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")]
        loose = _lines([c for c in row.children if not (isinstance(c, Node) and c.tag in ("td", "th"))], out.level + 1)
        if loose:
            out.lines += loose
        if cells:
            rows.append(cells)
    grid = _placed(rows)
    # Columns that a cell starts in, each as wide as the widest of its own cells that isn't too wide.
    widths: dict[int, int] = {}
    for cells in grid:
        for at, span, lines in cells:
            own = max(map(len, lines), default=0) if span == 1 else 0
            widths[at] = max(widths.get(at, 0), own if own <= CELL_WIDTH else 0)
    starts, x = {}, 0
    for c in sorted(widths):
        starts[c], x = x, x + widths[c] + 2
    aligned = x <= TABLE_WIDTH
    for cells in grid:
        for i in range(max(len(lines) for _, _, lines in cells)):
            text = ""
            for at, _, lines in cells:
                part = lines[i] if i < len(lines) else ""
                if aligned:
                    text = text.ljust(starts[at]) if not text or len(text) + 2 <= starts[at] else text + "  "
                elif text:
                    text += "  "
                text += part
            out.lines.append(text.rstrip(" "))


def _lines(children: list, level: int) -> list[str]:
    out = _Text(level)
    _into(children, out)
    return out.done()


def _item(node: Node, mark: str, out: _Text) -> None:
    out.flush()
    if out.level >= LEVELS:
        out.now.append(mark)
        _into(node.children, out)
        out.flush()
        return
    body = _lines(node.children, out.level + 1) or [""]
    out.lines += [(mark + x if i == 0 else " " * len(mark) + x).rstrip(" ") for i, x in enumerate(body)]


def _list(node: Node, out: _Text) -> None:
    number = int(start) if (start := node.attrs.get("start", "1")).isascii() and start.isdigit() and len(start) < 9 else 1
    for c in node.children:
        if isinstance(c, Node) and c.tag == "li":
            _item(c, f"{number}. " if node.tag == "ol" else "- ", out)
            number += 1
        else:
            _into([c], out)


def _svg(node: Node, out: _Text) -> None:
    """The text in a drawing; each text stands by itself."""
    for c in node.children:
        if isinstance(c, Node) and c.tag not in DRAWN_LATER and c.attrs.get("display") != "none":
            if c.tag in ("text", "foreignobject"):
                out.inline(" ")
                _into(c.children, out)
                out.inline(" ")
            else:
                _svg(c, out)


def _options(select: Node, disabled: bool = False) -> Iterator[tuple[str, bool, bool, bool]]:
    """(text, selected, disabled, heading) of a select's options and the labels of its groups."""
    for c in select.children:
        if isinstance(c, str):
            continue
        if c.tag == "option":
            text = c.attrs.get("label") or _WHITE.sub(" ", "".join(_plain(c))).strip()
            yield text, "selected" in c.attrs, disabled or "disabled" in c.attrs, False
        elif c.tag == "optgroup":
            yield c.attrs.get("label", ""), False, True, True
            yield from _options(c, disabled or "disabled" in c.attrs)
        else:
            yield from _options(c, disabled)


def _chosen(select: Node) -> list[str]:
    """What a select shows: all lines of a list box; of a drop-down the last option marked, else the first that can be chosen."""
    rows = int(size) if (size := select.attrs.get("size", "")).isascii() and size.isdigit() and len(size) < 9 else 0
    options = list(_options(select))
    if "multiple" in select.attrs or rows > 1:
        return [text for text, _, _, _ in options if text]
    marked = [text for text, selected, _, _ in options if selected]
    free = (text for text, _, disabled, heading in options if not disabled and not heading)
    return [text for text in (marked[-1:] or [next(free, "")]) if text]


def _select(node: Node, out: _Text) -> None:
    shown = _chosen(node)
    if "multiple" in node.attrs or len(shown) > 1:
        out.flush()
        for text in shown:
            out.inline(text)
            out.flush()
    elif shown:
        out.inline(f" {shown[0]} ")


def _into(children: list, out: _Text) -> None:
    for c in children:
        if isinstance(c, str):
            out.inline(c)
        elif c.tag == "br":
            out.br()
        elif c.tag == "hr":
            out.blank()
        elif c.tag == "img":
            if c.attrs.get("alt"):
                out.inline(c.attrs["alt"])
        elif c.tag == "input":
            if c.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url") and c.attrs.get("value"):
                out.inline(f" {c.attrs['value']} ")
        elif c.tag == "select":
            _select(c, out)
        elif c.tag == "svg":
            _svg(c, out)
        elif c.tag in BLOCK:
            out.blank() if c.tag in SPACED else out.flush()
            if c.tag == "table" and out.level < LEVELS:
                _table(c, out)
            elif c.tag in ("ul", "ol", "menu", "dir"):
                _list(c, out)
            elif c.tag == "pre":
                text = "".join(_plain(c))
                out.lines += [x.rstrip() for x in text.removeprefix("\n").rstrip().split("\n")] if text.strip() else []
            elif c.tag in ("blockquote", "dd") and out.level < LEVELS:
                out.lines += [f"  {x}" if x else x for x in _lines(c.children, out.level + 1)]
            elif c.tag == "details" and "open" not in c.attrs:
                _into([x for x in c.children if isinstance(x, Node) and x.tag == "summary"], out)
            elif c.tag == "li":
                _item(c, "- ", out)
            else:
                _into(c.children, out)
            out.blank() if c.tag in SPACED else out.flush()
        elif c.tag in ("td", "th", "tr", "caption", "textarea"):
            out.flush()
            _into(c.children, out)
            out.flush()
        else:
            _into(c.children, out)


def _plain(node: Node) -> Iterator[str]:
    for c in node.children:
        if isinstance(c, str):
            yield c
        elif c.tag == "svg":
            yield "\n".join(_lines([c], LEVELS))
        elif c.tag == "br":
            yield "\n"
        elif c.tag == "select":
            yield "\n".join(_chosen(c))
        else:
            yield from _plain(c)


def html_to_text(html: str | None) -> str:
    """Visible text of a page. Null or empty: an empty text. Text without any tag is collapsed text.

    Visible is what a browser with scripts shows: ``noscript`` and the stand-in content of ``object``, ``audio``, ``video`` and
    ``canvas`` are not; of a drop-down the chosen option is, of a list box all.
    """
    if not html:
        return ""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(DEPTH)
    try:
        return "\n".join(_lines(parse(html).children, 0))
    finally:
        sys.setrecursionlimit(before)


def rendered(pages: pd.Series) -> pd.Series:
    return pd.Series([html_to_text(h) for h in pages], dtype=object)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``page_id, text`` for every row of ``pages``, in one pass without a shuffle. Only the pages' HTML goes to Python.

    Repeated rows and rows with a null page_id are rendered like others; an empty table gives an empty
    result; a very long page is rendered whole; further columns are ignored.
    """
    return pages.select("page_id", F.pandas_udf(rendered, "string")(column).alias("text"))
