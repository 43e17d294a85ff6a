"""Layout-aware page text: a tree builder with implied tags, visibility rules, and a block renderer."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame

from hearthlake.llm.common import with_python
from hearthlake.sources.elements import RAW, VOID, tokens

# Element classes of the HTML standard.
UNSEEN = set(
    "head script style template title noscript iframe noembed noframes object audio video canvas datalist area svg math".split()
)
LINE = set(
    "address article aside body center dd details dialog div dt fieldset figcaption footer form header hgroup html legend li "
    "main menu nav optgroup option section summary caption search".split()
)
PRE = {"pre", "xmp", "listing", "plaintext"}
SPACED = set("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p table ul".split()) | PRE
BLOCK = LINE | SPACED
CELLS, ROW_GROUPS = {"td", "th"}, {"thead", "tbody", "tfoot"}
#: Opening the key ends open elements of the values, up to the nearest of STOPS.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "td": CELLS, "th": CELLS, "tr": CELLS | {"tr"}, **dict.fromkeys(ROW_GROUPS, CELLS | {"tr", "caption"} | ROW_GROUPS),
}
STOPS = {
    "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"},
    **dict.fromkeys([*CELLS, "tr", *ROW_GROUPS], {"table"}),
}
#: Widest padding of a table cell; wider cells are written whole and not padded to.
MAX_PADDING = 60

#: Columns in which cells reach down over rows; further ones are placed as if they did not.
MAX_COLUMNS = 1_000
#: Open elements that nest; deeper ones become siblings, as in browsers.
MAX_DEPTH = 512

_SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    rendered: bool = True
    visible: bool | None = None


def styles(source: str) -> dict[str, str]:
    """The last value of each declared property."""
    out = {}
    for declaration in source.split(";"):
        name, _, value = declaration.partition(":")
        out[name.strip().lower()] = value.lower().removesuffix("!important").strip()
    return out


def shown(tag: str, attrs: dict[str, str]) -> tuple[bool, bool | None]:
    """Whether an element is rendered at all, and whether its text is visible (None: as that of its parent).

    What is not rendered takes everything inside with it; text of an invisible element goes, but elements inside may be visible again.
    """
    style = styles(attrs["style"]) if "style" in attrs else {}
    display = style.get("display")
    unseen = tag in UNSEEN or display == "none" or (display is None and ("hidden" in attrs or (tag == "dialog" and "open" not in attrs)))
    return not unseen, {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(style.get("visibility", ""))


def parse(source: str) -> Node:
    """The element tree of a page: end tags implied where HTML implies them, stray end tags ignored."""
    root = Node("#root")
    stack, counts = [root], {}

    def close(upto: int) -> None:
        for node in stack[upto:]:
            counts[node.tag] -= 1
        del stack[upto:]

    def end(tags: set[str], stops: set[str]) -> None:
        """Close up to the outermost open element of `tags` that is nearer than any of `stops`."""
        if not any(counts.get(t) for t in tags):
            return
        at = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stops:
                break
            if stack[i].tag in tags:
                at = i
        if at is not None:
            close(at)

    for tag, slash, attrs in tokens(source):
        if slash is None:
            if tag:
                stack[-1].children.append(tag)
            continue
        if slash:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif counts.get(tag):
                fence = {"table"} if tag not in {"table", "html", "body"} and counts.get("table") else set()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if stack[i].tag in fence or (fence and stack[i].tag in CELLS and tag not in CELLS | {"tr"} | ROW_GROUPS):
                        break
            continue
        if tag in ENDS:
            end(ENDS[tag], STOPS[tag])
        if tag in BLOCK and counts.get("p"):
            end({"p"}, {"table", "td", "th", "button"})
        if tag in CELLS and stack[-1].tag in {"table", *ROW_GROUPS}:
            stack[-1].children.append(Node("tr"))
            stack.append(stack[-1].children[-1])
            counts["tr"] = counts.get("tr", 0) + 1
        node = Node(tag, attrs, [], *shown(tag, attrs))
        stack[-1].children.append(node)
        if tag not in VOID and (len(stack) < MAX_DEPTH or not node.rendered or tag in RAW):
            stack.append(node)
            counts[tag] = counts.get(tag, 0) + 1
    return root


class Flow:
    """Lines of a block container: collapsed inline text, blank lines between blocks, list prefixes."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.space = False
        self.gap = 0
        self.indent: list[str] = []
        self.marker = ""

    def text(self, s: str) -> None:
        first, last = s[:1] in " \t\n\r\f", s[-1:] in " \t\n\r\f"
        s = _SPACE.sub(" ", s).strip(" ")
        if not s:
            self.space = self.space or bool(self.inline)
            return
        if self.inline and (self.space or first):
            self.inline.append(" ")
        self.inline.append(s)
        self.space = last

    def verbatim(self, s: str) -> None:
        rows = s.split("\n")
        for i, row in enumerate(rows):
            if row:
                self.inline.append(row)
            if i < len(rows) - 1:
                self.line(always=True)

    def line(self, always: bool = False) -> None:
        """End the current line, if it has anything or `always`."""
        if self.inline or always:
            self.put("".join(self.inline))
        self.inline, self.space = [], False

    def put(self, s: str) -> None:
        if self.gap and self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        lead = "".join(self.indent)
        if self.marker:
            lead, self.marker = lead[: len(lead) - len(self.marker)] + self.marker, ""
        self.lines.append((lead + s).rstrip())

    def block(self, gap: int) -> None:
        self.line()
        self.gap = max(self.gap, gap)


@dataclass
class Table:
    rows: list[list[tuple[list[str], int, int]]] = field(default_factory=list)

    def grid(self) -> list[list[tuple[int, list[str], int]]]:
        """(column, lines, columns) of the cells of each row: a cell passes by those that reach down from above."""
        out, reaching = [], []  # (first column, column behind, rows left)
        for row in self.rows:
            taken, placed, grown, at, column = sorted(reaching), [], [], 0, 0
            for cell, across, down in row:
                while at < len(taken) and taken[at][0] <= column:
                    column = max(column, taken[at][1])
                    at += 1
                placed.append((column, cell, across))
                if down > 1 and column + across <= MAX_COLUMNS:
                    grown.append((column, column + across, down))
                column += across
            reaching = [(a, b, n - 1) for a, b, n in [*reaching, *grown] if n > 1]
            out.append(placed)
        return out

    def lines(self) -> list[str]:
        """Cells side by side: columns padded to their widest cell, a cell's lines kept below each other."""
        rows, width = self.grid(), {}
        for row in rows:
            for column, cell, across in row:
                if across == 1:
                    width[column] = max(width.get(column, 0), *[n for n in map(len, cell) if n <= MAX_PADDING], 0)
        columns = sorted(width)
        sums = [0, *accumulate(width[c] for c in columns)]
        out = []
        for row in rows:
            starts = [2 * column + sums[bisect_left(columns, column)] for column, _, _ in row]
            for i in range(max((len(cell) for _, cell, _ in row), default=0)):
                line = ""
                for start, (_, cell, _) in zip(starts, row, strict=True):
                    if i < len(cell) and cell[i]:
                        line = (line + "  " if line and len(line) + 2 > start else line.ljust(start)) + cell[i]
                out.append(line.rstrip())
        return out


def span_of(node: Node, name: str, most: int, none: int = 1) -> int:
    """A cell's number of columns or rows; `none` for 0."""
    value = node.attrs.get(name, "1")
    if not (value.isascii() and value.isdigit()):
        return 1
    return min(int(value[-9:] if value.strip("0") else 0), most) or none


def render(source: str | None) -> str:
    """All visible text of a page. Null and empty pages give an empty text; any nesting depth is read without recursion."""
    if not source:
        return ""
    flows, tables, lists, visible = [Flow()], [], [], [True]
    pre = 0
    todo: list = [(parse(source), True)]
    while todo:
        node, entering = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not visible[-1]:
                continue
            if tables and len(flows) == tables[-1][1]:
                if node.strip():  # text between rows belongs before the table
                    flow.text(node)
            elif pre:
                flow.verbatim(node)
            else:
                flow.text(node)
            continue
        tag = node.tag
        if entering:
            if not node.rendered:
                continue
            if tag == "br":
                if visible[-1]:
                    flow.line(always=True)
                continue
            if tag in VOID and tag != "hr":
                continue
            visible.append(visible[-1] if node.visible is None else node.visible)
            if tag in BLOCK:
                flow.block(1 if tag in SPACED and not (tag in {"ul", "ol"} and lists) else 0)
            if tag in {"ul", "ol", "menu"}:
                start = node.attrs.get("start", "1")
                lists.append([tag, int(start) if start.lstrip("-").isascii() and start.lstrip("-").isdigit() and len(start) < 9 else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                marker = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                flow.marker = marker if visible[-1] else ""
                flow.indent.append(" " * len(marker))
            elif tag == "blockquote":
                flow.indent.append("> ")
            elif tag == "dd":
                flow.indent.append("    ")
            elif tag in PRE:
                pre += 1
            elif tag == "table":
                tables.append((Table(), len(flows)))
            elif tag == "tr" and tables:
                tables[-1][0].rows.append([])
            elif tag in CELLS and tables:
                flows.append(Flow())
            todo.append((node, False))
            todo += [(child, True) for child in reversed(node.children)]
            continue
        visible.pop()
        if tag in CELLS and tables and len(flows) > tables[-1][1]:
            flow.line()
            flows.pop()
            if not tables[-1][0].rows:
                tables[-1][0].rows.append([])
            tables[-1][0].rows[-1].append((flow.lines or [""], span_of(node, "colspan", 1_000), span_of(node, "rowspan", 65_534, 65_534)))
        elif tag == "table" and tables:
            table, _ = tables.pop()
            flow.line()
            for line in table.lines():
                flow.put(line)
            flow.gap = 1
        elif tag in BLOCK:
            flow.block(1 if tag in SPACED and not (tag in {"ul", "ol"} and len(lists) > 1) else 0)
        if tag in {"ul", "ol", "menu"} and lists:
            lists.pop()
        elif tag == "li" and flow.indent:
            if flow.marker:  # an item without text still shows its marker
                flow.put("")
            flow.indent.pop()
        elif tag in {"blockquote", "dd"} and flow.indent:
            flow.indent.pop()
        elif tag in PRE:
            pre -= 1
    flows[0].line()
    return "\n".join(flows[0].lines).strip("\n")


def visible_text(pages: DataFrame, source: str = "html", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`pages` with the visible text of their markup, rendered whole.

    Null and empty markup gives an empty text. Rows depend on themselves alone: repeated rows give
    the same text, an empty table no rows; a column named like the new one is replaced.
    """
    def work(sources: list) -> dict:
        return {text: [render(s) for s in sources]}

    return with_python(pages, source, f"`{text}` string", work, keep)
