"""Visible text of web pages: a tree builder with implied tags, visibility rules and a renderer that keeps the layout."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_by_id

# Fixed values of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
HIDDEN = {
    "head", "script", "style", "template", "noembed", "noframes", "iframe", "object", "audio", "video", "canvas", "svg",
    "math", "datalist", "input", "link", "meta", "base", "param", "source", "track", "area", "map", "title", "embed",
}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section",
    "summary", "table", "ul", "caption", "xmp",
}
#: Blocks with an empty line before and after.
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "ul", "ol", "dl", "pre", "table", "figure", "hr", "fieldset"}
#: Tables in tables beyond this depth are laid out as plain blocks.
DEEPEST_TABLE = 50
#: Cells that begin beyond this column span one column.
MOST_COLUMNS = 1000
PARTS = {"thead", "tbody", "tfoot"}
#: A start tag ends an open element of these kinds, unless one of the barrier kinds is in between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
_HEAD_ONLY = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
#: Open elements beyond which further ones hold nothing: what stands in them goes to the one around.
DEEPEST = 512
_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*+)")
_COMMENT_END = re.compile(r"--!?>")
_TAG_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []


class _Tags:
    """Tags of a page from left to right. Each character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        # where the last of each kind stands, so that a search for one that is missing costs nothing
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def end_of(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` ends (its ">"), -1 if it is cut off. A ">" in quotes is not an
        end, unless the quote is never closed."""
        while (m := _TAG_STOP.search(self.page, at)) and m[0] != ">":
            if self.last[m[0]] <= m.start():
                return self.page.find(">", m.start()) if self.last[">"] > m.start() else -1
            at = self.page.find(m[0], m.start() + 1) + 1
        return m.start() if m else -1

    def at(self, lt: int) -> tuple[int, str | None, bool, str] | None:
        """(end, name, whether it is an end tag, attributes) of what begins with the "<" at ``lt``: no name for a comment
        or declaration, -1 as the end of a tag that is cut off, None for a "<" that begins nothing."""
        page = self.page
        if page.startswith("<!--", lt):
            m = _COMMENT_END.search(page, lt + 4)
            return (m.end() if m else len(page)), None, False, ""
        if page.startswith(("<!", "<?"), lt):
            gt = page.find(">", lt) if self.last[">"] > lt else -1
            return (gt + 1 or len(page)), None, False, ""
        m = _NAME.match(page, lt + 1)
        if not m:
            cut_off = page.startswith("</", lt) and self.last[">"] < lt
            return (-1, None, True, "") if cut_off else None
        gt = self.end_of(m.end())
        return (gt + 1 or -1), m[2].lower(), bool(m[1]), page[m.end() : gt]


def parse(page: str) -> Node:
    """The tree of a page. Missing ends are implied; an end without a start is ignored; what is open at the end ends."""
    root = Node("html", {})
    stack, at, n = [root], 0, len(page)
    in_head = False

    def text(piece: str) -> None:
        nonlocal in_head
        if not piece:
            return
        if in_head and piece.strip():
            close_head()
        # table parts hold no text of their own; what stands there is shown before the next cell all the same
        stack[-1].children.append(html.unescape(piece))

    def close_head() -> None:
        nonlocal in_head
        while any(x.name == "head" for x in stack):
            stack.pop()
        in_head = False

    tags = _Tags(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        found = tags.at(lt)
        if found is None:
            text("<")  # it begins no tag
            at = lt + 1
            continue
        at, name, is_end, raw = found
        if at < 0:
            break  # a tag that is cut off at the end of the page is not shown
        if name is None:
            continue
        if is_end:
            _end(stack, name)
            if name == "head":
                in_head = False
            continue
        attrs = {}
        if raw:
            for key, a, b, c in _ATTR.findall(raw):
                attrs.setdefault(key.lower(), a or b or c)
        if name == "html":
            root.attrs = {**attrs, **root.attrs}
            continue
        if name == "head":
            in_head = True
        elif in_head and name not in _HEAD_ONLY:
            close_head()
        if name in ENDS:
            closing, barrier = ENDS[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in barrier:
                    break
                if stack[i].name in closing:
                    del stack[i:]
        elif name in BLOCK and stack[-1].name != "html":
            # a block ends an open paragraph, as far as no other block began inside it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    del stack[i:]
                    break
                if stack[i].name in BLOCK or stack[i].name in ("td", "th", "button"):
                    break
        if name in ("td", "th") and stack[-1].name in ("table", *PARTS):
            _open(stack, Node("tr", {}))
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*/?>", re.I).search(page, at)
            body = page[at : close.start()] if close else page[at:]
            node.children.append(html.unescape(body) if name in ("title", "textarea") else body)
            at = close.end() if close else n
            continue
        if len(stack) < DEEPEST:
            stack.append(node)
    return root


def _open(stack: list[Node], node: Node) -> None:
    stack[-1].children.append(node)
    stack.append(node)


def _end(stack: list[Node], name: str) -> None:
    if name in ("html", "body"):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name == name:
            del stack[i:]
            return
        # an end tag does not reach out of a table cell, except for the table's own parts
        if stack[i].name in ("td", "th", "table") and name not in ("table", "tr", *PARTS):
            return
    if name == "br":
        stack[-1].children.append(Node("br", {}))


def visible(node: Node) -> bool:
    if node.name in HIDDEN:
        return False
    attrs = node.attrs
    if not attrs:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true":
        return False
    if node.name == "dialog" and "open" not in attrs:
        return False
    return not ("style" in attrs and _UNSEEN.search(attrs["style"]))


# --- rendering ---------------------------------------------------------------------------------------------------


def width(text: str) -> int:
    """Columns of a text on a fixed-width screen."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Page:
    """Lines of one block context. A pending gap of n empty lines comes before the next text, never doubled."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.started = False
        self.space = False
        self.marks: list[str] = []
        self.prefixes: list[str] = []
        self.depth = 0

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def flush(self) -> None:
        if self.started:
            self.lines.append("".join(self.line).rstrip())
        self.line, self.started, self.space = [], False, False

    def _start(self) -> None:
        if not self.started:
            if self.lines:
                self.lines += ["".join(self.prefixes).rstrip()] * self.gap
            self.gap = 0
            line = "".join(self.prefixes)
            if self.marks:
                # a list item's mark stands in the room its indent leaves
                mark = self.marks[-1]
                if mark:
                    line = line[: len(line) - len(mark)] + mark
                    self.marks[-1] = ""
            self.line.append(line)
            self.started = True

    def words(self, text: str) -> None:
        folded = _SPACES.sub(" ", text)
        if not folded:
            return
        if folded == " ":
            self.space = self.space or self.started
            return
        lead = folded[0] == " "
        body = folded.strip(" ")
        if (lead or self.space) and self.started:
            self.line.append(" ")
        self._start()
        self.line.append(body)
        self.space = folded[-1] == " "

    def literal(self, line: str) -> None:
        self._start()
        self.line.append(line)

    def br(self) -> None:
        if not self.started:
            self._start()
        self.flush()


def render(root: Node) -> str:
    page = _Page()
    _render(root, page)
    page.flush()
    return "\n".join(page.lines).strip("\n")


def _render(root: Node, page: _Page) -> None:
    """Depth first with a stack of its own, as pages may be nested deeper than Python calls."""
    todo: list = [("node", root, False, None)]
    while todo:
        kind, node, pre, extra = todo.pop()
        if kind == "do":
            node()
            continue
        if isinstance(node, str):
            if pre:
                parts = node.replace("\r\n", "\n").split("\n")
                for i, part in enumerate(parts):
                    if i:
                        page.br()
                    if part:
                        page.literal(part)
            else:
                page.words(node)
            continue
        if not visible(node):
            continue
        name = node.name
        if name == "br":
            page.br()
            continue
        if name == "wbr":
            continue
        if name == "img":
            if node.attrs.get("alt", "").strip():
                page.words(node.attrs["alt"])
            continue
        if name == "hr":
            page.block(1)
            page.block(1)
            continue
        if name == "table" and page.depth < DEEPEST_TABLE:
            _table(node, page)
            continue
        after = []
        if name in BLOCK:
            nested = name in ("ul", "ol") and bool(page.prefixes)
            gap = 1 if name in SPACED and not nested else 0
            page.block(gap)
            after.append(lambda gap=gap: page.block(gap))
        counter = extra
        if name in ("ul", "ol", "menu", "dir"):
            start = node.attrs.get("start", "1").strip()
            counter = ["ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1] if name == "ol" else ["ul", 0]
        elif name == "li":
            mark = "- "
            if extra and extra[0] == "ol":
                value = node.attrs.get("value", "").strip()
                if re.fullmatch(r"-?\d{1,9}", value):
                    extra[1] = int(value)
                mark = f"{extra[1]}. "
                extra[1] += 1
            page.marks.append(mark)
            page.prefixes.append(" " * len(mark))
            after.append(lambda: (page.flush(), page.marks.pop(), page.prefixes.pop()))
            counter = None
        elif name in ("blockquote", "dd"):
            page.prefixes.append("  ")
            page.marks.append("")
            after.append(lambda: (page.flush(), page.marks.pop(), page.prefixes.pop()))
        elif name == "q":
            page.words('"')
            after.append(lambda: page.literal('"'))
        own_pre = pre or name in ("pre", "xmp", "textarea")
        # the last one pushed comes first, so indents end before the block's gap
        todo += [("do", f, None, None) for f in after]
        children = node.children
        if own_pre and not pre and children and isinstance(children[0], str):
            children = [children[0].removeprefix("\n"), *children[1:]]
        todo += [("node", c, own_pre, counter) for c in reversed(children)]


def _rows(table: Node) -> tuple[list[Node], list[list[Node]], list]:
    """Captions, rows of cells and stray content of a table, in order; footers come last."""
    captions, rows, foot, stray = [], [], [], []

    def row(tr: Node, to: list) -> None:
        cells = []
        for c in tr.children:
            if isinstance(c, Node) and c.name in ("td", "th"):
                if visible(c):
                    cells.append(c)
            elif isinstance(c, Node) or c.strip():
                stray.append(c)
        to.append(cells)

    for child in table.children:
        if isinstance(child, str):
            if child.strip():
                stray.append(child)
        elif child.name == "caption":
            captions.append(child)
        elif child.name == "tr":
            if visible(child):
                row(child, rows)
        elif child.name in PARTS:
            for c in child.children if visible(child) else ():
                if isinstance(c, Node) and c.name == "tr":
                    if visible(c):
                        row(c, foot if child.name == "tfoot" else rows)
                elif isinstance(c, Node) or c.strip():
                    stray.append(c)
        elif child.name not in ("colgroup", "col"):
            stray.append(child)
    return captions, rows + foot, stray


def _span(cell: Node, key: str) -> int:
    value = cell.attrs.get(key, "1").strip()
    return min(max(int(value), 1), 1000) if re.fullmatch(r"\d{1,6}", value) else 1


def _table(table: Node, page: _Page) -> None:
    """Cells as columns of equal width, two spaces apart; a cell's lines stay below each other."""
    captions, rows, stray = _rows(table)
    page.block(1)
    for node in [*stray, *captions]:
        _render(node, page) if isinstance(node, Node) else page.words(node)
        page.block(0)
    grid: list[dict[int, tuple[list[str], int]]] = []
    held: dict[int, int] = {}
    for cells in rows:
        line: dict[int, tuple[list[str], int]] = {}
        col, taken = 0, {c for c, left in held.items() if left > 0}
        held = {c: left - 1 for c, left in held.items() if left > 1}
        for cell in cells:
            while col in taken:
                col += 1
            inner = _Page()
            inner.depth = page.depth + 1
            for child in cell.children:
                _render(child, inner) if isinstance(child, Node) else inner.words(child)
            inner.flush()
            span = _span(cell, "colspan") if col < MOST_COLUMNS else 1
            line[col] = ("\n".join(inner.lines).strip("\n").split("\n"), span)
            down = _span(cell, "rowspan")
            for c in range(col, col + span):
                if down > 1:
                    held[c] = down - 1
            col += span
        grid.append(line)
    widths: dict[int, int] = {}
    for line in grid:
        for col, (lines, span) in line.items():
            if span == 1:
                widths[col] = max(widths.get(col, 0), max(map(width, lines)))
    for line in grid:
        if not any(any(x) for x, _ in line.values()):
            continue
        height = max(len(x) for x, _ in line.values())
        for k in range(height):
            out, place = "", 0
            for col in range(max(line) + 1):
                lines = line[col][0] if col in line else []
                if k < len(lines) and lines[k]:
                    out += " " * max(0, place - width(out)) + lines[k]
                place += widths.get(col, 0) + (2 if widths.get(col, 0) else 0)
            page.literal(out)
            page.flush()
    page.block(1)


def page_text(page: str | None) -> str:
    """All visible text of a page, laid out; empty for null or empty pages."""
    return render(parse(page)) if page else ""


# --- on Spark ----------------------------------------------------------------------------------------------------


def extract_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_lines): the visible text of whole pages, each by itself in one pass without a shuffle.

    A null or empty page and one without visible text give an empty text with 0 lines. Repeated rows and null ids are
    kept as they are. Broken markup never fails: what can't be read as a tag is text. An empty table gives an empty
    result; other columns are ignored.
    """
    pages = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches):
        for pdf in batches:
            texts = [page_text(h) for h in pdf["html"]]
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "text": texts, "n_lines": [t.count("\n") + 1 if t else 0 for t in texts]}
            )

    return map_by_id(pages, run, "text string, n_lines long").withColumnRenamed("doc_id", "page_id")
