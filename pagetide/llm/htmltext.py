"""Operator 4: HTML to text with layout.

Each page is cut into tokens, built into a tree (with the end tags, cells and rows that HTML lets
authors leave out) and rendered: what a reader would see, with blank lines around blocks, list marks,
and table cells in columns.  A page is independent of all others: one projection, no shuffle.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .styles import Styles, media

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style title template noscript iframe noembed noframes object audio video canvas "
                   "datalist rp meta link base param source track area".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr".split())
BLOCK = SPACED | frozenset("html body address article aside center dd details dialog dir div dt fieldset figcaption footer form header "
                           "hgroup legend li main menu nav optgroup option section search summary caption tr".split())
CLOSES_P = BLOCK - frozenset("html body caption tr option optgroup legend dd dt li".split()) | {"li", "dd", "dt"}
CELLS = frozenset(("td", "th"))
GROUPS = frozenset(("thead", "tbody", "tfoot"))
TABLE_PARTS = CELLS | GROUPS | {"tr", "caption", "table"}
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
ROWS = GROUPS | {"tr"}
RUBY = frozenset("rb rt rtc rp".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BLANKS = re.compile(r"[ \t\n\f\r]+")
# As in browsers, elements nested deeper than this become neighbours: no text is lost, and no page costs
# more than its length.
DEPTH = 200


class Node:
    __slots__ = ("tag", "attributes", "children", "stray", "parent", "before", "last")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        # The element around, the one before it in there, and the last one inside.
        self.parent: Node | None = None
        self.before: Node | None = None
        self.last: Node | None = None
        self.stray: list[str] | tuple = ()  # of a table: text in it, its groups or rows, which stands before it


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        found.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return found


class Tree:
    """Builds the tree of one page."""

    def __init__(self, page: str):
        self.root = Node("html", {})
        self.body = Node("body", {})
        self.body.parent, self.root.last = self.root, self.body
        self.root.children.append(self.body)
        self.open = [self.body]
        self.in_head = True
        self.styles: list[tuple[int, str]] = []  # how surely a sheet holds, and the sheet
        at, end = 0, len(page)
        while at < end:
            m = TOKEN.search(page, at)
            if m is None:
                self._text(page[at:])
                break
            if m.start() > at:
                self._text(page[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            node = self._start(tag, _attributes(m[3]) if m[3] else {})
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                body, at = (page[at:stop.start()], stop.end()) if stop else (page[at:], end)
                if tag == "style":
                    kind = node.attributes.get("type", "").strip().lower()
                    holds = media(node.attributes.get("media", ""))
                    if kind in ("", "text/css") and holds and not (self._inside("noscript") or self._inside("template")):
                        self.styles.append((holds, body))
                elif tag in ("textarea", "xmp"):
                    node.children.append(unescape(body) if tag == "textarea" else body)
                if self.open[-1] is node:
                    self.open.pop()

    def _text(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        shown = BLANKS.sub(" ", text).strip(" ")
        if shown and len(self.open) == 1:
            self.in_head = False
        if shown and self.open[-1].tag == "colgroup":
            self.open.pop()
        if shown and (self.open[-1].tag in ROWS or self.open[-1].tag == "table"):
            i = len(self.open) - 1
            while self.open[i].tag in ROWS:
                i -= 1
            if self.open[i].tag == "table":
                self.open[i].stray = self.open[i].stray or []
                self.open[i].stray.append(shown)
                return
        self.open[-1].children.append(text)

    def _close(self, wanted: frozenset | set, walls: frozenset | set) -> bool:
        """Close the innermost open element of ``wanted`` and what is open in it, unless a wall stands between."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in wanted:
                del self.open[i:]
                return True
            if self.open[i].tag in walls:
                return False
        return False

    def _start(self, tag: str, attributes: dict[str, str]) -> Node:
        if tag in ("html", "body"):
            node = self.root if tag == "html" else self.body
            node.attributes.update({k: v for k, v in attributes.items() if k not in node.attributes})
            self.in_head = self.in_head and tag == "html"
            return node
        # What a head may hold is unseen by itself, and whatever else comes ends the head: no node is made,
        # so nothing hangs on an end tag that may be left out.
        if tag == "head" or tag == "colgroup" and not self._inside("table"):
            return self.open[-1]
        if self.open[-1].tag == "colgroup" and tag not in ("col", "template"):
            self.open.pop()
        if tag in CLOSES_P:
            self._close({"p"}, TABLE_PARTS | {"button"})
        if tag == "li":
            self._close({"li"}, TABLE_PARTS | {"ul", "ol", "menu"})
        elif tag in ("dt", "dd"):
            self._close({"dt", "dd"}, TABLE_PARTS | {"dl"})
        elif tag in ("option", "optgroup"):
            self._close({"option"} if tag == "option" else {"option", "optgroup"}, {"select"})
        elif tag in CELLS:
            self._close(CELLS, {"tr", "table"})
            if self._inside("table") and self.open[-1].tag != "tr":
                self._close({"caption"}, {"table"})
                self._group()
                self._add("tr", {})
        elif tag == "tr":
            self._close({"tr", "caption"}, {"table"})
            self._group()
        elif tag in RUBY:
            self._close({"rt", "rp", "rb"} if tag in ("rt", "rp") else RUBY, TABLE_PARTS | {"ruby"})
        elif tag in GROUPS or tag in ("caption", "colgroup"):
            while self._close(GROUPS | {"tr", "caption"}, {"table"}):
                pass
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6") and re.fullmatch("h[1-6]", self.open[-1].tag):
            self.open.pop()
        node = self._add(tag, attributes)
        if tag in VOID and self.open[-1] is node:
            self.open.pop()
        return node

    def _inside(self, tag: str) -> bool:
        return any(n.tag == tag for n in self.open)

    def _group(self) -> None:
        if self.open[-1].tag == "table":
            self._add("tbody", {})

    def _add(self, tag: str, attributes: dict[str, str]) -> Node:
        node, around = Node(tag, attributes), self.open[-1]
        node.parent = around
        around.children.append(node)
        if around is self.body and self.in_head and tag in HEAD:
            pass  # no neighbour of what the body holds
        else:
            self.in_head = self.in_head and around is not self.body
            node.before, around.last = around.last, node
        if len(self.open) < DEPTH:
            self.open.append(node)
        return node

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._start("br", {})
            return
        if tag in ("html", "head", "body") or tag in VOID:
            return
        if self.open[-1].tag == "colgroup" and tag not in ("colgroup", "template"):
            self.open.pop()
        if tag == "colgroup":
            self._close({"colgroup"}, {"table"})
        elif tag == "p" and not any(n.tag == "p" for n in self.open):
            node = self._add("p", {})
            if self.open[-1] is node:
                self.open.pop()
        elif tag in BLOCK or tag in TABLE_PARTS or tag in UNSEEN:
            self._close({tag}, {"table"} if tag in TABLE_PARTS else TABLE_PARTS)
        else:  # inline: blocks opened inside stay open
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    if any(n.tag in BLOCK for n in self.open[i + 1:]):
                        del self.open[i]
                    else:
                        del self.open[i:]
                    return
                if self.open[i].tag in TABLE_PARTS:
                    return


class Renderer:
    """Writes the visible text of a tree, block by block, without recursion."""

    def __init__(self, styles: Styles):
        self.styles = styles
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # line breaks still to be written before the next text
        self.blank = False  # a collapsed blank is pending
        self.indent = ""
        self.mark = ""

    def _break(self, lines: int) -> None:
        self.gap, self.blank = max(self.gap, lines), False

    def _flush(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []

    def _write(self, text: str) -> None:
        if self.gap:
            self._flush()
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
        if not self.line:
            self.line.append(self.indent + self.mark)
            if self.mark:
                self.indent += " " * len(self.mark)
                self.mark = ""
            text = text.lstrip(" ") if text != " " else ""
        elif self.blank:
            self.line.append(" ")
        self.blank = False
        self.line.append(text)

    def _inline(self, text: str) -> None:
        words = BLANKS.sub(" ", text)
        if words == " ":
            self.blank = self.blank or bool(self.line) and not self.gap
            return
        if words.startswith(" "):
            self.blank = bool(self.line) and not self.gap
            words = words[1:]
        end = words.endswith(" ")
        if words.strip(" "):
            self._write(words.rstrip(" "))
            self.blank = end

    def _exact(self, text: str) -> None:
        parts = text.replace("\r\n", "\n").split("\n")
        for i, part in enumerate(parts):
            if i:
                self._flush()
                if self.gap == 0:
                    self.line = [self.indent]
            if part:
                self._write(part) if self.gap or not self.line else self.line.append(part)

    def render(self, root: Node, seen: bool = True) -> str:
        # Work list of ("in", node, state) and ("out", node, state); state = (visible, exact).
        work: list = [("in", root, (seen, False))]
        counters: list = []
        saved: list[tuple[str, str]] = []
        while work:
            step, node, state = work.pop()
            if step == "text":
                if state[0]:
                    self._exact(node) if state[1] else self._inline(node)
                continue
            tag = node.tag
            if step == "out":
                if tag in ("li", "blockquote", "dd"):
                    self.indent, self.mark = saved.pop()
                if tag in ("ul", "ol", "menu"):
                    counters.pop()
                if tag in BLOCK:
                    self._break(2 if tag in SPACED and not (tag in ("ul", "ol") and counters) else 1)
                continue
            before = node.stray if state[0] else ()
            if before:  # shown even where the table or the row is not
                self._break(2)
                for text in before:
                    self._write(text)
                    self._break(1)
            if tag in UNSEEN or tag == "input" and node.attributes.get("type", "").lower() == "hidden":
                continue
            style = self.styles.of(node)
            if style.get("display") == "none":
                continue
            seen = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility"), state[0])
            inner = (seen, state[1] or tag in ("pre", "textarea", "xmp"))
            if tag == "br":
                if seen:
                    if self.gap or not self.line:
                        self.gap = min(self.gap + 1, 2)
                    else:
                        self._break(1)
                continue
            if tag == "input":
                if seen and node.attributes.get("type", "").lower() in ("submit", "button", "reset") and node.attributes.get("value"):
                    self._inline(node.attributes["value"])
                continue
            if tag in BLOCK:
                self._break(2 if tag in SPACED and not (before or tag in ("ul", "ol") and counters) else 1)
            if tag == "table":
                self._table(node, inner)
                self._break(2)
                continue
            children = node.children
            if tag == "details" and "open" not in node.attributes:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if tag in ("ul", "ol", "menu"):
                start = node.attributes.get("start", "1")
                counters.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag in ("li", "blockquote", "dd"):
                saved.append((self.indent, self.mark))
                if tag == "li" and counters and counters[-1][0] == "ol":
                    self.mark = f"{counters[-1][1]}. "
                    counters[-1][1] += 1
                elif tag == "li":
                    self.mark = "- "
                else:
                    self.indent += "  "
            elif tag == "q":
                children = ['"', *children, '"']
            elif tag in CELLS:  # a cell outside a table
                self.blank = True
            work.append(("out", node, inner))
            for child in reversed(children):
                work.append(("in", child, inner) if isinstance(child, Node) else ("text", child, inner))
        self._flush()
        return "\n".join(self.lines).strip("\n")

    def _cell(self, node: Node, state) -> str:
        """A cell's or caption's text on one line."""
        return BLANKS.sub(" ", Renderer(self.styles).render(node, state[0])).strip()

    def _table(self, table: Node, state) -> None:
        rows, captions, todo = [], [], [(c, state) for c in reversed(table.children) if isinstance(c, Node)]
        while todo:
            node, at = todo.pop()
            style = self.styles.of(node)
            if node.tag in UNSEEN or style.get("display") == "none":
                continue
            at = ({"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility"), at[0]), at[1])
            if node.tag == "tr":
                row = []
                for cell in node.children:
                    if not isinstance(cell, Node) or self.styles.of(cell).get("display") == "none":
                        continue
                    span = cell.attributes.get("colspan", "1")
                    row.append((self._cell(cell, at), min(int(span), 1000) if re.fullmatch(r"[1-9]\d{0,3}", span) else 1))
                rows.append(row)
            elif node.tag in GROUPS:
                todo += [(c, at) for c in reversed(node.children) if isinstance(c, Node)]
            else:  # captions and what does not belong in a table stand before it
                captions.append(self._cell(node, at))
        widths: dict[int, int] = {}
        for row in rows:
            column = 0
            for text, span in row:
                if span == 1:
                    widths[column] = max(widths.get(column, 0), len(text))
                column += span
        for text in captions:
            if text:
                self._write(text)
                self._break(1)
        for row in rows:
            column, cells = 0, []
            for text, span in row:
                room = sum(widths.get(c, 0) for c in range(column, column + span)) + 2 * (span - 1)
                cells.append(text.ljust(room))
                column += span
            line = "  ".join(cells).rstrip()
            if line:
                lead = len(line) - len(line.lstrip())
                self._write(line.lstrip(" "))
                if lead and self.line:
                    self.line.insert(1, " " * lead)
                self._break(1)


def page_text(html: str | None) -> str | None:
    """The visible text of a page; null for null, empty where nothing is visible."""
    if html is None:
        return None
    tree = Tree(html)
    return Renderer(Styles(tree.styles)).render(tree.root)


def _rows(column):
    def run(batches):
        for batch in batches:
            rest = [n for n in batch.schema.names if n != column]
            texts = [page_text(h) for h in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(texts, pa.string())], names=[*rest, "text"])
    return run


def extract(pages: DataFrame, html: str, keep: dict[str, Column]) -> DataFrame:
    """The ``keep`` columns and ``text`` of every row of ``pages``, repeated rows included."""
    rows = pages.select(*[c.alias(n) for n, c in keep.items()], F.col(html).alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_rows("__html"), ", ".join(x for x in (schema, "text string") if x))
