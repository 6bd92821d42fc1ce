"""HTML to text as it is laid out: a tree builder with implied tags, visibility rules, and a renderer for blocks, lists and tables."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from argil.llm._text import read

_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
_RCDATA = frozenset(("title", "textarea"))
_HEAD = frozenset("base basefont bgsound link meta title script style noscript template".split())
_HIDDEN = frozenset("head title script style template noscript noembed noframes iframe datalist rp audio video canvas object param source track area base link meta".split())
#: Elements before and after which a line ends, and the empty lines that they set off.
_BLOCKS = {t: 0 for t in "address article aside body center details dialog dir div dd dt fieldset figcaption footer form header hgroup html legend li main nav optgroup search section summary tr caption thead tbody tfoot".split()} | {t: 1 for t in "blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul listing xmp plaintext".split()}
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p plaintext pre search section summary table ul xmp".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("html table td th caption template object marquee applet".split())
#: What a start tag closes, and where the search for it ends.
_SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "caption", "colgroup"), ("table", "thead", "tbody", "tfoot")),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "caption": (("caption", "colgroup"), ("table",)),
    "rt": (("rt", "rp"), ("ruby", "rtc")),
    "rp": (("rt", "rp"), ("ruby", "rtc")),
}
#: Nested tables deeper than this are laid out as blocks; columns are aligned up to this width, and up to this place in a line; lines
#: are indented so far at most. No text is lost by any of these, and a page's text stays in proportion to the page.
_TABLE_DEPTH, _COLUMN, _LINE, _INDENT = 16, 120, 1000, 80

#: What collapses to one space; a single space is one already.
_SPACE = re.compile(r"[ \t\n\f\r]{2,}|[\t\n\f\r]")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']*)))?")
_QUOTE = re.compile(r"=\s*([\"'])")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b")
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b")
_PRE_STYLE = re.compile(r"(?:^|;)\s*white-space\s*:\s*(?:pre|break-spaces)")
_NO_ATTRIBUTES: dict[str, str] = {}


class Node:
    """An element: tag, attributes, and children, which are nodes or text."""

    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] = _NO_ATTRIBUTES) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


def _tag_end(text: str, at: int) -> int:
    """Place of the ``>`` that ends a tag, quoted values passed over; -1 if the text ends first."""
    while True:
        end = text.find(">", at)
        quote = _QUOTE.search(text, at, end) if end >= 0 else None
        if not quote:
            return end
        at = text.find(quote[1], quote.end()) + 1
        if not at:
            return -1


class Builder:
    """A tree from HTML in one pass, never recursive. Open elements have fixed places in a list; a formatting element that ends
    before those in it leaves a hole there. The innermost open element of each tag is known, so that each step costs the same
    however deep the tree, but for the elements that it closes."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.stack: list[Node | None] = [self.root]
        self.open: dict[str, list[int]] = {"html": [0]}
        self.blocks: list[int] = []

    @property
    def top(self) -> Node:
        while self.stack[-1] is None:
            self.stack.pop()
        return self.stack[-1]

    def _push(self, node: Node) -> None:
        self.top.children.append(node)
        if node.tag not in _VOID:
            self.open.setdefault(node.tag, []).append(len(self.stack))
            if node.tag in _BLOCKS:
                self.blocks.append(len(self.stack))
            self.stack.append(node)

    def _pop(self) -> None:
        node = self.stack.pop()
        if node is not None:
            self.open[node.tag].pop()
            if node.tag in _BLOCKS:
                self.blocks.pop()

    def _innermost(self, tags: Iterable[str]) -> int:
        return max((own[-1] for t in tags if (own := self.open.get(t))), default=0)

    def _close(self, tags: Iterable[str], limits: Iterable[str]) -> bool:
        """Close the innermost of ``tags`` and all in it, unless one of ``limits`` is in it."""
        at = self._innermost(tags)
        if not at or self._innermost(limits) > at:
            return False
        while len(self.stack) > at:
            self._pop()
        return True

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ("html", "body"):
            self._close(("head",), ())
            if tag == "body" and not self.open.get("body"):
                self._push(Node("body", attributes))
            return
        if self.open.get("head") and tag not in _HEAD and not self.open.get("template"):
            self._close(("head",), ())
        if tag in _CLOSES_P:
            self._close(("p",), _SCOPE | {"button"})
        if tag in _HEADINGS and self.top.tag in _HEADINGS:
            self._pop()
        if tag in _SIBLINGS:
            tags, limits = _SIBLINGS[tag]
            while self._close(tags, limits):
                pass
            if tag in ("td", "th", "tr") and self.open.get("table"):
                top = self.top.tag
                if top == "table":
                    self._push(Node("tbody"))
                    top = "tbody"
                if tag != "tr" and top in ("tbody", "thead", "tfoot"):
                    self._push(Node("tr"))
        elif tag == "a":
            self._close(("a",), _SCOPE)
        self._push(Node(tag, attributes))

    def end(self, tag: str) -> None:
        if tag == "br":
            self._push(Node("br"))
        elif tag in ("html", "body"):
            return
        elif tag == "p" and not self._close(("p",), _SCOPE | {"button"}):
            self.top.children.append(Node("p"))
        elif tag in _HEADINGS:
            self._close(tuple(_HEADINGS), _SCOPE)
        elif tag in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption", "template"):
            self._close((tag,), () if tag in ("table", "template") else ("table",))
        elif tag in ("li", "dd", "dt"):
            self._close((tag,), ("ul", "ol", "menu", "dir", "dl", *_SCOPE))
        elif tag in _BLOCKS or tag in ("head", "select", "button", "option"):
            self._close((tag,), _SCOPE)
        elif self.open.get(tag):
            # a formatting element ends, while blocks that it was left open in go on
            at = self.open[tag][-1]
            if self._innermost(_SCOPE) > at:
                return
            if self.blocks and self.blocks[-1] > at:
                self.stack[at] = None
                self.open[tag].pop()
            else:
                self._close((tag,), ())

    def text(self, text: str) -> None:
        if self.open.get("head") and self.top.tag == "head" and not text.isspace():
            self._close(("head",), ())
        self.top.children.append(html.unescape(text) if "&" in text else text)


def parse(text: str) -> Node:
    """The tree of an HTML text. Broken markup is read as far as it goes; a tag cut off by the end is dropped."""
    build, at, n = Builder(), 0, len(text)
    while at < n:
        mark = text.find("<", at)
        if mark < 0:
            build.text(text[at:])
            break
        if mark > at:
            build.text(text[at:mark])
        follows = text[mark + 1 : mark + 2]
        if follows == "!" or follows == "?":
            if text.startswith("<!--", mark):
                end = text.find("-->", mark + 4 if not text.startswith("<!-->", mark) else mark + 2)
                at = end + 3 if end >= 0 else n
            else:
                end = text.find(">", mark)
                at = end + 1 if end >= 0 else n
            continue
        closing = follows == "/"
        name = _NAME.match(text, mark + 1 + closing)
        if not name:
            if closing:
                end = text.find(">", mark)
                at = end + 1 if end >= 0 else n
            else:
                build.text("<")
                at = mark + 1
            continue
        end = _tag_end(text, name.end())
        if end < 0:
            break
        tag = name[0].lower()
        at = end + 1
        if closing:
            build.end(tag)
            continue
        inner = text[name.end() : end]
        attributes = _NO_ATTRIBUTES
        if inner and not inner.isspace():
            attributes = {}
            for m in _ATTRIBUTE.finditer(inner):
                attributes.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        build.start(tag, attributes)
        if tag in _RAW or tag in _RCDATA:
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(text, at)
            body = text[at : stop.start() if stop else n]
            build.top.children.append(html.unescape(body) if tag in _RCDATA else body)
            build.end(tag)
            if build.top.tag == tag:
                build._pop()
            at = _tag_end(text, stop.end()) + 1 if stop else n
            if stop and not at:
                break
    return build.root


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of a block of text. Runs of spaces count as one, and as none at either end of a line; margins collapse."""

    __slots__ = ("lines", "line", "space", "gap", "indent", "marker")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space, self.gap, self.indent, self.marker = False, 0, 0, ""

    def _begin(self) -> None:
        if not self.line:
            if self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            pad = " " * min(self.indent, _INDENT)
            if self.marker:
                pad = pad[: max(0, len(pad) - len(self.marker))] + self.marker
                self.marker = ""
            self.line.append(pad)

    def text(self, text: str) -> None:
        if not text:
            return
        body = _SPACE.sub(" ", text)
        if body[0] == " ":
            self.space, body = True, body[1:]
        if body:
            if self.space and self.line:
                self.line.append(" ")
            self._begin()
            self.space = body[-1] == " "
            self.line.append(body[:-1] if self.space else body)

    def exact(self, text: str) -> None:
        """Text whose spaces and line ends are kept."""
        for k, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                self.newline()
            if line:
                if self.space and self.line:
                    self.line.append(" ")
                self.space = False
                self._begin()
                self.line.append(line.expandtabs(8))

    def newline(self) -> None:
        """End the line, even if it is empty."""
        self._begin()
        self.end_line()

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def put(self, lines: list[str]) -> None:
        """Lines laid out already."""
        for line in lines:
            self._begin()
            self.line.append(line)
            self.end_line()

    def finish(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        begin = next((k for k, line in enumerate(self.lines) if line.strip()), 0)
        return self.lines[begin:] if begin else self.lines


def _span(node: Node, name: str, most: int) -> int:
    value = node.attributes.get(name, "1").strip()
    return min(most, int(value)) if value.isascii() and value.isdigit() and int(value) else 1


class Table:
    """Cells of a table in their grid; a cell's lines go to its first row and column."""

    def __init__(self) -> None:
        self.caption: list[str] = []
        self.rows: list[dict[int, list[str]]] = []
        # columns that cells of earlier rows reach down into: where they begin, in order; where they end, and their last row
        self.starts: list[int] = []
        self.taken: dict[int, tuple[int, int]] = {}
        self.wide: set[tuple[int, int]] = set()
        self.free = 0

    def row(self) -> None:
        self.rows.append({})
        self.free = 0

    def cell(self, node: Node, lines: list[str]) -> None:
        if not self.rows:
            self.row()
        now, column = len(self.rows) - 1, self.free
        while True:
            k = bisect_right(self.starts, column)
            end, last = self.taken[self.starts[k - 1]] if k else (0, 0)
            if end <= column or last < now:
                break
            column = end
        across, down = _span(node, "colspan", 1000), _span(node, "rowspan", 65534)
        self.rows[-1][column] = lines
        self.free = column + across
        if across > 1:
            self.wide.add((now, column))
        if down > 1:
            if column not in self.taken:
                insort(self.starts, column)
            self.taken[column] = (column + across, now + down - 1)

    def lines(self) -> list[str]:
        """Rows with columns two spaces apart. A cell over several columns doesn't widen the first of them."""
        widths: dict[int, int] = {}
        for r, row in enumerate(self.rows):
            for c, cell in row.items():
                size = max((w for w in map(_width, cell) if w <= _COLUMN), default=0) if (r, c) not in self.wide else 0
                widths[c] = max(widths.get(c, 0), size)
        starts, at = {}, 0
        for c in sorted(widths):
            starts[c] = at if at <= _LINE else 0
            at += widths[c] + 2 if widths[c] else 0
        out = list(self.caption)
        for row in self.rows:
            parts: list[list[tuple[int, str]]] = [[] for _ in range(max((len(cell) for cell in row.values()), default=0))]
            for c in sorted(row):
                for k, text in enumerate(row[c]):
                    if text:
                        parts[k].append((starts[c], text))
            for own in parts:
                line, used = [], 0
                for start, text in own:
                    pad = start - used if start > used else 2 if used else 0
                    line.append(" " * pad + text)
                    used += pad + _width(text)
                out.append("".join(line))
        return out


def _shown(node: Node) -> bool:
    tag, a = node.tag, node.attributes
    if tag in _HIDDEN:
        return False
    if not a:
        return tag != "dialog"
    if "hidden" in a and a["hidden"].lower() != "until-found":
        return False
    if tag == "dialog" and "open" not in a or tag == "input" and a.get("type", "").lower() == "hidden":
        return False
    return "style" not in a or not _DISPLAY.search(a["style"].lower())


_VALUE_TYPES = frozenset(("", "text", "search", "email", "url", "tel", "number", "submit", "reset", "button", "date", "time"))


def render(root: Node) -> str:
    """Visible text of a tree, laid out."""
    flows, tables, lists = [Flow()], [], []
    seen = [True]  # visibility, which a descendant may set again
    pre = 0
    # what is to be done: enter a node, or leave it
    todo: list[tuple[object, bool]] = [(root, True)]
    while todo:
        node, enters = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if seen[-1]:
                flow.exact(node) if pre else flow.text(node)
            continue
        tag = node.tag
        style = node.attributes.get("style", "").lower() if node.attributes else ""
        keeps = tag in ("pre", "textarea", "listing", "xmp", "plaintext") or bool(style and _PRE_STYLE.search(style))
        if not enters:
            pre -= keeps
            if style and _VISIBILITY.search(style):
                seen.pop()
            if tag in ("td", "th") and tables and tables[-1] and isinstance(tables[-1][-1], Flow):
                lines = flows.pop().finish()
                tables[-1].pop()
                tables[-1][0].cell(node, lines)
                continue
            if tag == "caption" and tables and tables[-1] and isinstance(tables[-1][-1], Flow):
                tables[-1].pop()
                tables[-1][0].caption.extend(flows.pop().finish())
                continue
            if tag == "table":
                own = tables.pop()
                if own:
                    flow.put(own[0].lines())
            elif tag in ("ul", "ol", "menu", "dir"):
                flow.indent -= lists.pop()[1]
            elif tag in ("blockquote", "dd"):
                flow.indent -= 2
            elif tag == "li":
                if flow.marker:  # an item without text
                    flow.newline()
                flow.block(0)
                continue
            elif tag == "q":
                flow.text("”") if seen[-1] else None
            if tag in _BLOCKS:
                flow.block(0 if lists and tag in ("ul", "ol", "menu", "dir") else _BLOCKS[tag])
            continue
        if not _shown(node):
            continue
        if tag == "br":
            flow.newline()
            continue
        if tag == "input":
            value = node.attributes.get("value", "")
            if value and seen[-1] and node.attributes.get("type", "").lower() in _VALUE_TYPES:
                flow.text(f" {value} ")
            continue
        if tag in _BLOCKS and not (tag in ("tr", "caption", "thead", "tbody", "tfoot") and tables and tables[-1]):
            flow.block(0 if lists and tag in ("ul", "ol", "menu", "dir") else _BLOCKS[tag])
        if tag in _VOID:
            continue
        children = node.children
        if tag == "table":
            tables.append([Table()] if len(tables) < _TABLE_DEPTH else [])
        elif tag == "tr" and tables and tables[-1] and not isinstance(tables[-1][-1], Flow):
            tables[-1][0].row()
        elif tag in ("td", "th", "caption") and tables and tables[-1] and not isinstance(tables[-1][-1], Flow):
            flows.append(Flow())
            tables[-1].append(flows[-1])
        elif tag in ("td", "th"):
            flow.text(" ")
        elif tag in ("ul", "ol", "menu", "dir"):
            first = node.attributes.get("start", "").strip()
            numbers = tag == "ol"
            n = sum(isinstance(c, Node) and c.tag == "li" for c in children) if numbers else 0
            back = numbers and "reversed" in node.attributes
            begin = int(first) if re.fullmatch(r"-?[0-9]{1,9}", first) else n if back else 1
            step = max(len(str(begin)), len(str(begin + (-n if back else n)))) + 2 if numbers else 2
            lists.append([begin if numbers else None, step, -1 if back else 1])
            flow.indent += step
        elif tag == "li":
            own = lists[-1] if lists else [None, 0, 1]
            if own[0] is None:
                flow.marker = "- "
            else:
                value = node.attributes.get("value", "").strip()
                own[0] = int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else own[0]
                flow.marker = f"{own[0]}. ".rjust(own[1])
                own[0] += own[2]
            if not seen[-1]:
                flow.marker = ""
        elif tag in ("blockquote", "dd"):
            flow.indent += 2
        elif tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        elif tag == "select":
            options = [o for c in children if isinstance(c, Node) for o in ([c] if c.tag == "option" else c.children) if isinstance(o, Node) and o.tag == "option"]
            children = ([o for o in options if "selected" in o.attributes] or options[:1]) if "multiple" not in node.attributes else options
            children = [x for o in children for x in (" ", o, " ")]
        elif tag == "q":
            flow.text("“") if seen[-1] else None
        if style and (m := _VISIBILITY.search(style)):
            seen.append(m[1] == "visible")
        if keeps:
            pre += 1
            if children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
        todo.append((node, False))
        if tables and tables[-1] and tag in ("table", "tr", "thead", "tbody", "tfoot") and not isinstance(tables[-1][-1], Flow):
            # text that lies loose in a table stands before it, as a browser puts it
            loose = [c for c in children if (isinstance(c, str) and not c.isspace()) or (isinstance(c, Node) and c.tag not in ("tr", "td", "th", "caption", "thead", "tbody", "tfoot", "colgroup", "col") and c.tag not in _HIDDEN)]
            apart = set(map(id, loose))
            fit = [c for c in children if isinstance(c, Node) and id(c) not in apart]
            children = loose + fit
        todo.extend((c, True) for c in reversed(children))
    return "\n".join(flows[0].finish()).replace("\xa0", " ")


def to_text(text: str | None) -> str | None:
    """Visible text of an HTML text; null for null, empty for empty."""
    return None if text is None else render(parse(text.replace("\0", "")))


def extract(pages: DataFrame, html_column: str = "html", out_column: str = "text") -> DataFrame:
    """Add the visible text of each page. A column of that name is replaced; other columns and repeated rows pass through.

    A null gives null, an empty page an empty text; no pages, no rows. Whole pages are read, one at a time, in time and memory linear
    in a page's length whatever its markup; nothing is shuffled or dropped: markup that can't be read is read as a browser would,
    and very deep or wide tables lose their alignment, not their text.
    """
    rest = [c for c in pages.columns if c != out_column or c == html_column]
    place = rest.index(html_column)
    if out_column == html_column:
        raise ValueError("the text needs a column of its own")
    schema = pages.select(*rest).schema.add(out_column, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [to_text(x.as_py()) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return pages.select(*rest).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: visible text of every page."""
    return extract(read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")
