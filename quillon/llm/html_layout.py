"""Layout-aware HTML rendering.

A tokenizer feeds a tree builder that knows which end tags are implied (p, li, dt,
dd, option, table parts); visibility rules remove head, script, style and hidden
elements; a block formatter writes the visible text with block spacing, list markers and
table cells padded to aligned columns (rows that a cell spans keep its column).  Cells of
more than WIDE characters do not widen their column, and the columns that spans add to all rows
are at most as many as the page has characters, so that what is written stays in proportion to it.  Style
attributes are read (display, visibility), style sheets are not.  The walk is iterative, so nesting depth is bounded by memory
only.

Defined cases: a null or empty page renders as an empty text; text without tags is kept;
unclosed and stray tags never fail; repeated rows render alike; an empty table gives an
empty result; other columns stay as they are.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import free_name

#: Widest cell that the other cells of its column are padded to.
WIDE = 120
#: Most rows and columns that a cell spans, as in the HTML standard.
MOST_ROWS, MOST_COLUMNS = 65534, 1000

# Element classes of the HTML standard's rendering and syntax sections.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE_RAW = frozenset("title textarea".split())
HIDDEN = frozenset("head script style template noscript noembed noframes iframe object audio video canvas svg datalist select title meta link base area param rp".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr legend li listing main menu nav ol optgroup option p plaintext pre search section summary table caption colgroup tbody thead tfoot tr td th ul xmp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure hr".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption colgroup dd dt li option optgroup".split()) | frozenset(["li", "dd", "dt"])
#: Start tag -> (open elements it ends, elements at which the search stops).
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir", "table"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["td", "th", "tr", "caption", "colgroup"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "tbody": (frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
_P = frozenset(["p"])
_SCOPE = frozenset("table td th caption html button object template".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>\x00]*)|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.S,
)
#: One attribute or the end of a tag.  A quote opens a value only right after the equals sign; anywhere else
#: (in a name, in an unquoted value, after a quoted one) it is a character like others.  A quoted value without an end is
#: read as an unquoted one, so that the page behind it stays.
_ATTR = re.compile(
    r"[\s/]*(?:(?P<close>>|\Z)|(?P<key>=?[^\s/>=]*)(?:\s*=\s*(?:\"(?P<double>[^\"]*)\"|'(?P<single>[^']*)'|(?P<bare>[^\s>]*)))?)",
)
_SPACES = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)[^;]*?(!\s*important)?\s*(?=;|$)", re.I)
#: Inputs whose value is written on them.
BUTTONS = frozenset(["submit", "reset", "button"])


#: Numeric references beyond every code point.
_TOO_LARGE = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")
_ZEROS = re.compile(r"(&#[xX]?)0{2,}(?=[0-9a-fA-F])")


def _unescaped(text: str) -> str:
    """Character references resolved; numbers too large for any character become U+FFFD, as the standard has it."""
    return html.unescape(_TOO_LARGE.sub("\ufffd", _ZEROS.sub(r"\g<1>0", text)))


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Stack(list):
    """Open elements; a count per tag spares searches for tags that are not open."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.open: Counter[str] = Counter()

    def push(self, node: Node) -> None:
        self.append(node)
        self.open[node.tag] += 1

    def cut(self, k: int) -> None:
        for node in self[k:]:
            self.open[node.tag] -= 1
        del self[k:]

    def end(self, tags: frozenset[str], stops: frozenset[str], all_of_them: bool = False) -> None:
        """End the innermost (or all) of ``tags`` that are open above a stop."""
        k = len(self) - 1
        while k and any(self.open[t] for t in tags) and self[k].tag not in stops:
            if self[k].tag in tags:
                self.cut(k)
                if not all_of_them:
                    return
            k -= 1


def parse(source: str) -> Node:
    """Element tree; text children are strings with character references resolved."""
    root = Node("#root", {})
    stack, at, n = _Stack(root), 0, len(source)
    while at < n:
        token = _TOKEN.match(source, at)
        at = token.end()
        name = token["name"]
        if name is None:
            text = token[0]
            if text[0] != "<" or len(text) == 1:
                stack[-1].children.append(_unescaped(text))
            continue
        name = name.lower()
        attrs, at = _attributes(source, at)
        if token["end"]:
            _close(stack, name)
            continue
        if name in IMPLIED:
            ends, stops = IMPLIED[name]
            stack.end(ends, stops, all_of_them=name in ("tr", "tbody", "thead", "tfoot", "optgroup"))
        if name in CLOSES_P:
            stack.end(_P, _SCOPE)
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW or name in ESCAPABLE_RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
            body = source[at : end.start() if end else n]
            node.children.append(_unescaped(body) if name in ESCAPABLE_RAW else body)
            at = n if end is None else (source.find(">", end.end()) + 1 or n)
            continue
        stack.push(node)
    return root


def _attributes(source: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a tag (the first of equal names counts) and where the tag ends."""
    attrs: dict[str, str] = {}
    while True:
        found = _ATTR.match(source, at)
        at = found.end()
        if found["close"] is not None:
            return attrs, at
        attrs.setdefault(found["key"].lower(), _unescaped(found["double"] or found["single"] or found["bare"] or ""))


def _close(stack: _Stack, name: str) -> None:
    if name == "br":  # a stray </br> is a line break
        stack[-1].children.append(Node("br", {}))
        return
    inline = name not in BLOCK
    for k in range(len(stack) - 1 if stack.open[name] else 0, 0, -1):
        if stack[k].tag == name:
            stack.cut(k)
            return
        if inline and stack[k].tag == "table":
            return  # an inline end tag never reaches out of a table
    if name == "p":
        stack[-1].children.append(Node("p", {}))


def visible(node: Node) -> bool:
    attrs = node.attrs
    if node.tag in HIDDEN or "hidden" in attrs:
        return False
    if node.tag == "input" and attrs.get("type", "").lower() == "hidden":
        return False
    if node.tag == "dialog" and "open" not in attrs:
        return False
    return _declared(attrs, "display") != "none"


def _declared(attrs: dict[str, str], name: str) -> str:
    """The value that a style attribute gives to a property: the last one, important ones first; empty if there is none."""
    value, weight = "", ""
    for key, given, important in _STYLE.findall(attrs.get("style", "")):
        if key.lower() == name and (important or not weight):
            value, weight = given.lower(), important
    return value


def _summary(node: Node) -> list[Node]:
    """What a closed details element shows."""
    return [x for x in node.children if isinstance(x, Node) and x.tag == "summary"][:1]


class _Out:
    """Lines of a block; ``gap`` is the number of newlines due before the next text."""

    __slots__ = ("parts", "gap", "space", "indent")

    def __init__(self):
        self.parts, self.gap, self.space, self.indent = [], 0, False, ""

    def text(self, value: str, pre: bool) -> None:
        if pre:
            if value:
                self._flush()
                self.parts.append(value.replace("\r\n", "\n").replace("\n", "\n" + self.indent))
                self.space = False
            return
        words = _SPACES.sub(" ", value)
        if words.startswith(" "):
            self.space = self.space or bool(self.parts) and not self.gap
            words = words[1:]
        if not words:
            return
        tail = words.endswith(" ")
        if self.gap or not self.parts:
            self._flush()
        elif self.space:
            self.parts.append(" ")
        self.parts.append(words[:-1] if tail else words)
        self.space = tail

    def _flush(self) -> None:
        if self.parts:
            if self.gap:
                self.parts.append("\n" * self.gap + self.indent)
            elif self.space:
                self.parts.append(" ")
        elif self.indent:
            self.parts.append(self.indent)
        self.gap, self.space = 0, False

    def block(self, lines: int) -> None:
        self.gap, self.space = max(self.gap, lines), False

    def line(self) -> None:
        self.gap, self.space = self.gap + 1 if self.gap < 2 else 2, False

    def value(self) -> str:
        return "\n".join(x.rstrip(" ") for x in "".join(self.parts).split("\n")).strip("\n")


def render(source: str | None) -> str:
    """Visible text of a page."""
    if not source:
        return ""
    out, tables = _Out(), []
    lists: list[list] = []
    spare = len(source)  # columns that spans may still add to rows, so that what is written stays in proportion to the page
    # Work items: a node or text to open, or a closing function of an open element; whether spaces
    # are kept; whether text is seen (visibility is inherited and can be set again further in).
    work: list = [(parse(source), False, True)]
    while work:
        item, pre, seen = work.pop()
        if callable(item):
            item()
            continue
        if isinstance(item, str):
            if seen:
                out.text(item, pre)
            continue
        tag = item.tag
        if tag != "#root" and not visible(item):
            continue
        if "style" in item.attrs:
            seen = {"visible": True, "hidden": False, "collapse": False}.get(_declared(item.attrs, "visibility"), seen)
        if tag == "br":
            out.line()
            continue
        if tag == "hr":
            out.block(2)
            if seen:
                out.text("---", False)
            out.block(2)
            continue
        if tag == "img" or tag == "input" and item.attrs.get("type", "").lower() == "image":
            if seen and item.attrs.get("alt", "").strip():
                out.text(item.attrs["alt"], False)
            continue
        if tag == "input":
            if seen and item.attrs.get("type", "").strip().lower() in BUTTONS and item.attrs.get("value", "").strip():
                out.text(item.attrs["value"], False)
            continue
        pre = pre or tag in ("pre", "textarea", "listing", "plaintext")
        close = None
        if tag == "table":
            close = _open_table(tables, out)
            out = _Out()
            outer, table = close
            tables.append(table)
            table["outer"] = outer

            def finish(table=table):
                nonlocal out
                rest = out.value()
                out = table["outer"]
                tables.pop()
                out.block(2)
                if rest:  # text of a table outside its cells comes first, as browsers place it
                    out.text(rest, True)
                    out.block(1)
                grid = _aligned(table["rows"])
                if grid:
                    out.text(grid, True)
                out.block(2)

            close = finish
        elif tables and tag == "tr":
            tables[-1]["rows"].append([])
        elif tables and tag in ("td", "th"):
            table = tables[-1]
            if not table["rows"]:
                table["rows"].append([])
            own = _Out()
            saved, out = out, own
            columns, below = _span(item.attrs, "colspan", MOST_COLUMNS) or 1, _span(item.attrs, "rowspan", MOST_ROWS)

            def finish_cell(table=table, saved=saved, own=own, columns=columns, below=below or MOST_ROWS):
                nonlocal out, spare
                row, at, held = table["rows"][-1], len(table["rows"]), table["held"]
                while held.get(len(row), 0) >= at and spare:  # columns that cells of rows above hold
                    row.append("")
                    spare -= 1
                columns = 1 + min(columns - 1, spare)
                spare -= columns - 1
                if below > 1:
                    held.update((len(row) + k, at + below - 1) for k in range(columns))
                row += [own.value(), *[""] * (columns - 1)]
                out = saved

            close = finish_cell
        elif tag in ("ul", "ol", "menu", "dir"):
            out.block(1 if lists else 2)
            start = item.attrs.get("start", "1")
            lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])

            def finish_list():
                lists.pop()
                out.block(1 if lists else 2)

            close = finish_list
        elif tag == "li":
            out.block(1)
            mark = "* "
            if lists and lists[-1][0]:
                value = item.attrs.get("value", "")
                if re.fullmatch(r"-?[0-9]{1,9}", value):
                    lists[-1][1] = int(value)
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            kept = out.indent
            out.indent = "  " * max(0, len(lists) - 1)
            if seen:
                out._flush()
                out.parts.append(mark)
            out.indent = "  " * max(1, len(lists))

            def finish_item(target=out, kept=kept):
                target.indent = kept
                target.block(1)

            close = finish_item
        elif tag == "dd":
            out.block(1)
            kept, out.indent = out.indent, out.indent + "    "

            def finish_dd(target=out, kept=kept):
                target.indent = kept
                target.block(1)

            close = finish_dd
        elif tag in BLOCK:
            lines = 2 if tag in SPACED else 1
            out.block(lines)
            close = lambda lines=lines: out.block(lines)
        elif tag == "q":
            if seen:
                out.text('"', True)
                close = lambda: out.text('"', True)
        if close:
            work.append((close, pre, seen))
        shown = _summary(item) if tag == "details" and "open" not in item.attrs else item.children
        work.extend((child, pre, seen) for child in reversed(shown))
    return out.value()


def _open_table(tables, out):
    return out, {"rows": [], "held": {}, "outer": None}


def _span(attrs: dict[str, str], name: str, most: int) -> int:
    """Rows or columns of a cell; 0 (as written) means all that follow."""
    value = attrs.get(name, "1")
    return min(int(value), most) if re.fullmatch("[0-9]{1,5}", value) else 1


def _aligned(rows: list[list[str]]) -> str:
    """Cells padded to the widest line (of up to WIDE characters) of their column; columns are two spaces apart."""
    rows = [r for r in rows if any(r)]
    widths: list[int] = []
    for row in rows:
        for k, cell in enumerate(row):
            width = max((len(x) for x in cell.split("\n") if len(x) <= WIDE), default=0)
            if k == len(widths):
                widths.append(width)
            else:
                widths[k] = max(widths[k], width)
    lines = []
    for row in rows:
        cells = [cell.split("\n") for cell in row]
        for i in range(max(map(len, cells))):
            line = "  ".join((cell[i] if i < len(cell) else "").ljust(widths[k]) for k, cell in enumerate(cells))
            lines.append(line.rstrip())
    return "\n".join(lines)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "__text") -> DataFrame:
    """``pages`` plus the visible text (in ``out_col``, with underscores appended if taken); nothing is shuffled."""
    names, out_col = pages.columns, free_name(pages, out_col)
    at = names.index(html_col)

    def run(batches):
        for batch in batches:
            texts = pa.array([render(x.as_py()) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*names, out_col])

    return pages.mapInArrow(run, pages.limit(0).withColumn(out_col, F.lit("")).schema)
