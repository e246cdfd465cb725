"""Visible text of HTML pages, laid out: a tolerant tree builder and a renderer.

The tree builder closes what HTML lets authors leave open (paragraphs, list items, table parts, options, definition
terms), ignores end tags that match nothing, and keeps script, style and other raw text out of the tree. Nested deeper
than DEPTH, elements become siblings, as browsers do, so no input exhausts the stack.

What isn't displayed is left out: head, script, style, template, noscript and the like, hidden inputs, hidden attributes and
closed dialogs, and elements with `display:none` by their inline style or the page's own style sheets. Of declarations that
meet an element the cascade decides: `!important`, inline style, id, class, tag, later over earlier. Only rules that hold on
every screen hide (at the top level or in @media screen or all), and only by a tag, class or id alone; any other rule that
may show an element, on some screens or by a longer selector, keeps it. `visibility:hidden` hides an element's own text, not
that of descendants made visible again. Of SVG and MathML the text is shown, without descriptions, definitions and
annotations. The content of a closed `details` is one click away and is kept.
Everything else is emitted once, in order. Paragraph-like blocks stand apart by an empty line, other blocks and nested
lists by a line break; list items carry a bullet or number and indent by level; preformatted text keeps its spaces and empty
lines; the cells of a table line up in columns, by their spans over columns and rows (a column's cells over WIDE characters
aren't filled up, nor are columns left empty in a table of more than WIDE columns, so padding stays in proportion to the
text; columns that no cell starts in take no room).

Defined results: null and empty pages give the empty text; broken markup is text or ignored, never an error; a page is
read whole in one pass, however long; rows that repeat a page and null ids stay, an empty table gives an empty one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import frugal, read_table

DEPTH, WIDE = 150, 80
#: Fixed value: the widest span of columns that the HTML standard allows.
MOST_COLUMNS = 1000
#: Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe noembed noframes object audio video canvas datalist".split())
#: Not displayed inside the element of the value.
UNSEEN_INSIDE = {
    **dict.fromkeys("desc defs metadata symbol clippath mask pattern marker".split(), "svg"),
    **dict.fromkeys(("annotation", "annotation-xml"), "math"),
}
#: Elements of SVG and MathML whose parts stand apart.
SPACED = frozenset("svg mfrac mtable mtr".split())
LISTS = frozenset("ul ol menu dir".split())
SCREEN = frozenset(("", "all", "screen", "only all", "only screen", "not print"))
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre xmp hr figure form fieldset".split())
BLOCK = APART | frozenset(
    "address article aside body center dd details dialog div dir dt figcaption footer header hgroup html legend li main menu nav option optgroup search section summary "
    "caption tr td th thead tbody tfoot colgroup select".split()
)
#: A start tag of the key closes the nearest open element among the values, looked for up to a BARRIER.
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "option": ("option",),
    "optgroup": ("optgroup", "option"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tr": ("tr",),
    "thead": ("thead", "tbody", "tfoot", "caption", "colgroup"),
    "tbody": ("thead", "tbody", "tfoot", "caption", "colgroup"),
    "tfoot": ("thead", "tbody", "tfoot", "caption", "colgroup"),
}
BARRIER = {
    **dict.fromkeys(("li",), frozenset(("ul", "ol", "menu", "dir", "td", "th", "table"))),
    **dict.fromkeys(("dt", "dd"), frozenset(("dl", "td", "th", "table"))),
    **dict.fromkeys(("option", "optgroup"), frozenset(("select", "datalist"))),
    **dict.fromkeys(("td", "th", "tr", "thead", "tbody", "tfoot"), frozenset(("table",))),
}
CLOSES_P = BLOCK - frozenset("html body td th tr thead tbody tfoot caption colgroup option optgroup select li dd dt legend summary".split()) | frozenset(("li", "dd", "dt"))

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
_END = re.compile(r"[^>]*>?")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_STYLE = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_NAMES = re.compile(r"[.#]?[a-zA-Z_][\w-]*")
_SIMPLE = re.compile(r"[.#]?[a-zA-Z_][\w-]*")
_COMMENT_OR_QUOTED = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:\\.?|[^\"\\\n])*\"?|'(?:\\.?|[^'\\\n])*'?", re.S)
_CSS = re.compile(r"[{};]")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


def parse(page: str) -> Node:
    """The tree of what is displayed, under a root."""
    root, sheet = Node("#root", {}), Sheet()
    stack, at, size = [root], 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            stack[-1].kids.append(html.unescape(page[at:lt]))
            at = lt
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            at = size if end < 0 else end + 3
            continue
        m = _TAG.match(page, at)
        if m is None:
            if page.startswith(("<!", "<?", "</"), at):
                at = _END.match(page, at).end()
            else:
                stack[-1].kids.append("<")
                at += 1
            continue
        tag, at = m[1].lower(), m.end()
        if page[m.start() + 1] == "/":
            at = _END.match(page, at).end()
            _close(stack, tag)
            continue
        attrs: dict[str, str] = {}
        while (a := _ATTR.match(page, at)) is not None:
            at = a.end()
            attrs.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
        end = _END.match(page, at)
        closed = page[at - 1] == "/" or "/" in end[0]
        at = end.end()
        if tag in UNSEEN_INSIDE and any(x.tag == UNSEEN_INSIDE[tag] for x in stack):
            attrs["hidden"] = ""
        elif tag == "text" and any(x.tag == "svg" for x in stack):  # a label of a drawing
            attrs["svg"] = ""
        node = _open(stack, tag, attrs)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            raw = page[at : stop.start() if stop else size]
            at = _END.match(page, stop.end()).end() if stop else size
            if tag == "style":
                sheet.read(raw, attrs.get("media", ""))
            elif tag == "xmp":
                node.kids.append(raw)
            elif tag == "textarea" and raw:
                node.kids.append(html.unescape(raw))
        elif tag not in VOID and not (closed and tag not in BLOCK) and len(stack) < DEPTH:
            stack.append(node)
    _displayed(root, sheet, True, False)
    return root


def _open(stack: list[Node], tag: str, attrs: dict[str, str]) -> Node:
    if tag in CLOSES_P:
        _pop_to(stack, ("p",), frozenset(("td", "th", "table", "li", "caption")))
    if tag in CLOSES:
        _pop_to(stack, CLOSES[tag], BARRIER[tag])
        if tag in ("tr", "thead", "tbody", "tfoot"):  # a row's end ends its cells, a group's end its rows
            _pop_to(stack, ("td", "th") if tag == "tr" else ("tr", "td", "th"), BARRIER[tag])
    node = Node(tag, attrs)
    stack[-1].kids.append(node)
    return node


def _pop_to(stack: list[Node], tags: tuple[str, ...], barrier: frozenset[str]) -> None:
    """Pop the nearest open element of tags, and all above it, unless a barrier comes first."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in barrier:
            return


def _close(stack: list[Node], tag: str) -> None:
    if tag == "br":
        stack[-1].kids.append(Node("br", {}))
        return
    wall = frozenset() if tag in ("table", "html", "body") else frozenset(("table",)) if tag in CLOSES else frozenset(("table", "td", "th"))
    if tag in ("td", "th"):
        wall = frozenset(("table",))
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in wall:
            return


def _on_screen(media: str) -> bool:
    """Whether a list of media queries holds on every screen."""
    return any(" ".join(x.lower().split()) in SCREEN for x in media.split(","))


def _declared(style: str) -> dict[str, tuple[bool, str]]:
    """display and visibility as a block of declarations leaves them: (important, value)."""
    out: dict[str, tuple[bool, str]] = {}
    for name, value, important in _STYLE.findall(style):
        new = (bool(important), value.lower())
        if new[0] >= out.get(name.lower(), new)[0]:
            out[name.lower()] = new
    return out


class Sheet:
    """What a page's style sheets say of display and visibility."""

    def __init__(self):
        #: Of a tag, class or id: property -> (important, order, value).
        self.rules: dict[str, dict[str, tuple[bool, int, str]]] = {}
        #: Names that some rule of another kind may show.
        self.shown: set[str] = set()
        self.order = 0

    def read(self, sheet: str, media: str) -> None:
        sheet = _COMMENT_OR_QUOTED.sub(lambda m: " " if m[0][0] == "/" else '""', sheet)
        # for each open block: the selectors of a rule and whether it holds on every screen, or "" and that for a group of rules
        blocks: list[tuple[str | None, bool]] = [("", True)] if _on_screen(media) else [("", False)]
        at = 0
        for m in _CSS.finditer(sheet):
            said, at = sheet[at : m.start()].strip(), m.end()
            if m[0] == "{":
                group, holds = blocks[-1]
                if group != "":
                    blocks.append((None, False))
                elif said.startswith("@"):
                    rule = re.match(r"@media\b", said, re.I)
                    media = said[rule.end() :] if rule else ""
                    paper = all(x.split()[-1:] == ["print"] and "not" not in x for x in media.lower().split(",")) if rule else False
                    blocks.append((None, False) if paper else ("", holds and bool(rule) and _on_screen(media)))
                else:
                    blocks.append((said or None, holds))
                continue
            if blocks[-1][0]:
                self._add(*blocks[-1], said)
            if m[0] == "}" and len(blocks) > 1:
                blocks.pop()

    def _add(self, selectors: str, holds: bool, said: str) -> None:
        for name, (important, value) in _declared(said).items():
            self.order += 1
            for x in map(str.strip, selectors.split(",")):
                if holds and _SIMPLE.fullmatch(x):
                    key = x if x[0] in ".#" else x.lower()
                    mine, new = self.rules.setdefault(key, {}), (important, self.order, value)
                    mine[name] = max(mine.get(name, new), new)
                elif value not in ("none", "hidden", "collapse"):
                    self.shown.update(n if n[0] in ".#" else n.lower() for n in _NAMES.findall(re.split(r"[\s>+~]", x)[-1]))

    def of(self, node: Node) -> dict[str, str]:
        """display and visibility of an element, where something is said of them."""
        found: dict[str, tuple[bool, int, int, str]] = {}
        if self.rules:
            a = node.attrs
            for rank, key in ((1, node.tag), *((2, f".{c}") for c in a.get("class", "").split()), (3, f"#{a.get('id', '')}")):
                for name, (important, order, value) in self.rules.get(key, {}).items():
                    if not (value in ("none", "hidden", "collapse") and key in self.shown):
                        new = (important, rank, order, value)
                        found[name] = max(found.get(name, new), new)
        for name, (important, value) in _declared(node.attrs.get("style", "")).items() if "style" in node.attrs else ():
            new = (important, 4, 0, value)
            found[name] = max(found.get(name, new), new)
        return {name: x[3] for name, x in found.items()}


def _displayed(node: Node, sheet: Sheet, visible: bool, in_list: bool) -> None:
    """Take out of the tree what isn't displayed, and mark lists inside lists and items whose own text isn't seen."""
    kids: list = []
    for kid in node.kids:
        if isinstance(kid, str):
            if visible or not kid.strip():
                kids.append(kid)
            continue
        a = kid.attrs
        if kid.tag in UNSEEN or (kid.tag == "input" and a.get("type", "").lower() == "hidden"):
            continue
        said = sheet.of(kid) if sheet.rules or "style" in a else {}
        display = said.get("display")
        if display == "none" or (display is None and ("hidden" in a or (kid.tag == "dialog" and "open" not in a))):
            continue
        shows = said.get("visibility")
        seen = shows == "visible" or (visible and shows not in ("hidden", "collapse"))
        if not seen:
            if kid.tag == "input":
                continue
            a["#unseen"] = ""
        if in_list and kid.tag in LISTS:
            a["#nested"] = ""
        if kid.kids:
            _displayed(kid, sheet, seen, in_list or kid.tag in LISTS)
        kids.append(kid)
    node.kids = kids


class _Page:
    """Lines of one flow: inline text gathers in a run, blocks end the run."""

    def __init__(self):
        self.lines: list[str] = []
        self.run: list[str] = []
        self.gap = 0  # 1: a line break is due, 2: an empty line

    def text(self, s: str) -> None:
        self.run.append(_SPACE.sub(" ", s))

    def end_run(self) -> None:
        if self.run:
            joined = _SPACE.sub(" ", "".join(self.run)).strip(" ")
            self.run = []
            if joined:
                self.add([joined])

    def add(self, lines: list[str]) -> None:
        if self.gap == 2 and self.lines:
            self.lines.append("")
        self.gap = 0
        self.lines += lines

    def brk(self, gap: int) -> None:
        self.end_run()
        self.gap = max(self.gap, gap)


def _flow(kids: list, page: _Page) -> None:
    for kid in kids:
        if isinstance(kid, str):
            page.text(kid)
        else:
            _element(kid, page)


def _lines(kids: list) -> list[str]:
    page = _Page()
    _flow(kids, page)
    page.end_run()
    return page.lines


def _element(node: Node, page: _Page) -> None:
    tag = node.tag
    if tag == "br":
        if "".join(page.run).strip():
            page.end_run()
        elif page.lines and not page.gap:
            page.add([""])
    elif tag == "input":
        if node.attrs.get("type", "").lower() in ("submit", "button", "reset", "text", "search", "") and node.attrs.get("value"):
            page.text(f" {node.attrs['value']} ")
    elif tag in ("pre", "textarea", "xmp"):
        page.brk(1 if tag == "textarea" else 2)
        raw = _raw(node).replace("\r\n", "\n").replace("\r", "\n").expandtabs(8)
        lines = raw.removeprefix("\n").split("\n")
        while lines and not lines[-1].strip():
            lines.pop()
        if lines:
            page.add([x.rstrip() for x in lines])
        page.brk(1 if tag == "textarea" else 2)
    elif tag == "hr":
        page.brk(2)
    elif tag in SPACED:
        for kid in node.kids:
            page.text(" ")
            _flow([kid], page)
        page.text(" ")
    elif tag == "text" and "svg" in node.attrs:
        page.text(" ")
        _flow(node.kids, page)
        page.text(" ")
    elif tag == "table":
        page.brk(2)
        if lines := _table(node):
            page.add(lines)
        page.brk(2)
    elif tag in LISTS:
        gap = 1 if "#nested" in node.attrs else 2
        page.brk(gap)
        if lines := _list(node):
            page.add(lines)
        page.brk(gap)
    elif tag in ("blockquote", "dd"):
        page.brk(2 if tag == "blockquote" else 1)
        if lines := _lines(node.kids):
            page.add([f"  {x}" if x else x for x in lines])
        page.brk(2 if tag == "blockquote" else 1)
    elif tag in BLOCK:
        gap = 2 if tag in APART else 1
        page.brk(gap)
        _flow(node.kids, page)
        page.brk(gap)
    else:
        _flow(node.kids, page)


def _raw(node: Node) -> str:
    return "".join(k if isinstance(k, str) else "\n" if k.tag == "br" else _raw(k) for k in node.kids)


def _list(node: Node) -> list[str]:
    start = node.attrs.get("start", "1")
    out, n = [], int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    loose: list = []

    def rest() -> None:
        if loose:
            out.extend(_lines(loose))
            loose.clear()

    for kid in node.kids:
        if isinstance(kid, Node) and kid.tag == "li":
            rest()
            mark = f"{n}. " if node.tag == "ol" else "- "
            lines = _lines(kid.kids) or ([] if "#unseen" in kid.attrs else [""])
            if lines:
                out.append((mark + lines[0]).rstrip())
                out += [" " * len(mark) + x if x else "" for x in lines[1:]]
            n += 1
        else:
            loose.append(kid)
    rest()
    return out


def _rows(kids: list, caption: list[str], foot: list) -> list[list[Node]]:
    rows: list[list[Node]] = []
    loose: list[Node] = []
    for kid in kids:
        if isinstance(kid, str):
            if kid.strip():
                caption.append(_SPACE.sub(" ", kid).strip())
            continue
        if kid.tag != "tr" and kid.tag not in ("td", "th") and loose:
            rows.append(loose)
            loose = []
        if kid.tag == "tr":
            rows.append([c for c in kid.kids if isinstance(c, Node) and c.tag in ("td", "th")])
            stray = [c for c in kid.kids if not (isinstance(c, Node) and c.tag in ("td", "th"))]
            caption += _lines(stray)
        elif kid.tag in ("td", "th"):
            loose.append(kid)
        elif kid.tag == "tfoot":
            foot += _rows(kid.kids, caption, foot)
        elif kid.tag in ("thead", "tbody"):
            rows += _rows(kid.kids, caption, foot)
        else:
            caption += _lines([kid])
    if loose:
        rows.append(loose)
    return rows


def _span(cell: Node, name: str, most: int) -> int:
    said = cell.attrs.get(name, "1").strip()
    return min(int(said), most) if re.fullmatch(r"\d{1,9}", said) else 1


def _grid(rows: list[list[Node]]) -> list[list[tuple[int, Node]]]:
    """The cells of each row with the columns they start in, past cells that reach down from rows above."""
    out, down = [], []  # down: (first column, column after the last, rows to go)
    for k, row in enumerate(rows):
        line, at, new, held = [], 0, [], 0
        for cell in row:
            while held < len(down) and down[held][0] <= at:
                at = max(at, down[held][1])
                held += 1
            line.append((at, cell))
            wide = max(1, _span(cell, "colspan", MOST_COLUMNS))
            deep = _span(cell, "rowspan", len(rows) - k) or len(rows) - k  # 0: to the end
            if deep > 1:
                if new and new[-1][1:] == (at, deep):
                    new[-1] = (new[-1][0], at + wide, deep)
                else:
                    new.append((at, at + wide, deep))
            at += wide
        out.append(line)
        down = sorted((a, z, n - 1) for a, z, n in down + new if n > 1)
    return out


def _table(node: Node) -> list[str]:
    caption: list[str] = []
    foot: list[list[Node]] = []
    rows = _rows(node.kids, caption, foot)
    grid = [[(at, _lines(cell.kids)) for at, cell in line] for line in _grid(rows + foot)]
    # a column where no cell starts takes no room
    place = {at: k for k, at in enumerate(sorted({at for line in grid for at, _ in line}))}
    width = [0] * len(place)
    for line in grid:
        for at, cell in line:
            width[place[at]] = max([width[place[at]], *(len(x) for x in cell if len(x) <= WIDE)])
    out = [x for x in caption if x]
    for line in grid:
        last = max((k for k, (_, cell) in enumerate(line) if cell), default=-1)
        for n in range(max((len(cell) for _, cell in line), default=0)):
            text, at = [], 0
            for where, cell in line[: last + 1]:
                if len(place) <= WIDE:
                    text += [" " * width[k] for k in range(at, place[where])]
                text.append((cell[n] if n < len(cell) else "").ljust(width[place[where]]))
                at = place[where] + 1
            while text and not text[-1].strip():
                text.pop()
            out.append(" | ".join(text).rstrip(" "))
    return out


def visible_text(page: str | None) -> str:
    """The page as laid-out text."""
    if not page:
        return ""
    return "\n".join(_lines(parse(page).kids)).strip("\n")


def html_text(source: Column) -> Column:
    """visible_text of each page."""

    @F.pandas_udf("string")
    @frugal
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([visible_text(p) for p in pages], dtype=object)

    return run(source)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text in place of the markup; a column named text is replaced."""
    rest = [c for c in pages.columns if c not in (html_col, "text")]
    return pages.select(*rest, html_text(F.col(html_col)).alias("text"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "html")
    return extract_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))
