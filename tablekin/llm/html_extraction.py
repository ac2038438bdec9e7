"""HTML to laid-out text.

A tokenizer reads the page once from front to back. A tree builder accepts tag soup: missing start and end tags are
implied (paragraphs, list items, table parts, head and body), stray end tags are dropped, open elements are closed at
the end. Visibility rules then decide what a reader would see: script, style and the head are not shown, nor elements
hidden by attribute, by inline style or by a simple rule of the page's own style sheets that holds on a screen and is
not overruled, nor the body of closed details; an element made visible again inside an invisible one is. Form fields
show their value, a drop-down its chosen option, a drawing its text. A renderer walks the tree: blocks are put on lines
of their own, paragraphs are spaced, list items get bullets or numbers and indents, table cells are aligned in columns
over all their lines, also where they span rows or columns, preformatted text keeps its white space.

The time is in proportion to the page, whatever is in it: elements are found in the stack of open ones by tag, depth
has its own stacks, indents end at DEEPEST levels, tables in more than NESTED others are laid out as blocks, and a table
whose padding would be more than PADDING times its text is written with single separators. No text is left out.

Defined cases: a null or empty page gives an empty text and no title; very long pages are extracted whole; repeated
rows are extracted each; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import html as charrefs
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table

#: Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title datalist iframe object audio video canvas meta link base colgroup col annotation annotation-xml".split())
#: Elements whose content is not part of the page, so that style sheets in them don't count.
UNREAD = ("noscript", "template", "iframe", "object", "audio", "video", "canvas")
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table ul caption tr thead tbody tfoot td th".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu fieldset".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "legend", "li", "dd", "dt", "optgroup"}
#: An element that starts here closes those open ones, up to the given borders.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
#: Elements whose content is text only, with and without character references.
RAW, RAW_WITH_REFERENCES = frozenset("script style xmp iframe noembed noframes noscript".split()), frozenset(("title", "textarea"))
DEEPEST, NESTED, PADDING = 20, 16, 4
#: Inputs that show no text, and elements of a drawing that are not drawn where they stand.
WORDLESS = frozenset("hidden checkbox radio file color range password".split())
UNDRAWN = frozenset("defs symbol desc metadata clippath mask marker pattern title style script".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")
_CSS = re.compile(r"""[{};]|"[^"]*"|'[^']*'|[^{};"']+|["']""")
_SHOWS = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([\w-]+)[^;!]*(!\s*important)?", re.IGNORECASE)
_SIMPLE = re.compile(r"([a-z][a-z0-9]*|\*|)((?:[.#][\w-]+)*)", re.IGNORECASE)
#: The screen that media queries are put to, in pixels, and the rank of inline styles among specificities.
SCREEN = {"width": 1280, "height": 800}
INLINE = 1 << 30


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str]
    children: list[Node | str] = field(default_factory=list)


class TreeBuilder:
    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = {"html": [0]}  # where elements of a tag are in the stack
        self.sheets: list[Node] = []

    def holds(self, *tags: str) -> bool:
        return any(self.at.get(t) for t in tags)

    def _cut(self, k: int) -> None:
        """Close the open elements from the k-th on."""
        while len(self.open) > k:
            self.at[self.open.pop().tag].pop()

    def _top(self, tags: set[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _close(self, tags: set[str], borders: set[str]) -> None:
        """Close open elements of these tags, with all inside them, down to the nearest border."""
        border = self._top(borders)
        found = [own[k] for t in tags if (own := self.at.get(t)) and (k := bisect.bisect_right(own, border)) < len(own)]
        if found:
            self._cut(max(1, min(found)))

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag == "style" and on_screen(attrs.get("media", "")) and attrs.get("type", "").lower() in ("", "text/css") and not self.holds(*UNREAD):
            self.sheets.append(node)
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def start(self, tag: str, own: dict[str, str]) -> None:
        if tag == "html" or tag == "body" and self.holds("body"):
            return
        if self.holds("select") and tag in ("select", "input", "textarea", "button"):
            self._close({"select"}, set())
            if tag == "select":
                return
        if tag in CLOSES_P and self.holds("p"):
            self._close({"p"}, {"table", "td", "th", "button", "object"})
        if self.holds("head") and tag not in HIDDEN and not self.holds("template"):
            self._close({"head"}, set())
        if tag in IMPLIED_END:
            self._close(*IMPLIED_END[tag])
        if tag in ("td", "th") and self.holds("table") and self.open[-1].tag != "tr":
            if self.open[-1].tag == "table":
                self._push("tbody", {})
            self._push("tr", {})
        elif tag == "tr" and self.open[-1].tag == "table":
            self._push("tbody", {})
        self._push(tag, own)

    def end(self, tag: str) -> None:
        if tag == "br":
            self._push("br", {})
        elif self.holds(tag) and tag != "html":
            if (k := self.at[tag][-1]) > (self._top({"table"}) if tag not in ("table", "body") else 0):
                self._cut(k)
        elif tag == "p":
            self._push("p", {})
            self._cut(len(self.open) - 1)

    def data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._close({"head"}, set())
        self.open[-1].children.append(data)

    def feed(self, page: str) -> None:
        """Read a page; every step goes on behind what the step before has read."""
        at, size = 0, len(page)
        while at < size:
            tag_at = _OPENS.search(page, at)
            if tag_at is None:
                self.data(unescaped(page[at:]))
                return
            k = tag_at.start()
            if k > at:
                self.data(unescaped(page[at:k]))
            if name := tag_at[2]:
                tag = name.lower()
                own, at = attributes(page, tag_at.end())
                if own is None:
                    return  # the page ends inside a tag
                if tag_at[1]:
                    self.end(tag)
                    continue
                foreign = self.holds("svg", "math")
                self.start(tag, own)
                if not foreign and (tag in RAW or tag in RAW_WITH_REFERENCES) and self.open[-1].tag == tag:
                    closing = _CLOSES[tag].search(page, at)
                    text = page[at : closing.start() if closing else size]
                    self.data(unescaped(text) if tag in RAW_WITH_REFERENCES else text)
                    at = closing.start() if closing else size
            elif page.startswith("<!--", k):
                done = page.startswith((">", "->"), k + 4)
                closing = None if done else _COMMENT_END.search(page, k + 4)
                at = page.index(">", k) + 1 if done else closing.end() if closing else size
            elif page.startswith("<![CDATA[", k) and self.holds("svg", "math"):
                closing = page.find("]]>", k)
                self.data(page[k + 9 : closing if closing >= 0 else size])
                at = closing + 3 if closing >= 0 else size
            else:
                closing = page.find(">", k + 2)
                at = closing + 1 if closing >= 0 else size


_OPENS = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|[!?]|/[^A-Za-z])")
_COMMENT_END = re.compile(r"--!?>")
_CLOSES = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW | RAW_WITH_REFERENCES}
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(?=["'])|([^\s>]*)))?)""")


def attributes(page: str, at: int) -> tuple[dict[str, str] | None, int]:
    """The attributes of a tag (the first of equal names) and where it ends; None if the page ends before."""
    out: dict[str, str] = {}
    while m := _ATTRIBUTE.match(page, at):
        at = m.end()
        if m[1]:
            return out, at
        if m[3] is None and m[4] is None and m[5] is None and page[at : at + 1] in ('"', "'") and page[at - 1 : at] in "= \t\n\r\f":
            break  # a quoted value without an end
        value = next((g for g in m.group(3, 4, 5) if g is not None), "")
        out.setdefault(m[2].lower(), unescaped(value))
    return None, len(page)


def unescaped(text: str) -> str:
    if "&" not in text:
        return text
    if "&#" in text:  # numbers of any length: zeros in front go, what is beyond all characters is one such
        text = re.sub(r"&#0+(?=[0-9])", "&#", text)
        text = re.sub(r"&#[0-9]{8,}", "&#1114112", text)
    return charrefs.unescape(text)


def on_screen(media: str) -> bool:
    """Whether a media query list holds on a screen of SCREEN pixels; features other than its size count as not given."""
    media = " ".join(media.lower().split())
    for query in media.split(","):
        words = query.split("(")[0].split()
        negated, kinds = "not" in words, set(words) - {"not", "only", "and", "screen", "all"}
        holds = not kinds
        for name, value in re.findall(r"\(\s*([\w-]+)\s*(?::\s*([^)]*?)\s*)?\)", query):
            size = re.fullmatch(r"([0-9.]+)(px|em|rem)", value)
            side = SCREEN.get(name.removeprefix("min-").removeprefix("max-"))
            pixels = float(size[1]) * (1 if size[2] == "px" else 16) if size and size[1].count(".") < 2 and size[1] != "." else None
            if side is not None and pixels is not None and name[:4] in ("min-", "max-"):
                holds &= side >= pixels if name[:4] == "min-" else side <= pixels
            else:
                holds &= (name, value) == ("orientation", "landscape")
        if re.search(r"\([^)]*[<>]", query):
            holds, negated = False, False
        if holds != negated:
            return True
    return not media.strip()


def rules_of(css: str) -> list[tuple[str, str]]:
    """(selectors, declarations) of the style rules that hold on screen, in order."""
    out: list[tuple[str, str]] = []
    blocks: list[tuple[bool, str, bool]] = []  # whether it holds; a style rule's selectors; whether all around it are at-rules that hold
    now = ""

    def tell(declarations: str) -> None:
        holds, selectors, clear = blocks[-1]
        if holds and selectors and clear and declarations:
            out.append((selectors, declarations))

    for token in _CSS.findall(re.sub(r"/\*.*?(?:\*/|$)|<!--|-->", " ", css, flags=re.DOTALL)):
        if token == "{":
            inside = bool(blocks and blocks[-1][1])
            before, _, head = now.rpartition(";") if inside else ("", "", now)
            if inside:
                tell(before)
            head, now = head.strip(), ""
            clear = not blocks or blocks[-1][0] and not blocks[-1][1] and blocks[-1][2]
            if head.startswith("@"):
                name, _, rest = re.sub(r"^(@[\w-]+)", r"\1 ", head.lower()).partition(" ")
                blocks.append((name in ("@supports", "@layer") or name == "@media" and on_screen(rest), "", clear))
            else:
                blocks.append((not inside, head or "?", clear))
        elif token == "}":
            if blocks:
                tell(now)
                blocks.pop()
            now = ""
        elif token == ";" and not (blocks and blocks[-1][1]):
            now = ""
        else:
            now += token
    while blocks:
        tell(now)
        blocks.pop()
        now = ""
    return out


@dataclass(slots=True)
class Rule:
    tag: str
    marks: frozenset[str]  # .class and #id
    rank: tuple  # important, specificity, order
    part: str  # display or visibility
    gone: bool


def _declared(body: str) -> list[tuple[str, bool, bool]]:
    """(display or visibility, whether it hides, whether important) as declared."""
    hides = {"display": ("none",), "visibility": ("hidden", "collapse")}
    return [(p, v.lower() in hides[p], bool(i)) for p, v, i in ((p.lower(), v, i) for p, v, i in _SHOWS.findall(body)) if v.lower() not in ("inherit", "unset", "revert")]


def hidden_by(styles: list[str]) -> dict[str, list[Rule]]:
    """The display and visibility rules of the page's style sheets by a tag or mark that they need; none if nothing is hidden.

    Rules that hide count with selectors of one element (tag, classes, ids); those that show count by their last element.
    """
    out: dict[str, list[Rule]] = {}
    hides = False
    for order, (selectors, body) in enumerate(r for css in styles for r in rules_of(css)):
        for part, gone, important in _declared(body):
            for selector in selectors.split(","):
                steps = re.split(r"[\s>+~]+", selector.strip())
                if not (m := _SIMPLE.fullmatch(steps[-1])) or not steps[-1] or gone and len(steps) > 1:
                    continue
                marks = re.findall(r"[.#][\w-]+", selector)
                ids = sum(x[0] == "#" for x in marks)
                tags = sum(bool(re.match(r"[a-z]", x, re.IGNORECASE)) for x in steps)
                own = frozenset(re.findall(r"[.#][\w-]+", m[2]))
                tag = m[1].lower().replace("*", "")
                rule = Rule(tag, own, (important, ids, len(marks) - ids, tags, order), part, gone)
                key = min(own, key=lambda m: (len(out.get(m, ())), m)) if own else tag or "*"  # the least crowded one
                out.setdefault(key, []).append(rule)
                hides |= gone
    return {k: list({(r.tag, r.marks, r.part): r for r in sorted(rules, key=lambda r: r.rank)}.values()) for k, rules in out.items()} if hides else {}


def shown(node: Node, gone: dict[str, list[Rule]]) -> tuple[bool, bool | None]:
    """Whether an element is displayed, and whether it is made visible or invisible (None: as what it stands in)."""
    if node.tag in HIDDEN or "hidden" in node.attrs and node.attrs["hidden"].lower() != "until-found":
        return False, None
    if node.tag == "input" and node.attrs.get("type", "").lower() == "hidden" or node.tag == "dialog" and "open" not in node.attrs:
        return False, None
    best: dict[str, tuple[tuple, bool]] = {}
    if style := node.attrs.get("style"):
        for part, hides, important in _declared(style):
            if part not in best or best[part][0] <= (important, INLINE):
                best[part] = (important, INLINE), hides
    if gone:
        marks = {"." + c for c in node.attrs.get("class", "").split()}
        if "id" in node.attrs:
            marks.add("#" + node.attrs["id"])
        for key in (node.tag, "*", *marks):
            for rule in gone.get(key, ()):
                if (not rule.tag or rule.tag == node.tag) and rule.marks <= marks and (rule.part not in best or best[rule.part][0] <= rule.rank):
                    best[rule.part] = rule.rank, rule.gone
    return not best.get("display", (0, False))[1], not best["visibility"][1] if "visibility" in best else None


def face(node: Node) -> str:
    """The text that an input shows: its value, or else its placeholder; an image's alternative text."""
    kind = node.attrs.get("type", "").lower()
    if kind in WORDLESS:
        return ""
    if kind == "image":
        return node.attrs.get("alt", "")
    return node.attrs.get("value", "") or ("" if kind in ("submit", "reset", "button") else node.attrs.get("placeholder", ""))


def chosen(select: Node, gone: dict[str, list[Rule]]) -> list[Node | str]:
    """What a select shows: all options of a list box, each on a line, or the chosen option of a drop-down, else its first."""
    options, work = [], [(select, False)]
    while work:
        node, off = work.pop()
        if node.tag == "option":
            options.append((node, off or "disabled" in node.attrs))
        else:
            work += [(c, off or node.tag == "optgroup" and "disabled" in node.attrs) for c in reversed(node.children) if isinstance(c, Node) and shown(c, gone)[0]]
    if "multiple" in select.attrs or re.fullmatch(r"0*([2-9]|[1-9][0-9]+)", select.attrs.get("size", "")):
        return [Node("div", {}, [n]) for n, _ in options]
    picked = [n for n, _ in options if "selected" in n.attrs][-1:] or [n for n, off in options if not off][:1]
    return [" ", *picked, " "]


class Page:
    """Lines of one flow of text: the page's, or a table cell's."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space, self.blank, self.mark, self.indent = False, False, "", 0

    def text(self, data: str) -> None:
        words = _SPACE.sub(" ", data)
        if words == " " or not words:
            self.space |= bool(words) and bool(self.now)
            return
        if (self.space or words[0] == " ") and self.now:
            self.now.append(" ")
        self.now.append(words.strip(" "))
        self.space = words[-1] == " "

    def end_line(self) -> None:
        line = "".join(self.now).rstrip()
        if line or self.mark:
            self.put(self.mark + line)
            self.mark = ""
        self.now, self.space = [], False

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append("  " * min(self.indent, DEEPEST) + line)

    def space_out(self) -> None:
        self.blank = bool(self.lines)


@dataclass(slots=True)
class Cell:
    column: int
    span: int
    lines: list[str]


class Table:
    """The cells of a table by row, put into columns."""

    def __init__(self):
        self.rows: list[list[Cell]] = []
        self.column, self.steps, self.cells = 0, 0, 0
        self.down: dict[int, tuple[int, int]] = {}  # by first column: width and last row of the cells that reach down

    def row(self) -> None:
        self.rows.append([])
        self.column = 0

    def cell(self, attrs: dict[str, str], lines: list[str]) -> None:
        across, down = (int(n) if re.fullmatch(r"[0-9]{1,5}", n := attrs.get(k, "1").strip()) else 1 for k in ("colspan", "rowspan"))
        across, here = max(1, min(across, 1000)), len(self.rows) - 1
        self.cells += 1
        # a page can make this step long for many rows; past 100 steps a cell, cells that reach down count no more
        while (held := self.down.get(self.column)) and held[1] >= here and self.steps < 100 * self.cells + 10_000:
            self.column += held[0]
            self.steps += 1
        if down != 1:
            self.down[self.column] = (across, here + (down - 1 if down else 1 << 30))
        self.rows[-1].append(Cell(self.column, across, lines))
        self.column += across

    def lines(self) -> list[str]:
        """The rows as lines; cells are padded to their column's width, those of several lines in each of these."""
        rows = [r for r in self.rows if any(line for c in r for line in c.lines)]
        if len(rows) == 1 and len(rows[0]) == 1:
            return rows[0][0].lines
        starts = sorted({c.column for r in rows for c in r})
        number = {c: k for k, c in enumerate(starts)}
        width = [0] * len(starts)
        size = sum(len(line) + 3 for r in rows for c in r for line in c.lines or [""])
        ends = {id(c): bisect.bisect_left(starts, c.column + c.span) for r in rows for c in r}
        for alone in (True, False):  # cells of one column first
            for r in rows:
                for c in r[:-1]:
                    first, end = number[c.column], ends[id(c)]
                    if (end - first == 1) == alone and c.lines:
                        room = width[first] if alone else sum(width[first:end]) + 3 * (end - first - 1)
                        width[end - 1] += max(0, max(map(len, c.lines)) - room)
        before = [0]
        for w in width:
            before.append(before[-1] + w + 3)
        cost = sum(before[number[r[-1].column]] * max(1, *(len(c.lines) for c in r)) for r in rows)
        pad = cost <= PADDING * size + 10_000
        out = []
        for r in rows:
            held, k = r, 0
            while held:
                line, at = [], 0
                for c in held:
                    first = before[number[c.column]]
                    if pad and first > at:  # columns without a cell, or without so many lines
                        line.append(" " * (first - at - 3) + (" | " if first - at > 3 else "   "))
                    text = c.lines[k] if c.lines else ""
                    at = before[ends[id(c)]]
                    if c is not held[-1]:
                        text = (text.ljust(at - 3 - first) if pad else text) + " | "
                    line.append(text)
                out.append("".join(line).rstrip())
                k += 1
                held = [c for c in held if len(c.lines) > k]
        return out


def render(root: Node, gone: dict[str, list[Rule]]) -> str:
    pages, lists, tables, pre = [Page()], [], [], 0
    drawing: list[bool] = []  # of each open svg: whether text in it is drawn at this place
    seen = [True]  # of each open element: whether it is visible
    work: list[tuple[Node | str, str]] = [(root, "enter")]
    while work:
        item, phase = work.pop()
        page = pages[-1]
        if isinstance(item, str):
            if drawing and not drawing[-1] or not seen[-1]:
                continue
            if pre:
                first, *rest = item.split("\n")
                page.now.append(first)
                for line in rest:
                    page.put("".join(page.now))
                    page.now = [line]
            else:
                page.text(item)
            continue
        tag = item.tag
        if phase == "enter":
            displayed, visible = shown(item, gone)
            if not displayed or drawing and not drawing[-1] and tag in UNDRAWN:
                continue
            seen.append(seen[-1] if visible is None else visible)
            phase = "leave"
            children = item.children
            if tag == "svg" or drawing and tag in ("text", "foreignobject"):
                page.space |= bool(page.now)
                drawing.append(tag != "svg")
            elif tag == "input":
                children = [" ", face(item), " "] if face(item) else []
            elif tag == "select":
                children = chosen(item, gone)
            elif tag == "option" and item.attrs.get("label"):
                children = [item.attrs["label"]]
            elif tag == "textarea":
                page.end_line()
                pre += 1
                words = "".join(c for c in children if isinstance(c, str)).removeprefix("\n") or item.attrs.get("placeholder", "")
                children = [words] if words else []
            if tag == "details" and "open" not in item.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
            if tag == "table":
                page.end_line()
                page.space_out()
                tables.append(Table())
            elif tag == "tr" and tables:
                if len(tables) <= NESTED:
                    tables[-1].row()
                page.end_line()
            elif tag in ("td", "th") and tables and tables[-1].rows:
                pages.append(Page())
                phase = "cell"
            elif tag == "br":
                line = bool(page.now or page.mark)
                page.end_line()
                if not line and page.lines and not page.blank:
                    page.put("")
            elif tag == "hr":
                page.end_line()
                if seen[-1]:
                    page.put("---")
            elif tag in BLOCK:
                page.end_line()
                if tag in SPACED and not (lists and tag in ("ul", "ol", "menu", "p")):
                    page.space_out()
                if tag in ("ul", "ol", "menu", "dir"):
                    page.indent += bool(lists)
                    start = item.attrs.get("start", "1")
                    lists.append(int(start) if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", start) else 1 if tag == "ol" else None)
                elif tag == "li":
                    if lists and lists[-1] is not None:
                        page.mark = f"{lists[-1]}. " if seen[-1] else ""
                        lists[-1] += 1
                    else:
                        page.mark = "- " if seen[-1] else ""
                elif tag in ("blockquote", "dd"):
                    page.indent += 1
                elif tag == "pre":
                    pre += 1
            work.append((item, phase))
            work.extend((c, "enter") for c in reversed(children))
            continue
        seen.pop()
        if phase == "cell":
            page.end_line()
            pages.pop()
            tables[-1].cell(item.attrs, page.lines)
        elif tag == "svg" or tag in ("text", "foreignobject") and drawing and drawing[-1]:
            drawing.pop()
            page.space |= bool(page.now)
        elif tag == "textarea":
            page.end_line()
            pre -= 1
        elif tag == "table" and tables:
            page.end_line()
            for line in tables.pop().lines():
                page.put(line)
            page.space_out()
        elif tag in BLOCK and tag != "hr":
            page.end_line()
            if tag in ("ul", "ol", "menu", "dir") and lists:
                lists.pop()
                page.indent -= bool(lists)
            elif tag in ("blockquote", "dd"):
                page.indent -= 1
            elif tag == "pre":
                pre -= 1
            if tag == "li":
                page.mark = ""
            if tag in SPACED and not lists:
                page.space_out()
    pages[0].end_line()
    return "\n".join(pages[0].lines)


def title_of(root: Node) -> str | None:
    work = [root]
    while work:
        node = work.pop()
        if node.tag == "title":
            return _SPACE.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        work.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return None


def extract(html: str | None) -> tuple[str | None, str]:
    """(title, text) of a page."""
    if not html:
        return None, ""
    builder = TreeBuilder()
    builder.feed(html)
    return title_of(builder.root), render(builder.root, hidden_by(["".join(c for c in n.children if isinstance(c, str)) for n in builder.sheets]))


def html_extraction(pages: DataFrame) -> DataFrame:
    """page_id, url, title, text and n_chars of every page."""

    def of(ids: list, urls: list, pages_: list) -> dict:
        done = [extract(x) for x in pages_]
        return {"page_id": ids, "url": urls, "title": [t for t, _ in done], "text": [x for _, x in done], "n_chars": [len(x) for _, x in done]}

    return map_batches(pages.select("page_id", "url", "html"), of, "page_id long, url string, title string, text string, n_chars long", rows=64)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction(table(spark, sf_dir, "pages"))
