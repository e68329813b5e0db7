"""Layout-aware text of web pages: a tree with implied tags, visibility rules, and blocks as they would be seen."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, quoted, text_udf

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?/][^>]*(?:>|\Z)|[^<]++|<", re.S)
#: What follows the last ">" holds no whole tag; the text before a broken one counts.
REST = re.compile(r"[^<]*+(?:<(?![A-Za-z/!?])[^<]*+)*+")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SELECTOR = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?\Z", re.I)
GONE = re.compile(r"display\s*:\s*none", re.I)
UNSEEN = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
#: Never drawn.
HIDDEN = frozenset("head script style title template noscript noembed noframes iframe object audio video canvas svg math datalist".split())
#: A blank line before and after, or just a line of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr form fieldset article section".split())
LINED = frozenset("html body div li dt dd tr address aside details summary dialog figcaption footer header hgroup legend main nav option caption center menu search".split())
#: What an opening tag ends, up to the elements that shield what lies outside of them.
CLOSES_P = (SPACED | LINED) - {"html", "body", "tr", "option", "caption"}
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
SHIELD = {"table", "td", "th", "caption", "button", "select"}
IN_HEAD = frozenset("html head title meta link base style script noscript template".split())
#: Columns up to this width are padded so that cells stand below each other; wider ones are layout.
PAD_WIDTH = 40
MAX_SPAN = 1000
MAX_INDENT = 60


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        value = m[2] or ""
        out.setdefault(m[1].lower(), unescape(value[1:-1] if value[:1] in "\"'" else value))
    return out


def build(html: str) -> tuple[Node, list[str]]:
    """The tree, and the texts of its style sheets."""
    root = Node("html", {})
    stack, styles, at, last = [root], [], 0, html.rfind(">")
    open_: Counter[str] = Counter()

    def close(tags: set[str] | frozenset[str], shields: set[str], nearest: bool) -> None:
        if not any(open_[t] for t in tags):
            return
        found = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                found = k
                if nearest:
                    break
            elif stack[k].tag in shields:
                break
        if found:
            open_.subtract(x.tag for x in stack[found:])
            del stack[found:]

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        stack.append(node)
        open_[node.tag] += 1

    while at < len(html):
        m = TOKEN.match(html, at) if at <= last else REST.match(html, at)
        at = m.end() if at <= last else len(html)
        if m.re is REST or m[2] is None:
            if m.re is REST or m[0][:2] not in ("<!", "<?", "</"):
                text = unescape(m[0])
                if stack[-1].tag == "head" and text.strip():
                    close({"head"}, set(), True)
                stack[-1].children.append(text)
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":  # a known habit of pages
                stack[-1].children.append(Node("br", {}))
            elif tag not in ("html", "body"):
                close({tag}, SHIELD - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "select") else {"table"} - {tag}, True)
            continue
        attrs = attributes(m[3])
        if tag == "html":
            root.attrs.update(attrs)
            continue
        if tag not in IN_HEAD:
            close({"head"}, set(), True)
        if tag in CLOSES_P:
            close({"p"}, SHIELD, True)
        if tag in ENDS:
            close(*ENDS[tag], False)
        if tag in ("td", "th") and stack[-1].tag != "tr" and open_["table"]:
            push(Node("tr", {}))
        node = Node(tag, attrs)
        if tag in RAW:
            stack[-1].children.append(node)
            end = RAW_END[tag].search(html, at)
            inner = html[at:end.start() if end else len(html)]
            at = end.end() if end else len(html)
            if tag == "style":
                styles.append(inner)
            elif tag not in HIDDEN:
                node.children.append(unescape(inner))
        elif tag in VOID or (m[3].endswith("/") and tag in ("svg", "math")):
            stack[-1].children.append(node)
        else:
            push(node)
    return root, styles


def sheet(styles: list[str]) -> list[tuple[str | None, str | None, str, str]]:
    """``tag, '.' or '#', name, declarations`` of simple selectors that hide or show."""
    rules = []
    for text in styles:
        for m in RULE.finditer(re.sub(r"/\*.*?\*/", "", text, flags=re.S)):
            if GONE.search(m[2]) or UNSEEN.search(m[2]):
                for s in m[1].split(","):
                    if (x := SELECTOR.match(s.strip())) and (x[1] or x[3]):
                        rules.append((x[1] and x[1].lower(), x[2], x[3], m[2]))
    return rules


def appearance(node: Node, seen: bool, rules) -> tuple[bool, bool]:
    """Whether the element is laid out at all, and whether its text is seen."""
    a = node.attrs
    style = ""
    for tag, kind, name, what in rules:
        if (not tag or tag == node.tag) and (not kind or (name in a.get("class", "").split() if kind == "." else name == a.get("id"))):
            style += what + ";"
    style += a.get("style", "")
    laid = not (node.tag in HIDDEN or "hidden" in a or GONE.search(style) or (node.tag == "dialog" and "open" not in a))
    for m in UNSEEN.finditer(style):
        seen = m[1].lower() == "visible"
    return laid, seen


class Page:
    """Lines of text; ``gap`` is what must come before the next word: 0 nothing, 1 a space, 2 a line, 3 a blank line."""

    def __init__(self):
        self.parts: list[str] = []
        self.gap, self.indent, self.mark = 0, "", ""

    def block(self, spaced: bool) -> None:
        self.gap = max(self.gap, 3 if spaced else 2)

    def text(self, text: str, pre: bool) -> None:
        if pre:
            lines = text.expandtabs(8).rstrip("\n").lstrip("\n" if self.gap >= 2 or not self.parts else "")
            if lines.strip():
                self.put(lines.replace("\n", "\n" + self.indent))
            if text.endswith("\n"):
                self.gap = max(self.gap, 2)
            return
        words = text.replace("\xa0", "\0").split()
        if text[:1].isspace():
            self.gap = max(self.gap, 1)
        if words:
            self.put(" ".join(words).replace("\0", " "))
            if text[-1] != "\xa0" and text[-1].isspace():
                self.gap = 1

    def newline(self) -> None:
        """One ends the line, the next leaves a line blank."""
        self.gap = 2 if self.gap < 2 else 3

    def put(self, text: str) -> None:
        if self.parts:
            self.parts.append(("", " ", "\n", "\n\n")[self.gap])
        if self.gap >= 2 or not self.parts:
            self.parts.append(self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent)
            self.mark = ""
        self.parts.append(text)
        self.gap = 0

    def done(self) -> str:
        return "\n".join(line.rstrip() for line in "".join(self.parts).split("\n")).strip("\n")


def number(text: str | None, usual: int) -> int:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,9}", text.strip()) else usual


def aligned(rows: list[list[tuple[str, int]]]) -> str:
    """Cells of a table below each other, two spaces apart."""
    width: dict[int, int] = {}
    for row in rows:
        at = 0
        for text, span in row:
            if span == 1 and len(text) <= PAD_WIDTH:
                width[at] = max(width.get(at, 0), len(text))
            at += span
    lines = []
    for row in rows:
        line, at = [], 0
        for text, span in row:
            line.append(text.ljust(sum(width.get(c, 0) for c in range(at, at + span)) + 2 * (span - 1) if span <= 50 else 0))
            at += span
        lines.append("  ".join(line).rstrip())
    return "\n".join(x for x in lines if x)


def render(html: str) -> str:
    """All visible text of a page."""
    root, styles = build(html)
    rules, top = sheet(styles), Page()
    # an explicit stack: pages nest deeper than Python's own
    work: list[tuple] = [("open", root, top, True, False, None)]
    while work:
        what, node, page, seen, pre, context = work.pop()
        if what == "close":
            tag = node.tag
            if tag in ("ul", "ol", "menu", "dd", "blockquote", "li"):
                page.indent = context
                page.mark = ""
            if tag == "table" and (grid := aligned(context)):
                page.block(True)
                for line in grid.split("\n"):
                    page.block(False)
                    page.put(line)
            if tag in ("td", "th"):
                row, cell, span = context
                row.append((" ".join(cell.done().split()), span))
                continue
            if tag in SPACED or tag in LINED:
                page.block(tag in SPACED)
            continue
        if isinstance(node, str):
            if seen:
                page.text(node, pre)
            continue
        laid, seen = appearance(node, seen, rules)
        if not laid:
            continue
        tag, kids = node.tag, node.children
        if tag == "br":
            page.newline()
            continue
        if tag == "input":
            if seen and node.attrs.get("type", "").lower() in ("submit", "button", "reset") and node.attrs.get("value"):
                page.text(node.attrs["value"], False)
            continue
        if tag in SPACED or tag in LINED:
            # lists in lists stand close
            page.block(tag in SPACED and not (tag in ("ul", "ol") and page.indent))
        if tag == "details" and "open" not in node.attrs:
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
        mine, inner, below = None, page, context
        if tag == "table":
            mine = below = []
        elif tag == "tr" and isinstance(context, list):
            below = []
            context.append(below)
        elif tag in ("td", "th") and isinstance(context, list):
            inner = Page()
            mine = (context, inner, min(max(number(node.attrs.get("colspan"), 1), 1), MAX_SPAN))
            below = None
        elif tag in ("ul", "ol", "menu"):
            mine = page.indent
            below = iter(range(number(node.attrs.get("start"), 1), 1 << 62)) if tag == "ol" else "-"
        elif tag == "li":
            mine = page.indent
            page.mark = f"{next(context)}. " if hasattr(context, "__next__") else "- "
            page.indent += " " * len(page.mark) if len(page.indent) < MAX_INDENT else ""
            below = None
        elif tag in ("dd", "blockquote"):
            mine = page.indent
            page.indent += "  " if len(page.indent) < MAX_INDENT else ""
        work.append(("close", node, page, seen, pre, mine))
        work += [("open", k, inner, seen, pre or tag in ("pre", "textarea", "xmp"), below) for k in reversed(kids)]
    return top.done()


def _extract(html: bytes | None) -> tuple[str | None]:
    return (None if html is None else render(html.decode("utf-8", "replace")),)


extract = text_udf(_extract, {"text": pa.string()})


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, text`` of each row: all text that a reader would see, laid out as lines.

    Missing end tags are implied.  Scripts, styles, ``hidden``, ``display:none`` and ``visibility:hidden`` (inline or by
    simple selectors of the page's style sheets), closed details and dialogs give no text.  Paragraphs,
    headings, lists and tables stand between blank lines, other blocks on lines; list items are marked and
    indented; table cells stand below each other.  A null page is null; a page without visible text is empty.
    """
    return pages.select("page_id", extract(F.col("html"))["text"].alias("text"))


def with_text(pages: DataFrame) -> DataFrame:
    """``pages`` with the text in a new last column."""
    return pages.select(*quoted(pages.columns), extract(F.col("html"))["text"].alias(free_names(pages, "text")[0]))
