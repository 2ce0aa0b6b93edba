"""A tolerant block-level HTML parser.

Only block elements become nodes; inline tags vanish (their text joins the block's),
so formatting left open can't swallow anything.  Each node keeps its own text in
pieces between its children.  Missing end tags of paragraphs, list items and cells
are implied, stray end tags ignored, comments and declarations dropped, raw-text
elements skipped up to their end tag.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

BLOCKS = frozenset(
    "html body head header footer nav aside main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "form fieldset legend details summary dialog menu address hr hgroup search center optgroup option select button title canvas object video audio map label".split()
)
RAW = frozenset("script style textarea noscript template iframe svg math noembed noframes xmp".split())
VOID = frozenset("hr area base br col embed img input link meta param source track wbr frame".split())
#: A start tag on the left ends an open element on the right (up to the barrier elements).
_ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"thead", "tbody", "tr", "td", "th"},
    "option": {"option"},
    "optgroup": {"option", "optgroup"},
    "body": {"head", "title"},
}
_BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
_INLINE_BLOCKS = frozenset(("label", "button", "option", "map", "object", "video", "audio", "canvas"))
#: Landmarks end navigation and headings left open.
_LANDMARKS = frozenset(("article", "main", "footer", "aside", "header", "nav"))

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_KEPT = frozenset(("class", "id", "role", "hidden", "style", "aria-hidden", "itemprop", "aria-label"))


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    #: str pieces of own text and child nodes, in order
    parts: list = field(default_factory=list)
    link_chars: int = 0

    @property
    def children(self) -> list[Node]:
        return [p for p in self.parts if not isinstance(p, str)]


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        name = m[1].lower()
        if name in _KEPT and name not in out:
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
            out[name] = html.unescape(value) if "&" in value else value
    return out


def parse(source: str | None) -> Node:
    root = Node("#root")
    if not source:
        return root
    stack, at, links = [root], 0, 0

    def text(piece: str) -> None:
        if piece:
            if "&" in piece:
                piece = html.unescape(piece)
            stack[-1].parts.append(piece)
            if links:
                stack[-1].link_chars += len(piece)

    def close(names: set[str] | frozenset[str], barrier: set[str] | frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in barrier:
                return

    n = len(source)
    scan = _MARKUP.search
    while True:
        m = scan(source, at)
        if m is None:
            text(source[at:])
            return root
        text(source[at : m.start()])
        at = m.end()
        if m[3] is None:
            if m[1]:
                stack[-1].parts.append(m[1])
            continue
        tag = m[3].lower()
        if m[2]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].parts.append(Node("p"))
            elif tag in BLOCKS:
                close({tag}, {"td", "th", "table"} if tag not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "body", "html") else frozenset())
            continue
        if tag in RAW:
            if m[4].rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if tag == "a":
            links += 1
        elif tag in ("br", "wbr", "img", "input"):
            if tag != "wbr":
                stack[-1].parts.append(" ")
        elif tag in BLOCKS:
            if tag not in _INLINE_BLOCKS:
                close({"p"}, {"td", "th", "button", "object"})
            if tag in _ENDS:
                close_all = _ENDS[tag]
                barrier = _BARRIER.get(tag, frozenset())
                while any(x.tag in close_all for x in stack[1:]):
                    before = len(stack)
                    close(close_all, barrier)
                    if len(stack) == before:
                        break
            if tag in _LANDMARKS:
                while any(x.tag in ("nav", "title", "head") for x in stack[1:]) and tag != "nav":
                    close({"nav", "title", "head"})
            if re.fullmatch("h[1-6]", tag):
                close({"h1", "h2", "h3", "h4", "h5", "h6"}, {"div", "section", "article", "td", "th", "li", "header", "main", "aside"})
            node = Node(tag, attributes(m[4]) if "=" in m[4] or "hidden" in m[4] else {})
            stack[-1].parts.append(node)
            if tag not in VOID:
                if len(stack) < 400:  # deeper nesting is laid flat
                    stack.append(node)
            links = 0
