"""A small HTML reader: elements with their own text, in page order."""

from __future__ import annotations

import re
from html import unescape

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_LONG_REFERENCE = re.compile(r"&#[0-9]{20,}+;?")
#: Deeper elements become siblings, as in browsers; so no step looks through more open elements.
MAX_DEPTH = 512
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = BLOCK - {"br", "body", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: Elements that a start tag closes, and the elements that stop the search for them.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
_SCOPE = frozenset("html body table td th caption article section main div nav aside header footer form".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "parts", "order")

    def __init__(self, tag: str, attrs: str, parent: Node | None, order: int):
        self.tag, self.attrs, self.parent, self.order = tag, attrs, parent, order
        self.children: list[Node] = []
        self.parts: list[tuple[int, str]] = []


def text_of(raw: str) -> str:
    """Character references decoded; one whose number no code point has stands for the replacement sign."""
    return unescape(_LONG_REFERENCE.sub("\ufffd", raw) if "&#" in raw else raw) if "&" in raw else raw


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): text_of(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw else {}


def parse(html: str) -> tuple[list[Node], int]:
    """All elements in page order, the root first, and the number of ordinals given to pieces of text and breaks.

    Text pieces carry an ordinal; block borders take one too, as an empty piece, so that the pieces of any choice of
    elements can be put in order with the blocks still apart. Unclosed and crossing tags are mended as browsers do; a
    tag that the page's end cuts off is dropped, and where a quote in a tag is never closed, tags end at the next `>`
    from there on. Time follows the page's length, whatever is in it.
    """
    root = Node("#root", "", None, 0)
    nodes, stack, at, order = [root], [root], 0, 0
    end, last = len(html), html.rfind(">")
    quotes = True
    while at < end:
        stop = at
        while True:  # the next mark-up; a sign that begins none is text
            stop = html.find("<", stop)
            sign = html[stop + 1 : stop + 2]
            if stop < 0 or sign in ("!", "?") and sign or sign.isascii() and (sign.isalpha() or sign == "/" and html[stop + 2 : stop + 3].isascii() and html[stop + 2 : stop + 3].isalpha()):
                break
            stop += 1
        stop = end if stop < 0 else stop
        if stop > at:
            order += 1
            stack[-1].parts.append((order, text_of(html[at:stop])))
        if stop == end:
            break
        if sign == "!" and html.startswith("<!--", stop):
            at = html.find("-->", stop + 4) + 3
            at = end if at < 3 else at
            continue
        if sign == "!" and html.startswith("<![CDATA[", stop):
            at = html.find("]]>", stop + 9) + 3
            at = end if at < 3 else at
            continue
        if stop > last:
            break
        if not sign.isalpha() and sign != "/":
            at = html.find(">", stop) + 1
            continue
        name = _NAME.match(html, stop + 1 + (sign == "/"))
        tag, first = name[0].lower(), name.end()
        rest = _REST.match(html, first) if quotes and sign != "/" else None
        if rest:
            at = rest.end()
        else:
            quotes = quotes and sign == "/"
            at = html.find(">", first) + 1
            if at == 0:
                break
        if sign != "/":
            if tag in _ENDS_P:
                _close(stack, {"p"}, _SCOPE)
            if tag in _CLOSES:
                _close(stack, *_CLOSES[tag])
            if tag in BLOCK:
                order += 1
                stack[-1].parts.append((order, ""))
            if tag in VOID:
                continue
            attrs = html[first : at - 1]
            node = Node(tag, attrs, stack[-1], order)
            if attrs.endswith("/") and tag in ("svg", "math"):
                continue
            stack[-1].children.append(node)
            nodes.append(node)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}[^>]*+>", re.I).search(html, at, last + 1)
                at = close.end() if close else end
            elif len(stack) < MAX_DEPTH:
                stack.append(node)
        else:
            if tag in BLOCK:
                order += 1
                stack[-1].parts.append((order, ""))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in _SCOPE and tag not in BLOCK:
                    break
            if tag in BLOCK:
                order += 1
                stack[-1].parts.append((order, ""))
    return nodes, order


def _close(stack: list[Node], tags: set, stops: frozenset | set) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in stops:
            return
