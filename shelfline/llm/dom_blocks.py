"""Leaf blocks of a page: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from collections import Counter

#: Elements by how HTML treats them.
RAW = {"script", "style", "template", "noscript", "iframe", "textarea", "title"}
#: Elements whose insides are no text of the page, if they have an end tag; markup inside them is markup.
DROPPED = {"svg", "select", "object", "canvas", "video", "audio"}
#: What may stand in a head; anything else begins the body.
IN_HEAD = {"title", "meta", "link", "style", "script", "base", "noscript", "template", "basefont", "bgsound", "html", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd",
    "label", "mark", "math", "mfrac", "mi", "mn", "mo", "mrow", "msub", "msup", "mtext", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: What a start tag of these ends, if it is open in the same container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = {"table", "ul", "ol", "dl", "div", "section", "article", "main", "aside", "body", "html", "nav", "header", "footer", "form", "blockquote", "figure", "td", "th", "li"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW | DROPPED}


class Block:
    __slots__ = ("text", "tags", "names", "nearest", "linked", "place")

    def __init__(self, text: str, tags: tuple, names: frozenset, nearest: frozenset, linked: int, place: int):
        self.text, self.tags, self.names, self.nearest, self.linked, self.place = text, tags, names, nearest, linked, place


def blocks_of(page: str | None) -> list[Block]:
    """Blocks in page order. A block's white space is single spaces, its character references are decoded, and it isn't empty."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, frozenset]] = []
    pieces: list[str] = []
    #: How many elements of each name are open, so that the stack is only searched for what is in it.
    names_open: Counter = Counter()
    linked = 0
    #: Names of dropped elements without a further end tag, looked for once.
    never_ended: set[str] = set()

    def close_from(k: int) -> None:
        names_open.subtract(t for t, _ in stack[k:])
        del stack[k:]

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                names = frozenset().union(*(n for _, n in stack)) if stack else frozenset()
                nearest = next((n for _, n in reversed(stack) if n), frozenset()) if names else names
                out.append(Block(text, tuple(t for t, _ in stack), names, nearest, linked, len(out)))
            pieces.clear()
        linked = 0

    at, in_head = 0, False
    while True:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if in_head and piece and not piece.isspace():
            in_head = False
        if piece and not in_head:
            piece = html.unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            if names_open["a"] > 0:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if close:
            if name == "head":
                in_head = False
            if name not in INLINE:
                end_block()
            for k in range(len(stack) - 1, -1, -1) if names_open[name] > 0 else ():
                if stack[k][0] == name:
                    if name in INLINE and any(t not in INLINE for t, _ in stack[k + 1 :]):
                        del stack[k]  # a block inside an inline element outlives it
                        names_open[name] -= 1
                    else:
                        close_from(k)
                    break
            continue
        if in_head and name not in IN_HEAD:
            in_head = False
        if name in RAW:
            stop = _RAW_END[name].search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if name in DROPPED:
            if not attrs.endswith("/") and name not in never_ended:
                stop = _RAW_END[name].search(page, at)
                at = stop.end() if stop else at
                if not stop:
                    never_ended.add(name)
            continue
        if name == "head":
            in_head = True
            continue
        if name not in INLINE:
            end_block()
            if name != "br" and name != "hr":
                ends = CLOSES.get(name, set()) | {"p"}
                for k in range(len(stack) - 1, -1, -1) if any(names_open[t] > 0 for t in ends) else ():
                    t = stack[k][0]
                    if t in ends:
                        close_from(k)
                        break
                    if t in CONTAINERS:
                        break
        if name in VOID or attrs.endswith("/") and name in INLINE:
            continue
        names = frozenset(p for v in _NAMES.findall(attrs) for p in _PARTS.findall((v[0] or v[1] or v[2]).lower())) if "=" in attrs else frozenset()
        stack.append((name, names))
        names_open[name] += 1
    end_block()
    return out
