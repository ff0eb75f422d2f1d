"""Reading a page's markup: the standard library's parser, and one expression for pages that are plain enough for it."""

from __future__ import annotations

import functools
import re
from html import unescape
from html.parser import HTMLParser

_WS = r"[ \t\r\n\f]"
_ATTR = rf"""{_WS}+([a-zA-Z][a-zA-Z0-9:_-]*)(?:(=)(?:"([^"&<>]*)"|'([^'&<>]*)'))?"""
_ATTRS = rf"""((?:{_WS}+[a-zA-Z][a-zA-Z0-9:_-]*(?:=(?:"[^"&<>]*"|'[^'&<>]*'))?)*){_WS}*"""
#: An element with its text as it stands, a start tag, an end tag, text before a tag, text at the end; the last group is whatever is none of these.
_TOKEN = re.compile(rf"<(script|style|title|textarea){_ATTRS}>([^<]*)</\1>|<([a-zA-Z][a-zA-Z0-9]*){_ATTRS}>|</([a-zA-Z][a-zA-Z0-9]*)>|([^<]+(?=<)|[^<&]+$)|<!(?:doctype|DOCTYPE) html>|([\s\S])")
_PAIR = re.compile(_ATTR)
#: Elements whose insides some version of the parser reads by rules of their own, and those whose text is not unescaped.
_OWN_RULES = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}
_RAW = {"script", "style"}


@functools.lru_cache(maxsize=4096)
def _pairs(text: str) -> tuple:
    return tuple((name.lower(), (double or single) if given else None) for name, given, double, single in _PAIR.findall(text))


class Markup(HTMLParser):
    """A parser of whole pages. Plain ones are cut into their tags by one expression, which makes the same calls in less than half the time."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)

    def read(self, html: str) -> None:
        tokens = _TOKEN.findall(html)
        if any(t[7] or t[3].lower() in _OWN_RULES for t in tokens):
            for step in (lambda: self.feed(html), self.close):
                try:
                    step()
                except AssertionError:  # declarations that the parser knows no rule for; what was read stays
                    pass
            return
        for own, own_attrs, inside, tag, attrs, end, text, _ in tokens:
            if tag:
                self.handle_starttag(tag.lower(), _pairs(attrs) if attrs else ())
            elif end:
                self.handle_endtag(end.lower())
            elif text:
                self.handle_data(unescape(text) if "&" in text else text)
            elif own:
                self.handle_starttag(own, _pairs(own_attrs) if own_attrs else ())
                if inside:
                    self.handle_data(inside if own in _RAW or "&" not in inside else unescape(inside))
                self.handle_endtag(own)
