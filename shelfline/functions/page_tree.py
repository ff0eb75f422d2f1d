"""Excerpts of pages: nodes found by selectors and written out again.

A page becomes a tree of nodes as its tags stand: an end tag closes what is open down to its
start tag, a stray one closes nothing, and nothing is closed by implication. Selectors are
compiled once: a chain of simple tests with the descendant and child combinators; a simple
test is a tag, classes, an id, attributes (present or equal) and ``:nth-of-type(n)``.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .markup import Markup
from .page_facts import VOID

#: Attributes that are lists of words, and elements whose text is not escaped.
WORD_LISTS = {"class", "accesskey", "dropzone", "rel", "rev", "headers"}
PLAIN = {"script", "style"}


class Node:
    """An element: what it says of itself, its place among siblings of its tag (from 1), and what it holds (text or nodes)."""

    __slots__ = ("tag", "attrs", "parent", "place", "held", "counts")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None):
        self.tag, self.attrs, self.parent, self.held, self.counts, self.place = tag, attrs, parent, [], {}, 1
        if parent is not None:
            self.place = parent.counts[tag] = parent.counts.get(tag, 0) + 1
            parent.held.append(self)


class _Builder(Markup):
    def __init__(self) -> None:
        super().__init__()
        self.root = Node("", {}, None)
        self.at, self.open, self.nodes = self.root, defaultdict(int), []

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        while self.open[tag] > 0:
            closed, self.at = self.at, self.at.parent
            self.open[closed.tag] -= 1
            if closed.tag == tag:
                break

    def handle_data(self, data):
        self.at.held.append(data)

    def handle_comment(self, data):
        self.at.held.append(("<!--", data, "-->"))


def nodes_of(html: str | None) -> list[Node]:
    """A page's elements in document order."""
    builder = _Builder()
    builder.read(html or "")
    return builder.nodes


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _attribute(name: str, value: str | None) -> str:
    if value is None:
        return f' {name}=""'
    value = _escaped(" ".join(value.split()) if name in WORD_LISTS else value)
    if '"' in value and "'" not in value:
        return f" {name}='{value}'"
    return f' {name}="' + value.replace('"', "&quot;") + '"'


def written_out(node: Node) -> str:
    """A node as markup again. Works through a list of what is left, so depth is no limit."""
    out, left = [], [node]
    while left:
        x = left.pop()
        if isinstance(x, Node):
            start = x.tag + "".join(_attribute(k, v) for k, v in x.attrs.items())
            if x.tag in VOID:
                out.append(f"<{start}/>")
                continue
            out.append(f"<{start}>")
            left.append(("", f"</{x.tag}>", ""))
            left += [("", h, "") if isinstance(h, str) and x.tag in PLAIN else h for h in reversed(x.held)]
        else:
            out.append(_escaped(x) if isinstance(x, str) else "".join(x))
    return "".join(out)


_SIMPLE = re.compile(r"""(?P<tag>^[\w-]+|^\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:=\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+)))?\s*\]|:nth-of-type\(\s*(?P<nth>\d+)\s*\)""")


@functools.lru_cache(maxsize=4096)
def _words(text: str) -> frozenset:
    return frozenset(text.split())


class Selector:
    """A compiled chain of simple tests; raises ValueError for what isn't one."""

    def __init__(self, text: str):
        # Spaces and > inside brackets are no combinators.
        held: list[str] = []
        bare = re.sub(r"\[[^\]]*\]", lambda m: held.append(m[0]) or f"[{len(held) - 1}]", text.strip())
        parts = [p for p in re.split(r"(\s*>\s*|\s+)", bare) if p]
        self.tests = [self._simple(re.sub(r"\[(\d+)\]", lambda m: held[int(m[1])], p)) for p in parts[::2]]
        self.steps = [">" if ">" in p else " " for p in parts[1::2]]
        if not self.tests or len(self.steps) != len(self.tests) - 1:
            raise ValueError(f"no selector: {text!r}")

    @staticmethod
    def _simple(text: str) -> tuple:
        at, tag, classes, attrs, nth = 0, None, set(), {}, None
        while at < len(text):
            m = _SIMPLE.match(text, at) if at == 0 or text[at] in ".#[:" else None
            if not m:
                raise ValueError(f"no selector: {text!r}")
            if m["tag"]:
                tag = None if m["tag"] == "*" else m["tag"].lower()
            elif m["cls"]:
                classes.add(m["cls"])
            elif m["id"]:
                attrs["id"] = m["id"]
            elif m["nth"]:
                nth = int(m["nth"])
            else:
                attrs[m["attr"].lower()] = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), None)
            at = m.end()
        return tag, classes, attrs, nth

    @staticmethod
    def _passes(test: tuple, node: Node) -> bool:
        tag, classes, attrs, nth = test
        if node.parent is None or (tag is not None and node.tag != tag) or (nth is not None and node.place != nth):
            return False
        if classes and not classes <= _words(node.attrs.get("class") or ""):
            return False
        return not attrs or all(k in node.attrs and (v is None or (node.attrs[k] or "") == v) for k, v in attrs.items())

    def matches(self, node: Node) -> bool:
        """Whether the node passes the last test and its ancestors, in some way, the others: sets of tests passed go up the tree once."""
        if not self._passes(self.tests[-1], node):
            return False
        wanted, node = {len(self.tests) - 2}, node.parent
        anywhere: set[int] = set()
        while True:
            if -1 in wanted:
                return True
            # A test behind a descendant combinator may be passed by any further ancestor, one behind > by the next alone.
            anywhere |= {k for k in wanted if self.steps[k] == " "}
            if node is None:
                return False
            wanted = {k - 1 for k in wanted | anywhere if self._passes(self.tests[k], node)}
            node = node.parent


@functools.lru_cache(maxsize=256)
def _compiled(text: str) -> Selector:
    return Selector(text)


def excerpt(html: str | None, selectors: list[str]) -> str:
    """All nodes that selectors find, selector by selector in document order, each text once, one a line."""
    nodes, found = nodes_of(html), {}
    for text in selectors:
        chosen = _compiled(text)
        for node in nodes:
            if chosen.matches(node):
                found.setdefault(written_out(node))
    return "\n".join(found)


def html_excerpt(*selectors: str):
    """A column function: the excerpt of a page by some selectors; null for null."""
    for s in selectors:
        Selector(s)

    @F.pandas_udf(T.StringType())
    def cut(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in pages:
            yield pd.Series([None if h is None else excerpt(h, list(selectors)) for h in html], dtype=object)

    return cut
