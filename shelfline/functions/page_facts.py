"""What the extraction rules need to know of a page: its JSON-LD product and its telling elements.

One small helper walks the page's tags once and returns plain values; the rules' precedence,
confidence and gates are column expressions in ``operators.extract``. A page that cannot be
read in some respect gives nulls there and never fails the job.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import json
import re
import socket
import unicodedata
from collections import defaultdict
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .markup import Markup

#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: A site's telling elements, each by the steps that lead to it: tag or None, and classes.
SITE_ELEMENTS = {
    "main": ((None, {"product_main"}), ("h1", set())),
    "stock": ((None, {"availability"}),),
    "price": ((None, {"price_color"}),),
    "shown": ((None, {"item", "active"}), ("img", set())),
    "cell": (("table", {"table-striped"}), ("tr", set()), ("th", set())),
    "datum": (("table", {"table-striped"}), ("tr", set()), ("td", set())),
    "listed": (("article", {"product_pod"}), ("h3", set()), ("a", set())),
}

_TEXT = T.StringType()
LINKED = T.StructType([T.StructField(f, _TEXT) for f in ("name", "brand", "category", "image", "sku", "availability", "price", "currency")])
FACTS = T.StructType([
    T.StructField("fingerprint", _TEXT), T.StructField("linked", LINKED), T.StructField("found", T.MapType(_TEXT, _TEXT)),
    T.StructField("site_links", T.ArrayType(_TEXT)), T.StructField("links", T.ArrayType(_TEXT)),
])


def _semantic(tag: str, attrs: dict[str, str]):
    """What a start tag may be to the semantic rules: a name, and the attributes that hold its value."""
    prop, item = attrs.get("property") if tag == "meta" else None, attrs.get("itemprop")
    if prop in ("og:title", "og:image"):
        yield prop, ("content",)
    if tag == "h1":
        yield "h1", ()
    if item == "price" or prop == "product:price:amount" or "data-price" in attrs:
        yield "amount", ("content", "data-price")
    if item == "priceCurrency" or prop == "product:price:currency":
        yield "money", ("content",)
    if item == "availability" or "data-availability" in attrs:
        yield "state", ("content", "href", "data-availability")
    if tag == "link" and attrs.get("rel") == "canonical":
        yield "canonical", ("href",)


@functools.lru_cache(maxsize=4096)
def _told(tag: str, attrs: tuple) -> tuple:
    """What a start tag says by itself, whatever page it stands in: most tags of a site's pages are the same ones again.

    Its attributes, classes and signature, what it may be to the semantic rules with the values that it
    holds, and the site elements whose last step it passes.
    """
    found: dict[str, str] = {}
    for k, v in attrs:
        found[k] = v or ""  # of a repeated attribute the last counts
    words = found.get("class", "").split()
    classes = frozenset(words)
    may_be = tuple((name, {f"{name}@{a}": found[a] for a in holds if a in found}) for name, holds in _semantic(tag, found))
    sites = tuple((name, steps) for name, steps in SITE_ELEMENTS.items() if steps[-1][0] in (None, tag) and steps[-1][1] <= classes)
    return found, classes, ".".join([tag, *sorted(words)[:3]]), may_be, sites


class _Walker(Markup):
    """Signatures of start tags, the first element of each kind that a rule may want, and JSON-LD scripts."""

    def __init__(self) -> None:
        super().__init__()
        self.signatures: dict[str, int] = defaultdict(int)
        self.scripts: list[str] = []
        #: Open elements as (tag, classes, collected text or None), how many of each tag are open, and those whose text is collected.
        self.open: list[tuple[str, frozenset, list | None]] = []
        self.names: dict[str, int] = defaultdict(int)
        self.hearing: list[list[str]] = []
        self.values: dict[str, str] = {}
        self.texts: dict[str, list[str]] = {}
        self.cells: list[tuple[str, int, list[str]]] = []
        self.rows = 0
        self.site_links: list[str | None] = []
        self.links: list[str | None] = []
        self.script = False

    def _leads_here(self, steps) -> bool:
        """Whether the open elements pass the steps before the last."""
        k = len(steps) - 2
        for name, has, _ in reversed(self.open) if k >= 0 else ():
            wanted, own = steps[k]
            if (wanted is None or wanted == name) and own <= has:
                k -= 1
                if k < 0:
                    break
        return k < 0

    def handle_starttag(self, tag, attrs):
        found, classes, signature, may_be, sites = _told(tag, tuple(attrs))
        self.signatures[signature] += 1
        self.rows += tag == "tr"
        said: list[str] | None = None
        for name, values in may_be:
            if name not in self.texts:
                said = said if said is not None else []
                self.texts[name] = said
                self.values.update(values)
        for name, steps in sites:
            if not self._leads_here(steps):
                continue
            if name in ("cell", "datum"):
                said = said if said is not None else []
                self.cells.append((name, self.rows, said))
            elif name == "listed":
                self.site_links.append(found.get("href") or found.get("data-product-url") or None)
            elif f"site:{name}" not in self.texts:
                said = said if said is not None else []
                self.texts[f"site:{name}"] = said
                if "src" in found:
                    self.values[f"site:{name}@src"] = found["src"]
        if tag == "a" and ("data-product-url" in found or found.get("rel") == "product"):
            self.links.append(found.get("href") or found.get("data-product-url") or None)
        self.script = tag == "script" and found.get("type") == "application/ld+json"
        if self.script:
            self.scripts.append("")
        if tag not in VOID:
            self.open.append((tag, classes, said))
            self.names[tag] += 1
            if said is not None:
                self.hearing.append(said)

    def handle_endtag(self, tag):
        if not self.names[tag]:
            return
        while self.open:
            name, _, said = self.open.pop()
            self.names[name] -= 1
            if said is not None:
                self.hearing.pop()
            if name == tag:
                return

    def handle_data(self, data):
        if self.open and self.open[-1][0] in ("script", "style"):
            if self.script and self.open[-1][0] == "script":
                self.scripts[-1] += data
            return
        said = data.strip()
        if said:
            for text in self.hearing:
                text.append(said)

    def found(self) -> dict[str, str]:
        out = self.values | {name: " ".join(text) for name, text in self.texts.items()}
        first = {}
        for name, row, text in self.cells:
            if name == "datum":
                first.setdefault(row, " ".join(text))
        for name, row, text in self.cells:  # the last row of a heading counts, as in a dictionary
            if name == "cell":
                out[f"cell:{' '.join(text)}"] = first.get(row)
        return out


_LONE = re.compile("[\ud800-\udfff]")


def _str(x) -> str | None:
    """A value as text; halves of surrogate pairs, which JSON may hold and no column can, become U+FFFD."""
    return None if x is None else _LONE.sub("\ufffd", str(x))


def linked_product(scripts: list[str]) -> dict | None:
    """Of all JSON-LD scripts, the first candidate that is a product; lists and graphs give their items, level by level."""
    for text in scripts:
        try:
            queue = json.loads(text)
        except (ValueError, RecursionError):
            continue
        queue = list(queue) if isinstance(queue, list) else [queue]
        for item in queue:  # grows as graphs are met
            if not isinstance(item, dict):
                continue
            kinds = item.get("@type")
            if any(str(k).lower() == "product" for k in (kinds if isinstance(kinds, list) else [kinds])):
                return item
            graph = item.get("@graph")
            queue += graph if isinstance(graph, list) else []
    return None


def _linked_fields(item: dict) -> dict:
    one = lambda x: (x[0] if x else None) if isinstance(x, list) else x
    offers = one(item.get("offers") or {})
    offers = offers if isinstance(offers, dict) else {}
    brand = item.get("brand")
    found = {
        "name": item.get("name"), "brand": brand.get("name") if isinstance(brand, dict) else brand, "category": item.get("category"), "image": one(item.get("image")),
        "sku": item.get("sku") or item.get("productID"), "availability": offers.get("availability"), "price": offers.get("price"), "currency": offers.get("priceCurrency"),
    }
    try:
        return {k: None if v == [] else _str(v) for k, v in found.items()}
    except RecursionError:
        return dict.fromkeys(found)


def facts_of(html: str | None) -> tuple:
    w = _Walker()
    w.read(html or "")
    item = linked_product(w.scripts)
    payload = "|".join(f"{k}:{w.signatures[k]}" for k in sorted(w.signatures))
    return hashlib.sha256(payload.encode("utf-8", "surrogatepass")).hexdigest()[:16], _linked_fields(item) if item else None, w.found(), w.site_links, w.links


@F.pandas_udf(FACTS)
def page_facts(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([facts_of(h) for h in html], columns=[f.name for f in FACTS])


@F.pandas_udf(T.StringType())
def url_join(base: pd.Series, url: pd.Series) -> pd.Series:
    """A reference resolved against its base, null if it is no URL; Spark has no built-in for it."""

    def one(b, u):
        try:
            return None if b is None else urljoin(b, u or "")
        except ValueError:
            return None

    return pd.Series([one(b, u) for b, u in zip(base, url)], dtype=object)


def _is_public(address: str) -> bool | None:
    """Whether an address is public, those inside IPv6 forms of an IPv4 address included; null for names."""
    # Resolvers fold digits and dots of other scripts to ASCII and take a trailing dot for the root.
    address = unicodedata.normalize("NFKC", address).replace("\u3002", ".").removesuffix(".")
    try:
        ip = ipaddress.ip_address(address.strip("[]").partition("%")[0])
    except ValueError:
        # Forms that resolvers take for IPv4 addresses without asking anyone: one number, octal, hexadecimal, fewer parts.
        if not address or not all(c in "0123456789abcdefx." for c in address) or not address[0].isdigit():
            return None
        try:
            ip = ipaddress.ip_address(socket.inet_aton(address))
        except OSError:
            return None
    if ip.version == 6:
        inner = ip.ipv4_mapped or ip.sixtofour or (ipaddress.ip_address(int(ip) & 0xFFFFFFFF) if ip in ipaddress.ip_network("64:ff9b::/96") else None)
        if inner is not None:
            return inner.is_global
        if ip.is_site_local:
            return False
    return ip.is_global and not ip.is_multicast


@F.pandas_udf(T.BooleanType())
def ip_is_global(address: pd.Series) -> pd.Series:
    """Whether a literal address is public by the registry that Python has; null for names."""
    return pd.Series([None if x is None else _is_public(x.lower()) for x in address], dtype=object)


@F.pandas_udf(T.BooleanType())
def all_global(addresses: pd.Series) -> pd.Series:
    """Whether all of an array of addresses are public; null for a null or empty one."""
    return pd.Series([None if x is None or not len(x) else all(a is not None and _is_public(a.lower()) is True for a in x) for x in addresses], dtype=object)


@F.pandas_udf(T.BooleanType())
def robots_allowed(rules: pd.Series, agent: pd.Series, url: pd.Series) -> pd.Series:
    """Whether a robots document lets an agent fetch a URL, null for no URL; each distinct document of a batch is read once. No document allows all."""
    known: dict[str, RobotFileParser] = {}
    out = []
    for text, who, u in zip(rules, agent, url):
        if u is None:
            out.append(None)
            continue
        if text not in known:
            known[text] = RobotFileParser()
            known[text].parse((text or "").splitlines())
        try:
            out.append(known[text].can_fetch(who or "*", u))
        except ValueError:
            out.append(None)
    return pd.Series(out, dtype=object)
