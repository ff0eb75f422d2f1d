"""Product extraction: evidence by JSON-LD, then site selectors, then semantic markup, as column rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.page_facts import page_facts, url_join
from ..functions.scalars import availability, price_amount, price_currency
from ..sources.schemas import EVIDENCE
from .quality import confidence, coverage, needs_browser, warnings


def _full(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _found(name: str) -> Column:
    """What the page walk found under a name, null if nothing."""
    return F.try_element_at(F.col("_found"), F.lit(name))


@dataclass(frozen=True)
class Evidence:
    """Where a field's value comes from: an expression over facts, its method, confidence and selector."""

    field: str
    value: Column
    method: str
    confidence: float
    selector: str


def _linked_rules() -> list[Evidence]:
    p = lambda f: F.col("_linked")[f]
    rows = [
        ("title", p("name"), 0.99, "$.name"), ("brand", p("brand"), 0.98, "$.brand"), ("category", p("category"), 0.98, "$.category"), ("image_url", p("image"), 0.98, "$.image"),
        ("external_id", p("sku"), 0.99, "$.sku"), ("availability", availability(p("availability")), 0.98, "$.offers.availability"),
        ("price_amount", price_amount(p("price")), 0.99, "$.offers.price"), ("currency", price_currency(p("price"), p("currency")), 0.99, "$.offers.priceCurrency"),
    ]
    return [Evidence(f, v, "json_ld", c, s) for f, v, c, s in rows]


def _with(found: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns added or replaced behind a one-row generator, which the optimizer doesn't fold into later steps."""
    return found.select(*(c for c in found.columns if c not in columns), F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


# Each step below names its intermediate values as columns, so later steps refer to them instead of
# repeating their expressions: plans stay small, and nothing is computed twice.


def _books_columns(found: DataFrame) -> DataFrame:
    """The site's price and stock: the table's cell, or else the line beside the title."""
    return _with(found, {
        "_site_price": F.coalesce(_full(_found("cell:Price (incl. tax)")), _found("site:price")),
        "_site_stock": F.coalesce(_full(_found("cell:Availability")), _found("site:stock")),
    })


def _books_rules() -> list[Evidence]:
    #: Confidences and selectors of the site's rules.
    price = F.col("_site_price")
    rows = [
        ("title", _found("site:main"), 0.97, ".product_main h1"), ("external_id", _found("cell:UPC"), 0.99, "table:UPC"), ("category", _found("cell:Product Type"), 0.96, "table:Product Type"),
        ("availability", F.col("_site_stock"), 0.96, "table:Availability"), ("price_amount", price_amount(price), 0.98, "table:Price (incl. tax)"),
        ("currency", price_currency(price, F.lit(None).cast("string")), 0.98, "table:Price (incl. tax)"), ("image_url", _found("site:shown@src"), 0.95, ".item.active img"),
    ]
    return [Evidence(f, v, "source_selector", k, s) for f, v, k, s in rows]


#: Site rules by source: what adds their columns, and the rules over these. A source without an entry has none.
SITES = {"books_to_scrape": (_books_columns, _books_rules)}


def _semantic_columns(found: DataFrame) -> DataFrame:
    first = lambda name, *attrs: F.coalesce(*(_full(_found(f"{name}@{a}")) for a in attrs), _found(name))
    return _with(found, {
        "_amount": first("amount", "content", "data-price"), "_money": _found("money@content"), "_state": first("state", "content", "href", "data-availability"),
        "_title": F.when(_found("og:title").isNotNull(), _found("og:title@content")).otherwise(_found("h1")),
        "_og_image": _found("og:image@content"), "_canonical": _found("canonical@href"),
    })


def _semantic_rules(have: Column) -> list[Evidence]:
    """Fallbacks for fields still absent; the currency is looked for only if the price is absent."""
    absent = lambda f, v: F.when(~F.map_contains_key(have, F.lit(f)), v)
    c = F.col
    rows = [
        ("title", absent("title", c("_title")), 0.86, "og:title|h1"), ("image_url", absent("image_url", c("_og_image")), 0.85, "og:image"),
        ("price_amount", absent("price_amount", price_amount(c("_amount"))), 0.84, "itemprop=price"), ("currency", absent("price_amount", price_currency(c("_amount"), c("_money"))), 0.84, "itemprop=priceCurrency"),
        ("availability", absent("availability", availability(c("_state"))), 0.82, "itemprop=availability"),
    ]
    out = [Evidence(f, v, "semantic_fallback", k, s) for f, v, k, s in rows]
    return [*out, Evidence("external_id", absent("external_id", c("_url")), "derived", 0.8, "canonical_url")]


def _lay(found: DataFrame, rules: list[Evidence], when: Column | None = None) -> DataFrame:
    """Evidence of some rules laid over ``_e``: null and empty values leave what was there, others replace it."""
    entries = [F.struct(F.lit(r.field).alias("key"), F.struct(r.value.alias("value"), F.lit(r.method).alias("source"), F.lit(r.confidence).alias("confidence"), F.lit(r.selector).alias("selector")).alias("value")) for r in rules]
    none = F.expr(f"CAST(map() AS {EVIDENCE})")
    found = _with(found, {"_new": F.array(*entries) if when is None else F.when(when, F.array(*entries))})
    full = F.filter("_new", lambda e: F.coalesce(e["value"]["value"] != "", F.lit(False)))
    found = _with(found, {"_new": F.coalesce(F.map_from_entries(full).cast(EVIDENCE), none)})
    # The one above counts whatever the session's map settings.
    return _with(found, {"_e": F.map_concat(F.map_filter("_e", lambda k, v: ~F.map_contains_key(F.col("_new"), k)), "_new")})


def parse_products(pages: DataFrame, url: str = "url", html: str = "html", source: str = "source") -> DataFrame:
    """Every page with its ``dom_fingerprint, field_evidence, required_field_coverage, warnings`` and product columns.

    A page without a title is no product: its product columns are null and its one warning says so.
    """
    found = pages.withColumns({"_facts": page_facts(F.col(html)), "_url": F.col(url), "_source": F.col(source)})
    found = _with(found, {"_found": F.col("_facts.found"), "_linked": F.col("_facts.linked"), "_print": F.col("_facts.fingerprint"), "_e": F.expr(f"CAST(map() AS {EVIDENCE})")})
    found = _lay(found, _linked_rules(), F.col("_linked").isNotNull())
    for name, (columns, rules) in SITES.items():
        found = _lay(columns(found), rules(), F.col("_source") == name)
    found = _semantic_columns(found)
    found = _lay(found, _semantic_rules(F.col("_e"))).withColumn("field_evidence", F.col("_e"))
    e = F.col("field_evidence")
    value = lambda f: F.try_element_at(e, F.lit(f))["value"]
    titled = F.map_contains_key(e, F.lit("title"))
    found = _with(found, {"_base": F.col("_url"), "_ref": _full(F.col("_canonical")), "_image": F.coalesce(value("image_url"), F.lit(""))})
    out = found.withColumns({
        "dom_fingerprint": F.col("_print"), "required_field_coverage": coverage(e), "warnings": warnings(e),
        **{f: F.when(titled, value(f)) for f in ("title", "external_id", "price_amount", "currency", "availability", "brand", "category")},
        "canonical_url": F.when(titled, F.coalesce(url_join(F.col("_base"), F.col("_ref")), F.col("_base"))),
        # A missing image gives the page's own URL.
        "image_url": F.when(titled, url_join(F.col("_base"), F.col("_image"))),
        "confidence": F.when(titled, confidence(e)),
    })
    return out.select(*dict.fromkeys([*pages.columns, *(c for c in out.columns if not c.startswith("_"))]))


def parse_rendered(pages: DataFrame, mode: str = "mode", rendered: str = "rendered", url: str = "url", html: str = "html", source: str = "source") -> DataFrame:
    """Products of pages as fetched; where the mode or a poor coverage asks for rendering, those of the rendered page, if there is one.

    ``was_rendered`` says which. Only pages that need it are parsed twice, in one pass over the rows.
    """
    once = parse_products(pages, url, html, source)
    names = [c for c in once.columns if c not in pages.columns]
    held = once.select(*pages.columns, F.struct(*names).alias("_first"))
    held = held.withColumn("_again", F.coalesce(needs_browser(F.col(mode), F.col("_first.required_field_coverage")), F.lit(False)))
    held = held.withColumn("_page", F.when(F.col("_again"), F.coalesce(rendered, html)))  # null, and so parsed at no cost, where once was enough
    twice = parse_products(held, url, "_page", source)
    chosen = [F.when(F.col("_again"), F.col(c)).otherwise(F.col("_first")[c]).alias(c) for c in names]
    return twice.select(*pages.columns, *chosen, (F.col("_again") & F.col(rendered).isNotNull()).alias("was_rendered"))


def product_links(pages: DataFrame, keys: list[str], url: str = "url", html: str = "html", source: str = "source") -> DataFrame:
    """``keys, at, link``: absolute product links of each page, ``at`` their order in the document. References are told once, links may repeat.

    The references stand behind a one-row generator: a filter for pages that have some would be
    put before the step that deals pages over all cores otherwise, and walk them all there, in few tasks, for itself.
    """
    listing = pages.select(*keys, F.col(url).alias("_base"), (F.col(source) == "books_to_scrape").alias("_books"), page_facts(F.col(html)).alias("_f"))
    refs = F.when(F.col("_books"), F.col("_f.site_links")).otherwise(F.col("_f.links"))
    each = _with(listing, {"_refs": F.array_distinct(refs)}).select(*keys, "_base", F.posexplode("_refs").alias("at", "_ref")).filter(F.col("_ref").isNotNull())
    each = _with(each.withColumn("_link", url_join(F.col("_base"), F.col("_ref"))), {"link": F.col("_link")})
    return each.filter(F.col("link").isNotNull()).select(*keys, "at", "link")


def discover_links(pages: DataFrame, key: str, url: str = "url", html: str = "html", source: str = "source") -> DataFrame:
    """``key, position, link``: absolute product links, each once, in document order."""
    each = product_links(pages, [key], url, html, source).groupBy(key, "link").agg(F.min("at").alias("_at"))
    return each.select(key, F.row_number().over(Window.partitionBy(key).orderBy("_at")).alias("position"), "link")


def extraction_path(evidence: Column, fields: list[str]) -> Column:
    """The methods that gave the required fields, each once, in order."""
    e = F.transform(F.array(*map(F.lit, fields)), lambda f: F.try_element_at(evidence, f)["source"])
    return F.array_distinct(F.filter(e, lambda x: x.isNotNull()))


def decision(title: Column, reason: Column) -> Column:
    """What a preview says of a page: rejected without a title, review with a reason, else eligible."""
    return F.when(title.isNull(), "rejected").when(reason.isNotNull(), "review").otherwise("eligible")
