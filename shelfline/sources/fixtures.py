"""Deterministic product pages from columns: the page variants that extraction is tested on.

The pages are of an invented shop. Each variant tells the product in another way; where a
variant needs a site's class names or markup vocabularies, it uses them in a layout of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BRAND, CATEGORY, SHOP = "Quill & Fern", "Homeware", "https://shop.example"
VARIANTS = ("jsonld", "selector", "semantic", "missing", "malformed", "dynamic", "listing")


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _fill(template: str, **values: Column) -> Column:
    """A template with its ``[name]`` places filled."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"[{name}]"), value)
    return out


def _linked(n: Column, title: Column, price: Column) -> Column:
    """A JSON-LD graph: the site, then the product with one offer."""
    offer = F.struct(F.lit("Offer").alias("@type"), F.lit("EUR").alias("priceCurrency"), price.alias("price"), F.lit("https://schema.org/LimitedAvailability").alias("availability"))
    product = F.struct(
        F.lit("Product").alias("@type"), title.alias("name"), F.concat(F.lit("QF-"), n).alias("sku"), F.lit(CATEGORY).alias("category"),
        F.struct(F.lit("Brand").alias("@type"), F.lit(BRAND).alias("name")).alias("brand"), F.array(F.concat(F.lit("/media/"), n, F.lit(".webp"))).alias("image"), F.array(offer).alias("offers"),
    )
    return F.concat(F.lit('{"@graph": [{"@type": "WebSite", "name": "Quill and Fern"}, '), F.to_json(product), F.lit("]}"))


#: What every variant but the listing begins with.
_HEAD = '<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>Shop</title>[extra]</head>'
_CANONICAL = '<link href="/items/[n]" rel="canonical">'
_BODIES = {
    "jsonld": '<body class="shop"><nav class="top"><a href="/">Home</a></nav><section class="wide detail"><h1>[title]</h1><p>Made to order.</p></section></body></html>',
    "selector": """<body class="shop"><div class="two-columns product_main"><h1>[title]</h1><p class="big price_color">£[price]</p><p class="instock availability">
  In stock </p></div>
<div class="carousel"><div class="slide item"><img src="/media/none.webp"></div><div class="slide active item"><img alt="" src="/media/[n].webp"></div></div>
<table class="table-striped facts"><tbody><tr><th>UPC</th><td>U[n]</td></tr><tr><th>Product Type</th><td>Homeware</td></tr><tr><th>Price (excl. tax)</th><td>£1.00</td></tr>
<tr><th>Price (incl. tax)</th><td>£[price]</td></tr><tr><th>Availability</th><td>Low stock (3 left)</td></tr></tbody></table></body></html>""",
    "semantic": '<body><main class="card new"><p itemprop="description">A thing.</p><span class="money" data-price="[price]">from [price]</span><link itemprop="availability" href="https://schema.org/PreOrder"></main></body></html>',
    "missing": '<body><main class="card"><h1 class="name">[title]</h1><p>Ask us for the price.</p></main></body></html>',
    "malformed": '<body><main><h1>[title]</h1><b itemprop="price" content="[price]">?</b><i itemprop="priceCurrency" content="EUR"></i><i data-availability="InStock"></i></main></body></html>',
    "dynamic": '<body><div id="app" data-item="[n]"></div><script>render([n])</script></body></html>',
    "listing": """<html><body><ul><li><article class="card product_pod"><h3><a class="name" href="/items/[n]/">One</a></h3></article></li>
<li><article class="product_pod card"><h3><a class="name" href="/items/[next]/">Two</a></h3></article></li><li><article class="product_pod"><h3><a href="/items/[n]/">One again</a></h3><a href="/cart">Buy</a></article></li></ul>
<h3><a href="/help">Help</a></h3></body></html>""",
}
_EXTRAS = {
    "jsonld": _CANONICAL + '<script type="application/ld+json">[linked]</script>',
    "selector": _CANONICAL,
    "semantic": '<meta content="[title]" property="og:title"><meta property="product:price:currency" content="EUR">' + _CANONICAL,
    "missing": _CANONICAL,
    "malformed": '<script type="application/ld+json">{"@type": "Product", "name": </script>' + _CANONICAL,
    "dynamic": "",
}


def page(variant: str, i: Column, title: Column, price: Column) -> Column:
    """The html of one of VARIANTS."""
    n = i.cast("string")
    template = _BODIES[variant] if variant == "listing" else _HEAD.replace("[extra]", _EXTRAS[variant]) + _BODIES[variant]
    values = {"n": n, "next": (i + 1).cast("string"), "price": price, "linked": _linked(n, title, price), "title": _escaped(title)}
    return _fill(template, **{k: v for k, v in values.items() if f"[{k}]" in template})


def _values(i: str, title: str | None, price: str | None) -> tuple[Column, Column, Column]:
    k = F.col(i)
    t = F.col(title) if title else F.concat(F.lit("Kettle No. "), k.cast("string"))
    return k, t, F.col(price).cast("string") if price else F.concat((F.lit(5) + k % 190).cast("string"), F.lit(".49"))


def product_pages(rows: DataFrame, variant: str, i: str, title: str | None = None, price: str | None = None, source: str = "generic") -> DataFrame:
    """``id, url, source, title_in, price_in, html`` for each row; titles and prices are made from the id where none is named."""
    k, t, p = _values(i, title, price)
    return rows.select(k.alias("id"), F.concat(F.lit(f"{SHOP}/items/"), k.cast("string")).alias("url"), F.lit(source).alias("source"), t.alias("title_in"), p.alias("price_in"), page(variant, k, t, p).alias("html"))


def rendered_pages(rows: DataFrame, i: str, title: str | None = None, price: str | None = None) -> DataFrame:
    """Pages built by scripts: ``html`` as fetched, without a product, and ``rendered`` as a browser would give it."""
    k, t, p = _values(i, title, price)
    return product_pages(rows.withColumns({"_k": k, "_t": t, "_p": p}), "dynamic", "_k", "_t", "_p").withColumn("rendered", page("semantic", F.col("id"), F.col("title_in"), F.col("price_in")))


def unstable_responses(rows: DataFrame, i: str, failures: int) -> DataFrame:
    """``id, attempt, status_code, retry_after, html``: so many times 429, then the page."""
    k, t, p = _values(i, None, None)
    tries = rows.select(k.alias("id"), t.alias("_t"), p.alias("_p"), F.explode(F.sequence(F.lit(1), F.lit(failures + 1))).alias("attempt"))
    ok = F.col("attempt") > failures
    return tries.select("id", "attempt", F.when(ok, 200).otherwise(429).alias("status_code"), F.when(~ok, "0").alias("retry_after"), F.when(ok, page("jsonld", F.col("id"), F.col("_t"), F.col("_p"))).alias("html"))
