"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .page_facts import all_global, ip_is_global

#: Symbols that tell a currency when they stand before the amount, and the pattern of an amount.
CURRENCIES = {"$": "USD", "£": "GBP", "€": "EUR", "₩": "KRW"}
_AMOUNT = "(?U)([$£€₩])?\\s*(\\d[\\d,]*(?:\\.\\d{1,2})?)"


def _found(c: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(F.replace(c, F.lit("\u00a0"), F.lit(" ")), _AMOUNT, group), F.lit(""))


def price_amount(text: Column) -> Column:
    """The leftmost number of a text as its decimal string, thousands separators dropped and its scale kept; null if there is none."""
    return F.replace(_found(text, 2), F.lit(","), F.lit(""))


def price_currency(text: Column, given: Column) -> Column:
    """The currency given, or that of the symbol before the leftmost number."""
    symbols = F.create_map(*(F.lit(x) for kv in CURRENCIES.items() for x in kv))
    return F.coalesce(F.nullif(given, F.lit("")), F.try_element_at(symbols, F.coalesce(_found(text, 1), F.lit(""))))


def availability(value: Column) -> Column:
    """The last path segment, trimmed."""
    return F.trim(F.substring_index(value, "/", -1))


def normalise_url(url: Column) -> Column:
    """All trailing slashes dropped."""
    return F.rtrim(url, F.lit("/"))


def http_class(status: Column, size: Column | None = None, limit: int = 5_000_000) -> Column:
    """What a response comes to: ``redirect``; ``response_too_large`` whatever its status; an error code; or ``ok``."""
    code = F.concat(F.lit("http_"), status.cast("string"))
    out = F.when(status.between(300, 399), "redirect")
    if size is not None:
        out = out.when(size > limit, "response_too_large")
    return out.when((status == 429) | (status >= 400), code).otherwise("ok")


def http_transient(status: Column) -> Column:
    return (status == 429) | (status >= 500)


def retry_after(value: Column, as_of: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number or an HTTP date, not below 0; null if neither."""
    seconds = value.try_cast("double")
    stamp = F.try_to_timestamp(F.substr(value, F.lit(6)), F.lit("dd MMM yyyy HH:mm:ss z"))
    late = (F.unix_micros(stamp) - F.unix_micros(as_of)) / 1e6
    wait = F.coalesce(seconds, late)
    return F.when(value.isNull() | (value == ""), None).otherwise(F.greatest(wait, F.when(wait.isNotNull(), 0.0)))


def backoff(attempt: Column, after: Column, base: float = 0.25, cap: float = 30.0, jitter: float = 0.2, seed: int | None = None) -> Column:
    """Seconds before the next attempt: what the server asked for within the cap, else exponential with jitter."""
    plain = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(cap))
    spread = plain if not jitter else F.greatest(plain * (1 + F.lit(jitter) * (2 * F.rand(seed) - 1)), F.lit(0.0))
    return F.when(after.isNotNull(), F.least(F.greatest(after, F.lit(0.0)), F.lit(cap))).otherwise(spread)


def split_hosts(text: Column) -> Column:
    """A comma list of hosts: trimmed, lower-cased, empty ones dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def host(url: Column) -> Column:
    """The host of a URL's authority, lower-cased. Spark's own HOST is null for forms that resolvers accept, such as hexadecimal addresses."""
    return F.lower(F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), "^(?:.*@)?(\\[[^\\]]*\\]|[^:]*)", 1))


def url_policy(url: Column, allowed: list[str], private_ok: list[str] = (), allow_private: bool = False, addresses: Column | None = None) -> Column:
    """Why a URL may not be fetched, or null: scheme and host, allowlist, name resolution, then addresses that are not public.

    ``addresses`` are those of the URL's host, from a table; a name without any is a
    ``dns_error``. Without them only hosts that are addresses themselves are judged.
    """
    name = host(url)
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    out = F.when(url.isNull() | scheme.isNull() | ~scheme.isin("http", "https") | name.isNull() | (name == ""), "invalid_url")
    if allowed:
        out = out.when(~name.isin([h.lower() for h in allowed]), "host_not_allowed")
    if not allow_private:
        held = name.isin(list(private_ok) or [""])
        literal = ip_is_global(name)
        out = out.when(~literal & ~held, "private_address")
        if addresses is not None:
            out = out.when(literal.isNull() & (F.coalesce(F.size(addresses), F.lit(0)) < 1), "dns_error")
            out = out.when(literal.isNull() & addresses_private(addresses) & ~held, "private_address")
    return out


def addresses_private(addresses: Column) -> Column:
    """True if any of an array of addresses is not public; what isn't an address counts as not public."""
    return ~F.coalesce(all_global(addresses), F.lit(False))


def redirect_outcome(hops: Column, limit: int = 5) -> Column:
    """The first error along an array of hops (error, location), ``too_many_redirects`` past the limit, or null."""
    first = F.try_element_at(F.filter(F.slice(hops, 1, limit + 1), lambda h: h["error"].isNotNull() | F.coalesce(h["location"] == "", F.lit(True))), F.lit(1))
    return F.when(first.isNotNull(), F.coalesce(first["error"], F.lit("invalid_redirect"))).when(F.size(hops) > limit, "too_many_redirects")
