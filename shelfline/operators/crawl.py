"""Decisions around a fetch, over tables of what was fetched: robots rules by origin, listing pages, bodies as text."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.page_facts import url_join
from ..functions.scalars import host, http_transient
from ..session import written
from .extract import product_links
from .reliability import effect


def origin(url: Column) -> Column:
    """Scheme and authority of a URL, null if it has none. Spark's own functions give null for what a path may not strictly hold, such as a blank."""
    part = lambda k: F.nullif(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]+)", k), F.lit(""))
    return F.concat(F.lower(part(1)), F.lit("://"), part(2))


def _unquoted(c: Column) -> Column:
    """Percent escapes decoded; what is no escape stays, plus signs too."""
    return F.url_decode(F.replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


def _quoted(c: Column) -> Column:
    """All but letters, digits, ``_.-~`` and slashes as percent escapes: the form in which rules and paths are compared."""
    out = F.url_encode(c)
    for coded, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def _bare(c: Column) -> Column:
    """A path without delimiters of empty parameters, queries and fragments."""
    out = F.regexp_replace(c, "^([^#]*)#$", "$1")
    out = F.regexp_replace(out, "^([^?#]*)\\?(?=#|$)", "$1")
    return F.regexp_replace(out, "^((?:[^?#]*/)?[^;/?#]*);(?=[?#]|$)", "$1")


def robots_path(url: Column) -> Column:
    """What rules are matched against: the URL after its authority, in the form of :func:`_quoted`; ``/`` if nothing is left."""
    rest = F.regexp_replace(_unquoted(url), "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*", "")
    return F.coalesce(F.nullif(_quoted(_bare(rest)), F.lit("")), F.when(url.isNotNull(), "/"))


def robots_rules(robots: DataFrame) -> DataFrame:
    """``origin, entry, agents, otherwise, pos, allow, path``: a robots document's rules as rows, read once an origin.

    Lines are events: agent, rule, blank. An agent line begins an entry unless another one
    stands before it; a rule belongs to the entry unless a blank line came since the last agent
    line. Entries without any rule are none. A rule without a path allows all. ``otherwise`` marks
    entries for any agent; rules that are no paths (delays) have a null path.
    """
    lines = robots.select("origin", F.posexplode(F.split("body", "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]")).alias("pos", "line"))
    parts = F.split(F.regexp_replace("line", "(?s)#.*$", ""), ":", 2)
    name, value = F.lower(F.trim(parts[0])), F.when(F.size(parts) == 2, _unquoted(F.trim(parts[1])))
    kind = F.when(F.col("line") == "", "blank").when(value.isNull(), None).when(name == "user-agent", "agent").when(name.isin("allow", "disallow", "crawl-delay", "request-rate"), "rule")
    events = lines.select("origin", "pos", kind.alias("kind"), name.alias("name"), value.alias("value")).filter("kind IS NOT NULL")
    here = Window.partitionBy("origin").orderBy("pos")
    starts = (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(here), F.lit("blank")) != "agent")
    events = events.withColumn("entry", F.sum(starts.cast("int")).over(here)).withColumn("since", F.last(F.when(F.col("kind") != "rule", F.col("kind")), ignorenulls=True).over(here))
    events = events.filter("entry > 0 AND kind <> 'blank' AND since = 'agent'")
    entries = events.groupBy("origin", "entry").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "agent", F.lower("value")))).alias("agents"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "rule", F.struct("pos", "name", "value")))).alias("rules"),
    )
    entries = entries.select("origin", "entry", "agents", F.array_contains("agents", "*").alias("otherwise"), F.explode("rules").alias("rule"))
    kept, blank = F.col("rule.name").isin("allow", "disallow"), F.col("rule.value") == ""
    return entries.select("origin", "entry", "agents", "otherwise", "rule.pos", F.when(kept, (F.col("rule.name") == "allow") | blank).alias("allow"), F.when(kept, _quoted(_bare(F.col("rule.value")))).alias("path"))


def agent_rules(rules: DataFrame, agent: str) -> DataFrame:
    """``origin, rules``: what holds for one agent, an array of (pos, allow, path) in order.

    The first entry that names a part of the agent's name counts, else the first for any agent.
    """
    token = F.lit(agent.split("/")[0].lower())
    mine = ~F.col("otherwise") & F.exists("agents", lambda a: F.contains(token, a))
    chosen = rules.filter(mine | F.col("otherwise")).groupBy(F.col("origin").alias("of")).agg(F.coalesce(F.min(F.when(mine, F.col("entry"))), F.min(F.when(F.col("otherwise"), F.col("entry")))).alias("which"))
    held = rules.filter("path IS NOT NULL").join(chosen, (F.col("origin") == F.col("of")) & (F.col("entry") == F.col("which")))
    return held.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("pos", "allow", "path"))).alias("rules"))


def robots_decisions(requests: DataFrame, robots: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """Requests with ``robots_error`` and ``allowed`` by the robots document of their origin.

    robots: ``origin, status, body``, one row an origin. A server error, no status (the fetch
    failed) and an origin without a row give the transient error ``robots_unavailable`` and a
    null ``allowed``; 200 is judged by the document, whose first rule that the path begins with
    decides; any other status allows all. A null URL has no origin. Documents are read once each,
    and only the rules for the agent meet the requests. Both sides may be large, so neither is
    broadcast by force.
    """
    rules = agent_rules(robots_rules(robots.filter("status = 200")), agent)
    judged = robots.select(F.col("origin").alias("_origin"), F.col("status").alias("_status")).join(rules.withColumnsRenamed({"origin": "_o", "rules": "_rules"}), F.col("_origin") == F.col("_o"), "left")
    out = requests.withColumn("_path", robots_path(F.col(url))).join(judged, origin(F.col(url)) == F.col("_origin"), "left")
    lost = F.col("_status").isNull() | (F.col("_status") >= 500)
    first = F.try_element_at(F.filter("_rules", lambda r: F.startswith(F.col("_path"), r["path"])), F.lit(1))
    allowed = F.coalesce(first["allow"], F.lit(True))
    return out.select(*requests.columns, F.when(lost, "robots_unavailable").alias("robots_error"), F.when(~lost, allowed).alias("allowed"))


#: Redirects that are followed, so a request makes one fetch more at most.
MAX_REDIRECTS = 5


def chase(requests: DataFrame, responses: DataFrame, policy: Callable[[Column], Column], robots: DataFrame | None = None, agent: str = "*", open_hosts: DataFrame | None = None, limit: int = MAX_REDIRECTS) -> DataFrame:
    """Redirects followed hop by hop: ``id, hop, url, status, error, transient, effect, next_url``, a row for each URL that a request came to.

    requests: ``id, url``. responses: ``url, status, location`` and perhaps ``error`` (such as timeout);
    a URL without a row is a ``transport_error``. Every hop is judged anew: the policy's error for its
    URL, ``circuit_open`` for hosts of open_hosts (``host``), the robots document of its origin. A
    redirect's location is resolved against its URL; without one it is an ``invalid_redirect``. A redirect
    at the last hop is ``too_many_redirects``, which ends circles too. ``effect`` is what the hop means to
    its host's breaker. Each hop is a join of the requests still on their way with the responses,
    and is written, so that no hop's work is done again for a later one.
    """
    known = responses.select(F.col("url").alias("_url"), "status", "location", (F.col("error") if "error" in responses.columns else F.lit(None).cast("string")).alias("_failed"))
    live, hops = requests.select("id", "url"), []
    for hop in range(limit + 1):
        live = live.withColumn("_policy", policy(F.col("url")))
        if open_hosts is not None:
            shut = open_hosts.select(F.col("host").alias("_host"), F.lit("circuit_open").alias("_open")).distinct()
            live = live.join(shut, host(F.col("url")) == F.col("_host"), "left").withColumn("_policy", F.coalesce("_policy", "_open")).drop("_host", "_open")
        if robots is not None:
            live = robots_decisions(live, robots, agent)
            live = live.withColumn("_policy", F.coalesce("_policy", "robots_error", F.when(~F.col("allowed"), "robots_disallowed"))).drop("robots_error", "allowed")
        met = live.join(known, (F.col("url") == F.col("_url")) & F.col("_policy").isNull(), "left")
        redirect = F.coalesce(F.col("status").between(300, 399), F.lit(False))
        lost = F.coalesce("_failed", F.when(F.col("_url").isNull(), "transport_error"))
        there = F.coalesce(F.col("location"), F.lit("")) != ""
        own = F.coalesce("_policy", lost, F.when(redirect & ~there, "invalid_redirect"), F.when(redirect, F.lit("too_many_redirects") if hop == limit else F.lit(None)), F.when(F.col("status") >= 400, F.concat(F.lit("http_"), F.col("status").cast("string"))))
        transient = own.isin("circuit_open", "robots_unavailable", "timeout", "transport_error", "dns_error") | (~redirect & http_transient(F.col("status")))
        fetched = F.col("_policy").isNull() & (own.isNull() | (own != "invalid_redirect"))
        met = met.select(
            "id", F.lit(hop).alias("hop"), "url", "status", own.alias("error"), F.coalesce(transient, F.lit(False)).alias("transient"),
            F.when(fetched, effect(F.col("status"), F.coalesce(lost, F.lit("")))).alias("effect"),
            F.when(F.col("_policy").isNull() & redirect & there & lost.isNull(), url_join(F.col("url"), F.col("location"))).alias("next_url"),
        )
        hops.append(written(met, f"hop-{hop}"))
        live = hops[-1].filter("next_url IS NOT NULL AND error IS NULL").select("id", F.col("next_url").alias("url"))
        if hop < limit and live.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, hops)


def chase_outcomes(hops: DataFrame) -> DataFrame:
    """``id, fetches, final_url, status, error, transient``: where each request ended; ``final_url`` is null if it failed."""
    last = hops.groupBy("id").agg(F.max_by(F.struct("hop", "url", "status", "error", "transient"), "hop").alias("e"))
    return last.select("id", (F.col("e.hop") + 1).alias("fetches"), F.when(F.col("e.error").isNull(), F.col("e.url")).alias("final_url"), "e.status", "e.error", "e.transient")


def products_of_listings(listings: DataFrame, limit: int, pages: int = 50, group: str = "source", page: str = "page") -> DataFrame:
    """``group, position, link, page``: the first ``limit`` product links of each group's listing pages, each link once.

    Pages are read in order from 1; reading ends at the first page that is missing or has no
    links, at ``pages``, or once there are enough links. A link's place doesn't depend on later
    pages, so ranks say what a loop over pages would find. No group ranks more than ``pages`` pages;
    rows without a group belong to none. Links meet once, by group, and nothing is joined: a join with
    the pages that are reached looks tiny to the optimizer, which then sends all links through the driver.
    """
    read = listings.filter(F.col(page).between(1, pages) & F.col(group).isNotNull()).withColumns({"_g": F.col(group), "_p": F.col(page)})
    links = product_links(read, ["_g", "_p"])
    # Pages with links stand at their own number as long as no page before them was missing or empty.
    links = links.withColumn("_n", F.dense_rank().over(Window.partitionBy("_g").orderBy("_p"))).filter("_n = _p")
    first = links.groupBy("_g", "link").agg(F.min(F.struct("_p", "at")).alias("_at"))
    placed = first.withColumn("position", F.row_number().over(Window.partitionBy("_g").orderBy("_at", "link")).cast("long"))
    return placed.filter(F.col("position") <= limit).select(F.col("_g").alias(group), "position", "link", F.col("_at._p").alias(page))


@F.pandas_udf(T.StringType())
def decode_body(body: pd.Series, charset: pd.Series) -> pd.Series:
    """A response's bytes as text in its charset, UTF-8 if none or an unknown one is named; what can't be read becomes U+FFFD.

    Spark's own ``decode`` takes few charsets and stops the job at a malformed byte.
    """

    def one(raw, name) -> str | None:
        if raw is None:
            return None
        try:
            return bytes(raw).decode(name or "utf-8", errors="replace")
        except (LookupError, ValueError):  # no charset of that name
            return bytes(raw).decode("utf-8", errors="replace")

    return pd.Series([one(b, c) for b, c in zip(body, charset)], dtype=object)
