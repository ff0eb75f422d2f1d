"""Operators of the catalog side on small hand-made rows; queries against SQL on the smallest tables."""

import random
import re
from collections import defaultdict
from pathlib import Path
from urllib.parse import urljoin

import duckdb
import pytest
from pyspark.sql import functions as F

import compare
from shelfline.functions import markup, page_tree
from shelfline.functions import scalars as S
from shelfline.operators import crawl, extract, lifecycle, quality, reads, reliability, reports
from shelfline.plans import registry
from shelfline.sources import fixtures, keyed, schemas
from shelfline.sources import reports as report_files
from shelfline.streaming import ingest, queue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


@pytest.mark.parametrize("name", ["required_field_accuracy", "parse_product_jsonld", "parse_product_semantic", "evidence_explode", "rendered_reparse", "parse_product_missing"])
def test_pages_of_one_file_are_walked_in_many_tasks(spark, name):
    assert spark.read.parquet(f"{SF}/part.parquet").rdd.getNumPartitions() == 1
    df = registry.queries()[name](spark, SF)
    walk = re.search(r"(?s)ArrowEvalPython.*?Exchange (\w+)\(\w+#\d+L?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())
    assert walk and walk[1] == "hashpartitioning" and int(walk[2]) >= 3 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    got, rows, order = df.collect(), want.fetchall(), sorted(cols)
    assert compare.rows_of(got, [df.columns.index(c) for c in order]) == compare.rows_of(rows, [cols.index(c) for c in order])


def test_price_rules(spark):
    rows = [("£17.90", None), ("1.234,56", None), ("$1,299.5 now", None), (" 12", "EUR"), ("none", None), (None, None), ("5 then $3", None), ("$ ٣٥", None)]
    df = spark.createDataFrame(rows, "t string, g string").select(S.price_amount(F.col("t")).alias("a"), S.price_currency(F.col("t"), F.col("g")).alias("c"))
    assert [tuple(r) for r in df.collect()] == [("17.90", "GBP"), ("1.23", None), ("1299.5", "USD"), ("12", "EUR"), (None, None), (None, None), ("5", None), ("٣٥", "USD")]


def test_backoff_and_retry_after(spark):
    df = spark.createDataFrame([(3, 2.0), (3, 50.0), (3, None)], "n int, ra double")
    assert [r[0] for r in df.select(S.backoff(F.col("n"), F.col("ra"), cap=10.0, jitter=0.0)).collect()] == [2.0, 10.0, 1.0]
    late = S.backoff(F.col("n"), F.lit(None).cast("double"), jitter=0.2, seed=3)
    assert all(0.8 <= r[0] <= 1.2 for r in df.select(late).collect())
    h = spark.createDataFrame([("2.5",), ("not-a-date",), ("",), (None,), ("-3",), ("Wed, 21 Oct 2015 07:28:00 GMT",)], "v string")
    assert [r[0] for r in h.select(S.retry_after(F.col("v"), F.lit("2015-10-21 07:27:00").cast("timestamp"))).collect()] == [2.5, None, None, None, 0.0, 60.0]


def test_url_rules(spark):
    urls = ["file:///etc/passwd", "http://127.0.0.1/admin", "https://ok.example/x", "http://other.example/", "http://[::1]/", "nonsense", None, "http://172.20.1.1/", "http://8.8.8.8/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(S.url_policy(F.col("u"), [])).collect()] == ["invalid_url", "private_address", None, None, "private_address", "invalid_url", "invalid_url", "private_address", None]
    assert [r[0] for r in df.select(S.url_policy(F.col("u"), ["ok.example"])).collect()][2:4] == [None, "host_not_allowed"]
    hops = spark.createDataFrame([([(None, "a")] * 6,), ([(None, "a"), ("private_address", "b")],), ([(None, "")],), ([(None, "a")],)], "h array<struct<error:string,location:string>>")
    assert [r[0] for r in hops.select(S.redirect_outcome(F.col("h"))).collect()] == ["too_many_redirects", "private_address", "invalid_redirect", None]


def test_drift_equals_fold(spark):
    rng = random.Random(5)
    rows, want = [], []
    for s in range(60):
        profile = None
        for k in range(rng.randint(1, 15)):
            fp, cov, conf = rng.choice("abc"), rng.choice([0.25, 0.5, 1.0]), rng.choice([0.8, 0.95])
            rows.append((f"s{s}", k, fp, cov, conf))
            drift = profile is not None and profile[0] != fp and (cov < profile[1] or conf < 0.9)
            want.append((f"s{s}", k, drift))
            profile = (fp, cov, 1) if profile is None else (profile[0] if drift else fp, max(profile[1], cov), profile[2] + 1)
        want[-1] += tuple(profile)
    df = spark.createDataFrame(rows, "source string, seq int, dom_fingerprint string, coverage double, confidence double")
    got = {(r["source"], r["seq"]): r["drift"] for r in quality.drift(df).collect()}
    assert got == {w[:2]: w[2] for w in want}
    # A drifting row keeps the profile's fingerprint, so the profile after a row is known from the fold too.
    ends = {w[0]: w[3:] for w in want if len(w) > 3}
    assert {r["source"]: (r["dom_fingerprint"], r["baseline_coverage"], r["observed_count"]) for r in quality.source_profiles(df).collect()} == ends


class LiteralBreaker:
    def __init__(self, threshold, timeout):
        self.state, self.count, self.since, self.threshold, self.timeout = "closed", 0, 0.0, threshold, timeout

    def ask(self, now):
        if self.state == "open" and now - self.since >= self.timeout:
            self.state = "half_open"
        return self.state != "open"

    def tell(self, what, now):
        if what == "success":
            self.state, self.count = "closed", 0
        elif what == "failure":
            self.count += 1
            if self.state == "half_open" or self.count >= self.threshold:
                self.state, self.since = "open", now


def test_breaker_equals_literal(spark):
    rng, rows = random.Random(2), []
    for host in "abcdef":
        at = 0.0
        for i in range(80):
            at += rng.choice([0.5, 1, 4])
            rows.append((host, len(rows), at, rng.choice(["failure", "failure", "success", "neutral"])))
    want = {}
    breakers = {h: LiteralBreaker(2, 5.0) for h in "abcdef"}
    for host, i, at, what in rows:
        ok = breakers[host].ask(at)
        if ok:
            breakers[host].tell(what, at)
        want[i] = (ok, breakers[host].state)
    df = spark.createDataFrame(rows, "host string, id long, at double, effect string")
    assert {r["id"]: (r["allowed"], r["state"]) for r in reliability.replay(df, 2, 5.0).collect()} == want


def test_breaker_stream_equals_replay(spark, tmp_path):
    from shelfline.streaming import ingest

    rng = random.Random(4)
    rows = [(rng.choice("abc"), i, float(i), rng.choice(["failure", "success"])) for i in range(90)]
    schema = "host string, id long, at double, effect string"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.breaker_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2, 5.0)
    q = stream.writeStream.format("memory").queryName("breakers").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("breakers").collect())) == sorted(map(tuple, reliability.replay(df, 2, 5.0).collect()))


def test_extraction_edges(spark):
    pages = [
        ("u://x/", "generic", None), ("u://x/", "generic", ""), ("u://x/", "generic", '<meta property="og:title" content=""><h1>No</h1>'),
        ("https://x.example/a", "generic", '<script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"@type":["A","product"],"name":"N","offers":[{"price":17.90,"priceCurrency":"EUR"}],"image":["i.png"]}]}</script>'),
        ("https://x.example/a", "generic", '<h1> a <b>b</b><script>no</script></h1><span itemprop="price">$ 5.5</span><i itemprop="availability" href="https://s/Out ">x</i>'),
    ]
    df = extract.parse_products(spark.createDataFrame(pages, "url string, source string, html string"))
    got = df.select("title", "price_amount", "currency", "availability", "image_url", F.array_join("warnings", ","), "confidence").collect()
    assert tuple(got[0])[:1] == (None,) and got[0][5] == "missing_title" == got[1][5] == got[2][5]
    assert tuple(got[3]) == ("N", "17.9", "EUR", None, "https://x.example/i.png", "missing_availability", round((0.99 * 3 + 0.98 + 0.8) / 5, 4))
    assert tuple(got[4])[:5] == ("a b", "5.5", "USD", "Out", "https://x.example/a")


def test_run_creation_rejects_slash_variants(spark):
    req = spark.createDataFrame([("r1", ["https://a/x", "https://a/x/"], 5), ("r2", ["https://a/1/", "https://a/2"], 1)], "id string, start_urls array<string>, max_pages int")
    req = req.withColumns({"connector": F.lit("g"), "render_mode": F.lit("http"), "max_attempts": F.lit(4)})
    targets, outbox, rejected = lifecycle.create_run(req, F.lit("2024-01-01").cast("timestamp"))
    assert [r["run_id"] for r in rejected.collect()] == ["r1"]
    assert [r["normalized_url"] for r in targets.collect()] == ["https://a/1"] and outbox.count() == 1


def test_empty_tables(spark):
    for name in schemas.TABLES:
        assert schemas.empty(spark, name).count() == 0
    t = schemas.empty(spark, "crawl_targets")
    assert reads.status_counts(schemas.empty(spark, "crawl_runs"), t).count() == 0
    assert reads.metrics(t, products=schemas.empty(spark, "products")).collect()[0]["value"] == 0


def test_validation(spark):
    df = spark.createDataFrame([("ok_1", ["a"], 5), ("No", ["a"], 5), ("ok", ["a", "a"], 5), ("ok", [], 5), ("ok", ["a"], 0)], "c string, u array<string>, m int")
    assert [r[0] for r in df.select(schemas.valid_run_request(F.col("c"), F.col("u"), F.col("m"))).collect()] == [True, False, False, False, False]
    notes = spark.createDataFrame([("accept", "fine"), ("accept", "no"), ("drop", "fine"), (None, "fine")], "a string, n string")
    assert [r[0] for r in notes.select(schemas.valid_resolution(F.col("a"), F.col("n"))).collect()] == [True, False, False, False]


def test_fixture_variants(spark):
    one = spark.range(41, 42)
    for variant in fixtures.VARIANTS:
        page = fixtures.product_pages(one, variant, "id")
        parsed = extract.parse_products(page).collect()[0]
        assert parsed["dom_fingerprint"] == quality.fingerprint(page, "id").collect()[0]["dom_fingerprint"]
        assert (parsed["title"] is None) == (variant in ("dynamic", "listing", "selector") and variant != "selector")
    tries = fixtures.unstable_responses(one, "id", 2).orderBy("attempt").collect()
    assert [r["status_code"] for r in tries] == [429, 429, 200] and [r["html"] is None for r in tries] == [True, True, False]


def test_odd_pages_give_nulls_and_no_failure(spark):
    deep = '<script type="application/ld+json">' + "[" * 100_000 + "]" * 100_000 + "</script><h1>Deep</h1>"
    pages = [
        ("https://x.example/a", deep), ("https://x.example/b", '<link rel="canonical" href="http://[x/"><h1>Bad</h1>'), (None, "<h1>No URL</h1>"),
        ("https://x.example/c", '<div class="a|b product_main"><h1>Bars</h1></div><p class="x|y price_color">£5.00</p>'), ("https://x.example/d", "<div>" * 30_000 + "<h1>Low</h1>"),
    ]
    df = spark.createDataFrame([(u, "books_to_scrape", h) for u, h in pages], "url string, source string, html string")
    got = extract.parse_products(df).select("title", "canonical_url", "price_amount").collect()
    assert [tuple(r) for r in got] == [("Deep", "https://x.example/a", None), ("Bad", "https://x.example/b", None), ("No URL", None, None), ("Bars", "https://x.example/c", "5.00"), ("Low", "https://x.example/d", None)]
    rules = spark.createDataFrame([("User-agent: *\nDisallow: /x", None), ("User-agent: *\nDisallow: /x", "https://a/x"), (None, "https://a/x")], "r string, u string")
    from shelfline.functions.page_facts import robots_allowed

    assert [r[0] for r in rules.select(robots_allowed(F.col("r"), F.lit("bot"), F.col("u"))).collect()] == [None, False, True]


def test_size_comes_before_status(spark):
    df = spark.createDataFrame([(500, 128), (404, 128), (200, 128), (302, 128), (500, 64), (200, 64)], "s int, n int")
    assert [r[0] for r in df.select(S.http_class(F.col("s"), F.col("n"), 64)).collect()] == ["response_too_large"] * 3 + ["redirect", "http_500", "ok"]


def test_stream_drops_repeats_across_batches(spark, tmp_path):
    from shelfline.streaming import ingest

    rows = spark.createDataFrame([(k % 40, k) for k in range(100)], "id long, v long")
    ingest.deliver(rows, str(tmp_path / "in"), 6)
    messages = ingest.message_stream(spark, str(tmp_path / "in"), "id long, v long", 1)
    for _ in range(2):  # a second start finds nothing new
        ingest.process(messages, str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: b.select("id"))
    ingest.deliver(rows.limit(3), str(tmp_path / "in" / "later"), 1)  # long after
    ingest.process(messages, str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: b.select("id"))
    assert not list((tmp_path / "cp").glob("state/**/*.delta"))
    assert sorted(r["id"] for r in ingest.results(spark, str(tmp_path / "out")).collect()) == list(range(40))


def test_robots_of_origins(spark):
    rules = spark.createDataFrame([("https://a.example:8443", 200, "User-agent: *\nDisallow: /x"), ("https://b.example", 500, ""), ("https://c.example", 302, "User-agent: *\nDisallow: /")], "origin string, status int, body string")
    urls = ["https://a.example:8443/x/1", "HTTPS://a.example:8443/y", "https://a.example/x", "https://b.example/", "https://c.example/x", None, "nonsense"]
    got = crawl.robots_decisions(spark.createDataFrame([(u,) for u in urls], "url string"), rules, "bot").collect()
    lost = ("robots_unavailable", None)
    assert {r["url"]: (r["robots_error"], r["allowed"]) for r in got} == dict(zip(urls, [(None, False), (None, True), lost, lost, (None, True), lost, lost]))


def test_listings_end_at_the_first_gap(spark):
    page = lambda *items: "".join(f'<article class="product_pod"><h3><a href="{i}/">x</a></h3></article>' for i in items)
    rows = [("a", 1, page(1, 2)), ("a", 2, page(2, 3)), ("a", 3, ""), ("a", 4, page(9)), ("b", 1, page(5)), ("b", 3, page(6)), ("c", 2, page(7)), ("d", 1, None), (None, 1, page(8))]
    df = spark.createDataFrame([(s, n, "https://s.example/list", h, "books_to_scrape") for s, n, h in rows], "shop string, page int, url string, html string, source string")
    got = [(r["shop"], r["position"], r["link"].removeprefix("https://s.example/"), r["page"]) for r in crawl.products_of_listings(df, 10, group="shop").collect()]
    assert [g for g in sorted(got, key=str) if g[0]] == [("a", 1, "1/", 1), ("a", 2, "2/", 1), ("a", 3, "3/", 2), ("b", 1, "5/", 1)]
    assert crawl.products_of_listings(df.limit(0), 10, group="shop").count() == 0
    assert crawl.products_of_listings(df, 2, group="shop").filter("shop = 'a'").count() == 2


def test_listings_equal_a_loop(spark):
    """Fuzz: pages that are missing, empty, there twice or beyond the last, references that repeat, resolve to one link or to none; a reader's loop says the same."""
    rng, base, limit, rows = random.Random(11), "https://s.example/list/", 6, []
    for g in range(60):
        for p in [n for n in range(8) if rng.random() < 0.93] + ([2] if g % 5 == 0 else []) + ([51] if g % 7 == 0 else []):
            rows.append((g if g else None, p, [rng.choice(["/i/1", "../i/1", "/i/2", "3", "./3", "4", "/i/5#x", "6", "7", "http://[", None]) for _ in range(rng.choice((0, 1, 1, 2, 4, 9)))]))
    rows += [(99, n, ["/only"] if n < 50 else [f"/{n}"]) for n in range(1, 53)]
    html = lambda refs: "".join(f'<article class="product_pod"><h3><a{f" href={chr(34)}{r}{chr(34)}" if r else ""}>x</a></h3></article>' for r in refs)

    def link(ref):
        try:
            return urljoin(base, ref) if ref else None
        except ValueError:
            return None

    want = []
    for g in {r[0] for r in rows} - {None}:
        seen = {}
        for p in range(1, 51):
            told = sorted((at, link(ref)) for og, op, refs in rows if (og, op) == (g, p) for at, ref in enumerate(dict.fromkeys(refs)) if link(ref))
            if not told:
                break
            for _, u in told:
                seen.setdefault(u, p)
        want += [(g, k + 1, u, p) for k, (u, p) in enumerate(list(seen.items())[:limit])]
    df = spark.createDataFrame([(g, p, base, html(refs), "books_to_scrape") for g, p, refs in rows], "shop long, page long, url string, html string, source string")
    got = crawl.products_of_listings(df.repartition(5), limit, group="shop")
    assert sorted(map(tuple, got.collect())) == sorted(want) and {u for _, _, u, _ in want} > {"https://s.example/50"}


def test_links_are_read_in_one_walk_and_not_joined(spark):
    """No page is walked before pages are dealt over all cores, none twice, and no table that grows with the input goes through the driver for a join."""
    for query in ("listing_products", "link_discovery"):
        plan = registry.queries()[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [page_facts") == plan.count("ArrowEvalPython [url_join") == 1, query
        assert plan.index("ArrowEvalPython [page_facts") < plan.index("REPARTITION_BY_NUM") and "Join" not in plan and "Broadcast" not in plan, query


def test_bodies_as_text(spark):
    rows = [("é".encode(), None), ("é".encode("latin-1"), "ISO-8859-1"), (b"a\xff", "utf-8"), ("가".encode("euc-kr"), "EUC-KR"), (b"abc", "base64"), (b"x", ""), (b"x", "no\x00name"), (None, "utf-8"), (b"", None)]
    df = spark.createDataFrame(rows, "b binary, c string")
    assert [r[0] for r in df.select(crawl.decode_body("b", "c")).collect()] == ["é", "é", "a\ufffd", "가", "abc", "x", "x", None, ""]


def test_how_values_are_shown(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.05, 0.1, 59.94, 60.0, 90.0, None)], "s double")
    assert [r[0] for r in df.select(reports.duration_text(F.col("s"))).collect()] == ["<0.1초", "<0.1초", "0.1초", "59.9초", "1.0분", "1.5분", None]
    at = spark.createDataFrame([("2026-07-09 18:05:06",), (None,)], "t string").select(reports.korean_time(F.col("t").cast("timestamp")))
    assert [r[0] for r in at.collect()] == ["2026. 7. 10. 03:05:06", None]
    v = spark.createDataFrame([("fixture_drift",), ("other",), (None,)], "c string").select(reports.label(F.col("c"), reports.CONNECTOR_LABELS))
    assert [r[0] for r in v.collect()] == ["구조 변경 테스트", "other", None]


def test_reports_as_json(spark, tmp_path):
    rows = [("a", None, 'q"\n'), ("b", "1", "é")]
    report_files.write_report(spark.createDataFrame(rows, "section string, id string, body string"), str(tmp_path / "r"))
    assert sorted(map(tuple, report_files.read_report(spark, str(tmp_path / "r"), "section string, id string, body string").collect())) == rows
    (tmp_path / "whole.json").write_text('{\n "section": "a",\n "id": "1"\n}')
    assert [tuple(r) for r in report_files.read_report(spark, str(tmp_path / "whole.json"), "section string, id string, body string", whole=True).collect()] == [("a", "1", None)]


def test_drift_of_one_source_is_many_tasks(spark):
    """One source with all rows: chunks hand on what a literal fold knows, and every range is a task of its own."""
    rng = random.Random(6)
    rows = [("s" if k < 900 else None, k, rng.choice("abc"), rng.choice([0.25, 0.5, 1.0, None]), rng.choice([0.8, 0.95])) for k in range(1000)]
    rows += [("s", -5, "z", None, 0.8), ("t", 1, "q", 1.0, 0.95)]
    want, profiles = {}, {}
    for s, k, fp, cov, conf in sorted(rows, key=lambda r: r[1]):
        known = profiles.get(s)
        bad = (known is not None and None not in (known[1], cov) and cov < known[1]) or conf < 0.9
        want[s, k] = (known[0] if known else None, known[1] if known else None, known is not None and known[0] != fp and bad)
        best = max((c for c in (known and known[1], cov) if c is not None), default=None)
        profiles[s] = (fp if known is None or not bad else known[0], best)
    df = spark.createDataFrame(rows, "source string, seq int, dom_fingerprint string, coverage double, confidence double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        out = quality.drift(df)
        assert out.columns == [*df.columns, "baseline_coverage", "previous_fingerprint", "drift"]
        assert {(r["source"], r["seq"]): (r["previous_fingerprint"], r["baseline_coverage"], r["drift"]) for r in out.collect()} == want
        dealt = df.repartitionByRange("source", "seq").withColumn("chunk", F.spark_partition_id())
        assert dealt.filter("source = 's'").select("chunk").distinct().count() >= 5
        assert quality.drift(df.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def literal_chase(url, web, judge):
    """One request after another, as a client would."""
    for hop in range(6):
        error = judge(url)
        if error:
            return hop + 1, None, error
        if url not in web:
            return hop + 1, None, "transport_error"
        status, location, failed = web[url]
        if failed:
            return hop + 1, None, failed
        if 300 <= status < 400:
            if not location:
                return hop + 1, None, "invalid_redirect"
            url = urljoin(url, location)
            continue
        return hop + 1, (None if status >= 400 else url), (f"http_{status}" if status >= 400 else None)
    return 6, None, "too_many_redirects"


def test_redirects_are_chased_and_judged_hop_by_hop(spark):
    rng = random.Random(9)
    hosts = ["a.example", "b.example", "10.0.0.8", "shut.example", "lost.example", "[::1]"]
    web = {}
    for k in range(120):
        h = rng.choice(hosts[:4])
        target = rng.choice([f"/p/{rng.randrange(120)}", f"../p/{rng.randrange(120)}", f"https://{rng.choice(hosts)}/p/{rng.randrange(120)}", "//b.example/x", "ftp://a.example/", None, ""])
        web[f"https://{h}/p/{k}"] = rng.choice([(200, None, None), (302, target, None), (301, target, None), (302, target, None), (404, None, None), (503, None, None), (429, None, None), (None, None, "timeout")])
    for k in range(9):
        web[f"https://a.example/c/{k}"] = (302, f"{k + 1}", None)
    web |= {"https://a.example/c/9": (200, None, None), "https://a.example/me": (302, "me", None), "https://a.example/in": (302, "/out", None), "https://a.example/out": (307, "http://10.0.0.8/x", None)}
    body = "User-agent: *\nDisallow: /p/1\nAllow: /\n"

    def judge(url):
        h = re.match(r"(\w+)://([^/]*)", url)
        if h[1] not in ("http", "https"):
            return "invalid_url"
        if h[2] in ("10.0.0.8", "[::1]"):
            return "private_address"
        if h[2] == "shut.example":
            return "circuit_open"
        if h[2] == "lost.example":
            return "robots_unavailable"
        return "robots_disallowed" if h[2] == "b.example" and "/p/1" in url else None

    start = [*web, "https://a.example/none", "https://b.example/p/2"]
    asked = spark.createDataFrame(list(enumerate(start)), "id long, url string")
    responses = spark.createDataFrame([(u, *r) for u, r in web.items()], "url string, status int, location string, error string")
    robots = spark.createDataFrame([("https://a.example", 404, None), ("https://b.example", 200, body), ("https://lost.example", 503, None)], "origin string, status int, body string")
    hops = crawl.chase(asked, responses, lambda u: S.url_policy(u, []), robots, "bot", spark.createDataFrame([("shut.example",), ("shut.example",)], "host string"))
    got = {r["id"]: (r["fetches"], r["final_url"], r["error"]) for r in crawl.chase_outcomes(hops).collect()}
    want = {i: literal_chase(u, web, judge) for i, u in enumerate(start)}
    assert got == want
    assert {"too_many_redirects", "invalid_redirect", "private_address", "circuit_open", "robots_disallowed", "timeout"} <= {w[2] for w in want.values()}
    assert any(w[0] > 1 and w[2] == "private_address" for w in want.values())
    events = {(r["id"], r["hop"]): (r["effect"], r["transient"]) for r in hops.collect()}
    for i, (fetches, _, error) in want.items():
        effect, transient = events[i, fetches - 1]
        failed = error in ("timeout", "transport_error", "http_503", "http_429")
        assert effect == ("failure" if failed else {"http_404": "neutral", None: "success", "too_many_redirects": "success"}.get(error))
        assert transient == (failed or error in ("circuit_open", "robots_unavailable"))
        assert all(events[i, k] == ("success", False) for k in range(fetches - 1))
    assert crawl.chase(asked.limit(0), responses, lambda u: S.url_policy(u, [])).count() == 0


def test_origin_of_urls_that_are_not_strict(spark):
    urls = ["HTTPS://u@X.example:8/a b", "https://x.example/%zz?q=a|b", "http://[::1]?x", "https://x.example#f", "https:///a", "mailto:a@b", "/a b", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(crawl.origin(F.col("u"))).collect()] == ["https://u@X.example:8", "https://x.example", "http://[::1]", "https://x.example", None, None, None, None, None]


def test_robots_rules_equal_the_parser(spark):
    from urllib.robotparser import RobotFileParser

    rng = random.Random(4)
    agents = ["*", "Bot", "shop", "Bot/2.0", "other", "BOT", ""]
    paths = ["", "/", "/a", "/a/b", "/A", "/a%20b", "/a b", "/%zz", "/a?x=1", "/a?", "/ü", "/a*", "*", "/a+b", "/~x", "/a#f", "/b;p", "/b;"]
    docs, urls = [], ["https://x.example" + p for p in paths] + ["https://x.example", "https://x.example/a/b/c?x=1&y=%41#z", "https://x.example/%7Ex", "https://x.example/a%2Fb"]
    for _ in range(250):
        lines = []
        for _ in range(rng.randrange(14)):
            lines.append(rng.choice([f"User-agent: {rng.choice(agents)}", f"user-AGENT:{rng.choice(agents)} # c", f"Disallow: {rng.choice(paths)}", f"Allow: {rng.choice(paths)}", f"disallow :{rng.choice(paths)}", "", "", "  ", "# only", "Crawl-delay: 3", "Sitemap: https://x.example/s", "nonsense", "Request-rate: 1/2"]))
        docs.append(rng.choice(["\n", "\r\n"]).join(lines))
    robots = spark.createDataFrame([(f"https://h{k}.example", 200, d) for k, d in enumerate(docs)] + [("https://none.example", 200, None)], "origin string, status int, body string")
    asked = [(k, u.replace("x.example", f"h{k}.example")) for k in range(len(docs)) for u in urls] + [(-1, "https://none.example/a")]
    df = spark.createDataFrame(asked, "k int, url string")
    for agent in ("Bot/1.0 (x)", "myshop", "zzz"):
        got = {(r["k"], r["url"]): r["allowed"] for r in crawl.robots_decisions(df, robots, agent).collect()}
        for k, d in enumerate(docs):
            parser = RobotFileParser()
            parser.parse(d.splitlines())
            for u in urls:
                u = u.replace("x.example", f"h{k}.example")
                assert got[k, u] == parser.can_fetch(agent, u), (agent, u, d)
        assert got[-1, "https://none.example/a"] is True


def test_broken_pages_do_not_stop_a_job(spark):
    """Random damage to pages, through Spark, with good rows beside them."""
    rng = random.Random(12)
    good = '<html><h1>Good</h1><script type="application/ld+json">{"@type": "Product", "name": "Good", "offers": {"price": "5.00", "priceCurrency": "USD", "availability": "InStock"}}</script></html>'
    bad = ["<![foo[bar]]>", "<!DOCTYPE [<!", "<![CDATA[", "<!-", "<![if x]>", "</", "<a b='", "&#xD800;", "&#99999999;", "<!ELEMENT", "<?php", "\x00", "<![endif", "<!doctype html <", "]]>"]
    surrogate = good.replace('"name": "Good"', '"name": "x\\ud800y"')
    rows = [(0, good), (1, surrogate)]
    for k in range(2, 1500):
        at = rng.randrange(len(good))
        rows.append((k, good[:at] + "".join(rng.choices(bad, k=rng.randint(1, 3))) + good[at + rng.randrange(3) :]))
    df = spark.createDataFrame([(k, f"https://x.example/{k}", "shop", h) for k, h in rows], "id int, url string, source string, html string")
    got = {r["id"]: r["title"] for r in extract.parse_products(df).select("id", "title").collect()}
    assert len(got) == 1500 and got[0] == "Good" and got[1] == "x�y"
    assert sum(t == "Good" for t in got.values()) > 300


def test_addresses_in_odd_forms_are_private(spark):
    df = spark.createDataFrame([(u,) for u in ["http://127.0.0.1./", "http://10.0.0.1.:8080/x", "http://①②⑦.0.0.1/", "http://2130706433./", "http://shop.example./", "http://93.184.216.7./"]], "u string")
    assert [r[0] for r in df.select(S.url_policy(F.col("u"), [])).collect()] == ["private_address"] * 4 + [None, None]


def files_of(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("part-*")}


def test_keyed_merge_rewrites_only_touched_buckets(spark, tmp_path):
    rng = random.Random(3)
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k long, sub string, at long, id string, v double", ["k", "sub"], 8)
    want = {}

    def load(rows):
        table.merge(spark.createDataFrame(rows, "k long, sub string, at long, id string, v double, other int" if len(rows[0]) == 6 else "k long, sub string, at long, id string, v double"), ["at", "id"], ["id"])
        for r in sorted(rows, key=lambda r: (r[2], r[3])):
            k, sub, at, i, v = r[:5]
            want[k, sub] = (at, want[k, sub][1] if (k, sub) in want else i, v)

    load([(rng.randrange(60), rng.choice(["a", None]), n, f"i{n}", float(n)) for n in range(200)])
    assert {(r["k"], r["sub"]): (r["at"], r["id"], r["v"]) for r in table.read().collect()} == want
    before = files_of(table.path)
    load([(5, "a", 900, "late", 1.0, 7), (5, "a", 901, "later", 2.0, 7), (777, None, 902, "new", 3.0, 7)])
    after = files_of(table.path)
    assert {(r["k"], r["sub"]): (r["at"], r["id"], r["v"]) for r in table.read().collect()} == want
    new = table._placed(spark.createDataFrame([(5, "a", 0, "", 0.0), (777, None, 0, "", 0.0)], "k long, sub string, at long, id string, v double"))
    touched = {f"_bucket={r['_bucket']}" for r in new.select("_bucket").collect()}
    assert {f for f in before if f.split("/")[0] not in touched} == {f for f in after if f.split("/")[0] not in touched}
    assert all(before[f] == after[f] for f in before if f.split("/")[0] not in touched)
    assert not {f for f in before if f.split("/")[0] in touched} & set(after)
    # The scan of a merge names its buckets, and Spark lists no other folder.
    read = table.touched(new)
    scanned = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scanned and "_bucket" in scanned.split("PartitionFilters: [")[1][:200]
    assert {f.split("/")[-2] for f in (r["f"] for r in read.select(F.input_file_name().alias("f")).distinct().collect())} <= touched
    table.merge(spark.createDataFrame([], "k long, sub string, at long, id string, v double"), ["at"])
    assert files_of(table.path) == after


def test_commit_and_merge_deal_their_rows_once(spark, tmp_path):
    """A commit's tasks are of a size, and a merge deals its rows once and never a second time for a join or for writing."""
    made = []
    kind = type(spark.range(1))
    was = kind.write

    class Seen:
        def __get__(self, df, owner=None):
            made.append(df._jdf.queryExecution().executedPlan().toString())
            return was.fget(df)

    try:
        kind.write = Seen()
        keyed.commit(spark.range(9).withColumn("table", F.lit("a")), str(tmp_path / "c"))
        table = keyed.KeyedTable(spark, str(tmp_path / "t"), "i long, at long, v string", ["i"], 4)
        for at in (1, 2):
            rows = spark.range(0, 40 * at, 1, 3).select(F.col("id").alias("i"), F.lit(at).cast("long").alias("at"), F.lit("x").alias("v"))
            table.merge(rows, ["at"], ["at"])
    finally:
        kind.write = was
    assert "REBALANCE" in made[0]
    assert len(made) == 3 and all(plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan for plan in made[1:])
    assert {tuple(r) for r in table.read().collect()} == {(i, 1 if i < 40 else 2, "x") for i in range(80)}


def test_absent_rows_are_dealt_over_all_tasks(spark):
    rows = spark.createDataFrame([(k % 50, None if k % 7 == 0 else k % 3) for k in range(200)], "k long, sub int")
    there = spark.createDataFrame([(k, 1) for k in range(20)] + [(30, None)], "k long, sub int")
    got = lifecycle.insert_absent(there, rows, ["k", "sub"])
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    want = [(r["k"], r["sub"]) for r in rows.collect() if not (r["sub"] == 1 and r["k"] < 20)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_keyed_insert_keeps_the_first(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k long, v string, day date", ["k"], 4, "day")
    day = "2024-01-01"
    for rows in ([(1, "a"), (2, "b"), (1, "z")], [(2, "c"), (3, "d")], []):
        table.insert(spark.createDataFrame(rows, "k long, v string").withColumn("day", F.lit(day).cast("date")), ["v"])
        day = "2024-01-01" if rows else day
    assert {(r["k"], r["v"]) for r in table.read().collect()} == {(1, "a"), (2, "b"), (3, "d")}
    before = files_of(table.path)
    table.insert(spark.createDataFrame([(9, "n", None)], "k long, v string, day date"), ["v"])
    table.insert(spark.createDataFrame([(9, "m", None)], "k long, v string, day date"), ["v"])
    assert before.items() <= files_of(table.path).items() and sorted(r["v"] for r in table.read().collect()) == ["a", "b", "d", "n"]


def test_one_commit_for_targets_and_outbox(spark, tmp_path):
    """A failure between the two tables leaves neither; a success has both, with a message for each target."""
    req = spark.createDataFrame([(k, "generic", "http", [f"https://s.example/{k}/{i}" for i in range(3)], 9, 4) for k in range(20)], "id long, connector string, render_mode string, start_urls array<string>, max_pages int, max_attempts int")
    rows, _ = lifecycle.create_rows(req, F.lit("2024-01-01").cast("timestamp"))
    path = str(tmp_path / "db")
    broken = rows.withColumn("id", F.when((F.col("table") == "outbox") & (F.col("payload.run_id") == 19), F.raise_error(F.lit("lost between the two"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost between the two"):
        keyed.commit(broken, path)
    assert not files_of(path) or all("_temporary" in f for f in files_of(path))
    keyed.commit(rows, path)
    targets, outbox = keyed.committed(spark, path, "crawl_targets", lifecycle.TARGET), keyed.committed(spark, path, "outbox", lifecycle.OUTBOX)
    assert targets.count() == outbox.count() == 60
    assert {r["id"] for r in targets.collect()} == {r["target_id"] for r in outbox.collect()} == {r["payload"]["target_id"] for r in outbox.collect()}
    assert "table=crawl_targets" not in str(outbox.select(F.input_file_name()).distinct().collect())


def test_queue_delays_reclaims_and_ends(spark, tmp_path):
    at = str(tmp_path)
    event = lambda *rows: queue.send(spark.createDataFrame(list(rows), queue.EVENT), f"{at}/in")
    event(("now", "message", 1000, 500, "p1"), ("retry", "message", 1000, 50_000, "p2"), ("now", "message", 1000, 500, "again"), ("idle", "message", 1000, 900, "p3"), (None, "message", 1000, 700, "p4"))
    for clock in (10_000, 10_001):
        queue.tick(spark, clock, f"{at}/in")
    event(("now", "ack", 12_000, None, None), ("never", "ack", 12_000, None, None))
    for clock in (30_000, 39_998, 45_000, 45_001, 60_000, 60_001):
        queue.tick(spark, clock, f"{at}/in")
    queue.run(spark, f"{at}/in", f"{at}/out", f"{at}/cp")
    got = queue.results(spark, f"{at}/out")
    told = sorted(((r["delivered_at"], r["id"] or "", r["delivery"], r["reclaimed"], r["payload"]) for r in got.collect()))
    assert told == [
        (9_000, "", 1, False, "p4"), (9_000, "idle", 1, False, "p3"), (9_000, "now", 1, False, "p1"),
        (44_000, "", 2, True, "p4"), (44_000, "idle", 2, True, "p3"), (59_000, "retry", 1, False, "p2"),
    ]
    mixed = got.filter("delivered_at >= 44000")
    assert [r["reclaimed"] for r in queue.in_order(mixed).collect()] == [True, True, False]


def test_queue_takes_a_delivery_of_many_files_in_one_step(spark, tmp_path):
    """A delivery is laid down by all tasks that made it and counts as one; nothing walks its messages one by one, and a repeated batch begins again from the step before."""
    at = str(tmp_path)
    k = F.col("id").cast("string")
    rows = spark.range(0, 20_000, 1, 5).select(k.alias("id"), F.lit("message").alias("kind"), F.lit(1000).cast("long").alias("at"), (F.col("id") % 2 * 50_000 + 1).alias("due"), F.concat(F.lit("p"), k).alias("payload"))
    queue.send(rows, f"{at}/in")
    assert len(list(Path(f"{at}/in/_sent").rglob("part-*"))) == 5
    queue.tick(spark, 10_000, f"{at}/in")
    queue.send(rows.filter("id % 4 = 0").withColumns({"kind": F.lit("ack"), "at": F.lit(12_000).cast("long")}), f"{at}/in")
    queue.run(spark, f"{at}/in", f"{at}/out", f"{at}/cp")
    queue.tick(spark, 45_000, f"{at}/in")
    queue.run(spark, f"{at}/in", f"{at}/out", f"{at}/cp")
    told = queue.results(spark, f"{at}/out").groupBy("delivered_at", "delivery", "reclaimed").agg(F.count("*").alias("n"), F.min(F.col("id").cast("long")).alias("least"))
    want = {(9_000, 1, False, 5_000, 2), (44_000, 2, True, 5_000, 2)}
    assert {tuple(r) for r in told.filter("delivered_at >= 9000").collect()} == want
    before = files_of(f"{at}/out")
    queue.run(spark, f"{at}/in", f"{at}/out", f"{at}/cp")  # nothing new: nothing happens
    assert files_of(f"{at}/out") == before


def test_worker_loop_over_the_queue(spark, tmp_path):
    """Publish, reclaim, read, process, acknowledge: transient failures retry after a delay, a crash before the acknowledgement delivers again, and every target ends once."""
    at, tried = str(tmp_path), defaultdict(int)
    table = keyed.KeyedTable(spark, f"{at}/done", "id string, attempt int", ["id"], 4)
    queue.send(spark.createDataFrame([(f"t{k}", "message", 1, 1000 + k, "1") for k in range(12)], queue.EVENT), f"{at}/in")
    clock = [10_000]

    def handle(batch, number):
        for r in queue.in_order(batch).collect():
            key, attempt, now = r["id"], int(r["payload"]), r["delivered_at"]
            tried[key] += 1
            k = int(key.removeprefix("t"))
            if k % 3 == 0 and tried[key] == 1:  # the worker dies: no acknowledgement
                continue
            table.insert(spark.createDataFrame([(key, attempt)], "id string, attempt int"), ["attempt"]) if not (k % 4 == 1 and attempt == 1) else None
            clock[0] = max(clock[0], now + 2000)
            queue.send(spark.createDataFrame([(key, "ack", clock[0], None, None)], queue.EVENT), f"{at}/in")
            if k % 4 == 1 and attempt == 1:  # a transient failure: the next attempt is visible later
                queue.send(spark.createDataFrame([(key, "message", clock[0] + 1, clock[0] + 20_000, "2")], queue.EVENT), f"{at}/in")

    for _ in range(6):
        clock[0] += 25_000
        queue.tick(spark, clock[0], f"{at}/in")
        queue.run(spark, f"{at}/in", f"{at}/out", f"{at}/cp", handle, files_each=100)
        if table.read().count() == 12:
            break
    assert {(r["id"], r["attempt"]) for r in table.read().collect()} == {(f"t{k}", 2 if k % 4 == 1 else 1) for k in range(12)}
    assert all(tried[f"t{k}"] >= 2 for k in range(12) if k % 3 == 0 or k % 4 == 1) and all(tried[f"t{k}"] >= 1 for k in range(12))


def test_queue_by_the_wall_clock(spark, tmp_path):
    at = str(tmp_path)
    queue.send(spark.createDataFrame([("a", "message", 0, 1, "x"), ("later", "message", 0, 1 << 52, "y")], queue.EVENT), f"{at}/in")
    queue.run(spark, f"{at}/in", f"{at}/out", f"{at}/cp", seconds=25)
    assert {r["id"] for r in queue.results(spark, f"{at}/out").collect()} == {"a"}


def test_pages_of_one_small_file_are_many_tasks(spark):
    """A file of parts is one task to Spark; the pages made of it are dealt over all cores before Python walks them."""
    for query in ("parse_product_selector", "page_excerpts", "listing_products", "rendered_reparse"):
        pages = registry._pages_of_parts(spark, SF, "selector") if query != "rendered_reparse" else registry.queries()[query](spark, SF)
        assert pages.select(F.spark_partition_id()).distinct().count() > 1
        assert "REPARTITION_BY_NUM" in registry.queries()[query](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_plain_pages_are_read_as_the_parser_reads_them():
    """Fuzz: the same calls in the same order, whichever way a page is read."""

    class Calls(markup.Markup):
        def __init__(self):
            super().__init__()
            self.calls, self.walked = [], False
            self.handle_starttag = lambda tag, attrs: self.calls.append((tag, tuple(attrs)))
            self.handle_endtag = lambda tag: self.calls.append("/" + tag)
            self.handle_data = lambda data: self.calls.append([data])

        def feed(self, html):
            self.walked = True
            super().feed(html)

    rng, plain = random.Random(8), 0
    parts = ["<p>", "</p>", '<P Class="A b">', "<a href=\"x\" data-k='y\"z'>", "<br>", "<br/>", "<img alt=\"\" src=q>", "text", "a &amp; b", "&lt", "&", "x<y", "<!-- c -->", "<!doctype html>", "<title>T &amp; U</title>", "<title>a<b></title>", "<script>if(a&&b){}</script>",
             '<script type="application/ld+json">{"a": "&amp;"}</script>', '<script>"<b>"</script>', "</script>", "<style>a>b{}</style>", "<textarea>", "<xmp>", "\n ", "<a b>", '<a b="1"c="2">', '<a b = "1">', '<a b="1&amp;2">', "<x:y>", "</h1 >", "</>", "<a B=''>", '<p\nid="i"\t>', '<a b="1" b="2">', "<SCRIPT>x</SCRIPT>", "\x0b", "<p\x0bx>"]
    for _ in range(4000):
        html = "".join(rng.choice(parts) for _ in range(rng.randrange(7)))
        got, want = Calls(), Calls()
        got.read(html)
        want.feed(html)
        want.close()
        assert got.calls == want.calls, html
        plain += not got.walked
    assert plain > 1000


def test_excerpts(spark):
    page = (
        '<html><body><div class="product_main  wide"><h1>A &amp; "B" &lt;c&gt;</h1><br><img src=x.png alt></div><p>no</p><table class="striped table-striped"><tr><th>1</th></tr><tbody><tr><th>2</th><td>two</td></tr>'
        "<tr><td>3</td></tr></tbody></table><table><tr><td>other</td></tr></table><script type='application/ld+json'>{\"a\": 1 < 2}</script><link rel=canonical href='/p?a=1&b=2'><main class='redesigned-card'>m<!-- c --></main></q></body>"
    )
    cases = {
        ".product_main": '<div class="product_main wide"><h1>A &amp; "B" &lt;c&gt;</h1><br/><img src="x.png" alt=""/></div>',
        "table.table-striped tr:nth-of-type(1)": '<tr><th>1</th></tr>\n<tr><th>2</th><td>two</td></tr>',
        "table.table-striped > tr": "<tr><th>1</th></tr>",
        "body table > tbody tr:nth-of-type(2) td": "<td>3</td>",
        'link[rel="canonical"]': '<link rel="canonical" href="/p?a=1&amp;b=2"/>',
        'script[type="application/ld+json"]': '<script type="application/ld+json">{"a": 1 < 2}</script>',
        "main.redesigned-card": '<main class="redesigned-card">m<!-- c --></main>',
        "*[alt]": '<img src="x.png" alt=""/>', "div > body": "", "#none": "", "p": "<p>no</p>",
    }
    df = spark.createDataFrame([(page,), (None,), ("",), ("<![foo[bar]]><p>x",), ("<div>" * 20_000 + "<p>deep",)], "html string")
    for selector, want in cases.items():
        got = [r[0] for r in df.select(page_tree.html_excerpt(selector)("html")).collect()]
        assert got[0] == want and got[1] is None and got[2] == ""
    got = [r[0] for r in df.select(page_tree.html_excerpt("p", "body > p", ".product_main h1")("html")).collect()]
    assert got == ["<p>no</p>\n<h1>A &amp; \"B\" &lt;c&gt;</h1>", None, "", got[3], "<p>deep</p>"]
    for bad in ("", "a >", "a:hover", "[x", "a,b"):
        with pytest.raises(ValueError):
            page_tree.html_excerpt(bad)


def test_recovery_totals(spark):
    tries = [("ok", 1, 200), ("back", 1, 429), ("back", 2, 503), ("back", 3, 200), ("back", 4, 429), ("gone", 1, 503), ("gone", 2, 503), ("gone", 3, 503), ("gone", 4, 503), ("no", 1, 404)]
    states = {(200): "succeeded", 404: "blocked"}
    attempts = spark.createDataFrame([(t, a, c, states.get(c, "retrying" if a < 4 else "failed")) for t, a, c in tries], "target_id string, attempt int, status_code int, state string")
    at = "2024-01-01 00:00:"
    messages = spark.createDataFrame([(at + "00", None), (at + "31", None), (at + "00", at + "10")], "d string, a string").select(F.col("d").cast("timestamp").alias("delivered_at"), F.col("a").cast("timestamp").alias("acknowledged_at"))
    stored = spark.createDataFrame([("back",), ("back",)], "target_id string")
    got = reports.recovery(attempts, messages, stored, F.lit(at + "59").cast("timestamp")).collect()
    assert [tuple(r) for r in got] == [(4, 2, 6, 1, 1, 1, 1)]
    empty = reports.recovery(attempts.limit(0), messages.limit(0), stored.limit(0), F.lit(at + "59").cast("timestamp")).collect()
    assert [tuple(r) for r in empty] == [(0, 0, 0, 0, 0, 0, 0)]


def test_json_messages_by_consumer_group(spark, tmp_path):
    """Every group gets every message once across restarts; a bad message is told, not lost, and stops nothing."""
    at = str(tmp_path)
    message = lambda k: (f"t{k}", "r", f"https://s.example/{k}?a=\"{k}\"", "generic", "http", k)
    send = lambda ks: ingest.enqueue(spark.createDataFrame([message(k) for k in ks], ingest.MESSAGE), f"{at}/in")
    seen = defaultdict(list)

    def read(group):
        rows = ingest.payloads(spark, f"{at}/in", files_each=1)
        sink = lambda batch, number: seen[group].extend(tuple(r) for r in batch.collect())
        rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/{group}").trigger(availableNow=True).start().awaitTermination()

    send(range(5))
    read("one")
    send(range(5, 9))
    spark.createDataFrame([("{not json",), ('{"target_id": "x", "attempt": "many"}',)], "value string").coalesce(1).write.mode("append").text(f"{at}/in")
    read("one")
    read("one")
    read("two")
    for group in ("one", "two"):
        good = sorted(r[:6] for r in seen[group] if r[-1])
        assert good == sorted(message(k) for k in range(9))
        assert {r[-2] for r in seen[group] if not r[-1]} == {"{not json", '{"target_id": "x", "attempt": "many"}'} and len(seen[group]) == 11


def test_limiter_equals_a_literal_one(spark):
    rng = random.Random(7)
    rows = [(f"h{rng.randrange(4)}", k, round(rng.random() * 60, 2), rng.choice([0.0, 1.5, 20.0])) for k in range(300)] + [(None, 900, 1.0, 2.0), (None, 901, 1.0, 2.0)]
    for concurrency, spacing in ((1, 0.0), (2, 1.0), (5, 0.25)):
        want = {}
        for h in {r[0] for r in rows}:
            running, last = [], None  # ends of what runs
            for _, i, at, seconds in sorted((r for r in rows if r[0] == h), key=lambda r: (r[2], r[1])):
                start = at if last is None else max(at, last + spacing)
                if len(running) == concurrency:
                    start = max(start, min(running))
                    running.remove(min(running))
                running.append(start + seconds)
                want[i], last = (start, start + seconds), start
        got = reliability.limited(spark.createDataFrame(rows, "host string, id long, at double, seconds double"), concurrency, spacing).collect()
        assert {r["id"]: (r["starts_at"], r["ends_at"]) for r in got} == want
        # Never more than so many at once, never closer than the spacing.
        for h in {r[0] for r in rows}:
            starts = sorted(r["starts_at"] for r in got if r["host"] == h)
            assert all(b - a >= spacing - 1e-9 for a, b in zip(starts, starts[1:]))
            assert all(sum(r["starts_at"] <= t < r["ends_at"] for r in got if r["host"] == h) <= concurrency for t in starts)
