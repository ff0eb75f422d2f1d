"""Queries of the catalog side, by name, with the SQL that they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.page_tree import html_excerpt
from ..operators import crawl, extract, lifecycle, quality, reads, reliability, reports
from ..session import spread
from ..sources import fixtures
from ..sources import reports as report_files
from ..sources import views as V
from ..sources.schemas import REQUIRED_FIELDS
from ..sources.keyed import KeyedTable, commit, committed
from ..streaming import ingest, queue

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

AS_OF = "2024-01-15 00:00:00"


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name, with its SQL over the views named."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = V.sql(sql, *views) if views else sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_ISO = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
_PRINTS = """tags AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<script\\b[^>]*>).*?(</script\\s*>)|(<style\\b[^>]*>).*?(</style\\s*>)', '\\1\\2\\3\\4', 'g'), '<[a-zA-Z][^>]*>')) AS tag FROM pages),
 sigs AS (SELECT page_id, array_to_string(list_concat([lower(regexp_extract(tag, '^<([a-zA-Z][a-zA-Z0-9:-]*)', 1))], list_sort(list_filter(regexp_split_to_array(regexp_extract(tag, '\\sclass="([^"]*)"', 1), '\\s+'), lambda c: c <> ''))[1:3]), '.') AS sig FROM tags),
 counted AS (SELECT page_id, sig, count(*) AS n FROM sigs GROUP BY 1, 2),
 prints AS (SELECT page_id, left(sha256(string_agg(sig || ':' || n, '|' ORDER BY sig)), 16) AS dom_fingerprint FROM counted GROUP BY 1)"""
_DRIFT = f"""{_PRINTS}, caps AS (SELECT seq, source, coverage, confidence, dom_fingerprint FROM captures_v JOIN prints ON seq = page_id),
 based AS (SELECT *, row_number() OVER w AS rn, max(coverage) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM caps WINDOW w AS (PARTITION BY source ORDER BY seq)),
 deg AS (SELECT *, coalesce(coverage < base, false) OR confidence < 0.9 AS bad FROM based),
 folded AS (SELECT *, last_value(CASE WHEN rn = 1 OR NOT bad THEN dom_fingerprint END IGNORE NULLS) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM deg),
 drifted AS (SELECT *, coalesce(prev <> dom_fingerprint AND bad, false) AS drift FROM folded)"""


def _prints(spark: SparkSession, sf: str) -> DataFrame:
    return quality.fingerprint(V.read(spark, sf, "pages"), "page_id")


def _captures(spark: SparkSession, sf: str) -> DataFrame:
    return V.captures(spark, sf).drop("html").join(_prints(spark, sf), F.col("seq") == F.col("page_id")).drop("page_id")


# ------------------------------------------------------------------------------------- reads


@query(
    f"""SELECT t.connector, t.targets, t.succeeded, t.last_seen_at, a.average_latency_ms, d.last_drift_seq FROM (
      SELECT connector, count(*) AS targets, count(*) FILTER (status = 'succeeded') AS succeeded, {_ISO.format("max(updated_at)")} AS last_seen_at FROM targets_v GROUP BY 1) t
      LEFT JOIN (SELECT connector, round(avg(latency_ms), 2) AS average_latency_ms FROM attempts_v a JOIN hosts_v h ON a.target_id = h.id GROUP BY 1) a USING (connector)
      LEFT JOIN (WITH {_DRIFT} SELECT source AS connector, max(seq) AS last_drift_seq FROM drifted WHERE drift GROUP BY 1) d USING (connector)""",
    "targets", "attempts", "hosts", "captures",
)
def source_health(spark: SparkSession, sf: str) -> DataFrame:
    tried = V.attempts(spark, sf).join(V.hosts(spark, sf).select(F.col("id").alias("h"), "connector"), F.col("target_id") == F.col("h"))
    drifts = quality.drift(_captures(spark, sf)).filter("drift").select("source", F.col("seq").alias("detected_at"))
    out = reads.source_health(V.targets(spark, sf), tried, drifts)
    return out.select("connector", "targets", "succeeded", V.iso("last_seen_at").alias("last_seen_at"), "average_latency_ms", F.col("last_drift_at").alias("last_drift_seq"))


@query(
    f"""SELECT r.id, r.connector, {_ISO.format("r.created_at")} AS created_at, """
    + ", ".join(f"count(*) FILTER (t.status = '{s}') AS {s}" for s in V.STATUS_OF.values())
    + " FROM runs_v r LEFT JOIN targets_v t ON t.run_id = r.id GROUP BY ALL",
    "runs", "targets",
)
def run_summary_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return reads.status_counts(V.runs(spark, sf), V.targets(spark, sf)).withColumn("created_at", V.iso("created_at"))


@query(f"SELECT id, connector, {_ISO.format('created_at')} AS created_at FROM runs_v ORDER BY runs_v.created_at DESC, id LIMIT 50", "runs")
def recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    return reads.latest(V.runs(spark, sf), "created_at", 50).withColumn("created_at", V.iso("created_at"))


@query(
    """SELECT r.id, CASE WHEN bool_and(t.status = 'succeeded') THEN 'succeeded'
      WHEN bool_and(t.status IN ('succeeded', 'failed', 'blocked')) THEN CASE WHEN bool_or(t.status = 'failed') THEN 'failed' ELSE 'blocked' END
      WHEN bool_or(t.status = 'running') THEN 'running' ELSE 'queued' END AS status
      FROM runs_v r LEFT JOIN targets_v t ON t.run_id = r.id GROUP BY r.id""",
    "runs", "targets",
)
def run_status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return reads.run_status(V.runs(spark, sf), V.targets(spark, sf))


_METRICS = """SELECT 'targets{status="' || status || '"}' AS key, count(*) AS value FROM targets_v GROUP BY status UNION ALL SELECT 'products', count(*) FROM products_v
  UNION ALL SELECT 'fetch_attempts', count(*) FROM attempts_v UNION ALL SELECT 'review_items', count(*) FROM reviews_v WHERE status = 'pending'"""


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return reads.metrics(V.targets(spark, sf), products=V.products(spark, sf), fetch_attempts=V.attempts(spark, sf), review_items=V.reviews(spark, sf).filter("status = 'pending'"))


@query(_METRICS, "targets", "products", "attempts", "reviews")
def status_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf)


@query(f"SELECT '# TYPE ingest_targets gauge' || chr(10) || string_agg('ingest_' || key || ' ' || value, chr(10) ORDER BY key) || chr(10) AS text FROM ({_METRICS})", "targets", "products", "attempts", "reviews")
def metrics_text(spark: SparkSession, sf: str) -> DataFrame:
    return reads.metrics_text(_metrics(spark, sf))


@query("SELECT id, title, source, confidence, captured FROM products_v WHERE confidence >= 0.9 AND source = 'Brand#12' ORDER BY captured DESC, id LIMIT 100", "products")
def product_listing(spark: SparkSession, sf: str) -> DataFrame:
    return reads.list_products(V.products(spark, sf), 0.9, "Brand#12", 100).select("id", "title", "source", "confidence", "captured")


@query("SELECT id, title, source, confidence, captured FROM products_v WHERE confidence >= 0.8 ORDER BY captured DESC, id LIMIT 500", "products")
def product_listing_all_sources(spark: SparkSession, sf: str) -> DataFrame:
    return reads.list_products(V.products(spark, sf), 0.8, "", 500).select("id", "title", "source", "confidence", "captured")


@query("SELECT * FROM products_v WHERE id = 42", "products")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return V.products(spark, sf).filter(F.col("id") == 42)


@query(f"SELECT a.id, target_id, {_ISO.format('a.created_at')} AS created_at, url FROM attempts_v a JOIN hosts_v h ON target_id = h.id WHERE target_id = 7 ORDER BY a.created_at, a.id LIMIT 1000", "attempts", "hosts")
def attempt_listing(spark: SparkSession, sf: str) -> DataFrame:
    tried = lifecycle.number_attempts(V.attempts(spark, sf), "target_id", ["created_at", "id"])
    return reads.list_attempts(tried, V.hosts(spark, sf), target_id=7).select("id", "target_id", V.iso("created_at").alias("created_at"), "url")


@query("SELECT r.id, r.product_id, r.status, r.reason, r.created, title, canonical_url, confidence FROM reviews_v r JOIN products_v p ON r.product_id = p.id WHERE r.status = 'pending' ORDER BY r.created DESC, r.id LIMIT 100", "reviews", "products")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return reads.review_queue(V.reviews(spark, sf), V.products(spark, sf))


@query(f"SELECT id, target_id, {_ISO.format('created_at')} AS created_at FROM attempts_v WHERE event_type <> 'purchase' AND created_at + to_seconds(k * 60) <= TIMESTAMP '{AS_OF}' ORDER BY attempts_v.created_at, id LIMIT 100", "attempts")
def due_outbox(spark: SparkSession, sf: str) -> DataFrame:
    a = V.attempts(spark, sf)
    box = a.withColumn("published_at", F.when(F.col("event_type") == "purchase", F.col("created_at"))).withColumn("available_at", F.timestamp_micros(F.unix_micros("created_at") + F.col("k").cast("long") * 60_000_000))
    return reads.due_outbox(box, F.lit(AS_OF).cast("timestamp")).select("id", "target_id", V.iso("created_at").alias("created_at"))


@query("SELECT target_id, string_agg(status_code::VARCHAR, ',' ORDER BY created_at, id) AS request_statuses, string_agg(id::VARCHAR, ',' ORDER BY created_at, id) AS attempt_ids FROM attempts_v GROUP BY 1", "attempts")
def attempt_history_arrays(spark: SparkSession, sf: str) -> DataFrame:
    out = reads.attempt_arrays(V.attempts(spark, sf))
    return out.select("target_id", F.array_join(F.col("request_statuses").cast("array<string>"), ",").alias("request_statuses"), F.array_join(F.col("attempt_ids").cast("array<string>"), ",").alias("attempt_ids"))


@query(
    """SELECT target_id, count(*) AS n, round(median(latency_ms), 3) AS p50_ms, round(max(latency_ms) FILTER (r = greatest(floor(c * 0.95), 1)), 3) AS p95_ms
      FROM (SELECT target_id, latency_ms, row_number() OVER (PARTITION BY target_id ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY target_id) AS c FROM attempts_v) GROUP BY 1""",
    "attempts",
)
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return reads.latency_percentiles(V.attempts(spark, sf), "target_id")


@query(
    """SELECT p.id, 3 / 4.0::DOUBLE AS required_field_coverage, coalesce(n, 0) AS fetch_attempts, r.id IS NOT NULL AS review_required, r.id AS review_id, r.reason AS review_reason, r.status AS review_status
      FROM products_v p LEFT JOIN (SELECT target_id, count(*) AS n FROM attempts_v GROUP BY 1) a ON a.target_id = p.id LEFT JOIN reviews_v r ON r.product_id = p.id""",
    "products", "attempts", "reviews",
)
def product_output(spark: SparkSession, sf: str) -> DataFrame:
    p = V.products(spark, sf).withColumns({"target_id": F.col("id"), "price_amount": F.col("price").cast("string"), "currency": F.lit("USD"), "availability": F.lit("")})
    out = reads.product_output(p, V.attempts(spark, sf), V.reviews(spark, sf))
    return out.select("id", "required_field_coverage", "fetch_attempts", "review_required", "review_id", "review_reason", "review_status")


@query("SELECT count_if(confidence >= 0.9) AS confident, count_if(r.id IS NOT NULL) AS to_review, count(*) AS shown FROM products_v p LEFT JOIN reviews_v r ON r.product_id = p.id", "products", "reviews")
def catalog_counters(spark: SparkSession, sf: str) -> DataFrame:
    p, r = V.products(spark, sf), V.reviews(spark, sf).select("product_id")
    return p.join(r, p["id"] == r["product_id"], "left").agg(F.count_if(F.col("confidence") >= 0.9).alias("confident"), F.count("product_id").alias("to_review"), F.count("*").alias("shown"))


@query(
    """SELECT connector, count(*) AS runs, sum(CASE WHEN n IS NULL THEN 0 ELSE n END)::BIGINT AS targets, sum(coalesce(ok, 0))::BIGINT AS succeeded, round(sum(coalesce(ok, 0)) / greatest(sum(coalesce(n, 0)), 1)::DOUBLE, 4) AS success_rate
      FROM runs_v r LEFT JOIN (SELECT run_id, count(*) AS n, count_if(status = 'succeeded') AS ok FROM targets_v GROUP BY 1) t ON t.run_id = r.id GROUP BY 1""",
    "runs", "targets",
)
def cross_run_totals(spark: SparkSession, sf: str) -> DataFrame:
    per = reads.status_counts(V.runs(spark, sf), V.targets(spark, sf))
    n = sum((F.col(s) for s in V.STATUS_OF.values()), F.lit(0))
    out = per.groupBy("connector").agg(F.count("*").alias("runs"), F.sum(n).alias("targets"), F.sum("succeeded").alias("succeeded"))
    return out.withColumn("success_rate", F.round(F.col("succeeded") / F.greatest("targets", F.lit(1)), 4))


# ------------------------------------------------------------------------------------ scalars


@query("SELECT page_id, url, rtrim(url, '/') AS normalized_url, count(*) OVER (PARTITION BY rtrim(url, '/')) > 1 AS duplicate FROM pages")
def url_normalize_dupes(spark: SparkSession, sf: str) -> DataFrame:
    p = V.read(spark, sf, "pages").select("page_id", "url", S.normalise_url(F.col("url")).alias("normalized_url"))
    twice = lifecycle.duplicate_urls(p.withColumn("run_id", F.lit(1))).select("normalized_url", F.lit(True).alias("d"))
    return p.join(twice, "normalized_url", "left").select("page_id", "url", "normalized_url", F.coalesce("d", F.lit(False)).alias("duplicate"))


_PRICE_IN = "CASE p_partkey % 6 WHEN 0 THEN '£' || p_retailprice WHEN 1 THEN 'from $ ' || p_size || ',' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '.50 each' WHEN 2 THEN p_retailprice || ' €' WHEN 3 THEN 'sold out' WHEN 4 THEN '€' || chr(160) || p_size ELSE 'No 5 at ₩' || p_size END"


@query(
    f"""SELECT p_partkey, nullif(replace(regexp_extract(s, '([$£€₩])?\\s*(\\d[\\d,]*(?:\\.\\d{{1,2}})?)', 2), ',', ''), '') AS amount,
      CASE regexp_extract(s, '([$£€₩])?\\s*(\\d[\\d,]*(?:\\.\\d{{1,2}})?)', 1) WHEN '$' THEN 'USD' WHEN '£' THEN 'GBP' WHEN '€' THEN 'EUR' WHEN '₩' THEN 'KRW' END AS currency
      FROM (SELECT p_partkey, replace({_PRICE_IN}, chr(160), ' ') AS s FROM part)"""
)
def price_parse(spark: SparkSession, sf: str) -> DataFrame:
    part, k = V.read(spark, sf, "part"), F.col("p_partkey") % 6
    price, size = F.col("p_retailprice").cast("string"), F.col("p_size").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("£"), price)).when(k == 1, F.concat(F.lit("from $ "), size, F.lit(","), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(".50 each")))
        .when(k == 2, F.concat(price, F.lit(" €"))).when(k == 3, "sold out").when(k == 4, F.concat(F.lit("€ "), size)).otherwise(F.concat(F.lit("No 5 at ₩"), size))
    )
    return part.select("p_partkey", S.price_amount(text).alias("amount"), S.price_currency(text, F.lit(None).cast("string")).alias("currency"))


@query("SELECT p_partkey, trim(list_last(string_split(s, '/'))) AS availability FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'https://schema.org/' || p_type WHEN 1 THEN ' ' || p_type || ' ' ELSE 'a/b/ ' || p_brand END AS s FROM part)")
def availability_norm(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    s = F.when(k == 0, F.concat(F.lit("https://schema.org/"), "p_type")).when(k == 1, F.concat(F.lit(" "), "p_type", F.lit(" "))).otherwise(F.concat(F.lit("a/b/ "), "p_brand"))
    return V.read(spark, sf, "part").select("p_partkey", S.availability(s).alias("availability"))


#: Hosts and what the policy says of them without an allowlist: names and public addresses may be fetched.
_HOSTS = {
    "shop.example": None, "93.184.216.7": None, "[2606:2800:220::1]": None, "10.0.0.8": "private_address", "127.0.0.1": "private_address", "[0:0:0:0:0:0:0:1]": "private_address",
    "[64:ff9b::7f00:1]": "private_address", "[fec0::1]": "private_address", "[100::1]": "private_address", "2130706433": "private_address", "0x7f.1": "private_address",
    "[::ffff:10.0.0.1]": "private_address", "[2002:7f00:1::]": "private_address", "169.254.1.1": "private_address", "100.64.0.1": "private_address",
}
_HOST_LIST = list(_HOSTS)


def _url_of(k, hosts: list[str]):
    host = F.element_at(F.array(*map(F.lit, hosts)), (F.pmod(k, F.lit(len(hosts))) + 1).cast("int"))
    return F.when(k % 17 == 0, "file:///etc/passwd").otherwise(F.concat(F.lit("http://"), host, F.lit("/p/"), k.cast("string")))


_HOST_ROWS = ", ".join(f"({k}, '{h}', " + (f"'{e}'" if e else "NULL") + ")" for k, (h, e) in enumerate(_HOSTS.items()))


@query(
    f"""SELECT page_id, CASE WHEN page_id % 17 = 0 THEN 'invalid_url' WHEN page_id % 2 = 1 AND host <> 'shop.example' THEN 'host_not_allowed' ELSE error END AS error
      FROM pages JOIN (VALUES {_HOST_ROWS}) h(k, host, error) ON page_id % {len(_HOSTS)} = k"""
)
def url_policy(spark: SparkSession, sf: str) -> DataFrame:
    u = V.read(spark, sf, "pages").select("page_id", _url_of(F.col("page_id"), _HOST_LIST).alias("u"))
    closed, open_ = S.url_policy(F.col("u"), ["shop.example"]), S.url_policy(F.col("u"), [])
    return u.select("page_id", F.when(F.col("page_id") % 2 == 1, closed).otherwise(open_).alias("error"))


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'dns_error' WHEN 2 THEN 'private_address' END AS error FROM pages"""
)
def url_policy_dns(spark: SparkSession, sf: str) -> DataFrame:
    """Names judged by a table of their addresses: public ones, none, a private one among public ones, IPv6."""
    rows = [("a.example", ["93.184.216.7", "2606:2800:220::1"]), ("b.example", []), ("c.example", ["93.184.216.7", "10.1.1.1"]), ("d.example", ["2606:2800:220::9"])]
    known = spark.createDataFrame(rows, "host string, addresses array<string>")
    host = F.element_at(F.array(*(F.lit(h) for h, _ in rows)), (F.col("page_id") % 4 + 1).cast("int"))
    u = V.read(spark, sf, "pages").select("page_id", host.alias("host"), F.concat(F.lit("https://"), host, F.lit("/x")).alias("u"))
    u = u.join(F.broadcast(known), "host", "left")
    return u.select("page_id", S.url_policy(F.col("u"), [], addresses=F.col("addresses")).alias("error"))


@query(
    """SELECT id, CASE WHEN status_code BETWEEN 300 AND 399 THEN 'redirect' WHEN k * 100000 > 5000000 THEN 'response_too_large' WHEN status_code = 429 OR status_code >= 400 THEN 'http_' || status_code ELSE 'ok' END AS outcome,
      status_code = 429 OR status_code >= 500 AS transient FROM attempts_v""",
    "attempts",
)
def http_classify(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("status_code")
    return V.attempts(spark, sf).select("id", S.http_class(c, F.col("k") * 100000).alias("outcome"), S.http_transient(c).alias("transient"))


@query(
    f"""SELECT id, CASE k % 5 WHEN 0 THEN k / 2.0::DOUBLE WHEN 1 THEN 0.0 WHEN 2 THEN greatest(epoch_us(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(id)) / 1e6 - epoch_us(TIMESTAMP '{AS_OF}') / 1e6, 0.0) END AS seconds FROM attempts_v""",
    "attempts",
)
def retry_after_parse(spark: SparkSession, sf: str) -> DataFrame:
    k, stamp = F.col("k") % 5, F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 60_000_000)
    header = F.when(k == 0, (F.col("k") / 2).cast("string")).when(k == 1, F.concat(F.lit("-"), F.col("k").cast("string"))).when(k == 2, F.date_format(stamp, "E, dd MMM yyyy HH:mm:ss 'GMT'")).when(k == 3, "not-a-date")
    return V.attempts(spark, sf).select("id", S.retry_after(header, F.lit(AS_OF).cast("timestamp")).alias("seconds"))


@query("SELECT id, CASE WHEN k % 3 = 0 THEN least(k / 2.0::DOUBLE, 30.0) ELSE least(0.25 * pow(2.0, k % 12), 30.0) END AS delay FROM attempts_v", "attempts")
def backoff_delay(spark: SparkSession, sf: str) -> DataFrame:
    after = F.when(F.col("k") % 3 == 0, F.col("k") / 2.0)
    return V.attempts(spark, sf).select("id", S.backoff(F.col("k") % 12 + 1, after, jitter=0.0).alias("delay"))


@query("SELECT id, len(list_filter(string_split(' A.example, ,b.Example,' || target_id || '.c ', ','), lambda x: trim(x) <> '')) AS n, array_to_string(list_transform(list_filter(string_split(' A.example, ,b.Example,' || target_id || '.c ', ','), lambda x: trim(x) <> ''), lambda x: lower(trim(x))), ';') AS hosts FROM attempts_v", "attempts")
def host_lists(spark: SparkSession, sf: str) -> DataFrame:
    h = S.split_hosts(F.concat(F.lit(" A.example, ,b.Example,"), F.col("target_id").cast("string"), F.lit(".c ")))
    return V.attempts(spark, sf).select("id", F.size(h).cast("long").alias("n"), F.array_join(h, ";").alias("hosts"))


# ---------------------------------------------------------------------------------- lifecycle


@query("SELECT id, target_id, row_number() OVER (PARTITION BY target_id ORDER BY created_at, id) AS attempt FROM attempts_v", "attempts")
def attempt_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.number_attempts(V.attempts(spark, sf), "target_id", ["created_at", "id"]).select("id", "target_id", F.col("attempt").cast("long").alias("attempt"))


@query("SELECT run_id, attempt, part_id, supplier_id, status FROM targets_v QUALIFY row_number() OVER (PARTITION BY run_id, attempt ORDER BY updated_at, part_id, supplier_id, status, price, quantity) = 1", "targets")
def attempt_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = lifecycle.first_write(V.targets(spark, sf), ["run_id", "attempt"], ["updated_at", "part_id", "supplier_id", "status", "price", "quantity"])
    return rows.select("run_id", "attempt", "part_id", "supplier_id", "status")


@query(
    """SELECT run_id, attempt, first_value(id) OVER w AS id, part_id, price FROM targets_v WINDOW w AS (PARTITION BY run_id, attempt ORDER BY updated_at, part_id, supplier_id, status, price, quantity ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
      QUALIFY row_number() OVER (PARTITION BY run_id, attempt ORDER BY updated_at DESC, part_id DESC, supplier_id DESC, status DESC, price DESC, quantity DESC) = 1""",
    "targets",
)
def product_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = lifecycle.upsert(V.targets(spark, sf), ["run_id", "attempt"], ["updated_at", "part_id", "supplier_id", "status", "price", "quantity"], ["id"])
    return rows.select("run_id", "attempt", "id", "part_id", "price")


_STATE = "CASE WHEN status_code < 400 THEN 'succeeded' WHEN (status_code = 429 OR status_code >= 500) AND attempt < 4 THEN 'retrying' WHEN NOT (status_code = 429 OR status_code >= 500) THEN 'blocked' ELSE 'failed' END"


def _states(spark: SparkSession, sf: str) -> DataFrame:
    a = lifecycle.number_attempts(V.attempts(spark, sf), "target_id", ["created_at", "id"])
    c = F.col("status_code")
    return a.withColumn("state", lifecycle.outcome(S.http_transient(c), c < 400, F.col("attempt"), F.lit(4)))


@query(
    f"""SELECT target_id, coalesce(min(attempt) FILTER (state IN ('succeeded', 'blocked')), max(attempt)) AS attempts,
      coalesce(arg_min(state, attempt) FILTER (state IN ('succeeded', 'blocked')), arg_max(state, attempt)) AS status
      FROM (SELECT *, {_STATE} AS state FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY created_at, id) AS attempt FROM attempts_v)) GROUP BY 1""",
    "attempts",
)
def target_transition(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.target_states(_states(spark, sf)).select("target_id", F.col("attempts").cast("long").alias("attempts"), "status")


@query(f"SELECT id, attempt, {_STATE} AS state FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY created_at, id) AS attempt FROM attempts_v)", "attempts")
def attempt_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _states(spark, sf).select("id", F.col("attempt").cast("long").alias("attempt"), "state")


@query(
    "SELECT id, round(3.0 * (r - 1) + max(x) OVER (PARTITION BY target_id ORDER BY created_at, id), 3) AS starts_at FROM (SELECT *, epoch_us(created_at) / 1e6 - 1704067200 - 3.0 * (r - 1) AS x FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY created_at, id) AS r FROM attempts_v))",
    "attempts",
)
def host_pacing(spark: SparkSession, sf: str) -> DataFrame:
    a = V.attempts(spark, sf).withColumn("at", F.unix_micros("created_at") / 1e6 - 1704067200)
    return lifecycle.pace(a, "target_id", "at", ["created_at", "id"], 3.0).select("id", F.round("starts_at", 3).alias("starts_at"))


@query(
    """SELECT c_custkey AS run_id, rtrim(u, '/') AS normalized_url, i AS position FROM (SELECT c_custkey, unnest(range(1, 4)) AS i, 'https://shop.example/' || c_custkey || '/' || i || CASE WHEN c_custkey % 7 = 0 AND i = 3 THEN '' ELSE '/' END AS u FROM customer)
      WHERE i <= 1 + c_custkey % 3""",
)
def create_run(spark: SparkSession, sf: str) -> DataFrame:
    targets, _, _ = lifecycle.create_run(_run_requests(spark, sf), F.lit(AS_OF).cast("timestamp"))
    return targets.select("run_id", "normalized_url", F.substring_index("normalized_url", "/", -1).cast("long").alias("position"))


def _run_requests(spark: SparkSession, sf: str) -> DataFrame:
    c = V.read(spark, sf, "customer")
    url = lambda i: F.concat(F.lit("https://shop.example/"), F.col("c_custkey").cast("string"), F.lit(f"/{i}"), F.when((F.col("c_custkey") % 7 == 0) & F.lit(i == 3), "").otherwise("/"))
    return c.select(F.col("c_custkey").alias("id"), F.lit("generic").alias("connector"), F.lit("http").alias("render_mode"), F.array(url(1), url(2), url(3)).alias("start_urls"), (F.lit(1) + F.col("c_custkey") % 3).cast("int").alias("max_pages"), F.lit(4).alias("max_attempts"))


_RUN_URLS = """SELECT c_custkey AS run_id, u AS url, rtrim(u, '/') AS normalized_url, sha256(c_custkey || '|' || rtrim(u, '/')) AS target_id FROM (
  SELECT c_custkey, unnest(range(1, 4)) AS i, 'https://shop.example/' || c_custkey || '/' || i || CASE WHEN c_custkey % 7 = 0 AND i = 3 THEN '' ELSE '/' END AS u FROM customer) WHERE i <= 1 + c_custkey % 3"""


@query(
    f"""SELECT sha256(target_id || '|0') AS id, target_id,
      '{{"target_id":"' || target_id || '","run_id":' || run_id || ',"url":"' || url || '","connector":"generic","render_mode":"http","attempt":1}}' AS payload,
      '{AS_OF}' AS available_at, true AS unpublished FROM ({_RUN_URLS})"""
)
def registered_outbox(spark: SparkSession, sf: str) -> DataFrame:
    """Targets and their first messages are committed by one job; the outbox as read back from its files, payloads as JSON."""
    at = ingest.run_folder(spark, "registered")
    commit(lifecycle.create_rows(_run_requests(spark, sf), F.lit(AS_OF).cast("timestamp"))[0], at)
    box = committed(spark, at, "outbox", lifecycle.OUTBOX)
    return box.select("id", "target_id", F.to_json("payload").alias("payload"), F.date_format("available_at", "yyyy-MM-dd HH:mm:ss").alias("available_at"), F.col("published_at").isNull().alias("unpublished"))


@query(f"SELECT target_id AS id, run_id, url, normalized_url, 'queued' AS status, 0 AS attempts, 4 AS max_attempts FROM ({_RUN_URLS})")
def registered_targets(spark: SparkSession, sf: str) -> DataFrame:
    """The targets of the same kind of commit, from their own files."""
    at = ingest.run_folder(spark, "registered")
    commit(lifecycle.create_rows(_run_requests(spark, sf), F.lit(AS_OF).cast("timestamp"))[0], at)
    return committed(spark, at, "crawl_targets", lifecycle.TARGET).select("id", "run_id", "url", "normalized_url", "status", "attempts", "max_attempts")


@query(
    """SELECT run_id, attempt, first_value(id) OVER w AS id, part_id, price FROM targets_v WINDOW w AS (PARTITION BY run_id, attempt ORDER BY updated_at, part_id, supplier_id, status, price, quantity ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
      QUALIFY row_number() OVER (PARTITION BY run_id, attempt ORDER BY updated_at DESC, part_id DESC, supplier_id DESC, status DESC, price DESC, quantity DESC) = 1""",
    "targets",
)
def stored_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """The upsert as a stored table takes it: loads one after another by time, each merged into the buckets that it touches; the first id stays."""
    order = ["updated_at", "part_id", "supplier_id", "status", "price", "quantity"]
    rows = V.targets(spark, sf).select("run_id", "attempt", "id", *order)
    table = KeyedTable(spark, ingest.run_folder(spark, "products"), rows.schema.simpleString().removeprefix("struct<").removesuffix(">"), ["run_id", "attempt"], 16)
    for lo, hi in (("0001-01-01", "1994-01-01"), ("1994-01-01", "1997-01-01"), ("1997-01-01", "9999-01-01")):
        table.merge(rows.filter((F.col("updated_at") >= lo) & (F.col("updated_at") < hi)), order, ["id"])
    return table.read().select("run_id", "attempt", "id", "part_id", "price")


@query("SELECT c_custkey AS run_id FROM customer WHERE c_custkey % 2 = 1")
def rejected_runs(spark: SparkSession, sf: str) -> DataFrame:
    c = V.read(spark, sf, "customer")
    base = F.concat(F.lit("https://shop.example/"), F.col("c_custkey").cast("string"))
    req = c.select(F.col("c_custkey").alias("id"), F.lit("generic").alias("connector"), F.lit("http").alias("render_mode"), F.array(base, F.concat(base, F.when(F.col("c_custkey") % 2 == 1, "//").otherwise("/b"))).alias("start_urls"), F.lit(5).alias("max_pages"), F.lit(4).alias("max_attempts"))
    return lifecycle.create_run(req, F.lit(AS_OF).cast("timestamp"))[2]


@query("SELECT id, product_id, CASE WHEN status = 'pending' AND id % 2 = 0 THEN CASE WHEN id % 4 = 0 THEN 'accept' ELSE 'reject' END ELSE status END AS status FROM reviews_v", "reviews")
def resolve_reviews(spark: SparkSession, sf: str) -> DataFrame:
    r = V.reviews(spark, sf)
    actions = r.filter(F.col("id") % 2 == 0).select("id", F.when(F.col("id") % 4 == 0, "accept").otherwise("reject").alias("action"), F.lit("seen").alias("note"))
    return lifecycle.resolve_reviews(r, actions, F.lit(AS_OF).cast("timestamp")).select("id", "product_id", "status")


@query(f"SELECT id FROM attempts_v WHERE event_type <> 'view' AND epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at) >= 30000000", "attempts")
def stale_messages(spark: SparkSession, sf: str) -> DataFrame:
    m = V.attempts(spark, sf).withColumn("acknowledged_at", F.when(F.col("event_type") == "view", F.col("created_at"))).withColumn("delivered_at", F.col("created_at"))
    return lifecycle.stale(m, F.lit(AS_OF).cast("timestamp")).select("id")


@query("SELECT a.id, a.target_id FROM attempts_v a WHERE EXISTS (SELECT 1 FROM reviews_v r WHERE r.id = a.target_id AND r.status <> 'accept')", "attempts", "reviews")
def startable_messages(spark: SparkSession, sf: str) -> DataFrame:
    t = V.reviews(spark, sf).select("id", F.when(F.col("status") == "accept", "succeeded").otherwise("failed").alias("status"))
    return lifecycle.startable(V.attempts(spark, sf), t).select("id", "target_id")


@query("SELECT run_id, attempt, count(*) AS n FROM targets_v WHERE (run_id, attempt) NOT IN (SELECT (o_orderkey, 1) FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2", "targets")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    there = V.read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"), F.lit(1).alias("attempt"))
    fresh = lifecycle.insert_absent(there, V.targets(spark, sf), ["run_id", "attempt"])
    return fresh.groupBy("run_id", "attempt").agg(F.count("*").alias("n"))


@query(
    """SELECT target_id AS product_id, arg_min(id, (created_at, id)) AS id FROM attempts_v a WHERE status_code >= 400 AND NOT EXISTS (SELECT 1 FROM reviews_v r WHERE r.product_id = a.target_id AND r.reason = 'low_confidence') GROUP BY 1""",
    "attempts", "reviews",
)
def review_insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    """A product's first review stays for good: candidates for products without one, the earliest of each."""
    there = V.reviews(spark, sf).filter("reason = 'low_confidence'").select("product_id")
    candidates = V.attempts(spark, sf).filter("status_code >= 400").select(F.col("target_id").alias("product_id"), "id", "created_at")
    return lifecycle.first_reviews(there, candidates, ["created_at", "id"]).select("product_id", "id")


@query(
    f"""SELECT target_id, attempts, epoch_us(TIMESTAMP '{AS_OF}') + (least(0.25 * pow(2.0, attempts - 1), 30.0) * 1000000)::BIGINT AS due_us FROM (
      SELECT target_id, coalesce(min(attempt) FILTER (state IN ('succeeded', 'blocked')), max(attempt)) AS attempts,
        coalesce(arg_min(state, attempt) FILTER (state IN ('succeeded', 'blocked')), arg_max(state, attempt)) AS status
      FROM (SELECT *, {_STATE} AS state FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY created_at, id) AS attempt FROM attempts_v)) GROUP BY 1) WHERE status = 'retrying'""",
    "attempts",
)
def retry_outbox(spark: SparkSession, sf: str) -> DataFrame:
    """Targets that failed for now are put into the outbox again, due after their backoff."""
    t = lifecycle.target_states(_states(spark, sf))
    delay = S.backoff(F.col("attempts"), F.lit(None).cast("double"), jitter=0.0)
    box = lifecycle.retries(t, F.lit(AS_OF).cast("timestamp"), delay)
    return box.select("target_id", F.col("payload.attempt").cast("long").alias("next"), F.unix_micros("available_at").alias("due_us")).select("target_id", (F.col("next") - 1).alias("attempts"), "due_us")


_DUE = f"event_type <> 'purchase' AND created_at + to_seconds(k * 60) <= TIMESTAMP '{AS_OF}'"


@query(f"SELECT id, event_type = 'purchase' OR ({_DUE}) AS published, coalesce({_DUE}, false) AS sent FROM attempts_v", "attempts")
def publish_outbox(spark: SparkSession, sf: str) -> DataFrame:
    """All due rows are sent, then marked; a crash between the two sends them again, and the sink drops the repeat."""
    a = V.attempts(spark, sf)
    box = a.withColumn("published_at", F.when(F.col("event_type") == "purchase", F.col("created_at"))).withColumn("available_at", F.timestamp_micros(F.unix_micros("created_at") + F.col("k").cast("long") * 60_000_000))
    messages, marked = lifecycle.publish(box, F.lit(AS_OF).cast("timestamp"))
    sent = messages.select(F.col("id").alias("m_id"), F.lit(True).alias("sent"))
    out = marked.join(sent, F.col("id") == F.col("m_id"), "left")
    return out.select("id", F.col("published_at").isNotNull().alias("published"), F.coalesce("sent", F.lit(False)).alias("sent"))


@query("SELECT r.id, count(t.id) AS targets, CASE WHEN count(t.id) > 0 THEN greatest(round((max(epoch_us(t.updated_at)) - min(epoch_us(r.created_at))) / 1e6, 3), 0.0) END AS duration_seconds FROM runs_v r LEFT JOIN targets_v t ON t.run_id = r.id GROUP BY 1", "runs", "targets")
def run_durations(spark: SparkSession, sf: str) -> DataFrame:
    return reads.run_durations(V.runs(spark, sf), V.targets(spark, sf))


@query(
    """SELECT connector, n, baseline_per_second, concurrent_per_second, round(concurrent_per_second / greatest(baseline_per_second, 0.001), 2) AS speedup
      FROM (SELECT connector, count(*) AS n, round(count(*) / nullif(sum(latency_ms) / 1000, 0), 2) AS baseline_per_second,
          round(count(*) / nullif(max(epoch_us(created_at) / 1e6 + latency_ms / 1000) - min(epoch_us(created_at) / 1e6), 0), 2) AS concurrent_per_second
        FROM attempts_v JOIN hosts_v h ON target_id = h.id GROUP BY 1)""",
    "attempts", "hosts",
)
def fetch_throughput(spark: SparkSession, sf: str) -> DataFrame:
    """Fetches a second one after another, and as they ran: from the first start to the last end."""
    tried = V.attempts(spark, sf).join(V.hosts(spark, sf).select(F.col("id").alias("h"), "connector"), F.col("target_id") == F.col("h"))
    return reads.throughput(tried, "connector", "created_at", "latency_ms")


# ------------------------------------------------------------------------------------ quality


@query(f"WITH {_PRINTS} SELECT * FROM prints")
def dom_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return _prints(spark, sf)


@query(f"WITH {_DRIFT} SELECT seq, source, prev AS previous_fingerprint, dom_fingerprint AS new_fingerprint, coverage, confidence FROM drifted WHERE drift", "captures")
def drift_events(spark: SparkSession, sf: str) -> DataFrame:
    return quality.drift(_captures(spark, sf)).filter("drift").select("seq", "source", "previous_fingerprint", F.col("dom_fingerprint").alias("new_fingerprint"), "coverage", "confidence")


@query(f"WITH {_DRIFT} SELECT source, arg_max(dom_fingerprint, seq) FILTER (rn = 1 OR NOT bad) AS dom_fingerprint, max(coverage) AS baseline_coverage, count(*) AS observed_count FROM drifted GROUP BY 1", "captures")
def source_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return quality.source_profiles(_captures(spark, sf))


@query(f"WITH {_DRIFT} SELECT seq, CASE WHEN drift THEN 'schema_drift' WHEN confidence < 0.9 THEN 'low_confidence' WHEN coverage < 1 THEN 'incomplete_required_fields' END AS reason FROM drifted", "captures")
def review_gate(spark: SparkSession, sf: str) -> DataFrame:
    return quality.drift(_captures(spark, sf)).select("seq", quality.review_reason(F.col("drift"), F.col("confidence"), F.col("coverage")).alias("reason"))


@query("SELECT seq, CASE WHEN seq % 3 = 0 THEN coverage < 0.5 ELSE seq % 3 = 1 END AS render FROM captures_v", "captures")
def browser_fallback(spark: SparkSession, sf: str) -> DataFrame:
    mode = F.when(F.col("seq") % 3 == 0, "auto").when(F.col("seq") % 3 == 1, "browser").otherwise("http")
    return V.captures(spark, sf).select("seq", quality.needs_browser(mode, F.col("coverage")).alias("render"))


# --------------------------------------------------------------------------------- extraction


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts dealt over all cores: each becomes a page that Python walks."""
    return spread(V.read(spark, sf, "part"), "p_partkey")


def _pages_of_parts(spark: SparkSession, sf: str, variant: str, source: str = "generic") -> DataFrame:
    return fixtures.product_pages(_parts(spark, sf), variant, "p_partkey", "p_name", None, source)


#: The start tags of each fixture page, counted by hand: what its fingerprint is made of.
_TAGS = {
    "jsonld": "a:1 body.shop:1 h1:1 head:1 html:1 link:1 meta:1 nav.top:1 p:1 script:1 section.detail.wide:1 title:1",
    "selector": "body.shop:1 div.active.item.slide:1 div.carousel:1 div.item.slide:1 div.product_main.two-columns:1 h1:1 head:1 html:1 img:2 link:1 meta:1 p.availability.instock:1 p.big.price_color:1 table.facts.table-striped:1 tbody:1 td:5 th:5 title:1 tr:5",
    "semantic": "body:1 head:1 html:1 link:2 main.card.new:1 meta:3 p:1 span.money:1 title:1",
    "missing": "body:1 h1.name:1 head:1 html:1 link:1 main.card:1 meta:1 p:1 title:1",
    "malformed": "b:1 body:1 h1:1 head:1 html:1 i:2 link:1 main:1 meta:1 script:1 title:1",
}


def _print_of(variant: str) -> str:
    return f"left(sha256('{_TAGS[variant].replace(' ', '|')}'), 16)"


_SHOWN = ["id", "external_id", "title", "price_amount", "currency", "availability", "brand", "category", "canonical_url", "image_url", "confidence", "required_field_coverage"]
_PART = "SELECT p_partkey AS id, {external} AS external_id, p_name AS title, (5 + p_partkey % 190) || '.49' AS price_amount, '{currency}' AS currency, '{stock}' AS availability, {brand} AS brand, {category} AS category, {canonical} AS canonical_url, {image} AS image_url, {confidence}::DOUBLE AS confidence, 1.0::DOUBLE AS required_field_coverage, {fp} AS dom_fingerprint FROM part"
_URL = "'https://shop.example/items/' || p_partkey"
_IMAGE = "'https://shop.example/media/' || p_partkey || '.webp'"


@query(_PART.format(external="'QF-' || p_partkey", currency="EUR", stock="LimitedAvailability", brand="'Quill & Fern'", category="'Homeware'", canonical=_URL, image=_IMAGE, confidence="0.985", fp=_print_of("jsonld")))
def parse_product_jsonld(spark: SparkSession, sf: str) -> DataFrame:
    return extract.parse_products(_pages_of_parts(spark, sf, "jsonld")).select(*_SHOWN, "dom_fingerprint")


@query(_PART.format(external="'U' || p_partkey", currency="GBP", stock="Low stock (3 left)", brand="NULL", category="'Homeware'", canonical=_URL, image=_IMAGE, confidence="0.97", fp=_print_of("selector")))
def parse_product_selector(spark: SparkSession, sf: str) -> DataFrame:
    return extract.parse_products(_pages_of_parts(spark, sf, "selector", "books_to_scrape")).select(*_SHOWN, "dom_fingerprint")


_EXCERPTED = (".product_main", "table.table-striped tr:nth-of-type(1)", "table.table-striped tr:nth-of-type(2)", "table.table-striped tr:nth-of-type(4)", "table.table-striped > tbody > tr:nth-of-type(5)")


@query(
    """SELECT p_partkey AS id, '<div class="two-columns product_main"><h1>' || replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</h1><p class="big price_color">£' || (5 + p_partkey % 190) || '.49</p><p class="instock availability">' || chr(10)
      || '  In stock </p></div>' || chr(10) || '<tr><th>UPC</th><td>U' || p_partkey || '</td></tr>' || chr(10) || '<tr><th>Product Type</th><td>Homeware</td></tr>' || chr(10)
      || '<tr><th>Price (incl. tax)</th><td>£' || (5 + p_partkey % 190) || '.49</td></tr>' || chr(10) || '<tr><th>Availability</th><td>Low stock (3 left)</td></tr>' AS excerpt FROM part"""
)
def page_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """What a report quotes of a page: nodes found by selectors, written out again."""
    pages = _pages_of_parts(spark, sf, "selector", "books_to_scrape")
    return pages.select("id", html_excerpt(*_EXCERPTED)("html").alias("excerpt"))


@query(_PART.format(external=_URL, currency="EUR", stock="PreOrder", brand="NULL", category="NULL", canonical=_URL, image=_URL, confidence="0.832", fp=_print_of("semantic")))
def parse_product_semantic(spark: SparkSession, sf: str) -> DataFrame:
    return extract.parse_products(_pages_of_parts(spark, sf, "semantic")).select(*_SHOWN, "dom_fingerprint")


@query(f"SELECT p_partkey AS id, p_name AS title, 0.83::DOUBLE AS confidence, 0.25::DOUBLE AS required_field_coverage, 'missing_price_amount,missing_currency,missing_availability' AS warnings, {_print_of('missing')} AS dom_fingerprint FROM part")
def parse_product_missing(spark: SparkSession, sf: str) -> DataFrame:
    p = extract.parse_products(_pages_of_parts(spark, sf, "missing"))
    return p.select("id", "title", "confidence", "required_field_coverage", F.array_join("warnings", ",").alias("warnings"), "dom_fingerprint")


@query(f"SELECT p_partkey AS id, p_name AS title, 0.832::DOUBLE AS confidence, 1.0::DOUBLE AS required_field_coverage, {_print_of('malformed')} AS dom_fingerprint FROM part")
def parse_product_malformed(spark: SparkSession, sf: str) -> DataFrame:
    return extract.parse_products(_pages_of_parts(spark, sf, "malformed")).select("id", "title", "confidence", "required_field_coverage", "dom_fingerprint")


@query(
    """SELECT p_partkey AS id, unnest([0, 1, 2, 3]) AS position, unnest(['title', 'price_amount', 'currency', 'availability']) AS field, unnest([p_name, (5 + p_partkey % 190) || '.49', 'EUR', 'PreOrder']) AS value,
      unnest(['semantic_fallback', 'semantic_fallback', 'semantic_fallback', 'semantic_fallback']) AS method, unnest(['og:title|h1', 'itemprop=price', 'itemprop=priceCurrency', 'itemprop=availability']) AS selector, unnest([0.86::DOUBLE, 0.84, 0.84, 0.82]) AS confidence FROM part"""
)
def evidence_explode(spark: SparkSession, sf: str) -> DataFrame:
    return quality.explode_evidence(extract.parse_products(_pages_of_parts(spark, sf, "semantic")), "id")


@query("SELECT 4 * count(*) AS expected, 4 * count(*) AS present FROM part")
def required_field_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    p = extract.parse_products(_pages_of_parts(spark, sf, "jsonld"))
    right = (F.col("title") == F.col("title_in")).cast("long") + (F.col("price_amount") == F.col("price_in")).cast("long") + (F.col("currency") == "EUR").cast("long") + (F.col("availability") == "LimitedAvailability").cast("long")
    return p.agg((F.count("*") * len(REQUIRED_FIELDS)).alias("expected"), F.sum(right).alias("present"))


@query("SELECT p_partkey AS id, unnest([1, 2])::BIGINT AS position, 'https://shop.example/items/' || unnest([p_partkey, p_partkey + 1]) || '/' AS link FROM part")
def link_discovery(spark: SparkSession, sf: str) -> DataFrame:
    found = extract.discover_links(_pages_of_parts(spark, sf, "listing", "books_to_scrape"), "id")
    return found.withColumn("position", F.col("position").cast("long"))


@query("SELECT p_partkey AS id, CASE p_partkey % 2 WHEN 0 THEN 'json_ld' ELSE 'semantic_fallback' END AS path, CASE p_partkey % 2 WHEN 0 THEN 'eligible' ELSE 'review' END AS decision FROM part")
def preview_decision(spark: SparkSession, sf: str) -> DataFrame:
    both = None
    for r, variant in enumerate(("jsonld", "semantic")):
        p = _pages_of_parts(spark, sf, variant).filter(F.col("id") % 2 == r)
        both = p if both is None else both.unionByName(p)
    e = extract.parse_products(both)
    reason = quality.review_reason(F.lit(False), F.col("confidence"), F.col("required_field_coverage"))
    return e.select("id", F.array_join(extract.extraction_path(F.col("field_evidence"), list(REQUIRED_FIELDS)), ",").alias("path"), extract.decision(F.col("title"), reason).alias("decision"))


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS title, p_partkey % 3 < 2 AS was_rendered, CASE WHEN p_partkey % 3 < 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS required_field_coverage FROM part"""
)
def rendered_reparse(spark: SparkSession, sf: str) -> DataFrame:
    """Script-built pages: rendered where the mode is automatic or a browser, parsed as fetched where it is plain HTTP."""
    pages = fixtures.rendered_pages(_parts(spark, sf), "p_partkey", "p_name")
    mode = F.element_at(F.array(F.lit("auto"), F.lit("browser"), F.lit("http")), (F.col("id") % 3 + 1).cast("int"))
    return extract.parse_rendered(pages.withColumn("mode", mode)).select("id", "title", "was_rendered", "required_field_coverage")


@query("SELECT page_id, url, NOT regexp_matches(url, '^https?://[^/]+/blocked') AS allowed FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://shop.example/blocked/' || page_id ELSE 'https://shop.example/p/' || page_id END AS url FROM pages)")
def robots_policy(spark: SparkSession, sf: str) -> DataFrame:
    """One origin that all requests ask: its rules are rows, and the first that a path begins with decides."""
    n = F.col("page_id").cast("string")
    u = V.read(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://shop.example/blocked/"), n)).otherwise(F.concat(F.lit("https://shop.example/p/"), n)).alias("url"))
    rules = spark.createDataFrame([("https://shop.example", 200, "User-agent: *\nDisallow: /blocked\nAllow: /\n")], "origin string, status int, body string")
    return crawl.robots_decisions(u, rules, "catalog-bot").select("page_id", "url", "allowed")


@query(
    """SELECT page_id, CASE WHEN k NOT IN (0, 1) THEN 'robots_unavailable' END AS robots_error, CASE WHEN k = 0 THEN page_id % 3 <> 0 WHEN k = 1 THEN true END AS allowed FROM (SELECT page_id, page_id % 5 AS k FROM pages)"""
)
def robots_by_origin(spark: SparkSession, sf: str) -> DataFrame:
    """Origins whose document is there, missing, broken, not to be had; and one host under a scheme that was never asked."""
    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    origin = F.when(k == 4, "http://shop0.example").otherwise(F.concat(F.lit("https://shop"), k.cast("string"), F.lit(".example")))
    u = V.read(spark, sf, "pages").select("page_id", F.concat(origin, F.when(F.col("page_id") % 3 == 0, "/blocked/").otherwise("/p/"), n).alias("url"))
    rules = "User-agent: *\nDisallow: /blocked\n"
    robots = spark.createDataFrame([("https://shop0.example", 200, rules), ("https://shop1.example", 404, rules), ("https://shop2.example", 503, rules), ("https://shop3.example", None, None)], "origin string, status int, body string")
    return crawl.robots_decisions(u, robots, "catalog-bot").select("page_id", "robots_error", "allowed")


def _web(spark: SparkSession, sf: str) -> DataFrame:
    """Responses of two hosts for each page: answers, redirects within and across hosts, to a private address, in a circle, and without a location."""
    k = F.col("page_id") % 10
    before = F.concat(F.lit("/p/"), (F.col("page_id") - 1).cast("string"))
    status = F.when(k > 0, 302).otherwise(F.element_at(F.array(*map(F.lit, (200, 404, 503, 429))), (F.floor(F.col("page_id") / 10) % 4 + 1).cast("int")))
    location = F.when(k.between(1, 5), before).when(k == 6, F.concat(F.lit("https://b.example"), before)).when(k == 8, "http://10.0.0.8/p").when(k == 9, F.col("page_id").cast("string"))
    hosts = F.explode(F.array(F.lit("https://a.example/p/"), F.lit("https://b.example/p/"))).alias("at")
    return V.read(spark, sf, "pages").select("page_id", status.alias("status"), location.alias("location"), hosts).select(F.concat("at", F.col("page_id").cast("string")).alias("url"), "status", "location")


@query(
    """WITH RECURSIVE walk AS (
        SELECT page_id AS id, page_id AS n, 'a.example' AS host, 0 AS hop FROM pages
        UNION ALL SELECT id, CASE WHEN n % 10 = 9 THEN n ELSE n - 1 END, CASE n % 10 WHEN 6 THEN 'b.example' WHEN 8 THEN '10.0.0.8' ELSE host END, hop + 1
          FROM walk WHERE n % 10 NOT IN (0, 7) AND hop < 5 AND host <> '10.0.0.8' AND NOT (host = 'b.example' AND starts_with(n::VARCHAR, '1'))),
      ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY hop DESC) = 1),
      judged AS (SELECT *, CASE WHEN host = '10.0.0.8' THEN 'private_address' WHEN host = 'b.example' AND starts_with(n::VARCHAR, '1') THEN 'robots_disallowed' WHEN n % 10 = 7 THEN 'invalid_redirect'
        WHEN n % 10 > 0 THEN 'too_many_redirects' WHEN (n // 10) % 4 > 0 THEN 'http_' || [404, 503, 429][(n // 10) % 4] END AS error FROM ends)
      SELECT id, hop + 1 AS fetches, CASE WHEN error IS NULL THEN 'https://' || host || '/p/' || n END AS final_url, error, coalesce(error IN ('http_503', 'http_429'), false) AS transient FROM judged"""
)
def redirect_chase(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's URL followed over at most five redirects, every hop judged by URL policy and robots rules."""
    asked = V.read(spark, sf, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("https://a.example/p/"), F.col("page_id").cast("string")).alias("url"))
    robots = spark.createDataFrame([("https://a.example", 404, None), ("https://b.example", 200, "User-agent: *\nDisallow: /p/1\n")], "origin string, status int, body string")
    hops = crawl.chase(asked, _web(spark, sf), lambda u: S.url_policy(u, []), robots, "catalog-bot")
    return crawl.chase_outcomes(hops).select("id", "fetches", "final_url", "error", "transient")


@query(
    """WITH RECURSIVE walk AS (
        SELECT page_id AS id, page_id AS n, 'a.example' AS host, 0 AS hop FROM pages
        UNION ALL SELECT id, CASE WHEN n % 10 = 9 THEN n ELSE n - 1 END, CASE n % 10 WHEN 6 THEN 'b.example' WHEN 8 THEN '10.0.0.8' ELSE host END, hop + 1
          FROM walk WHERE n % 10 NOT IN (0, 7) AND hop < 5 AND host <> '10.0.0.8')
      SELECT host, count(*) FILTER (n % 10 NOT IN (0, 7) OR (n % 10 = 0 AND (n // 10) % 4 = 0)) AS successes, count(*) FILTER (n % 10 = 0 AND (n // 10) % 4 IN (2, 3)) AS failures,
        count(*) FILTER (n % 10 = 0 AND (n // 10) % 4 = 1) AS neutral FROM walk WHERE host <> '10.0.0.8' GROUP BY 1"""
)
def redirect_breaker_events(spark: SparkSession, sf: str) -> DataFrame:
    """What all hops mean to their hosts' breakers, by host."""
    asked = V.read(spark, sf, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("https://a.example/p/"), F.col("page_id").cast("string")).alias("url"))
    hops = crawl.chase(asked, _web(spark, sf), lambda u: S.url_policy(u, [])).filter("effect IS NOT NULL OR error = 'invalid_redirect'")
    count = lambda what: F.count_if(F.col("effect") == what)
    return hops.groupBy(S.host(F.col("url")).alias("host")).agg(count("success").alias("successes"), count("failure").alias("failures"), count("neutral").alias("neutral"))


@query(
    """WITH l AS (SELECT p_partkey // 60 AS source, p_partkey % 60 + 1 AS page, p_partkey AS k, p_partkey % 97 = 96 AS blank FROM part),
      e AS (SELECT source, coalesce(min(page) FILTER (blank), 51) AS stop FROM l GROUP BY 1),
      f AS (SELECT l.source, item, min(page) AS page FROM (SELECT source, page, unnest([k, k + 1]) AS item FROM l WHERE page <= 50) l JOIN e ON e.source = l.source AND l.page < e.stop GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page, item) AS position FROM f)
      SELECT source, position, 'https://shop.example/items/' || item || '/' AS link, page FROM r WHERE position <= 30"""
)
def listing_products(spark: SparkSession, sf: str) -> DataFrame:
    """Sixty listing pages a source, some empty: the first thirty products."""
    p = _pages_of_parts(spark, sf, "listing", "books_to_scrape")
    shop, page = F.floor(F.col("id") / 60).cast("long"), F.col("id") % 60 + 1
    p = p.select("url", "source", shop.alias("shop"), page.alias("page"), F.when(F.col("id") % 97 != 96, F.col("html")).alias("html"))
    return crawl.products_of_listings(p, 30, group="shop").withColumnRenamed("shop", "source")


@query("SELECT p_partkey AS id, p_name || CASE p_partkey % 4 WHEN 2 THEN ' caf' || chr(65533) ELSE ' café' END AS text FROM part")
def body_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies in UTF-8 without a charset, in Latin 1, in Latin 1 said to be UTF-8, and in UTF-8 under a charset that nobody knows."""
    text, k = F.concat("p_name", F.lit(" café")), F.col("p_partkey") % 4
    body = F.when(k.isin(1, 2), F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    charset = F.when(k == 1, "latin-1").when(k == 2, "utf-8").when(k == 3, "x-unknown")
    return V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), crawl.decode_body(body, charset).alias("text"))


# ------------------------------------------------------------------------------------ reports


_STATES = ", ".join(f"'{s}': count(*) FILTER (t.status = '{s}')" for s in V.STATUS_OF.values())


_DATASET = f"""SELECT 'metrics' AS section, 'targets' AS id, to_json({{'targets': count(*), 'succeeded': count(*) FILTER (status = 'succeeded'), 'success_rate': round(count(*) FILTER (status = 'succeeded') / count(*), 4)}})::VARCHAR AS body FROM targets_v
  UNION ALL SELECT 'metrics', 'attempts', to_json({{'fetch_attempts': count(*)}})::VARCHAR FROM attempts_v
  UNION ALL SELECT 'metrics', 'products', to_json({{'required_fields_present': count(title) + count(price) + count(nullif(category, '')), 'required_fields_expected': 4 * count(*)}})::VARCHAR FROM products_v
  UNION ALL SELECT 'metrics', 'reviews', to_json({{'reviews_pending': count(*) FILTER (status = 'pending')}})::VARCHAR FROM reviews_v
  UNION ALL SELECT 'sources', connector, to_json({{'targets': count(*), {_STATES}}})::VARCHAR FROM targets_v t GROUP BY connector
  UNION ALL SELECT 'runs', r.id::VARCHAR, to_json({{{_STATES}}})::VARCHAR FROM runs_v r LEFT JOIN targets_v t ON t.run_id = r.id GROUP BY r.id"""


@query(_DATASET, "targets", "attempts", "products", "reviews", "runs")
def dataset_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report over all runs, written as JSON and read back. Parts have no currency; their price and type stand for amount and availability."""
    p = V.products(spark, sf).select("title", F.col("price").alias("price_amount"), F.lit(None).cast("string").alias("currency"), F.col("category").alias("availability"))
    at = ingest.run_folder(spark, "report")
    report_files.write_report(reports.dataset(V.targets(spark, sf), V.attempts(spark, sf), p, V.reviews(spark, sf), V.runs(spark, sf)), at)
    return report_files.read_report(spark, at, "section string, id string, body string")


@query(
    """SELECT r.id, strftime(any_value(r.created_at) + INTERVAL 9 HOUR, '%Y. %-m. %-d. %H:%M:%S') AS created, count(t.id) AS targets,
      CASE WHEN count(t.id) = 0 THEN NULL WHEN max(t.updated_at) <= any_value(r.created_at) THEN '<0.1초' ELSE printf('%.1f분', (epoch_us(max(t.updated_at)) - epoch_us(any_value(r.created_at))) / 6e7) END AS duration
      FROM runs_v r LEFT JOIN targets_v t ON t.run_id = r.id GROUP BY r.id""",
    "runs", "targets",
)
def run_display(spark: SparkSession, sf: str) -> DataFrame:
    r = V.runs(spark, sf)
    shown = reads.run_durations(r, V.targets(spark, sf)).join(r.select(F.col("id").alias("r_id"), "created_at"), F.col("id") == F.col("r_id"))
    return shown.select("id", reports.korean_time(F.col("created_at")).alias("created"), "targets", reports.duration_text(F.col("duration_seconds")).alias("duration"))


@query(f"SELECT id, {V._case(reports.STATUS_LABELS, 'status')} AS status FROM targets_v", "targets")
def status_labels(spark: SparkSession, sf: str) -> DataFrame:
    return V.targets(spark, sf).select("id", reports.label(F.col("status"), reports.STATUS_LABELS).alias("status"))


# ------------------------------------------------------------------------ reliability, streams


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 12 = 0 THEN 2 ELSE 1 END AS attempts, 'succeeded' AS status FROM part")
def rehearsal(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as targets, of which every 12th fails once with a transient error and is tried again."""
    t = V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    tries = t.select(F.col("id").alias("target_id"), F.explode(F.when(F.col("id") % 12 == 0, F.array(F.lit(429), F.lit(200))).otherwise(F.array(F.lit(200)))).alias("code"))
    tries = lifecycle.number_attempts(tries.withColumn("seq", F.when(F.col("code") == 429, 0).otherwise(1)), "target_id", ["seq"])
    tries = tries.withColumn("state", lifecycle.outcome(S.http_transient(F.col("code")), F.col("code") < 400, F.col("attempt"), F.lit(4)))
    return lifecycle.target_states(tries).select(F.col("target_id").alias("id"), "attempts", "status")


@query("SELECT count(*) AS targets, count(*) + count(*) FILTER (p_partkey % 12 = 0) AS attempts, count(*) FILTER (p_partkey % 12 = 0) AS transient_recovered, count(*) AS succeeded, 0::BIGINT AS lost, 0::BIGINT AS duplicated, 1.0::DOUBLE AS success_rate FROM part")
def rehearsal_report(spark: SparkSession, sf: str) -> DataFrame:
    r = rehearsal(spark, sf)
    ok = F.count_if(F.col("status") == "succeeded")
    return r.agg(
        F.count("*").alias("targets"), F.sum("attempts").alias("attempts"), F.count_if((F.col("attempts") > 1) & (F.col("status") == "succeeded")).alias("transient_recovered"), ok.alias("succeeded"),
        F.greatest(F.count("*") - ok, F.lit(0)).alias("lost"), F.greatest(ok - F.count("*"), F.lit(0)).alias("duplicated"), F.round(ok / F.count("*"), 4).alias("success_rate"),
    )


_TRIED = f"(SELECT *, {_STATE} AS state FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY created_at, id) AS attempt FROM attempts_v))"


@query(
    f"""WITH tried AS {_TRIED}, ends AS (SELECT target_id, coalesce(arg_min(state, attempt) FILTER (state IN ('succeeded', 'blocked')), arg_max(state, attempt)) AS status,
        coalesce(min(attempt) FILTER (state IN ('succeeded', 'blocked')), max(attempt)) AS last FROM tried GROUP BY 1),
      failed AS (SELECT target_id, count(*) AS n FROM tried JOIN ends USING (target_id) WHERE attempt <= last AND (status_code = 429 OR status_code >= 500) GROUP BY 1),
      stored AS (SELECT target_id, count(*) AS n FROM tried WHERE state = 'succeeded' GROUP BY 1)
      SELECT count(*) AS targets, count(*) FILTER (status = 'succeeded') AS succeeded, coalesce(sum(f.n), 0)::BIGINT AS transient_failures, count(*) FILTER (f.n > 0 AND status = 'succeeded') AS recovered,
        (SELECT count(*) FROM attempts_v WHERE event_type <> 'purchase' AND TIMESTAMP '{AS_OF}' - created_at >= INTERVAL 30 SECOND) AS reclaimable,
        count(*) FILTER (status = 'succeeded' AND s.n IS NULL) AS lost, coalesce(sum(greatest(s.n - 1, 0)), 0)::BIGINT AS duplicates
      FROM ends LEFT JOIN failed f USING (target_id) LEFT JOIN stored s USING (target_id)""",
    "attempts",
)
def recovery_totals(spark: SparkSession, sf: str) -> DataFrame:
    """How runs recovered, from the tables of attempts, messages and stored products: a success stores a product each time that it is reported."""
    tried = _states(spark, sf)
    messages = V.attempts(spark, sf).select("id", F.col("created_at").alias("delivered_at"), F.when(F.col("event_type") == "purchase", F.col("created_at")).alias("acknowledged_at"))
    stored = tried.filter("state = 'succeeded'").select("target_id")
    return reports.recovery(tried, messages, stored, F.lit(AS_OF).cast("timestamp"))


@query(
    """SELECT a.id, target_id, attempt, strftime(a.created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, url, run_id FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY created_at, id) AS attempt FROM attempts_v) a
      JOIN (SELECT *, id % 10 AS run_id FROM hosts_v) h ON target_id = h.id WHERE run_id = 3 ORDER BY a.created_at, attempt, a.id LIMIT 1000""",
    "attempts", "hosts",
)
def attempt_listing_of_run(spark: SparkSession, sf: str) -> DataFrame:
    """The attempts of one run's targets, oldest first, with their numbers."""
    tried = lifecycle.number_attempts(V.attempts(spark, sf), "target_id", ["created_at", "id"])
    out = reads.list_attempts(tried, V.hosts(spark, sf).withColumn("run_id", F.col("id") % 10), run_id=3)
    return out.select("id", "target_id", F.col("attempt").cast("long").alias("attempt"), V.iso("created_at").alias("created_at"), "url", "run_id")


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    a = V.attempts(spark, sf)
    return a.select(F.col("target_id").cast("string").alias("host"), "id", (F.unix_micros("created_at") / 1e6).alias("at"), reliability.effect(F.col("status_code"), F.lit(None).cast("string")).alias("effect"))


_DENIED = "(w.state = 'open' AND r.at - w.opened < 7200)"
_TRIPS = "(r.effect = 'failure' AND (w.state <> 'closed' OR w.failures + 1 >= 2))"


@query(
    f"""WITH RECURSIVE r AS (SELECT target_id::VARCHAR AS host, id, epoch_us(created_at) / 1e6 AS at, row_number() OVER (PARTITION BY target_id ORDER BY created_at, id) AS rn,
        CASE WHEN status_code = 429 OR status_code >= 500 THEN 'failure' WHEN status_code BETWEEN 200 AND 399 THEN 'success' ELSE 'neutral' END AS effect FROM attempts_v),
      w AS (SELECT DISTINCT host, 0::BIGINT AS rn, 0::BIGINT AS id, true AS allowed, 'closed' AS state, 0 AS failures, 0.0::DOUBLE AS opened FROM r
        UNION ALL SELECT r.host, r.rn, r.id, NOT {_DENIED},
          CASE WHEN {_DENIED} OR {_TRIPS} THEN 'open' WHEN r.effect = 'success' THEN 'closed' WHEN w.state = 'open' THEN 'half_open' ELSE w.state END,
          CASE WHEN {_DENIED} THEN w.failures WHEN r.effect = 'success' THEN 0 WHEN r.effect = 'failure' THEN w.failures + 1 ELSE w.failures END,
          CASE WHEN {_TRIPS} AND NOT {_DENIED} THEN r.at ELSE w.opened END
        FROM w JOIN r ON r.host = w.host AND r.rn = w.rn + 1)
      SELECT host, id, allowed, state, failures FROM w WHERE rn > 0""",
    "attempts",
)
def circuit_replay(spark: SparkSession, sf: str) -> DataFrame:
    return reliability.replay(_requests(spark, sf), threshold=2, timeout=7200.0)


@query(
    """WITH RECURSIVE r AS (SELECT connector AS host, a.id, epoch_us(a.created_at) / 1e6 - 1704067200 AS at, k * 60.0::DOUBLE AS seconds, row_number() OVER (PARTITION BY connector ORDER BY a.created_at, a.id) AS rn
        FROM attempts_v a JOIN hosts_v h ON a.target_id = h.id),
      w AS (SELECT DISTINCT host, 0::BIGINT AS rn, 0::BIGINT AS id, -1e18::DOUBLE AS starts_at, 0.0::DOUBLE AS ends_at, [-1e18::DOUBLE, -1e18::DOUBLE] AS slots FROM r
        UNION ALL SELECT host, rn, id, s, s + seconds, list_sort(list_append(slots[2:], s + seconds))
        FROM (SELECT r.host, r.rn, r.id, r.seconds, w.slots, greatest(r.at, w.slots[1], w.starts_at + 300.0) AS s FROM w JOIN r ON r.host = w.host AND r.rn = w.rn + 1))
      SELECT host, id, round(starts_at, 3) AS starts_at, round(ends_at, 3) AS ends_at FROM w WHERE rn > 0""",
    "attempts", "hosts",
)
def host_limiter(spark: SparkSession, sf: str) -> DataFrame:
    """When attempts would run if a connector is a host with two slots and five minutes between starts."""
    tried = V.attempts(spark, sf).join(V.hosts(spark, sf).select(F.col("id").alias("h"), "connector"), F.col("target_id") == F.col("h"))
    asked = tried.select(F.col("connector").alias("host"), "id", (F.unix_micros("created_at") / 1e6 - 1704067200).alias("at"), (F.col("k") * 60.0).alias("seconds"))
    return reliability.limited(asked, 2, 300.0).select("host", "id", F.round("starts_at", 3).alias("starts_at"), F.round("ends_at", 3).alias("ends_at"))


@query("SELECT id, target_id, CASE WHEN status_code BETWEEN 300 AND 399 THEN 'redirect' WHEN status_code >= 400 THEN 'http_' || status_code ELSE 'ok' END AS outcome FROM attempts_v", "attempts")
def stream_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream of message files, one in ten delivered twice; each has one effect, and the stream keeps no state."""
    at = ingest.run_folder(spark, "messages")
    a = V.attempts(spark, sf).select("id", "target_id", "status_code", F.to_date("created_at").alias("day"))
    ingest.deliver(a.unionByName(a.filter(F.col("id") % 10 == 0)), f"{at}/in", 8)
    messages = ingest.message_stream(spark, f"{at}/in", "id long, target_id long, status_code int, day date")
    ingest.process(messages, f"{at}/out", f"{at}/checkpoint", lambda b: b.select("id", "target_id", S.http_class(F.col("status_code")).alias("outcome"), "day"), day="day", buckets=1)
    return ingest.results(spark, f"{at}/out").drop("day")


@query("SELECT id::VARCHAR AS target_id, 'run-' || (id % 7) AS run_id, url, connector, 'http' AS render_mode, 1 AS attempt FROM hosts_v", "hosts")
def json_message_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as JSON on a stream, some sent twice: a consumer reads them, stops, and reads on; each target's message counts once."""
    at = ingest.run_folder(spark, "json")
    h = V.hosts(spark, sf)
    rows = h.select(F.col("id").cast("string").alias("target_id"), F.concat(F.lit("run-"), (F.col("id") % 7).cast("string")).alias("run_id"), "url", "connector", F.lit("http").alias("render_mode"), F.lit(1).alias("attempt"))
    for third in range(3):
        ingest.enqueue(rows.filter((F.col("target_id").cast("long") % 3 == third) | (F.col("target_id").cast("long") % 10 == 0)), f"{at}/in")
        ingest.process(ingest.payloads(spark, f"{at}/in"), f"{at}/out", f"{at}/checkpoint", lambda b: b.filter("valid").drop("raw", "valid"), key="target_id")
    return ingest.results(spark, f"{at}/out")


_AS_OF_MS = 1705276800000
_DUE = "epoch_us(created_at) // 1000 + k * 60000"


@query(
    f"""SELECT id::VARCHAR AS id, CASE WHEN due <= {_AS_OF_MS + 9000} AND NOT acked THEN 2 ELSE 1 END AS deliveries, due <= {_AS_OF_MS + 9000} AND NOT acked AS reclaimed,
      CASE WHEN due <= {_AS_OF_MS - 1000} THEN {_AS_OF_MS - 1000} WHEN due <= {_AS_OF_MS - 999} THEN {_AS_OF_MS - 999} WHEN due <= {_AS_OF_MS + 9000} THEN {_AS_OF_MS + 9000} ELSE {_AS_OF_MS + 44000} END AS first_delivered_at
      FROM (SELECT id, due, due <= {_AS_OF_MS - 1000} AND id % 3 <> 0 AS acked FROM (SELECT id, ({_DUE})::BIGINT AS due FROM attempts_v)) WHERE due <= {_AS_OF_MS + 44000}""",
    "attempts",
)
def delayed_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts as messages with delays, by the events' clock: due ones are delivered, those acknowledged are done, and those that lie idle come again."""
    at = ingest.run_folder(spark, "queue")
    due = (F.floor(F.unix_micros("created_at") / 1000) + F.col("k") * 60_000).cast("long")
    none = F.lit(None).cast("string")
    a = V.attempts(spark, sf).select(F.col("id").cast("string").alias("id"), due.alias("due"), (F.col("id") % 3 != 0).alias("done"))
    queue.send(a.select("id", F.lit("message").alias("kind"), F.lit(1704067200000 - 1).alias("at"), "due", none.alias("payload")), f"{at}/in")
    queue.tick(spark, _AS_OF_MS, f"{at}/in")
    queue.tick(spark, _AS_OF_MS + 1, f"{at}/in")
    acks = a.filter(F.col("done") & (F.col("due") <= _AS_OF_MS - 1000))
    queue.send(acks.select("id", F.lit("ack").alias("kind"), F.lit(_AS_OF_MS + 10_000).alias("at"), F.lit(None).cast("long").alias("due"), none.alias("payload")), f"{at}/in")
    queue.tick(spark, _AS_OF_MS + 45_000, f"{at}/in")
    queue.run(spark, f"{at}/in", f"{at}/out", f"{at}/checkpoint")
    got = queue.results(spark, f"{at}/out")
    return got.groupBy("id").agg(F.count("*").alias("deliveries"), F.bool_or("reclaimed").alias("reclaimed"), F.min("delivered_at").alias("first_delivered_at"))
