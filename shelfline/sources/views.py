"""The ingestion tables as views over the star-schema test tables, in Spark and as SQL.

Every view has both forms under one name, so a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pairs of flag and line status stand for the six states.
STATUS_OF = {"AF": "queued", "AO": "running", "NF": "retrying", "NO": "succeeded", "RF": "failed", "RO": "blocked"}
#: Event types stand for what a fetch came to; each has an HTTP status or an error of its own.
CODE_OF = {"view": 200, "click": 301, "purchase": 404, "signup": 429, "error": 503}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target for each line item; its connector is the supplier's nation."""
    lines, supp, nat = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    status = F.create_map(*(F.lit(x) for kv in STATUS_OF.items() for x in kv))
    named = lines.join(supp, F.col("l_suppkey") == F.col("s_suppkey")).join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("attempt"), F.col("n_name").alias("connector"),
        status[F.concat("l_returnflag", "l_linestatus")].alias("status"), F.col("l_shipdate").cast("timestamp").alias("updated_at"),
        F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("connector"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt for each event; a user stands for a target and for its host."""
    code = F.create_map(*(F.lit(x) for kv in CODE_OF.items() for x in kv))
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("target_id"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type"),
        code[F.col("event_type")].alias("status_code"), F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What attempts belong to: one target for each customer, with the nation as its connector."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("connector"), F.concat(F.lit("https://shop.example/"), F.col("c_custkey")).alias("url"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures in order of page_id: source, made-up coverage and confidence, and the html."""
    p, n = read(spark, sf_dir, "pages"), read(spark, sf_dir, "nation")
    return p.join(F.broadcast(n), F.col("page_id") % 5 == F.col("n_nationkey")).select(
        F.col("page_id").alias("seq"), F.col("n_name").alias("source"), "url", "html",
        (F.lit(1.0) - (F.col("page_id") * 7 % 5) / 4.0 * F.when(F.col("page_id") % 3 == 0, 1.0).otherwise(0.0)).alias("coverage"),
        F.round(F.lit(0.8) + (F.col("page_id") * 13 % 20) / 100.0, 4).alias("confidence"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("source"), F.col("p_type").alias("category"),
        F.round(F.lit(0.7) + F.col("p_partkey") * 37 % 31 / 100.0, 4).alias("confidence"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") * 7919 % 100003).alias("captured"),
        F.concat(F.lit("https://shop.example/p/"), F.col("p_partkey")).alias("canonical_url"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read(spark, sf_dir, "labels")
    return lab.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("product_id"), F.when(F.col("quality") == 1, "accept").when(F.col("toxic") == 1, "reject").otherwise("pending").alias("status"),
        F.when(F.col("toxic") == 1, "schema_drift").otherwise("low_confidence").alias("reason"), (F.col("doc_id") * 31 % 9973).alias("created"),
    )


def _case(of: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in of.items()) + " END"


#: The same views for DuckDB.
SQL = {
    "targets": f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_orderkey AS run_id, l_linenumber AS attempt, n_name AS connector,
      {_case(STATUS_OF, "l_returnflag || l_linestatus")} AS status, l_shipdate AS updated_at, l_partkey AS part_id, l_suppkey AS supplier_id, l_extendedprice AS price, l_quantity AS quantity
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "runs": "SELECT o_orderkey AS id, o_orderpriority AS connector, o_orderdate AS created_at FROM orders",
    "attempts": f"""SELECT event_id AS id, user_id AS target_id, ts AS created_at, event_type, {_case(CODE_OF, "event_type")} AS status_code, value AS latency_ms, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "hosts": "SELECT c_custkey AS id, n_name AS connector, 'https://shop.example/' || c_custkey AS url FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "captures": """SELECT page_id AS seq, n_name AS source, url, html, 1.0::DOUBLE - (page_id * 7 % 5) / 4.0::DOUBLE * CASE WHEN page_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS coverage,
      round(0.8::DOUBLE + (page_id * 13 % 20) / 100.0::DOUBLE, 4) AS confidence FROM pages JOIN nation ON page_id % 5 = n_nationkey""",
    "products": """SELECT p_partkey AS id, p_name AS title, p_brand AS source, p_type AS category, round(0.7::DOUBLE + p_partkey * 37 % 31 / 100.0::DOUBLE, 4) AS confidence, p_retailprice AS price,
      p_partkey * 7919 % 100003 AS captured, 'https://shop.example/p/' || p_partkey AS canonical_url FROM part""",
    "reviews": """SELECT doc_id AS id, doc_id AS product_id, CASE WHEN quality = 1 THEN 'accept' WHEN toxic = 1 THEN 'reject' ELSE 'pending' END AS status,
      CASE WHEN toxic = 1 THEN 'schema_drift' ELSE 'low_confidence' END AS reason, doc_id * 31 % 9973 AS created FROM labels""",
}


def sql(query: str, *names: str) -> str:
    """A query with the views that it names in front."""
    own = query.removeprefix("WITH ")
    first = "WITH RECURSIVE " if own.startswith("RECURSIVE ") else "WITH "
    if own.startswith("RECURSIVE "):
        return first + ", ".join(f"{n}_v AS ({SQL[n]})" for n in names) + ", " + own.removeprefix("RECURSIVE ")
    return first + ", ".join(f"{n}_v AS ({SQL[n]})" for n in names) + (", " if own != query else " ") + own
