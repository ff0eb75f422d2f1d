"""Read queries over the ingestion tables: listings, roll-ups, health, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import STATUSES


def status_counts(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """Runs with a count for each of the six states, 0 where none; a run without targets stays.

    One conditional aggregation before the join, so the join carries one row a run.
    """
    counts = targets.groupBy("run_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    return runs.join(counts, runs["id"] == counts["run_id"], "left").drop("run_id").na.fill(0, list(STATUSES))


def run_status(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """Each run's state: all succeeded; else all terminal gives failed or blocked; else running if any runs; else queued."""
    s = F.col("status")
    flags = targets.groupBy("run_id").agg(
        F.every(s == "succeeded").alias("done"), F.every(s.isin("succeeded", "failed", "blocked")).alias("over"),
        F.some(s == "failed").alias("bad"), F.some(s == "running").alias("live"),
    )
    state = F.when(F.col("done"), "succeeded").when(F.col("over"), F.when(F.col("bad"), "failed").otherwise("blocked")).when(F.col("live"), "running").otherwise("queued")
    return runs.select("id").join(flags, runs["id"] == flags["run_id"], "left").select("id", state.alias("status"))


def latest(df: DataFrame, by: str, n: int, key: str = "id") -> DataFrame:
    """The newest rows; the id breaks ties."""
    return df.orderBy(F.desc(by), key).limit(n)


def source_health(targets: DataFrame, attempts: DataFrame, drifts: DataFrame) -> DataFrame:
    """By connector: targets, those succeeded, last update, mean latency, last drift.

    Each side is aggregated by itself and joined once. attempts carry a connector.
    """
    base = targets.groupBy("connector").agg(F.count("*").alias("targets"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.max("updated_at").alias("last_seen_at"))
    slow = attempts.groupBy("connector").agg(F.round(F.avg("latency_ms"), 2).alias("average_latency_ms"))
    drift = drifts.groupBy(F.col("source").alias("connector")).agg(F.max("detected_at").alias("last_drift_at"))
    return base.join(slow, "connector", "left").join(drift, "connector", "left")


def metrics(targets: DataFrame, **tables: DataFrame) -> DataFrame:
    """``key, value`` rows: targets by state (only states that occur) and the size of each table."""
    out = targets.groupBy(F.format_string('targets{status="%s"}', F.col("status")).alias("key")).agg(F.count("*").alias("value"))
    for name, df in tables.items():
        out = out.unionByName(df.agg(F.lit(name).alias("key"), F.count("*").alias("value")))
    return out


def metrics_text(rows: DataFrame, prefix: str = "ingest_") -> DataFrame:
    """The metrics in exposition format, one text; a few rows by construction."""
    line = F.format_string(f"{prefix}%s %d", F.col("key"), F.col("value"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.agg(F.concat(F.lit(f"# TYPE {prefix}targets gauge\n"), lines, F.lit("\n")).alias("text"))


def list_products(products: DataFrame, min_confidence: float = 0.0, source: str = "", n: int = 100) -> DataFrame:
    """Products of at least a confidence, of one source if one is named, newest first."""
    out = products.filter(F.col("confidence") >= min_confidence)
    return latest(out.filter(F.col("source") == source) if source else out, "captured", n)


def list_attempts(attempts: DataFrame, targets: DataFrame, run_id=None, target_id=None, n: int = 1000) -> DataFrame:
    """Attempts with their targets' url, oldest first."""
    out = attempts.join(targets.select(F.col("id").alias("t_id"), "url", *(c for c in ("run_id",) if c in targets.columns)), F.col("target_id") == F.col("t_id")).drop("t_id")
    for name, value in (("run_id", run_id), ("target_id", target_id)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out.orderBy("created_at", "attempt", "id").limit(n)


def review_queue(reviews: DataFrame, products: DataFrame, status: str = "pending", n: int = 100) -> DataFrame:
    """Reviews of one status with their products' title, URL and confidence, newest first."""
    shown = products.select(F.col("id").alias("p_id"), "title", "canonical_url", "confidence")
    return latest(reviews.filter(F.col("status") == status).join(shown, F.col("product_id") == F.col("p_id")).drop("p_id"), "created", n)


def due_outbox(outbox: DataFrame, as_of: Column, n: int = 100) -> DataFrame:
    """Messages not yet published that may be seen by now, first in first out."""
    return outbox.filter(F.col("published_at").isNull() & (F.col("available_at") <= as_of)).orderBy("created_at", "id").limit(n)


def attempt_arrays(attempts: DataFrame) -> DataFrame:
    """By target: status codes and ids of its attempts in order."""
    rows = F.array_sort(F.collect_list(F.struct("created_at", "id", "status_code")))
    out = attempts.groupBy("target_id").agg(rows.alias("r"))
    return out.select("target_id", F.transform("r", lambda x: x["status_code"]).alias("request_statuses"), F.transform("r", lambda x: x["id"]).alias("attempt_ids"))


def latency_percentiles(attempts: DataFrame, by: str) -> DataFrame:
    """By key: median, and the value of rank floor(0.95 n).

    Ranks come from a window and the values wanted from a conditional aggregate, so no group is
    gathered as an array.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(by)
    ranked = attempts.select(by, "latency_ms", F.row_number().over(w.orderBy("latency_ms")).alias("r"), F.count("*").over(w).alias("n"))
    p95 = F.max(F.when(F.col("r") == F.greatest(F.floor(F.col("n") * 0.95), F.lit(1)), F.col("latency_ms")))
    middle = F.avg(F.when(F.col("r").isin(0) | (F.col("r") == F.floor((F.col("n") + 1) / 2)) | (F.col("r") == F.floor((F.col("n") + 2) / 2)), F.col("latency_ms")))
    return ranked.groupBy(by).agg(F.count("*").alias("n"), F.round(middle, 3).alias("p50_ms"), F.round(p95, 3).alias("p95_ms"))


def product_output(products: DataFrame, attempts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Products with recomputed coverage, their number of attempts, and their review if any."""
    fields = [c for c in ("title", "price_amount", "currency", "availability")]
    present = sum((F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in fields), F.lit(0))
    n = attempts.groupBy("target_id").agg(F.count("*").alias("fetch_attempts"))
    r = reviews.select(F.col("product_id").alias("r_product"), F.col("id").alias("review_id"), F.col("reason").alias("review_reason"), F.col("status").alias("review_status"))
    out = products.join(n, "target_id", "left").join(r, F.col("id") == F.col("r_product"), "left").drop("r_product")
    return out.withColumns({"required_field_coverage": present / float(len(fields)), "fetch_attempts": F.coalesce("fetch_attempts", F.lit(0)), "review_required": F.col("review_id").isNotNull()})


def run_durations(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """Each run's number of targets, and seconds from its creation to its last target's update, not below 0; null without targets."""
    ends = targets.groupBy("run_id").agg(F.count("*").alias("targets"), F.max(F.unix_micros("updated_at")).alias("_end"))
    out = runs.join(ends, runs["id"] == ends["run_id"], "left")
    seconds = F.round((F.col("_end") - F.unix_micros("created_at")) / 1e6, 3)
    return out.select("id", F.coalesce("targets", F.lit(0)).alias("targets"), F.when(seconds < 0, 0.0).otherwise(seconds).alias("duration_seconds"))


def throughput(attempts: DataFrame, by: str, started_at: str, latency_ms: str, floor: float = 0.001) -> DataFrame:
    """Fetches a second by ``by``: n over the seconds that it takes one after another, and over those from the first start to the last end.

    Rates have two places and are null for no time; their ratio divides by ``floor`` at least.
    """
    start = F.unix_micros(started_at) / 1e6
    spent, span = F.sum(latency_ms) / 1000, F.max(start + F.col(latency_ms) / 1000) - F.min(start)
    rate = lambda seconds: F.round(F.count("*") / F.nullif(seconds, F.lit(0.0)), 2)
    out = attempts.groupBy(by).agg(F.count("*").alias("n"), rate(spent).alias("baseline_per_second"), rate(span).alias("concurrent_per_second"))
    return out.withColumn("speedup", F.round(F.col("concurrent_per_second") / F.greatest("baseline_per_second", F.lit(floor)), 2))
