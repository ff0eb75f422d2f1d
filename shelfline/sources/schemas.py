"""Schemas of the ingestion tables and the closed sets that their columns come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: States of a target, required fields of a product, how evidence was found, how a page is rendered.
STATUSES = ("queued", "running", "retrying", "succeeded", "failed", "blocked")
REQUIRED_FIELDS = ("title", "price_amount", "currency", "availability")
EVIDENCE_SOURCES = ("json_ld", "source_selector", "semantic_fallback", "derived")
RENDER_MODES = ("http", "browser", "auto")

EVIDENCE = "map<string,struct<value:string,source:string,confidence:double,selector:string>>"

TABLES = {
    "crawl_runs": "id string, connector string, status string, render_mode string, created_at timestamp, updated_at timestamp",
    "crawl_targets": "id string, run_id string, url string, normalized_url string, connector string, render_mode string, status string, attempts int, max_attempts int, error_code string, next_attempt_at timestamp, created_at timestamp, updated_at timestamp",
    "fetch_attempts": "id string, target_id string, attempt int, status_code int, latency_ms double, bytes_received int, error_code string, retry_after_seconds double, created_at timestamp",
    "products": f"id string, run_id string, target_id string, source string, external_id string, canonical_url string, title string, price_amount string, currency string, availability string, brand string, category string, image_url string, captured_at timestamp, confidence double, dom_fingerprint string, field_evidence {EVIDENCE}",
    "review_items": "id string, product_id string, status string, reason string, note string, created_at timestamp, resolved_at timestamp",
    "source_profiles": "source string, dom_fingerprint string, baseline_coverage double, observed_count int, updated_at timestamp",
    "drift_events": "id string, source string, target_id string, previous_fingerprint string, new_fingerprint string, coverage double, confidence double, detected_at timestamp",
    "outbox": "id string, target_id string, payload struct<target_id:string,run_id:string,url:string,connector:string,render_mode:string,attempt:int>, available_at timestamp, published_at timestamp, created_at timestamp",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def valid_run_request(connector: Column, start_urls: Column, max_pages: Column) -> Column:
    """What a run may be registered with: a plain connector name, 1 to 1000 distinct URLs, 1 to 10000 pages."""
    n = F.size(start_urls)
    return F.coalesce(connector.rlike("^[a-z0-9_-]+$") & n.between(1, 1000) & (F.size(F.array_distinct(start_urls)) == n) & max_pages.between(1, 10000), F.lit(False))


def valid_resolution(action: Column, note: Column) -> Column:
    return F.coalesce(action.isin("accept", "reject") & F.length(note).between(3, 500), F.lit(False))
