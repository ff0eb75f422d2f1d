"""The report over all runs, and how its values are shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import http_transient
from ..sources.schemas import REQUIRED_FIELDS, STATUSES
from .lifecycle import stale, target_states

#: Labels of connectors, states and availabilities.
CONNECTOR_LABELS = {"fixture_chaos": "장애 복구 테스트", "books_to_scrape": "Books to Scrape", "fixture_drift": "구조 변경 테스트"}
STATUS_LABELS = {"queued": "대기", "running": "처리 중", "retrying": "재시도", "succeeded": "완료", "failed": "실패", "blocked": "차단"}
AVAILABILITY_LABELS = {"InStock": "재고 있음", "In stock (3 available)": "재고 있음 (3개)", "In stock (22 available)": "재고 있음 (22개)"}


def label(value: Column, labels: dict[str, str]) -> Column:
    """A value's label, or the value itself."""
    known = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return F.coalesce(F.try_element_at(known, value), value)


def korean_time(at: Column) -> Column:
    """A point in time on Korean clocks, to the second."""
    return F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(at, F.current_timezone()), "+09:00"), "yyyy. M. d. HH:mm:ss")


def duration_text(seconds: Column) -> Column:
    """Seconds, or minutes from one on, with one decimal rounded half up; null for null."""
    return F.when(seconds < 0.1, "<0.1초").when(seconds < 60, F.format_string("%.1f초", seconds)).when(seconds.isNotNull(), F.format_string("%.1f분", seconds / 60))


def dataset(targets: DataFrame, attempts: DataFrame, products: DataFrame, reviews: DataFrame, runs: DataFrame) -> DataFrame:
    """The report as rows ``section, id, body``, body in JSON: totals, then each source and each run.

    A row an entity rather than one document, so that no row grows with the input. targets:
    ``run_id, connector, status``; products: the required fields; reviews: ``status``.
    """
    by = lambda s: F.count_if(F.col("status") == s).alias(s)
    present = sum((F.coalesce(F.col(f).cast("string") != "", F.lit(False)).cast("long") for f in REQUIRED_FIELDS), F.lit(0))
    totals = [
        targets.agg(F.struct(F.count("*").alias("targets"), by("succeeded"), F.round(F.count_if(F.col("status") == "succeeded") / F.count("*"), 4).alias("success_rate")).alias("b")).select(F.lit("targets").alias("id"), F.to_json("b").alias("body")),
        attempts.agg(F.struct(F.count("*").alias("fetch_attempts")).alias("b")).select(F.lit("attempts").alias("id"), F.to_json("b").alias("body")),
        products.agg(F.struct(F.coalesce(F.sum(present), F.lit(0)).alias("required_fields_present"), (F.count("*") * len(REQUIRED_FIELDS)).alias("required_fields_expected")).alias("b")).select(F.lit("products").alias("id"), F.to_json("b").alias("body")),
        reviews.agg(F.struct(F.count_if(F.col("status") == "pending").alias("reviews_pending")).alias("b")).select(F.lit("reviews").alias("id"), F.to_json("b").alias("body")),
    ]
    states = [by(s) for s in STATUSES]
    sources = targets.groupBy("connector").agg(F.count("*").alias("targets"), *states).select(F.col("connector").alias("id"), F.to_json(F.struct("targets", *STATUSES)).alias("body"))
    held = targets.groupBy("run_id").agg(*states)
    each = runs.select("id").join(held, runs["id"] == held["run_id"], "left").na.fill(0, list(STATUSES))
    each = each.select(F.col("id").cast("string").alias("id"), F.to_json(F.struct(*STATUSES)).alias("body"))
    parts = [("metrics", t) for t in totals] + [("sources", sources), ("runs", each)]
    return reduce(DataFrame.unionByName, (p.select(F.lit(name).alias("section"), "id", "body") for name, p in parts))


def recovery(attempts: DataFrame, messages: DataFrame, stored: DataFrame, as_of: Column, idle_seconds: float = 30.0) -> DataFrame:
    """One row: how often work failed for a while, came back, lay idle, was lost or done twice.

    attempts: numbered, ``target_id, attempt, status_code, state``; those after a target's end don't count.
    messages: ``delivered_at, acknowledged_at``. stored: ``target_id``, a row for each product kept. ``lost`` are
    targets that succeeded without a product, ``duplicates`` products beyond the first of a target.
    """
    ends = target_states(attempts).select(F.col("target_id").alias("t"), F.col("attempts").alias("last"), "status")
    failed = attempts.join(ends, (F.col("target_id") == F.col("t")) & (F.col("attempt") <= F.col("last"))).filter(http_transient(F.col("status_code")))
    failed = failed.groupBy(F.col("target_id").alias("f")).agg(F.count("*").alias("failures"))
    kept = stored.groupBy(F.col("target_id").alias("s")).agg(F.count("*").alias("products"))
    each = ends.join(failed, F.col("t") == F.col("f"), "left").join(kept, F.col("t") == F.col("s"), "left")
    ok = F.col("status") == "succeeded"
    totals = each.agg(
        F.count("*").alias("targets"), F.count_if(ok).alias("succeeded"), F.coalesce(F.sum("failures"), F.lit(0)).alias("transient_failures"), F.count_if(ok & (F.col("failures") > 0)).alias("recovered"),
        F.count_if(ok & F.col("products").isNull()).alias("lost"), F.coalesce(F.sum(F.greatest(F.col("products") - 1, F.lit(0))), F.lit(0)).alias("duplicates"),
    )
    idle = stale(messages, as_of, idle_seconds).agg(F.count("*").alias("reclaimable"))
    names = ["targets", "succeeded", "transient_failures", "recovered", "reclaimable", "lost", "duplicates"]
    return totals.unionByName(idle, allowMissingColumns=True).agg(*(F.max(n).alias(n) for n in names))
