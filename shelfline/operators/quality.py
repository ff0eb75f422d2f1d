"""Structure fingerprints, coverage and confidence, drift against a source's baseline, and the review gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from ..sources.schemas import REQUIRED_FIELDS

LOW_CONFIDENCE = 0.9


def start_tags(html: Column) -> Column:
    """Start tags of a page as they stand, comments and the insides of scripts and styles left out."""
    bare = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, "(?is)(<(script|style)\\b[^>]*>).*?(</\\2\\s*>)", "$1$3")
    return F.regexp_extract_all(bare, F.lit("(<[a-zA-Z][^>]*>)"), 1)


def signature(tag: Column) -> Column:
    """A start tag's name with at most three of its sorted classes."""
    name = F.lower(F.regexp_extract(tag, "^<([a-zA-Z][a-zA-Z0-9:-]*)", 1))
    classes = F.filter(F.split(F.regexp_extract(tag, "\\sclass=\"([^\"]*)\"", 1), "\\s+"), lambda c: c != "")
    return F.array_join(F.concat(F.array(name), F.slice(F.array_sort(classes), 1, 3)), ".")


def fingerprint(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Each page's 16-digit structure hash: its signatures with their counts, in order of the signature.

    Counting by (page, signature) is pre-aggregated, and both groupings are by page first, so
    one exchange by page serves them.
    """
    tags = pages.select(key, F.explode_outer(F.transform(start_tags(F.col(html)), signature)).alias("sig"))
    counted = tags.groupBy(key, "sig").agg(F.count("sig").alias("n"))
    parts = F.array_sort(F.collect_list(F.when(F.col("sig").isNotNull(), F.struct("sig", "n"))))
    payload = F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["sig"], p["n"])), "|")
    return counted.groupBy(key).agg(F.substring(F.sha2(payload.cast("binary"), 256), 1, 16).alias("dom_fingerprint"))


def coverage(evidence: Column) -> Column:
    """The share of required fields that have evidence."""
    return F.size(F.array_intersect(F.map_keys(evidence), F.array(*map(F.lit, REQUIRED_FIELDS)))) / F.lit(float(len(REQUIRED_FIELDS)))


def confidence(evidence: Column) -> Column:
    """The mean confidence of all evidence, optional and derived fields included, to four places."""
    return F.round(F.aggregate(F.map_values(evidence), F.lit(0.0), lambda acc, e: acc + e["confidence"]) / F.size(evidence), 4)


def warnings(evidence: Column) -> Column:
    """``missing_title`` alone without a title, else the missing required fields in their order."""
    missing = F.filter(F.array(*map(F.lit, REQUIRED_FIELDS)), lambda f: ~F.map_contains_key(evidence, f))
    named = F.transform(missing, lambda f: F.concat(F.lit("missing_"), f))
    return F.when(F.map_contains_key(evidence, F.lit("title")), named).otherwise(F.array(F.lit("missing_title")))


def explode_evidence(products: DataFrame, key: str, evidence: str = "field_evidence") -> DataFrame:
    """A row for each required field: value, method, selector, confidence; null where there's no evidence."""
    rows = products.select(key, evidence, F.posexplode(F.array(*map(F.lit, REQUIRED_FIELDS))).alias("position", "field"))
    e = F.try_element_at(F.col(evidence), F.col("field"))
    return rows.select(key, "position", "field", e["value"].alias("value"), e["source"].alias("method"), e["selector"].alias("selector"), e["confidence"].alias("confidence"))


def drift(captures: DataFrame, by: str = "source", order: list[str] = ("seq",), threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """Captures with ``previous_fingerprint, baseline_coverage, drift`` as their source's profile stood before each.

    A capture is degraded if it covers less than the best before it or its confidence is low.
    A degraded one leaves the profile's fingerprint as it is and any other sets it, so the
    profile before a row is the last fingerprint not degraded. A row drifts if it is degraded
    and its fingerprint isn't the profile's.

    Both parts of a profile are prefix scans, taken in two levels so that a source of any size is
    many tasks: rows are dealt by ranges of (source, order); each source's part of a range is a
    chunk. Chunks first hand on their best coverage, then, once that says which rows are
    degraded, their last fingerprint that isn't. The dealt rows are written, since ranges
    drawn twice need not be the same.
    """
    dealt = captures.repartitionByRange(by, *order).withColumn("_chunk", F.spark_partition_id())
    dealt = written(dealt, "captures")
    key = [by, "_chunk"]
    in_chunk = Window.partitionBy(*key).orderBy(*order)
    past = in_chunk.rowsBetween(Window.unboundedPreceding, -1)
    chunks_before = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)

    best = dealt.groupBy(*key).agg(F.max("coverage").alias("_best"))
    best = best.select(*key, F.max("_best").over(chunks_before).alias("_best"), (F.row_number().over(Window.partitionBy(by).orderBy("_chunk")) == 1).alias("_opens"))
    out = _carried(dealt, best, key).withColumn("baseline_coverage", F.greatest("_best", F.max("coverage").over(past)))
    out = out.withColumn("_first", F.col("_opens") & (F.row_number().over(in_chunk) == 1))
    out = out.withColumn("_bad", F.coalesce(F.col("coverage") < F.col("baseline_coverage"), F.lit(False)) | F.coalesce(F.col("confidence") < threshold, F.lit(False)))
    out = out.withColumn("_sets", F.when(F.col("_first") | ~F.col("_bad"), F.col("dom_fingerprint")))

    last = out.groupBy(*key).agg(F.max_by("_sets", F.when(F.col("_sets").isNotNull(), F.struct(*order))).alias("_last"))
    last = last.select(*key, F.last("_last", ignorenulls=True).over(chunks_before).alias("_last"))
    out = _carried(out, last, key).withColumn("previous_fingerprint", F.coalesce(F.last("_sets", ignorenulls=True).over(past), "_last"))
    out = out.withColumn("drift", F.coalesce((F.col("previous_fingerprint") != F.col("dom_fingerprint")) & F.col("_bad"), F.lit(False)))
    return out.select(*captures.columns, "baseline_coverage", "previous_fingerprint", "drift")


def _carried(rows: DataFrame, chunks: DataFrame, key: list[str]) -> DataFrame:
    """Rows with what was handed on to their chunk; a source may be null."""
    named = chunks.withColumnsRenamed({k: f"_of{k}" for k in key})
    met = [rows[k].eqNullSafe(named[f"_of{k}"]) for k in key]
    return rows.join(named, met[0] & met[1]).drop(*(f"_of{k}" for k in key))


def source_profiles(captures: DataFrame, by: str = "source", order: list[str] = ("seq",), threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """Each source's profile after all of its captures: the last fingerprint not degraded, best coverage, number seen."""
    d = drift(captures, by, order, threshold)
    good = F.col("previous_fingerprint").isNull() | ~((F.col("coverage") < F.col("baseline_coverage")) | (F.col("confidence") < threshold))
    key = F.struct(*order)
    return d.groupBy(by).agg(F.max_by(F.col("dom_fingerprint"), F.when(good, key)).alias("dom_fingerprint"), F.max("coverage").alias("baseline_coverage"), F.count("*").alias("observed_count"))


def review_reason(drifted: Column, conf: Column, cov: Column, threshold: float = LOW_CONFIDENCE) -> Column:
    """Why a product needs a review, drift before low confidence before missing fields; null if it needs none."""
    return F.when(drifted, "schema_drift").when(conf < threshold, "low_confidence").when(cov < 1, "incomplete_required_fields")


def needs_browser(mode: Column, cov: Column) -> Column:
    """Whether a page must be rendered and parsed again."""
    return (mode == "browser") | ((mode == "auto") & (cov < 0.5))
