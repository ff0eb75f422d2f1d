"""State transitions of runs, targets, attempts, products, reviews and the outbox, as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalise_url
from ..session import spread


TARGET = ["id", "run_id", "url", "normalized_url", "connector", "render_mode", "status", "attempts", "max_attempts", "created_at"]
OUTBOX = ["id", "target_id", "payload", "available_at", "published_at", "created_at"]


def create_rows(requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Of requests (id, connector, render_mode, start_urls, max_pages, max_attempts): the rows that registering adds, and rejected runs.

    The rows are those of ``crawl_targets`` and ``outbox``, told apart by ``table``: a target and its first
    message come from one row of one plan, so one job writes both or neither. URLs past max_pages
    are cut off. Two URLs of a run that differ by trailing slashes only reject the whole run.
    """
    urls = requests.select("id", "connector", "render_mode", "max_attempts", F.posexplode(F.slice("start_urls", F.lit(1), F.col("max_pages"))).alias("pos", "url"))
    urls = urls.withColumn("normalized_url", normalise_url(F.col("url")))
    rejected = duplicate_urls(urls.withColumnRenamed("id", "run_id")).select("run_id").distinct()
    good = urls.join(rejected, urls["id"] == rejected["run_id"], "left_anti")
    both = good.select(
        F.sha2(F.concat_ws("|", "id", "normalized_url"), 256).alias("_target"), F.col("id").alias("_run"), F.col("url").alias("_url"), F.col("normalized_url").alias("_normalized"),
        F.col("connector").alias("_connector"), F.col("render_mode").alias("_mode"), F.col("max_attempts").alias("_max"), F.explode(F.array(F.lit("crawl_targets"), F.lit("outbox"))).alias("table"),
    )
    message = F.col("table") == "outbox"
    target = lambda c: F.when(~message, c)
    payload = F.struct(F.col("_target").alias("target_id"), F.col("_run").alias("run_id"), F.col("_url").alias("url"), F.col("_connector").alias("connector"), F.col("_mode").alias("render_mode"), F.lit(1).alias("attempt"))
    rows = both.select(
        "table", F.when(message, F.sha2(F.concat("_target", F.lit("|0")), 256)).otherwise(F.col("_target")).alias("id"),
        target(F.col("_run")).alias("run_id"), target(F.col("_url")).alias("url"), target(F.col("_normalized")).alias("normalized_url"), target(F.col("_connector")).alias("connector"),
        target(F.col("_mode")).alias("render_mode"), target(F.lit("queued")).alias("status"), target(F.lit(0)).alias("attempts"), target(F.col("_max")).alias("max_attempts"),
        F.when(message, F.col("_target")).alias("target_id"), F.when(message, payload).alias("payload"), F.when(message, as_of).alias("available_at"), F.lit(None).cast("timestamp").alias("published_at"), as_of.alias("created_at"),
    )
    return rows, rejected


def create_run(requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What :func:`create_rows` adds, as targets and outbox rows by themselves, and rejected runs."""
    rows, rejected = create_rows(requests, as_of)
    return rows.filter("table = 'crawl_targets'").select(*TARGET), rows.filter("table = 'outbox'").select(*OUTBOX), rejected


def duplicate_urls(targets: DataFrame) -> DataFrame:
    """Normalised URLs that a run has more than once."""
    return targets.groupBy("run_id", "normalized_url").agg(F.count("*").alias("n")).filter("n > 1")


def startable(messages: DataFrame, targets: DataFrame) -> DataFrame:
    """Messages whose target exists and is neither succeeded nor blocked; failed and running ones may run again."""
    live = targets.filter(~F.col("status").isin("succeeded", "blocked")).select(F.col("id").alias("target_id"))
    return messages.join(live, "target_id", "left_semi")


def number_attempts(events: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Attempts numbered from 1 in order."""
    return events.withColumn("attempt", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def first_write(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def insert_absent(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't there yet, to be appended.

    They are dealt over all tasks of a shuffle: keys are few bytes, of which Spark would put so many into one
    task that sorting and grouping them there takes much memory.
    """
    return spread(rows, *keys).join(existing.select(*keys), keys, "left_anti")


def upsert(rows: DataFrame, keys: list[str], order: list, keep_first: list[str]) -> DataFrame:
    """One row for each key: the last one's values, but the first one's in ``keep_first``.

    One sort serves both: first values come from a frame over the whole key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rows.withColumn("_n", F.row_number().over(w)).withColumn("_last", F.count("*").over(whole))
    return out.withColumns({c: F.first(c).over(whole) for c in keep_first}).filter("_n = _last").drop("_n", "_last")


def outcome(transient: Column, ok: Column, attempt: Column, max_attempts: Column) -> Column:
    """A target's state after an attempt: succeeded; retrying while transient and attempts are left; blocked if permanent; failed if exhausted."""
    return F.when(ok, "succeeded").when(transient & (attempt < max_attempts), "retrying").when(~transient, "blocked").otherwise("failed")


def target_states(attempts: DataFrame) -> DataFrame:
    """Of numbered attempts with a ``state``: each target's attempts and state, the first terminal one or else the last.

    Attempts after a success or a block are never started.
    """
    end = F.min(F.when(F.col("state").isin("succeeded", "blocked"), F.col("attempt")))
    last = F.max(F.struct("attempt", "state"))
    ended = attempts.groupBy("target_id").agg(end.alias("e"), last.alias("l"), F.min(F.when(F.col("state").isin("succeeded", "blocked"), F.struct("attempt", "state"))).alias("f"))
    return ended.select("target_id", F.coalesce("e", F.col("l.attempt")).alias("attempts"), F.coalesce(F.col("f.state"), F.col("l.state")).alias("status"))


def first_reviews(existing: DataFrame, candidates: DataFrame, order: list) -> DataFrame:
    """Of review candidates for products that have no review yet, the first of each; a review is never replaced."""
    return first_write(insert_absent(existing, candidates, ["product_id"]), ["product_id"], order)


def retries(targets: DataFrame, as_of: Column, delay: Column) -> DataFrame:
    """Outbox rows for targets in state retrying, each with its next attempt, visible when the delay is over."""
    due = F.timestamp_micros(F.unix_micros(as_of) + (delay * 1_000_000).cast("long"))
    payload = F.struct("target_id", (F.col("attempts") + 1).alias("attempt"))
    return targets.filter("status = 'retrying'").select(
        F.sha2(F.concat_ws("|", "target_id", "attempts"), 256).alias("id"), "target_id", payload.alias("payload"), due.alias("available_at"),
        F.lit(None).cast("timestamp").alias("published_at"), as_of.alias("created_at"),
    )


def publish(outbox: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Messages for all due rows, and the outbox with these marked.

    Messages are delivered before the mark is stored, so a crash between the two delivers them
    again: at least once, with the same ids, which a sink that drops repeats makes once.
    """
    due = F.col("published_at").isNull() & (F.col("available_at") <= as_of)
    marked = outbox.withColumn("published_at", F.when(due, as_of).otherwise(F.col("published_at")))
    return outbox.filter(due), marked


def resolve_reviews(reviews: DataFrame, actions: DataFrame, as_of: Column) -> DataFrame:
    """Pending reviews named in actions (id, action, note) take the action as their status; others stay."""
    a = actions.select(F.col("id").alias("a_id"), "action", F.col("note").alias("a_note"))
    hit = F.col("a_id").isNotNull() & (F.col("status") == "pending")
    out = reviews.join(a, F.col("id") == F.col("a_id"), "left")
    changed = {"status": F.when(hit, F.col("action")).otherwise(F.col("status"))}
    if "note" in reviews.columns:
        changed |= {"note": F.when(hit, F.col("a_note")).otherwise(F.col("note")), "resolved_at": F.when(hit, as_of).otherwise(F.col("resolved_at"))}
    return out.withColumns(changed).select(*reviews.columns)


def stale(messages: DataFrame, as_of: Column, idle_seconds: float = 30.0) -> DataFrame:
    """Messages delivered that long ago and never acknowledged."""
    return messages.filter(F.col("acknowledged_at").isNull() & ((F.unix_micros(as_of) - F.unix_micros("delivered_at")) / 1e6 >= idle_seconds))


def pace(requests: DataFrame, host: str, at: str, order: list[str], spacing: float) -> DataFrame:
    """When each request may go if a host's requests are at least ``spacing`` apart.

    The wait-for-the-last recurrence in closed form: a running maximum of arrival - spacing * rank.
    """
    w = Window.partitionBy(host).orderBy(*order)
    rank = F.row_number().over(w) - 1
    lead = requests.withColumn("_r", rank).withColumn("_x", F.col(at) - F.lit(spacing) * F.col("_r"))
    return lead.withColumn("starts_at", F.lit(spacing) * F.col("_r") + F.max("_x").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_r", "_x")
