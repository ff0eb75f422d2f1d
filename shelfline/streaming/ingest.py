"""Incremental ingestion with Structured Streaming: at-least-once input, exactly-once effect."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.reliability import THRESHOLD, TIMEOUT, step
from ..session import new_folder
from ..sources.keyed import BUCKET, SLICE, KeyedTable


def message_stream(spark: SparkSession, path: str, schema: str, files_each: int = 4) -> DataFrame:
    """Messages from Parquet files as they arrive; the checkpoint's offsets stand for acknowledgements."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def process(messages: DataFrame, out: str, checkpoint: str, apply, key: str = "id", day: str | None = None, buckets: int = 16) -> None:
    """Run ``apply`` on the stream until the input is used up and append each key's first result to ``out``.

    The sink is a keyed table, and keys are looked up there: a batch reads the buckets that its rows
    fall into and adds the keys that are missing. So nothing is kept in the stream's state however long it
    runs, a repeated batch changes nothing, and neither does a message that comes again after any
    time. ``day``: an expression over a message that is the same when it comes again, such as the day
    of its creation; then a batch only looks into the days that its messages name.
    """
    parts = apply(messages)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    table = KeyedTable(parts.sparkSession, out, schema, [key], buckets, day)
    query = parts.writeStream.foreachBatch(lambda batch, number: table.insert(batch, [key])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


#: The fields of a message about a target.
MESSAGE = "target_id string, run_id string, url string, connector string, render_mode string, attempt int"


def enqueue(rows: DataFrame, path: str) -> None:
    """Append messages to a stream's folder, each as one line of JSON; files appear whole when the job commits."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def payloads(spark: SparkSession, path: str, schema: str = MESSAGE, files_each: int = 4) -> DataFrame:
    """Messages of a stream's folder as they arrive: the fields of their JSON, and ``raw``, ``valid``.

    A consumer group is a checkpoint: each has offsets of its own, gets every message, and goes on
    after a restart where it stopped. What is no JSON of the schema comes with null fields and
    ``valid`` false, so that one bad message neither stops the stream nor is lost.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_each).text(path)
    read = lines.select(F.col("value").alias("raw"), F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("m"))
    return read.select("m.*", "raw").withColumn("valid", F.col("_bad").isNull()).drop("_bad")


def results(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop(BUCKET, SLICE)


def breaker_stream(requests: DataFrame, threshold: int = THRESHOLD, timeout: float = TIMEOUT) -> DataFrame:
    """Circuit breakers kept as state by host over a stream of (host, id, at, effect); rows of a batch go by (at, id)."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, failures, opened = state.get if state.exists else ("closed", 0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["at", "id"], kind="stable")
        out = []
        for i, at, what in zip(rows["id"].tolist(), rows["at"].tolist(), rows["effect"].tolist()):
            allowed, name, failures, opened = step(name, failures, opened, at, what, threshold, timeout)
            out.append((key[0], i, allowed, name, failures))
        state.update((name, failures, opened))
        yield pd.DataFrame(out, columns=["host", "id", "allowed", "state", "failures"])

    return requests.groupBy("host").applyInPandasWithState(update, "host string, id long, allowed boolean, state string, failures int", "name string, failures int, opened double", "append", GroupStateTimeout.NoTimeout)


def deliver(rows: DataFrame, path: str, parts: int) -> None:
    """Lay rows down as message files in a few deliveries, as a producer would."""
    rows.repartition(parts).write.mode("overwrite").parquet(path)


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared place of the session."""
    return new_folder(spark, f"ingest-{name}")
