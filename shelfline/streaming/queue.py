"""A message queue as a stream with timers: delayed delivery, acknowledgement, and delivery again of what lies idle.

Events are rows ``id, kind, at, due, payload``: a ``message`` may be delivered from ``due`` on (at once if
that is null), an ``ack`` ends it, a ``tick`` only moves the clock. Timers compare with the wall clock, or
with the events' own (``at``, milliseconds), which makes a run the same however long it takes; events
that come later than that clock allows are dropped, so it is for replays whose lateness is known.

Messages that are not acknowledged are rows of a table, ``held``. A batch of the stream is one step of it:
a join of its events by id where there are any, and a filter of timers. Steps are written beside the
stream's checkpoint under numbers that follow from the batch's, so a batch that is repeated begins
again from the step before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "id string, kind string, at long, due long, payload string"
DELIVERY = "id string, delivery int, due long, delivered_at long, reclaimed boolean, payload string"
#: A message between its arrival and its end: how often it was handed out, when it is next, and whether that was in this step.
HELD = "id string, due long, deliveries int, timer long, payload string, fresh boolean"
#: The clock of a step, that of the step before, and the latest event up to it.
CLOCK = "now long, before long, latest long"
#: Milliseconds after which a message that was delivered and not acknowledged is delivered again.
IDLE = 30_000
#: Milliseconds that an event may be behind the latest one by the events' clock.
LATENESS = 1_000
#: Rows are laid down in this folder, and an event of this kind names them, so that one delivery of any size is one event file.
SENT, SENT_KIND = "_sent", "sent"
_FIRST, _LAST = -(1 << 63), (1 << 63) - 1


def advance(held: DataFrame, events: DataFrame | None, now: int, idle: int = IDLE) -> DataFrame:
    """What is held (HELD) after some events (EVENT and ``seq``, the order of equal times) and the timers up to ``now``.

    A message that comes twice before its acknowledgement is one. One that an ``ack`` ended may come
    again as a new one with the same id (a retry), which is why sinks drop what they have. At one
    time a message comes before its end.
    """
    if events is not None:
        first = F.greatest(F.coalesce("due", F.lit(1)), F.lit(1))
        rows = events.filter(F.col("kind").isin("message", "ack")).select("id", "kind", F.coalesce("at", F.lit(_LAST)).alias("at"), "seq", "due", F.lit(0).alias("deliveries"), first.alias("timer"), "payload")
        there = held.select("id", F.lit("held").alias("kind"), F.lit(_FIRST).alias("at"), F.lit(0).cast("long").alias("seq"), "due", "deliveries", "timer", "payload")
        end = F.max(F.when(F.col("kind") == "ack", F.col("at"))).over(Window.partitionBy("id"))
        left = there.unionByName(rows).withColumn("_end", end).filter("kind <> 'ack' AND (_end IS NULL OR at > _end)")
        held = left.groupBy("id").agg(F.min_by(F.struct("due", "deliveries", "timer", "payload"), F.struct("at", "seq")).alias("m")).select("id", "m.*")
    fires = F.col("timer") <= now
    return held.select(
        "id", "due", (F.col("deliveries") + fires.cast("int")).alias("deliveries"), F.when(fires, F.lit(now + idle).cast("long")).otherwise(F.col("timer")).alias("timer"), "payload", fires.alias("fresh"),
    )


def in_order(delivered: DataFrame) -> DataFrame:
    """How a worker takes what a batch delivers: what it reclaims before what is new, then by due time."""
    return delivered.orderBy(F.desc("reclaimed"), "due", "id")


class _Steps:
    """The steps of ``held`` beside a checkpoint: batch n is step 2n, and 2n + 1 if its own clock is waited for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, number: int) -> bool:
        """Whether the step is whole: its clock is written last."""
        return self.files.exists(self.at(f"{self.path}/{number}/clock/_SUCCESS"))

    def last(self) -> int:
        there = [int(f.getPath().getName()) for f in self.files.listStatus(self.at(self.path))] if self.files.exists(self.at(self.path)) else []
        return max((n for n in there if self.has(n)), default=-1)

    def clock(self, number: int) -> tuple[int, int, int]:
        return tuple(self.spark.read.schema(CLOCK).json(f"{self.path}/{number}/clock").first()) if number >= 0 else (0, 0, 0)

    def held(self, number: int) -> DataFrame:
        return self.spark.read.schema(HELD).parquet(f"{self.path}/{number}/held") if number >= 0 else self.spark.createDataFrame([], HELD)

    def put(self, number: int, held: DataFrame, clock: tuple[int, int, int]) -> DataFrame:
        self.files.delete(self.at(f"{self.path}/{number}/clock"), True)
        held.write.mode("overwrite").parquet(f"{self.path}/{number}/held")
        self.spark.createDataFrame([clock], CLOCK).coalesce(1).write.mode("overwrite").json(f"{self.path}/{number}/clock")
        for old in (number - 4, number - 3):  # a repeated batch begins with the step before it
            self.files.delete(self.at(f"{self.path}/{old}"), True)
        return self.held(number)


def run(spark: SparkSession, events: str, out: str, checkpoint: str, handle: Callable[[DataFrame, int], None] | None = None, idle: int = IDLE, seconds: float | None = None, files_each: int = 1, lateness: int = LATENESS) -> None:
    """Deliver what a folder of events holds; each step's deliveries (DELIVERY) overwrite a folder of its number and then go to ``handle``.

    By the events' clock until they are used up, or for some ``seconds`` by the wall clock. ``handle`` may
    add events to the folder (acknowledgements, retries); a further run takes them up.
    """
    wall = seconds is not None
    steps = _Steps(spark, f"{checkpoint}/held")

    def put(number: int, held: DataFrame, clock: tuple[int, int, int]) -> None:
        fresh = steps.put(number, held, clock).filter("fresh")
        told = fresh.select("id", F.col("deliveries").alias("delivery"), "due", F.lit(clock[0]).cast("long").alias("delivered_at"), (F.col("deliveries") > 1).alias("reclaimed"), "payload")
        told.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if handle is not None:
            handle(spark.read.schema(DELIVERY).parquet(f"{out}/batch={number}"), number)

    def step(batch: DataFrame, batch_number: int) -> None:
        number = 2 * batch_number
        last = next((n for n in (number - 1, number - 2) if n >= 0 and steps.has(n)), -1)
        was, _, latest = steps.clock(last)
        now = int(batch.sparkSession.sql("SELECT unix_millis(current_timestamp())").first()[0]) if wall else max(was, latest - lateness)
        rows = batch.filter(~F.col("kind").eqNullSafe(SENT_KIND)).withColumn("seq", F.monotonically_increasing_id())
        folders = [f"{events}/{SENT}/{r['payload']}" for r in batch.filter(F.col("kind") == SENT_KIND).select("payload").collect()]
        if folders:
            rows = rows.unionByName(batch.sparkSession.read.schema(f"{EVENT}, seq long").parquet(*folders))
        if not wall:
            rows = rows.filter(F.col("at").isNull() | (F.col("at") > was))
        seen = rows.agg(F.max("at").alias("latest"), F.count_if(F.col("kind").isin("message", "ack")).alias("n")).first()
        put(number, advance(steps.held(last), rows if seen["n"] else None, now, idle), (now, was, max(latest, seen["latest"] or 0)))

    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_each).parquet(events)
    if wall:  # a row a second keeps the clock going where no events come
        beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        stream = stream.unionByName(beat.select(F.lit("").alias("id"), F.lit("tick").alias("kind"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("due"), F.lit(None).cast("string").alias("payload")))
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if wall:
        query = writer.trigger(processingTime="1 second").start()
        try:
            query.awaitTermination(seconds)
        finally:
            query.stop()
        return
    writer.trigger(availableNow=True).start().awaitTermination()
    last = steps.last()
    now, _, latest = steps.clock(last)
    if last >= 0 and last % 2 == 0 and latest - lateness > now:  # the clock that the last events set
        put(last + 1, advance(steps.held(last), None, latest - lateness, idle), (latest - lateness, now, latest))


def send(rows: DataFrame, events: str) -> None:
    """Add events to the folder as one delivery of a producer, which may be many files: they count once they are named."""
    name = uuid.uuid4().hex
    rows.select("id", "kind", "at", "due", "payload", F.monotonically_increasing_id().alias("seq")).write.parquet(f"{events}/{SENT}/{name}")
    _append(rows.sparkSession, (None, SENT_KIND, None, None, name), events)


def tick(spark: SparkSession, at: int, events: str) -> None:
    """Move the clock."""
    _append(spark, ("", "tick", at, None, None), events)


def _append(spark: SparkSession, event: tuple, events: str) -> None:
    spark.createDataFrame([event], EVENT).coalesce(1).write.mode("append").parquet(events)


def results(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{DELIVERY}, batch int").parquet(out)
