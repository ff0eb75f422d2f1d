"""Circuit breakers: replayed over a log of requests by host, and kept as state of a stream."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, TIMEOUT = 5, 20.0


def effect(status: Column, error: Column) -> Column:
    """What a request's end means to its host's breaker: success, failure, or nothing."""
    ok = status.between(200, 399)
    bad = (status == 429) | (status >= 500) | error.isin("timeout", "transport_error", "response_too_large")
    return F.when(bad, "failure").when(ok, "success").otherwise("neutral")


def step(state: str, failures: int, opened: float, at: float, what: str, threshold: int, timeout: float) -> tuple[bool, str, int, float]:
    """One request: whether it was let through, and the breaker after it."""
    if state == "open":
        if at - opened < timeout:
            return False, state, failures, opened
        state = "half_open"
    if what == "success":
        return True, "closed", 0, opened
    if what == "failure":
        failures += 1
        if state == "half_open" or failures >= threshold:
            return True, "open", failures, at
    return True, state, failures, opened


OUT = "host string, id long, allowed boolean, state string, failures int"


def replay(requests: DataFrame, threshold: int = THRESHOLD, timeout: float = TIMEOUT) -> DataFrame:
    """Requests (host, id, at seconds, effect) in order of (at, id), each host's with its own breaker.

    A host's requests depend on each other one by one, so a host is one ordered walk. Rows of a
    host are sorted by Spark and walked as they stream by: a task holds one breaker, not a group.
    """
    dealt = requests.select(F.col("host").cast("string").alias("host"), F.col("id").cast("long").alias("id"), F.col("at").cast("double").alias("at"), "effect")
    dealt = dealt.repartition("host").sortWithinPartitions("host", "at", "id")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, failures, opened = object(), "closed", 0, 0.0
        for f in frames:
            out = []
            for host, i, at, what in zip(f["host"].tolist(), f["id"].tolist(), f["at"].tolist(), f["effect"].tolist()):
                if host != current:
                    current, state, failures, opened = host, "closed", 0, 0.0
                allowed, state, failures, opened = step(state, failures, opened, at, what, threshold, timeout)
                out.append((host, i, allowed, state, failures))
            yield pd.DataFrame(out, columns=["host", "id", "allowed", "state", "failures"])

    return dealt.mapInPandas(walk, OUT)


LIMITED = "host string, id long, starts_at double, ends_at double"


def limited(requests: DataFrame, concurrency: int, spacing: float) -> DataFrame:
    """When requests (host, id, at, seconds) of a host run, with ``concurrency`` at once and starts ``spacing`` seconds apart.

    First come, first served by (at, id): a request waits for a slot, then for the time since the
    host's last start. A task walks a host's rows as they stream by, sorted by Spark, and holds the
    ends of the slots alone.
    """
    dealt = requests.select(F.col("host").cast("string").alias("host"), F.col("id").cast("long").alias("id"), F.col("at").cast("double").alias("at"), F.col("seconds").cast("double").alias("seconds"))
    dealt = dealt.repartition("host").sortWithinPartitions("host", "at", "id")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, slots, last = object(), [], -math.inf
        for f in frames:
            out = []
            for host, i, at, seconds in zip(f["host"].tolist(), f["id"].tolist(), f["at"].tolist(), f["seconds"].tolist()):
                if host != current:
                    current, slots, last = host, [], -math.inf
                free = heapq.heappop(slots) if len(slots) >= concurrency else -math.inf
                last = max(at, free, last + spacing)
                heapq.heappush(slots, last + seconds)
                out.append((host, i, last, last + seconds))
            yield pd.DataFrame(out, columns=["host", "id", "starts_at", "ends_at"])

    return dealt.mapInPandas(walk, LIMITED)
