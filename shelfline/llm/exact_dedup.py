"""Exact deduplication through a log-structured merge index of text digests.

Inserting rows fills memtables in the tasks: digest -> smallest id and count. A full memtable
is flushed as a run sorted by digest. A level that has FAN_OUT runs is compacted: its runs
are merged in the order of their digests, of equal digests the smallest id stays and counts
add up, and the merged run joins the next level. Each run has a Bloom filter, which lookups
ask before they read the run, and one over its repeated digests, which tells the rows that
can have a copy. A row that passes it is a hit if the index says so, and its bytes are
compared with those of the row that stays; digests whose texts differ are grouped again by
the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blooms import Bloom, bloom_of
from .common import SPACES, begin_task, materialise, new_folder, text_of

#: Rows that a task's memtable holds before it flushes a sorted run (about 40 MB).
MEMTABLE_ROWS = 500_000
#: Runs of one level that are merged into one of the next.
FAN_OUT = 4

#: A digest is held as two 64-bit hashes of it; bytes are compared in the end, so a clash of both costs work, not results.
RUN_SCHEMA = "a long, b long, keep_id long, n long"
_LAST = np.iinfo(np.int64).max


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_of(text), SPACES, " ")


def sha256_of(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def digest_key(digest: Column) -> tuple[Column, Column]:
    return F.xxhash64(digest), F.xxhash64(digest, F.lit(1))


def _folded(a: np.ndarray, b: np.ndarray, ids: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Rows sorted by digest, those of one digest as one: the smallest id and the sum of counts."""
    order = np.lexsort((ids, b, a))
    a, b, ids, n = a[order], b[order], ids[order], n[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(first)
    return [a[at], b[at], ids[at], np.add.reduceat(n, at) if len(at) else n]


def _batch(rows: list[np.ndarray]) -> pa.RecordBatch:
    a, b, ids, n = rows
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(ids, mask=ids == _LAST), pa.array(n)], names=["a", "b", "keep_id", "n"])


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The columns of a run as arrays; a null id is larger than all others."""
    ids = batch.column(2).fill_null(_LAST).to_numpy(zero_copy_only=False)
    return [batch.column(0).to_numpy(), batch.column(1).to_numpy(), ids, batch.column(3).to_numpy()]


def _memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin_task()
    held, size = [], 0
    for batch in batches:
        held.append(_columns(batch))
        size += batch.num_rows
        if size >= MEMTABLE_ROWS:
            yield _batch(_folded(*map(np.concatenate, zip(*held))))
            held, size = [], 0
    if held:
        yield _batch(_folded(*map(np.concatenate, zip(*held))))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges runs that arrive as one sorted stream; a digest may go on in the next batch."""
    begin_task()
    over = None
    for batch in batches:
        rows = _columns(batch)
        if over is not None:
            rows = [np.concatenate(x) for x in zip(over, rows)]
        if not len(rows[0]):
            continue
        rows = _folded(*rows)
        over = [x[-1:] for x in rows]
        if len(rows[0]) > 1:
            yield _batch([x[:-1] for x in rows])
    if over is not None:
        yield _batch(over)


@dataclass
class Run:
    """A sorted run: its folder and the filters over its digests (None where they would be too large to hold)."""

    path: str
    keys: Bloom | None


class DigestIndex:
    """A digest -> (smallest id, count) index in a shared folder, in levels of sorted runs."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.levels, self.made = spark, path or new_folder(spark, "digests"), [[]], 0

    def _write(self, rows: DataFrame, level: int) -> None:
        self.made += 1
        path = f"{self.path}/level-{level}-{self.made}"
        rows.write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(Run(path, None))

    def _read(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(*(r.path for r in runs))

    def insert(self, rows: DataFrame) -> None:
        """Add rows (id, digest): flushed memtables become a run of level 0; levels that are full then are merged."""
        ids, digest = (F.col(c) for c in rows.columns[:2])
        a, b = digest_key(digest)
        plain = rows.select(a.alias("a"), b.alias("b"), ids.cast("long").alias("keep_id"), F.lit(1).cast("long").alias("n"))
        self._write(plain.mapInArrow(_memtables, RUN_SCHEMA), 0)
        level = 0
        while len(self.levels[level]) >= FAN_OUT:
            self._merge([level], level + 1)
            level += 1

    def _merge(self, levels: list[int], to: int) -> None:
        runs = [r for k in levels for r in self.levels[k]]
        # Runs are sorted and each digest is in a run of a task once, so the sort merges and no digest is a large group.
        dealt = self._read(runs).repartition("a", "b").sortWithinPartitions("a", "b", "keep_id")
        for k in levels:
            self.levels[k] = []
        self._write(dealt.mapInArrow(_merged, RUN_SCHEMA), to)

    def compact(self) -> None:
        """Merge all levels into one run of the last."""
        self._merge(list(range(len(self.levels))), max(1, len(self.levels) - 1))

    @property
    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def entries(self) -> DataFrame:
        """All runs' entries, those of one digest not yet merged unless compacted."""
        return self._read(self.runs)

    def repeated(self) -> DataFrame:
        """``a, b, keep_id, n`` of digests that occur more than once; of a compacted index."""
        if len(self.runs) != 1:
            self.compact()
        return self.entries().filter("n > 1")

    def lookup(self, digests: list[str]) -> DataFrame:
        """``digest, keep_id, n`` of some digests: runs whose filter holds none of them are not read."""
        wanted = self.spark.createDataFrame([(d,) for d in digests], "digest string").select("digest", *(k.alias(c) for k, c in zip(digest_key(F.col("digest")), "xy")))
        keys = np.array([r["x"] for r in wanted.select("x").collect()], np.int64).view(np.uint64)
        asked = []
        for run in self.runs:
            if run.keys is None:
                run.keys = bloom_of(self._read([run]).select("a"))
            if run.keys is None or run.keys.may_hold(keys).any():
                asked.append(run)
        self.asked = [r.path for r in asked]
        found = self._read(asked) if asked else self.spark.createDataFrame([], RUN_SCHEMA)
        found = found.join(F.broadcast(wanted), (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")))
        return found.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def may_hold(bloom: Bloom | None, spark: SparkSession) -> Callable[[Column], Column]:
    """A filter as a function of a column of hashes; without one, everything may be held."""
    if bloom is None:
        return lambda h: F.lit(True)
    shared = spark.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def asked(h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.may_hold(h.to_numpy(np.int64).view(np.uint64)))

    return asked


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_of, whole_rows: bool = False) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, row``; ``row`` is the input row as a struct if ``whole_rows``, else null where the row has no copy."""
    spark = docs.sparkSession
    norm = normalised(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(norm).alias("digest"), sha256_of(norm).alias("sha"), F.struct(*(docs[c] for c in (docs.columns if whole_rows else [text_col]))).alias("row"))

    index = DigestIndex(spark)
    index.insert(base.select("doc_id", "digest"))
    index.compact()
    repeated = index.repeated()
    # One filter for both questions: may the digest repeat, and may this be the row that stays?
    pair = lambda i: F.xxhash64("a", "b", F.coalesce(i, F.lit(-1)))
    held = may_hold(bloom_of(repeated.select(F.explode(F.array(F.col("a"), pair(F.col("keep_id")))).alias("h"))), spark)

    # Rows that cannot be hits shed their text here; only hits' texts are shuffled.
    probed = base.withColumns(dict(zip("ab", digest_key(F.col("digest")))))
    probed = probed.withColumns({"hit": held(F.col("a")), "first": held(pair(F.col("doc_id")))})
    row = F.col("row") if whole_rows else F.when(F.col("hit"), F.col("row"))
    probed = materialise(probed.select("doc_id", "a", "b", "sha", "hit", "first", row.alias("row"), F.monotonically_increasing_id().alias("rid")), "probed")
    alone = probed.filter("NOT hit").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), "row")
    hits = probed.filter("hit").withColumn("norm", normalised(F.col("row")[text_col]))

    # The row that stays, with its bytes: ids are all but unique, so this join has no hot key but rows repeated in full, pre-aggregated.
    known = repeated.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("keep_id"), F.col("n").alias("size"))
    firsts = hits.filter("first").join(known.hint("merge"), (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    firsts = materialise(firsts.groupBy("x", "y", "keep_id", "size").agg(F.min(F.struct("rid", "norm")).alias("first")), "firsts")
    firsts = firsts.select("x", "y", "keep_id", "size", F.col("first.rid").alias("keep_rid"), F.col("first.norm").alias("keep_norm"))
    # A group of copies of any size: a plain equi-join whose large side the adaptive skew join splits.
    checked = hits.join(firsts.hint("merge"), (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left")
    single = F.col("x").isNull()
    checked = checked.select(
        "doc_id", "rid", "a", "b", "sha", "row",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        (single | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        (single | F.col("norm").eqNullSafe(F.col("keep_norm"))).alias("verified"),
    )
    checked = materialise(checked, "checked")
    broken = checked.filter("NOT verified").select("a", "b").distinct()
    done = checked
    if not broken.isEmpty():  # different texts under one digest: those groups are made again from the texts
        broken = materialise(broken, "broken")
        again = hits.join(broken, ["a", "b"], "left_semi")
        groups = again.groupBy("a", "b", "norm").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("m"), F.count("*").alias("n"))
        again = again.join(groups.withColumnsRenamed({"a": "x", "b": "y", "norm": "t"}), (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")) & (F.col("norm") == F.col("t")))
        again = again.select("doc_id", "rid", "a", "b", "sha", "row", F.col("m.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("m.rid")).alias("kept"), F.lit(True).alias("verified"))
        done = checked.join(broken, ["a", "b"], "left_anti").select(*again.columns).unionByName(again)
    return alone.unionByName(done.select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"), "row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_of) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of white space became one space; null
    counts as the empty text, and empty texts are equal to each other. The row with the
    smallest id stays. Rows repeated with the same id and text: one of them stays. A null
    id is larger than any other; a group with null ids only keeps one row and its keep_id
    is null. An empty table gives an empty result. Columns besides id and text are ignored.
    """
    return decide(docs, id_col, text_col, digest).drop("row")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, decided as by :func:`exact_dedup`; of rows repeated with id and text, one."""
    return decide(docs, whole_rows=True).filter("kept").select("row.*")


ORACLE = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
