"""Best-fit packing certified by lower bounds.

Documents become token sequences, cut into pieces of CAPACITY only where longer. Pieces are
dealt at random to partitions, each packed by best-fit decreasing. Dual feasible functions
give a lower bound on each partition's bins; where the bins equal it, the partition is
optimal and its bins are closed, but for the emptiest. Partitions with a gap close their bins
that are all but full. The other documents make a common pool, which is dealt anew to fewer
partitions and packed again, until nothing is left over or ROUNDS are over.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .token_orc import vocabulary_path
from .tokens import encoder

CAPACITY, END_ID = 4096, 1
#: Pieces dealt to a partition, and rounds of exchange.
PIECES_EACH, ROUNDS = 4000, 4
#: Free tokens up to which a bin of a partition with a gap is closed, and the share (one in ROOM) up to which one of an
#: optimal partition is: what its emptiest bins hold may still fit beside documents of other partitions.
SLACK, ROOM = 8, 8

#: Chunks whose ids a worker keeps where packing is all that a job does (about 200 bytes each); results don't depend on it.
KEPT_CHUNKS = 600_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, chunks: int | None = None) -> DataFrame:
    """The pieces of every document's ids; null is the empty text, whose ids are the end id alone."""
    vocabulary = vocabulary or vocabulary_path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, False, chunks)
        for b in batches:
            out = []
            for i, raw in zip(b.column(0).to_pylist(), encode.documents(b.column(1).to_pylist())):
                raw += end
                view = memoryview(raw)
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = view[at : at + 4 * capacity]
                    out.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE_SCHEMA)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, as the largest of two families of dual feasible functions."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    weight, number = np.cumsum(counts * np.arange(capacity + 1)), np.cumsum(counts)
    t = np.arange(capacity // 2 + 1)
    # Lengths over capacity - t count as a whole bin, those under t as nothing, the others as they are.
    large = number[-1] - number[capacity - t]
    middle = weight[capacity - t] - np.where(t > 0, weight[t - 1], 0)
    best = int((large + -(-middle // capacity)).max())
    sizes = np.flatnonzero(counts)
    for k in range(1, 41):
        # (k + 1) x, rounded down to a whole number and divided by k, unless (k + 1) x is whole.
        up = (k + 1) * sizes
        value = np.where(up % capacity == 0, sizes * k, up // capacity * capacity)
        best = max(best, int(-(-int((value * counts[sizes]).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length, in descending order as given, and what each bin has left."""
    open_bins: dict[int, list[int]] = {}
    free, bins, offsets, left = 0, [], [], []
    for n in lengths:
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                free &= ~(1 << room)
        else:
            b, room = len(left), capacity
            left.append(capacity)
        bins.append(b)
        offsets.append(capacity - room)
        left[b] = room - n
        open_bins.setdefault(room - n, []).append(b)
        free |= 1 << (room - n)
    return bins, offsets, left


PACKED_SCHEMA = PIECE_SCHEMA + ", shard long, bin long, offset long, done boolean, bins long, bound long"


def _pack(last: bool, capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, offsets, left = best_fit_decreasing(lengths.tolist(), capacity)
        bound = lower_bound(lengths, capacity)
        closed = np.array(left) <= (capacity if last else capacity // ROOM if len(left) == bound else SLACK)
        n = len(lengths)
        for name, x in (("bin", bins), ("offset", offsets), ("done", closed[np.array(bins, np.int64)]), ("bins", [len(left)] * n), ("bound", [bound] * n)):
            table = table.append_column(name, pa.array(x))
        return table

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece (of the columns of PIECE_SCHEMA) a ``sequence_id`` and an ``offset``.

    Offsets are gapless from 0 and no sequence is longer than ``capacity``. Pieces of equal
    length are ordered by doc_id, piece and start; rows repeated in full are packed as rows of
    their own. An empty table gives none.
    """
    todo, done = parts, None
    for r in range(ROUNDS):
        n = todo.count()
        last = r == ROUNDS - 1 or n <= PIECES_EACH
        shards = max(1, -(-n // (PIECES_EACH * (1 << r))))
        dealt = todo.withColumn("shard", F.floor(F.rand(r) * shards).cast("long"))
        packed = materialise(dealt.groupBy("shard").applyInArrow(_pack(last, capacity), PACKED_SCHEMA), f"packed-{r}")
        # Rounds, shards and bins have ranges of their own in an id.
        numbered = packed.withColumn("sequence_id", F.lit(r << 58) + F.col("shard") * (1 << 20) + F.col("bin"))
        fixed = numbered.filter("done").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
        done = fixed if done is None else done.unionByName(fixed)
        if last:
            break
        todo = packed.filter("NOT done").select("doc_id", "piece", "start", "length", "ids_crc32")
        if todo.isEmpty():
            break
    return done


def pack_documents(docs: DataFrame, chunks: int | None = None) -> DataFrame:
    """Pack whole documents: one row per piece, ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece of the end id alone. Rows that repeat an id, or repeat in
    full, are documents of their own with pieces of their own; null ids stay. An empty table
    gives none. Columns besides doc_id and text are ignored.
    """
    return pack(materialise(pieces(docs, chunks=chunks), "pieces"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), KEPT_CHUNKS)
