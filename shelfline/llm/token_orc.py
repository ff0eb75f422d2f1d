"""Token ids in ORC: integer run-length encoded stripes with row indexes and Bloom filters.

Documents are range-partitioned and sorted by id, so files and stripes follow ascending ids
and a document's place in the whole stream is its place in its file plus the ids of all
files before it, which the files' own count columns give. ORC encodes the id lists by
integer run-length encoding; its row index and the Bloom filter on doc_id let a reader skip
stripes, and Spark reads stripes in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_folder
from .tokens import encoder

END_ID = 2
#: Chunks whose ids a worker keeps while files are written (about 200 bytes each).
KEPT_CHUNKS = 800_000
STORED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("start_in_part", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
])
#: ORC settings: rows of a row-index group, bytes of a stripe, false positives of the Bloom filters.
ORC = {"orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text, null as empty, add the end id, and write ORC files in ascending doc_id order.

    Null ids come first; rows of one id follow each other in the order of their texts' hashes,
    so that the rows of one id can lie in several files. Repeated rows stay.
    Columns besides doc_id and text are ignored. An empty table writes an empty table.
    """
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(vocabulary, True, KEPT_CHUNKS), TaskContext.get().partitionId(), 0
        for b in batches:
            ids, counts, held, size = b.column(0), [], [], 0
            rows, first = [], 0

            def flush(upto: int) -> pa.RecordBatch:
                n = np.array(counts, np.int64)
                starts = at - int(n.sum()) + np.cumsum(n) - n
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(np.frombuffer(b"".join(held), "<i4")))
                return pa.RecordBatch.from_arrays([ids.slice(first, upto - first), pa.array([part] * len(n), pa.int32()), pa.array(starts), pa.array(n), lists], names=[f.name for f in STORED])

            for i, raw in enumerate(encode.documents(b.column(1).to_pylist())):
                held.append(raw + end)
                counts.append(len(raw) // 4 + 1)
                at += counts[-1]
                size += counts[-1]
                if size >= 1 << 20:
                    yield flush(i + 1)
                    first, counts, held, size = i + 1, [], [], 0
            if counts:
                yield flush(b.num_rows)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The order goes on past the id, so that very many rows of one id are split as well.
    dealt = plain.withColumn("_h", F.xxhash64("text")).withColumn("_salt", F.rand(7))
    dealt = dealt.repartitionByRange("doc_id", "_h", "_salt").sortWithinPartitions("doc_id", "_h", "_salt").select("doc_id", "text")
    dealt.mapInArrow(run, STORED).write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of what was written; a filter on doc_id skips stripes by their indexes."""
    rows = spark.read.schema(STORED).orc(path)
    # Two numbers for each written file (a million files are some 100 MB on the driver), and no ids are read for it.
    sums = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, before = [], 0
    for part in sorted(sums):
        base.append((part, before))
        before += sums[part]
    bases = spark.createDataFrame(base, "part int, before long")
    # One row for each file is small enough to broadcast, so ids aren't shuffled for the sum.
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """The unsigned CRC-32 of each list of ids as little-endian 32-bit integers, in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            off = lists.offsets.to_numpy().tolist()
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return with_crc32(read_tokens(spark, path))
