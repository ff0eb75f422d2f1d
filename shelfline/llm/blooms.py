"""Bloom filters over 64-bit hashes, sized by the number of keys and made by the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin_task

#: Bits for each key, probes for each key, and the most bits of one filter (64 MB), which is what may be broadcast.
BITS_EACH, PROBES, MOST_BITS = 12, 3, 1 << 29


class Bloom:
    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(bits // 64, np.uint64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The bits of each key, as [probe, key]."""
        out = []
        for k in range(PROBES):
            h = (keys ^ np.uint64(7919 + k)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out.append((h >> np.uint64(20)) % np.uint64(self.bits))
        return np.stack(out)

    def add(self, keys: np.ndarray) -> None:
        at = self.places(keys).ravel()
        np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1).all(axis=0)


def bloom_of(hashes: DataFrame, most_bits: int = MOST_BITS) -> Bloom | None:
    """The filter of a column of 64-bit hashes, or None if one of ``most_bits`` would be too full to be of use.

    Callers go without a filter then: it only spares work, and exact joins follow it. Tasks set
    bits of their own, which meet by word, and the driver takes no more than the filter's size.
    """
    n = hashes.count()
    bits = 1 << max(16, int(np.ceil(np.log2(max(1, n * BITS_EACH)))))
    if bits > most_bits:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        mine = Bloom(bits)
        for b in batches:
            mine.add(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        at = np.flatnonzero(mine.words)
        for k in range(0, len(at), 1 << 16):
            some = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(mine.words[some].view(np.int64))], names=["word", "bits"])

    words = hashes.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = Bloom(bits)
    out.words[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out
