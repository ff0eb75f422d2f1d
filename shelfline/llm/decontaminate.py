"""Benchmark decontamination by an FM-index over each shard of training text.

Benchmark items give the windows to look for: each 13 consecutive words of an item, or the
whole item if it has fewer. A task gathers whole documents into shards of word numbers, one
number for each distinct word of the shard. A suffix array over all of a shard's words gives
the Burrows-Wheeler transform, kept in a wavelet matrix. All windows are searched backward
at once, occurrences are located by walking to sampled suffix positions, and the spans they
cover are merged. A document longer than a shard goes on in the next one, which starts with
the last words of the one before, so no window is cut.

Benchmarks are held in blocks of about BLOCK_CHARS, so what is broadcast is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begin_task, hand_back, materialise

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Characters of benchmark text looked for at once: windows of a block take some 15 MB, 100 MB at most.
BLOCK_CHARS = 1_000_000
#: Words that a shard gathers before its index is built.
SHARD_WORDS = 1 << 19
#: Documents, of few words each, whose results are held at most.
SHARD_DOCS = 40_000
#: Every so many text positions a suffix keeps its position.
SAMPLE = 8
#: Bytes of a text that are split into words at once.
SLICE = 1 << 22

#: Word bytes are digits, letters and all beyond ASCII; A-Z become a-z and the rest spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """A text's words, in lists of those of some megabytes each."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
    at = 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            end = data.rfind(b" ", at, end) + 1 or (data.find(b" ", end) + 1 or len(data))
        yield data[at:end].split()
        at = end


class WaveletMatrix:
    """Ranks and symbols of a sequence in as many bit planes as its largest symbol has."""

    def __init__(self, seq: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.planes, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.planes.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo, hi = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.planes, self.zeros)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before it."""
        symbol, lo, hi = np.zeros_like(at), np.zeros_like(at), at
        for ones, zeros in zip(self.planes, self.zeros):
            one = (ones[hi + 1] - ones[hi]).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
            symbol = symbol * 2 + one
        return symbol, hi - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in their order, by prefix doubling over those whose order is still open.

    A suffix that is the beginning of another comes before it.
    """
    n = len(text)
    wide = int(text.max(initial=0)) + 2
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(2, np.int64)])
    key = (padded[:n] * wide + padded[1 : n + 1]) * wide + padded[2:] if wide < 1 << 21 else padded[:n]
    k = 3 if wide < 1 << 21 else 1
    order = np.argsort(key)
    key = key[order]
    at = np.arange(n)
    #: By suffix: where in the order those begin that agree with it in the first k symbols; 0 stands for the end of the text.
    rank = np.zeros(n + 1, np.int64)
    while True:
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        rank[order[at]] = np.maximum.accumulate(np.where(first, at, 0)) + 1
        last = np.append(first[1:], True)
        at = at[~(first & last)]
        if not len(at):
            return order
        some = order[at]
        key = rank[some] * (n + 2) + rank[np.minimum(some + k, n)]
        into = np.argsort(key)
        order[at], key = some[into], key[into]
        k *= 2


class FMIndex:
    """Counts and locates sequences of symbols (1 and above) in a text, whose end is marked by 0."""

    def __init__(self, text: np.ndarray):
        text = np.append(text, 0)
        sa = suffix_array(text)
        self.n = len(text)
        self.matrix = WaveletMatrix(text[sa - 1], int(text.max()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        #: Of rows whose suffix starts at a multiple of SAMPLE, the start; of the others -1.
        self.sampled = np.where(sa % SAMPLE == 0, sa, -1).astype(np.int32)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that start with each pattern (all of one length), as ranges."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k]
            known = (c > 0) & (c < len(self.first) - 1)
            c = np.where(known, c, 0)
            a = self.first[c] + self.matrix.rank(c, lo[alive])
            b = self.first[c] + self.matrix.rank(c, hi[alive])
            lo[alive], hi[alive] = a, np.where(known, b, a)
            alive = alive[lo[alive] < hi[alive]]
        gone = np.ones(len(patterns), bool)
        gone[alive] = False
        hi[gone] = lo[gone]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these rows start."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        left = np.flatnonzero(self.sampled[rows] < 0)
        while len(left):
            c, r = self.matrix.symbol_and_rank(rows[left])
            rows[left] = self.first[c] + r
            steps[left] += 1
            left = left[self.sampled[rows[left]] < 0]
        return self.sampled[rows] + steps


class Windows:
    """What is looked for: words, windows of word numbers by length, and the items of each window, all in flat arrays."""

    def __init__(self, items: list[tuple[str, str | None]]):
        numbers: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(self.items)}
        found: dict[int, list] = {}
        for item, text in items:
            ws = np.array([numbers.setdefault(w, len(numbers)) for part in words_of(text) for w in part], np.int32)
            if len(ws):
                n = min(WINDOW, len(ws))
                rows = np.lib.stride_tricks.sliding_window_view(ws, n)
                found.setdefault(n, []).append((rows, np.full(len(rows), place[item], np.int32)))
        self.words = list(numbers)
        #: By length: distinct windows, and in order of the window the items that have it, from ``cut[w]`` to ``cut[w + 1]``.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, parts in sorted(found.items()):
            rows, of = np.concatenate([r for r, _ in parts]), np.concatenate([o for _, o in parts])
            whole = np.ascontiguousarray(rows).view(np.dtype((np.void, 4 * n))).ravel()
            _, at, window = np.unique(whole, return_index=True, return_inverse=True)
            pairs = np.unique(window.astype(np.int64) * len(self.items) + of)
            cut = np.searchsorted(pairs // len(self.items), np.arange(len(at) + 1))
            self.by_length[n] = (rows[at], cut, (pairs % len(self.items)).astype(np.int32))
        self.longest = max(self.by_length, default=1)


class _Numbers(dict):
    """Numbers of a shard's words, from 2 on; 1 stands between documents."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 2
        return n


class Scan:
    """Goes over a task's documents shard by shard; ``add`` and ``end`` give the results of those whose last shard was searched."""

    def __init__(self, windows: Windows):
        self.windows, self.docs, self.hits = windows, [], []
        self._start_shard()

    def _start_shard(self) -> None:
        self.numbers, self.parts, self.size = _Numbers(), [], 0
        #: Of each document part in the shard: its document, where it starts, and the word of the document that it starts with.
        self.places: list[tuple[int, int, int]] = []

    def _append(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def add(self, doc_id, text: str | None) -> Iterator[pa.RecordBatch]:
        row, n = len(self.docs), 0
        self.docs.append([doc_id, 0])
        self.places.append((row, self.size, 0))
        for words in words_of(text):
            while words:
                room = max(1, SHARD_WORDS - self.size)
                now, words = words[:room], words[room:]
                self._append(now)
                n += len(now)
                if self.size >= SHARD_WORDS:
                    # The next shard starts with what a window over the cut would need.
                    kept = (now if len(now) >= self.windows.longest else self._last(now))[1 - self.windows.longest :] if self.windows.longest > 1 else []
                    self._search()
                    self._start_shard()
                    self.places.append((row, 0, n - len(kept)))
                    self._append(kept)
        self.docs[row][1] = n
        self.parts.append(np.ones(1, np.int32))
        self.size += 1
        if self.size >= SHARD_WORDS - SHARD_WORDS // 16 or len(self.docs) >= SHARD_DOCS:
            yield self.end()

    def _last(self, now: list[bytes]) -> list[bytes]:
        """The last words of the part that a shard ends with, spelled again from their numbers."""
        mine = np.concatenate(self.parts)[self.places[-1][1] :][-self.windows.longest :]
        spelled = list(self.numbers)
        return [spelled[k - 2] for k in mine.tolist()]

    def _search(self) -> None:
        """Find all windows in the shard and note (document, first word, end, length, window)."""
        longest = self.windows.by_length
        if not longest or not self.numbers:
            return
        number = np.array([self.numbers.get(w, 0) for w in self.windows.words], np.int32)
        index = None
        starts, rows, bases = (np.array(x, np.int64) for x in zip(*((s, r, b) for r, s, b in self.places)))
        for n, (patterns, _, _) in longest.items():
            able = np.flatnonzero((number[patterns] > 0).all(axis=1))
            if not len(able):
                continue
            if index is None:
                index = FMIndex(np.concatenate(self.parts))
            lo, hi = index.search(number[patterns[able]])
            some = np.flatnonzero(hi > lo)
            times = (hi - lo)[some]
            found = index.locate(np.repeat(lo[some], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
            part = np.searchsorted(starts, found, "right") - 1
            first = found - starts[part] + bases[part]
            self.hits.append(np.stack([rows[part], first, first + n, np.full(len(first), n), np.repeat(able[some], times)]))

    def end(self) -> pa.RecordBatch:
        """Results of all documents added since the last time."""
        self._search()
        n_docs = len(self.docs)
        hits = np.concatenate(self.hits, axis=1) if self.hits else np.zeros((5, 0), np.int64)
        row, a, b = hits[:3]
        order = np.lexsort((a, row))
        row, a, b = row[order], a[order], b[order]
        # Spans of one document that meet are one; with documents laid far apart a running maximum of ends tells where one begins.
        far = int(b.max(initial=0)) + 2
        reach = np.maximum.accumulate(b + row * far)
        fresh = np.ones(len(row), bool)
        fresh[1:] = (a + row * far)[1:] > reach[:-1]
        at = np.flatnonzero(fresh)
        stop = (reach - row * far)[np.append(at[1:], len(row)) - 1] if len(at) else b[:0]
        cuts = np.searchsorted(row[at], np.arange(n_docs + 1)).astype(np.int32)
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        spans = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(a[at]), pa.array(stop)], fields=list(kind)))
        n_hit = np.bincount(row[at], weights=stop - a[at], minlength=n_docs).astype(np.int64)
        found: list[set] = [set() for _ in range(n_docs)]
        known = np.unique(hits[[0, 3, 4]], axis=1)
        for r, n, w in known.T.tolist():
            _, cut, of = self.windows.by_length[n]
            found[r].update(of[cut[w] : cut[w + 1]].tolist())
        names = self.windows.items
        out = pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in self.docs], pa.int64()), pa.array([n for _, n in self.docs], pa.int64()), pa.array(n_hit), spans, pa.array([[names[k] for k in sorted(x)] for x in found], pa.list_(pa.string()))],
            names=["doc_id", "n_words", "n_hit", "spans", "items"],
        )
        self.docs, self.hits = [], []
        self._start_shard()
        return out


SCHEMA = "doc_id long, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>"


def _scan(docs: DataFrame, items: list) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Windows(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        scan = Scan(shared.value)
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                yield from scan.add(i, text.as_py())
        if scan.docs:
            yield scan.end()
        del scan
        hand_back()

    return docs.mapInArrow(run, SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, spans, items``.

    ``spans`` are the hit word positions as merged, sorted ranges [start, end); ``items`` the
    ids of items with a window in the document, as sorted strings. Null and empty texts have no
    words. Items without words are never found; items with equal windows are all named; a null
    item_id counts as ``null``. Rows repeat as they come; an empty benchmark hits nothing.
    Columns besides doc_id and text, item_id and text, are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    chars = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars <= BLOCK_CHARS:
        return _scan(plain, [tuple(r) for r in wanted.collect()])
    # A benchmark too large for one broadcast: each block against all rows, then spans merged by row.
    rows = materialise(plain.withColumn("row", F.monotonically_increasing_id()), "documents")
    blocks = -(-2 * chars // BLOCK_CHARS)  # about half full each, as hashing deals items unevenly
    wanted = materialise(wanted.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "benchmark")
    found = None
    for k in range(blocks):
        items = [tuple(r) for r in wanted.filter(F.col("block") == k).select("item_id", "text").collect()]
        part = _scan(rows.select(F.col("row").alias("doc_id"), "text"), items)
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.aggregate(
        "all", F.expr("CAST(array() AS array<struct<start:long,end:long>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]),
                              F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    merged = merged.withColumn("spans", joined).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))
    return merged.withColumnRenamed("doc_id", "row").join(rows.select("row", "doc_id"), "row").select("doc_id", "n_words", "n_hit", "spans", "items")


def contaminated():
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that aren't contaminated, with all their columns."""
    key = F.xxhash64(docs["doc_id"], docs["text"])  # rows repeated under one id with other texts are judged apart
    found = decontaminate(docs.select(key.alias("doc_id"), "text"), benchmark)
    bad = materialise(found.filter(contaminated()).select(F.col("doc_id").alias("bad_key")).distinct(), "contaminated")
    return docs.join(bad, key == F.col("bad_key"), "left_anti")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


ORACLE = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM wins), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM words, lens WHERE len(w) >= n)
), hits AS (SELECT g.doc_id, g.i, g.n, w.item_id FROM grams g JOIN wins w USING (n, win)),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""
