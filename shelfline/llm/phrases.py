"""Phrase mining: collocations by counts of all phrases of up to four words, counted out of core.

1. Texts become pieces, and equal pieces of a language one row with its multiplicity, so a
   passage that many documents share is taken apart once.
2. Tasks number the words of a window of pieces and count its phrases level by level, a phrase
   being (the phrase without its last word, that word); counts are weighted by multiplicities.
   Phrases leave a task as packed parts, one for each hash bucket and window.
3. Each bucket adds up its parts in duckdb, whose aggregation spills to the folders that
   Spark's own spills use. Phrases under the least count go: neither a part of a candidate nor
   a longer candidate is rarer than the candidate.
4. Candidates send lookup requests for their parts, shuffled to where the counts are, and
   counts return as the least-scoring cut. Longer candidates tell the phrases inside them
   their count likewise.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, begin_task, hand_back, materialise, table, text_of

#: Where texts are cut into pieces, and what parts words.
ENDS, GAPS = "[.,;:!?\\x0A-\\x0D]", "[\\x20\\x09]+"
LONGEST = 4
#: Words of one window that a task counts at a time, and what duckdb may hold of a bucket before it spills.
WINDOW, HELD = 1 << 20, "150MB"

#: Hash buckets for each shuffle partition: small enough that a bucket's sums seldom spill.
BUCKETS = 4

PARTS = "bucket int, langs array<string>, phrases array<long>, size long, packed binary"
#: Parts are phrases of the same words over and over; they are shuffled compressed.
CODEC, LEVEL = "zstd", 3
COUNTS = "lang string, phrase string, words int, n long"


def pieces(docs: DataFrame) -> DataFrame:
    """``lang, piece, n``: distinct pieces of each language, words joined by one space, and how often they occur."""
    text = F.regexp_replace(ascii_lower(text_of(F.col("text").cast("string"))), GAPS, " ")
    cut = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(text, ENDS)).alias("piece"))
    return cut.select("lang", F.btrim("piece").alias("piece")).filter("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("n"))


def _ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of many ranges of ``buf``, one after another."""
    size = end - start
    to = np.cumsum(size)
    return buf[np.repeat(start - (to - size), size) + np.arange(to[-1] if len(to) else 0)]


class _Window:
    """Consecutive pieces: their bytes, their words' places, and each word's piece."""

    def __init__(self, texts: pa.Array, langs: np.ndarray, times: np.ndarray):
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        self.buf = np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]]
        self.ended = np.append(self.buf, np.uint8(10))
        gaps = np.flatnonzero(self.buf[offsets[0] :] == 0x20) + offsets[0]
        self.start = np.sort(np.concatenate([offsets[:-1], gaps + 1]))
        self.end = np.sort(np.concatenate([gaps, offsets[1:]]))
        self.piece = np.searchsorted(offsets[1:], self.start, side="right")
        self.langs, self.times = langs, times

    def words(self, lo: int, hi: int) -> pa.Array:
        start, end = self.start[lo:hi], self.end[lo:hi]
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(_ranges(self.buf, start, end))])


def _grouped(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each key, the first place of each distinct key, and the sum of its times."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return number, order[at], np.add.reduceat(times[order], at) if len(at) else times[:0]


def _counted(w: _Window, lo: int, hi: int, buckets: int) -> Iterator[tuple[int, list[int], list[int], bytes]]:
    """A part for each bucket of the phrases that begin at words lo to hi; those may end up to LONGEST - 1 words later.

    A part is its languages, the phrases of each, and packed: counts, then phrases with a line end after each.
    """
    upto = min(len(w.start), hi + LONGEST - 1)
    coded = w.words(lo, upto).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x.as_py()) for x in coded.dictionary), np.uint64, len(coded.dictionary))
    piece, lang = w.piece[lo:upto], w.langs[w.piece[lo:upto]]
    at = np.arange(hi - lo)
    number, mixed = lang.astype(np.int64), np.zeros(upto - lo, np.uint64)  # of the phrase so far, by its first word
    told: list[tuple] = []
    for n in range(1, LONGEST + 1):
        last = at + n - 1
        fits = last < upto - lo
        fits[fits] = piece[last[fits]] == piece[at[fits]]
        at, last = at[fits], last[fits]
        if not len(at):
            break
        found, first, times = _grouped(number[at] << np.int64(32) | ids[last], w.times[piece[at]])
        mixed[at] = (mixed[at] ^ hashes[ids[last]]) * np.uint64(0x9E3779B97F4A7C15)
        mixed[at] ^= mixed[at] >> np.uint64(29)
        number[at] = found
        first = at[first]
        bucket = ((mixed[first] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        told.append((bucket, lang[first].astype(np.int32), times, w.start[lo + first], w.end[lo + first + n - 1]))
    if not told:
        return
    bucket, lang, times, start, end = map(np.concatenate, zip(*told))
    order = np.lexsort((lang, bucket))
    bucket, lang, times, start, end = bucket[order], lang[order], times[order], start[order], end[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(bucket))):
        kinds, sizes = np.unique(lang[a:b], return_counts=True)
        # A phrase ends where a space, a line end or nothing follows; one byte more is taken and made a line end.
        text = _ranges(w.ended, start[a:b], end[a:b] + 1)
        text[np.cumsum(end[a:b] + 1 - start[a:b]) - 1] = 10
        yield int(bucket[a]), kinds.tolist(), sizes.tolist(), times[a:b].astype("<i8").tobytes() + text.tobytes()


def _totals(w: _Window, names: list[str], buckets: int) -> Iterator[tuple[int, list[int], list[int], bytes]]:
    """The words of each language as a phrase of no words."""
    words = w.times[w.piece]
    for i, name in enumerate(names):
        n = int(words[w.langs[w.piece] == i].sum())
        yield xxhash.xxh3_64_intdigest(name.encode()) % buckets, [i], [1], np.int64(n).tobytes() + b"\n"


def _take_apart(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        held, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):  # pieces may be long
                some = batch.slice(k, 4096)
                held.append(some)
                size += some.column(1).nbytes
                if size >= WINDOW * 6:
                    yield from count(held)
                    held, size = [], 0
        if held:
            yield from count(held)
        hand_back()

    def count(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        coded = rows.column(0).combine_chunks().dictionary_encode()
        names = coded.dictionary.to_pylist()
        w = _Window(rows.column(1).combine_chunks(), coded.indices.to_numpy(), rows.column(2).to_numpy())
        some, size = list(_totals(w, names, buckets)), 0
        for lo in range(0, len(w.start), WINDOW):
            for part in _counted(w, lo, min(lo + WINDOW, len(w.start)), buckets):
                some.append(part)
                size += len(part[3])
                if size > 8 << 20:
                    yield packed(some, names)
                    some, size = [], 0
        yield packed(some, names)

    def packed(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
        codec = pa.Codec(CODEC, LEVEL)
        rows = [(bucket, [names[i] for i in kinds], sizes, len(body), codec.compress(body, asbytes=True)) for bucket, kinds, sizes, body in parts]
        kinds = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["bucket", "langs", "phrases", "size", "packed"])

    return run


def _unpacked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows (lang, phrase and a line end, n) of packed parts."""
    codec = pa.Codec(CODEC)
    for langs, sizes, size, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
        buf, m = codec.decompress(body.as_buffer(), size), sum(sizes)
        offsets = np.zeros(m + 1, np.int32)
        offsets[1:] = np.flatnonzero(np.frombuffer(buf, np.uint8, size - 8 * m, 8 * m) == 10) + 1
        lang = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(langs), dtype=np.int32), sizes)), langs).cast(pa.string())
        phrase = pa.StringArray.from_buffers(m, pa.py_buffer(offsets), buf.slice(8 * m))
        yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.frombuffer(buf, "<i8", m))], names=["lang", "phrase", "n"])


def spill_folder() -> str:
    """A new folder where Spark lets this task spill; it holds nothing that another task or a later one reads."""
    places = os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()
    return os.path.join(places.split(",")[0], f"duckdb-{uuid.uuid4().hex}")


def _add_up(least: int):
    """Sums of the parts of a task's buckets, in duckdb; a phrase has one space less than words, and a line end after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        kind = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
        parts = pa.RecordBatchReader.from_batches(kind, (part for batch in batches for part in _unpacked(batch)))
        spill = spill_folder()
        con = duckdb.connect(config={"threads": 1, "memory_limit": HELD, "temp_directory": spill, "preserve_insertion_order": False})
        try:
            con.register("parts", parts)
            out = con.sql(
                "SELECT lang, rtrim(phrase, chr(10)) AS phrase, CASE WHEN phrase = chr(10) THEN 0 ELSE length(phrase) - length(replace(phrase, ' ', '')) + 1 END::INTEGER AS words, n FROM "
                f"(SELECT lang, phrase, sum(n)::BIGINT AS n FROM parts GROUP BY lang, phrase) WHERE n >= {least} OR phrase = chr(10)"
            )
            yield from out.to_arrow_reader(1 << 16)
        finally:
            con.close()
            shutil.rmtree(spill, ignore_errors=True)
        hand_back()

    return run


def phrase_counts(docs: DataFrame, least: int = 30, buckets: int | None = None) -> DataFrame:
    """``lang, phrase, words, n``: phrases of 1 to LONGEST words with ``least`` occurrences, and each language's words in all under the empty phrase with 0 words."""
    n = buckets or BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = pieces(docs).mapInArrow(_take_apart(n), PARTS).repartitionById(n, F.col("bucket"))
    return parts.mapInArrow(_add_up(least), COUNTS)


def _exact(c: str):
    """Counts in decimals, since products may pass 64 bits."""
    return F.col(c).cast("decimal(20,0)")


def mine(docs: DataFrame, least: int = 30, top: int = 2000, buckets: int | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best ``top`` phrases of 2 to 4 words.

    Texts are cut into pieces at ``.,;:!?`` and line ends, A-Z lower-cased, pieces into words at
    spaces and tabs. ``a`` counts the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut (ties: the
    earliest), ``n`` all words of the language; score is floor(2000000 a / (l + r)). Candidates have
    ``least`` occurrences; those inside a longer candidate with 80 % of their count go. Order: score, a
    (both descending), phrase by bytes. A null lang is ``und``; null, empty and blank texts have no
    pieces; rows that repeat count each time; an empty table gives none. Columns besides text and lang
    are ignored.
    """
    counts = materialise(phrase_counts(docs, least, buckets), "phrases")
    totals = counts.filter("words = 0").groupBy(F.col("lang").alias("tongue")).agg(F.sum("n").alias("n"))
    known = counts.filter("words > 0").select(F.col("lang").alias("tongue"), F.col("phrase").alias("known"), F.col("n").alias("f"))
    found = counts.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))

    words = F.split("phrase", " ")
    cuts = found.select("lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    side = lambda first: F.when(first, F.slice("w", F.lit(1), F.col("k"))).otherwise(F.slice("w", F.col("k") + 1, F.size("w")))
    asked = cuts.select("lang", "phrase", "a", "k", "w", F.explode(F.array(F.lit(True), F.lit(False))).alias("left"))
    asked = asked.select("lang", "phrase", "a", "k", "left", F.array_join(side(F.col("left")), " ").alias("part"))
    told = asked.join(known.hint("merge"), (F.col("lang") == F.col("tongue")) & (F.col("part") == F.col("known")))
    both = told.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    both = both.withColumn("score", F.expr("(CAST(2000000 AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    scored = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = found.filter("words > 2").select("lang", "a", "words", words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inside = inside.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inside = inside.select(F.col("lang").alias("tongue"), F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("inner"), "a").groupBy("tongue", "inner").agg(F.max("a").alias("longer"))
    scored = scored.join(inside.hint("merge"), (F.col("lang") == F.col("tongue")) & (F.col("phrase") == F.col("inner")), "left")
    kept = scored.filter(F.col("longer").isNull() | (100 * _exact("longer") < 80 * _exact("a")))

    # Each task keeps its own first ``top`` of a language before any are shuffled.
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    best = best.join(totals.hint("merge"), F.col("lang") == F.col("tongue"))
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


ORACLE = """
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM cut),
grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS m FROM pieces) WHERE len(w) >= m)
), f AS (SELECT lang, m, g, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
cands AS (SELECT lang, m, g AS phrase, string_split(g, ' ') AS w, c AS a FROM f WHERE m > 1),
cuts AS (SELECT lang, phrase, w, a, unnest(range(1, m)) AS k FROM cands),
scores AS (
  SELECT cuts.lang, phrase, a, k, x.c AS l, y.c AS r, CAST(floor((CAST(2000000 AS HUGEINT) * a) // (CAST(x.c AS HUGEINT) + y.c)) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = cuts.lang AND y.g = array_to_string(w[k+1:], ' ')
), least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
gone AS (
  SELECT DISTINCT s.lang, s.phrase FROM cands s JOIN cands b ON b.lang = s.lang AND b.m > s.m AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * CAST(b.a AS HUGEINT) >= 80 * CAST(s.a AS HUGEINT)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least JOIN totals USING (lang) WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM gone)
QUALIFY rank <= 2000
"""
