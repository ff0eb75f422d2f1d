"""Language identification by bit-sliced Bloom filters of letter n-grams.

Learning: every training text's letter trigrams are counted by language. A trigram enters a
language's filter if its share of that language's trigrams is at least MIN_SHARE and at
least RATIO of its largest share in any language. The filters of all languages lie bit by
bit side by side: slot j holds a bitmask whose bit l is slot j of language l's filter, so
one AND over a trigram's slots returns all languages that contain it.

Prediction: popcounts by language over all trigrams of the text, corrected for each
filter's measured rate of false positives; the largest decides.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begin_task, bucket, materialise

#: Folds of crc32(doc_id as text); the held-out one is never learned from.
FOLDS, HELD_OUT = 4, 2
#: A trigram's least share of its language's trigrams. No language has more than 1 / MIN_SHARE of these, which bounds the filters.
MIN_SHARE = 1e-5
#: And its least share against that in the language where it is most frequent.
RATIO = 0.4
#: Hash functions, and slots for each trigram of the language that has most.
HASHES, SLOTS_EACH = 4, 16
#: Characters handled at once; a longer text goes in slices cut at spaces (a run of more characters without any is cut as if one stood there).
SLICE = 1 << 19
UND = "und"


@functools.cache
def _letters() -> np.ndarray:
    """By code point: 0 for what isn't a letter, else the lower-case letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _slices(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lower-case letters or 0, the text's number of each) of many short or parts of long texts."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        zero = np.zeros(1, np.uint32)
        codes = np.concatenate([zero, *(x for _, part in held for x in (part, zero))])
        owner = np.repeat([held[0][0], *(i for i, _ in held)], [1, *(len(part) + 1 for _, part in held)])
        return codes, owner

    for i, text in enumerate(texts):
        if not text:
            continue
        at = 0
        while at < len(text):
            end = at + SLICE
            if end < len(text):
                end = text.rfind(" ", at, end) + 1 or end
            part = _letters()[np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), "<u4")]
            held.append((i, part))
            at, size = end, size + len(part)
            if size >= SLICE:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _trigrams(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of trigrams and their texts. What isn't a letter is one boundary; a trigram has a letter in the middle."""
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    c, o = codes[keep].astype(np.int64), owner[keep]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mid = c[1:-1] != 0
    grams = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    return grams[mid], o[1:-1][mid]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language of a task's texts, summed in the task when many have gathered."""
    begin_task()
    sums: dict[str, list] = {}

    def packed(parts: list) -> list:
        grams, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        u, inv = np.unique(grams, return_inverse=True)
        return [(u, np.bincount(inv, weights=n, minlength=len(u)).astype(np.int64))]

    for b in batches:
        texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lang in set(langs):
            for codes, owner in _slices([t for t, x in zip(texts, langs) if x == lang]):
                parts = sums.setdefault(lang, [])
                parts.append(np.unique(_trigrams(codes, owner)[0], return_counts=True))
                if len(parts) >= 16:
                    sums[lang] = packed(parts)
    for lang, parts in sums.items():
        (grams, n), = packed(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])


def _slots(grams: np.ndarray, m: int) -> Iterator[np.ndarray]:
    """The slots of each trigram, from two halves of one mixed hash."""
    h = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield ((a + np.uint64(k) * b) & np.uint64(m - 1)).astype(np.int64)


class Filters:
    """Bit-sliced Bloom filters: ``words[w][slot]`` has the bits of languages 64 w to 64 w + 63."""

    def __init__(self, langs: list[str], grams: dict[str, np.ndarray], common: str | None):
        self.langs, self.common = langs, common
        most = max([1, *(len(g) for g in grams.values())])
        self.m = 1 << int(np.ceil(np.log2(most * SLOTS_EACH)))
        self.words = np.zeros(((len(langs) + 63) // 64 or 1, self.m), np.uint64)
        if len(langs) <= 8:
            self.words = self.words.astype(np.uint8)
        for l, lang in enumerate(langs):
            for s in _slots(grams.get(lang, np.zeros(0, np.int64)), self.m):
                self.words[l // 64][s] |= self.words.dtype.type(1 << (l % 64))
        fill = [float(((self.words[l // 64] >> self.words.dtype.type(l % 64)) & self.words.dtype.type(1)).mean()) for l in range(len(langs))]
        #: Rates of false positives, from how full each filter came out.
        self.false = np.array([f**HASHES for f in fill])

    def languages(self, grams: np.ndarray) -> np.ndarray:
        """For each word of the mask, the mask of languages that contain each trigram."""
        found = None
        for s in _slots(grams, self.m):
            found = self.words[:, s] if found is None else found & self.words[:, s]
        return found

    def counts(self, grams: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """By text: trigrams, and those in each language's filter, not yet corrected."""
        total, mask = np.bincount(owner, minlength=n), self.languages(grams)
        out = np.zeros((n, len(self.langs)))
        for l in range(len(self.langs)):
            w = mask[l // 64]
            out[:, l] = np.bincount(owner, weights=((w >> w.dtype.type(l % 64)) & w.dtype.type(1)), minlength=n)
        return total, out

    def predict(self, texts: list) -> tuple[list, list, list]:
        """Languages, scores and coverages of texts."""
        n, total, hits = len(texts), np.zeros(len(texts)), np.zeros((len(texts), len(self.langs)))
        for codes, owner in _slices(texts):
            grams, of = _trigrams(codes, owner)
            lo = int(owner.min())
            t, h = self.counts(grams, of - lo, int(owner.max()) - lo + 1)
            total[lo : lo + len(t)] += t
            hits[lo : lo + len(t)] += h
        if not self.langs:
            return [UND] * n, [0.0] * n, [0.0] * n
        right = np.clip((hits - total[:, None] * self.false) / (1 - np.minimum(self.false, 0.999)), 0, total[:, None])
        order = np.sort(right, axis=1)
        best, second = order[:, -1], order[:, -2] if len(self.langs) > 1 else np.zeros(n)
        pick = np.where(best > 0, right.argmax(axis=1), self.langs.index(self.common))
        langs = [UND if t == 0 else self.langs[p] for t, p in zip(total, pick)]
        scores = np.where(best > 0, 1 - second / np.maximum(best, 1e-12), 0.0)
        return langs, scores.tolist(), (best / np.maximum(total, 1)).tolist()


def learn(labelled: DataFrame) -> Filters:
    """Filters from all rows of (text, lang) with neither null."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).dropna()
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "trigrams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Filters([], {}, None)
    share = counts.join(F.broadcast(counts.sparkSession.createDataFrame(list(totals.items()), "lang string, total long")), "lang").withColumn("share", F.col("n") / F.col("total"))
    share = share.filter(F.col("share") >= MIN_SHARE)
    top = share.groupBy("gram").agg(F.max("share").alias("top"))
    chosen = share.join(top, "gram").filter(F.col("share") >= RATIO * F.col("top")).select("lang", "gram").toPandas()
    grams = {lang: g["gram"].to_numpy(np.int64) for lang, g in chosen.groupby("lang")}
    return Filters(sorted(totals), grams, max(sorted(totals), key=totals.get))


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score, coverage``.

    ``score`` is 1 - second / best of the corrected counts, ``coverage`` the corrected share of
    the text's trigrams that the language's filter holds. A null or empty text and one without a
    letter give ``und`` and zeros. A text of letters that no filter holds gives the most frequent
    language learned, with zeros; ties give the first in alphabetical order. Rows repeat as
    they come, nulls in doc_id stay, and columns besides doc_id and text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for b in batches:
            langs, scores, cover = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(cover, pa.float64())], names=["doc_id", "lang_pred", "score", "coverage"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, coverage double")


def held_out():
    return F.coalesce(bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))


#: A document whose best language holds less of its trigrams than this is in none of the languages learned.
LEAST_COVERAGE = 0.25


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose text is in a language learned, with all their columns; those without a letter or in no such language go.

    Null and empty texts go. Languages are learned from rows with neither text nor lang null
    outside the held-out fold; if there are none, no language is known and every row goes.
    Rows repeat as they come, null ids stay, an empty table gives none.
    """
    filters = learn(docs.filter(~held_out()).select("text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        begin_task()
        langs, _, cover = shared.value.predict(texts.tolist())
        return pd.Series([lang != UND and c >= LEAST_COVERAGE for lang, c in zip(langs, cover)])

    return docs.filter(known(F.col("text").cast("string")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, learn(docs.filter(~held_out()).select("text", "lang")))
    return found.withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "coverage")
