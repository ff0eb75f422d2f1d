"""Similarity join on word shingles: rare-first prefix filtering, exact, without pairs inside groups.

1. Documents with equal sets are one class, shown by its smallest id.
2. A pigeonhole filter finds the classes that can link at all. Of sets that link, most of the
   fifth with the smallest hashes is common, so a class of which too few of these occur in any
   other class's fifth has no partner; ``least_shared`` is what no linking set falls below.
3. Over the classes left, shingles are counted in COUNTERS hashed counters; a shingle's place in
   the one order of all shingles is (its counter, its hash), so rare ones come first. A set need
   only be looked up by its first n - ceil(t n) + 1 shingles in that order.
4. Classes meet on prefix shingles. Length, positional and suffix filters reject most pairs,
   and each pair left is verified once on the whole sets.
5. What is wanted is who reaches whom. So each bucket's documents are first compared to its
   leader, the one whose shared shingle comes earliest, then those still apart to a leader of
   their own; components are joined after each round. Only pairs that share a bucket and are
   in different components then are left, and all of these are verified: no link between
   components is lost, and none within one is looked for.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blooms import bloom_of
from .common import begin_task, drop_folders, hand_back, materialise, scratch
from .components import components
from .exact_dedup import may_hold

#: Hashed counters of the shingle order (1 MB); ranges of the hash whose counts the suffix filter compares, 16 bits each in one long.
COUNTERS, RANGES = 1 << 18, 4
#: The share of a set, by smallest hashes, that the pigeonhole filter looks at.
LOW = 0.2
#: Pairs of one leader that are verified by one call.
BLOCK = 200


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, ascending; a text of fewer words is one shingle."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + _mixed(w[i : len(w) - n + 1 + i])
    return np.unique(_mixed(h))


def _keys(s: np.ndarray) -> tuple[int, int, int]:
    """What tells a set from others: two independent sums over its shingles, and its size."""
    a, b = _mixed(s).sum(dtype=np.uint64), _mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a) - (1 << 63), int(b) - (1 << 63), len(s)


def _count(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        total, held, size = np.zeros(COUNTERS, np.int64), [], 0
        for b in batches:
            for t in b.column(0):
                held.append(shingles(t.as_py(), k) & np.uint64(COUNTERS - 1))
                size += len(held[-1])
                if size > COUNTERS:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=COUNTERS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["counter", "n"])

    return run


def _low(n):
    """How many of n shingles the pigeonhole filter looks at."""
    return np.ceil(LOW * n - 1e-9).astype(np.int64)


@functools.cache
def least_shared(n: int, num: int, den: int) -> int:
    """The least number of a set's low shingles that are low in any set it links with, whatever that set's size.

    With x the set whose low shingles end first, all common ones up to there are low in both,
    and x has at most its size less the overlap that aren't common.
    """
    m = np.arange(-(-num * n // den), den * n // num + 1, dtype=np.int64)
    overlap = -(-num * (n + m) // (num + den))
    own = int(_low(np.array([n]))[0])
    return max(1, int(np.minimum(own - n + overlap, _low(m) - m + overlap).min()))


SKETCH = "doc_id long, n long, key_a long, key_b long, need long, low array<long>"


def _sketch(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingles(t.as_py(), k)
                n = len(s)
                if not n:
                    out.append((i, 0, None, None, None, None))
                    continue
                a, c, _ = _keys(s)
                out.append((i, n, a, c, least_shared(n, num, den), s[: int(_low(np.array([n]))[0])].view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=["doc_id", "n", "key_a", "key_b", "need", "low"])
        hand_back()

    return run


SIGNATURE = "cls long, n int, ranges long, prefix array<long>"


def _sign(k: int, num: int, den: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        counter = shared.value
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingles(t.as_py(), k)
                n = len(s)
                order = np.argsort(counter[(s & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")[: n - -(-num * n // den) + 1]
                cuts = np.append(np.searchsorted(s, RANGE_STARTS), n)
                # Counts stop at what 16 bits hold, which only makes two sets look more alike to the filter.
                packed = np.minimum(np.diff(cuts), 0xFFFF).astype("<u2").view("<i8")[0]
                out.append((i, n, int(packed), s[order].view(np.int64)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)], names=["cls", "n", "ranges", "prefix"])

    return run


RANGE_STARTS = (np.arange(RANGES, dtype=np.uint64) << np.uint64(62)).astype(np.uint64)


def _needed(num: int, den: int) -> Column:
    """The least overlap of two sets that link: den * o >= num * (na + nb - o)."""
    return F.ceil(F.lit(num) * (F.col("na") + F.col("nb")) / F.lit(num + den) - 1e-9)


def _possible(num: int, den: int) -> Column:
    """Length, positional and suffix filters for a pair with columns na, nb, pa, pb (place of the shared shingle), ra, rb."""
    length = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
    positional = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= _needed(num, den)
    count = lambda c, k: F.shiftrightunsigned(c, 16 * k).bitwiseAND(F.lit(0xFFFF))
    apart = sum((F.abs(count("ra", k) - count("rb", k)) for k in range(1, RANGES)), F.abs(count("ra", 0) - count("rb", 0)))
    return length & positional & (apart <= F.col("na") + F.col("nb") - 2 * _needed(num, den))


def _verify(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Of distinct pairs (a, b), those that link. Pairs of one ``a`` go in blocks, each with its own copy of a's text."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    sizes = materialise(sizes, "blocks")
    dealt = pairs.join(sizes.filter("blocks > 1").hint("merge"), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).alias("block"))
    members = dealt.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")).hint("merge"), "b").select("a", "block", "b", "tb", F.lit(None).cast("string").alias("ta"))
    leaders = sizes.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    leaders = leaders.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("string").alias("tb"), "ta")

    def check(table: pa.Table) -> pa.Table:
        leader, out = None, []
        for t in table.column("ta"):
            if t.as_py() is not None:
                leader = shingles(t.as_py(), k)
        a = table.column("a")[0].as_py() if table.num_rows else None
        for b, t in zip(table.column("b").to_pylist(), table.column("tb")):
            if b is None:
                continue
            s = shingles(t.as_py(), k)
            both = len(np.intersect1d(leader, s, assume_unique=True))
            if den * both >= num * (len(leader) + len(s) - both):
                out.append(b)
        return pa.table({"a": pa.array([a] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    return members.unionByName(leaders).groupBy("a", "block").applyInArrow(check, "a long, b long")


def _meet(shared: DataFrame, joined: DataFrame | None, tried: DataFrame | None, turn: int, num: int, den: int) -> DataFrame | None:
    """The pairs (lo, hi) that a turn verifies, with the leader ``a`` of each; None if no bucket has two components left."""
    member = F.struct("pos", "cls", "n", "ranges", "component")
    labelled = shared.withColumn("component", F.col("cls")) if joined is None else shared.join(joined.hint("merge"), "cls")
    mixed = labelled.groupBy("gram").agg(F.min(member).alias("l"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    mixed = materialise(mixed.select(F.col("gram").alias("g"), "l"), "mixed")
    if mixed.isEmpty():
        return None
    labelled = materialise(labelled.join(mixed.select(F.col("g").alias("gram")).hint("merge"), "gram"), "labelled")
    y = labelled.select("gram", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("ranges").alias("rb"), F.col("component").alias("cb"))
    if turn == 1:  # a leader of those that the first leader's component hasn't taken in
        apart = labelled.join(mixed.select("g", F.col("l.component").alias("c")).hint("merge"), (F.col("gram") == F.col("g")) & (F.col("component") != F.col("c")))
        # Written first: the join alone is split where a bucket is large, and the minimum is then taken in two steps.
        apart = materialise(apart.select("gram", "pos", "cls", "n", "ranges", "component"), "apart")
        mixed = materialise(apart.groupBy("gram").agg(F.min(member).alias("l")).withColumnRenamed("gram", "g"), "second")
    if turn < 2:
        x = mixed.select("g", F.col("l.cls").alias("a"), F.col("l.n").alias("na"), F.col("l.pos").alias("pa"), F.col("l.ranges").alias("ra"), F.col("l.component").alias("ca"))
        met = y.join(x.hint("merge"), (F.col("gram") == F.col("g")) & (F.col("ca") != F.col("cb")) & _possible(num, den))
    else:  # all that still share a bucket from different components, met by bands of lengths: those that link are in one band or in neighbours
        band = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("int")
        x = labelled.select(F.col("gram").alias("g"), F.explode(F.array(*(band(F.col("n")) + d for d in (-1, 0, 1)))).alias("w"), F.col("cls").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("ranges").alias("ra"), F.col("component").alias("ca"))
        y = y.withColumn("band", band(F.col("nb")))
        met = y.join(x.hint("merge"), (F.col("gram") == F.col("g")) & (F.col("band") == F.col("w")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _possible(num, den))
    pairs = met.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"))
    if tried is not None:
        pairs = pairs.join(tried.hint("merge"), ["lo", "hi"], "left_anti")
    return materialise(pairs, "pairs")


def jaccard_join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Sets are of distinct k-word shingles of words between white space, A-Z lower-cased; two
    documents link when den * intersection >= num * union. ``component_id`` is the smallest
    doc_id reachable over links, its own included. A text with fewer than k words is one
    shingle; null, empty and blank texts have an empty set and link with nothing. Rows that
    repeat an id are documents of their own. A null id is reached like any other but is no
    smallest id, so a component of null ids alone has a null component_id. An empty table
    gives none. Columns besides doc_id and text are ignored.
    """
    out = _rows(docs, k, num, den)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _rows(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``doc_id, n, key_a, key_b, component, component_id`` of every row; ``component`` numbers components, whose smallest ids may repeat."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch() as made:
        labels, sketched = _labels(plain, k, num, den)
    drop_folders(docs.sparkSession, [f for f in made.folders if "/sketches-" not in f and "/labels-" not in f])
    out = sketched.select("doc_id", "n", "key_a", "key_b").join(labels.hint("merge"), (F.col("key_a") == F.col("x")) & (F.col("key_b") == F.col("y")) & (F.col("n") == F.col("z")), "left")
    return out.drop("x", "y", "z")


def _labels(plain: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Components of the classes of equal sets as ``x, y, z, component, component_id``, and every document's sketch."""
    spark = plain.sparkSession
    with scratch() as wide:
        sketched = materialise(plain.mapInArrow(_sketch(k, num, den), SKETCH), "wide")
        classes = sketched.filter("n > 0").groupBy("key_a", "key_b", "n").agg(F.min("doc_id").alias("doc"), F.any_value("need").alias("need"), F.any_value("low").alias("low"))
        classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    # Low shingles are a fifth of all: each table that holds them is dropped once it has been used, and so are shuffles of them.
    sketched = materialise(sketched.select("doc_id", "n", "key_a", "key_b"), "sketches")
    drop_folders(spark, wide.folders[:1])
    low = classes.select("cls", F.explode("low").alias("gram"))
    twice = materialise(low.groupBy("gram").agg(F.count("*").alias("size")).filter("size > 1").select("gram"), "shared")
    drop_folders(spark, [])
    able = low.join(twice.hint("merge"), "gram").groupBy("cls").agg(F.count("*").alias("c"))
    able = materialise(classes.select("cls", "need").join(able.hint("merge"), "cls").filter("c >= need").select("cls"), "able")
    classes = materialise(classes.drop("need", "low"), "named")
    drop_folders(spark, wide.folders[1:])
    texts = _texts_of(plain, classes.join(able.hint("merge"), "cls").select("cls", "doc", "key_a", "key_b", "n"), k)

    counted = texts.select("text").mapInArrow(_count(k), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counter = np.zeros(COUNTERS, np.int64)
    counter[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
    counter = np.minimum(counter, (1 << 32) - 1).astype(np.uint32)
    signed = materialise(texts.select("cls", "text").mapInArrow(_sign(k, num, den, spark.sparkContext.broadcast(counter)), SIGNATURE), "signatures")
    postings = signed.select("cls", "n", "ranges", F.posexplode("prefix").alias("pos", "gram"))
    buckets = materialise(postings.groupBy("gram").agg(F.count("*").alias("size")).filter("size > 1").select("gram"), "buckets")
    shared = materialise(postings.join(buckets.hint("merge"), "gram").select("cls", "n", "pos", "gram", "ranges"), "postings")

    joined = links = tried = None
    old: list[str] = []
    for turn in range(3):
        with scratch() as now:
            pairs = _meet(shared, joined, tried, turn, num, den)
            if pairs is None:
                break
            tried = pairs.select("lo", "hi") if tried is None else tried.unionByName(pairs.select("lo", "hi"))
            found = _verify(pairs.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b")), texts, k, num, den)
            found = materialise(found, "verified")
            links = found if links is None else links.unionByName(found)
            reached = components(links)
            joined = classes.select("cls").join(reached.hint("merge"), F.col("cls") == F.col("vertex"), "left")
            joined = materialise(joined.select("cls", F.coalesce("component", "cls").alias("component")), "components")
        read = lambda f: any(f"/{name}-" in f for name in ("pairs", "verified"))
        drop_folders(spark, old + [f for f in now.folders[:-1] if not read(f)])
        old = now.folders[-1:]

    joined = classes.select("cls", F.col("cls").alias("component")) if joined is None else joined
    labels = classes.select("key_a", "key_b", "n", "doc", "cls").join(joined.hint("merge"), "cls")
    least = labels.groupBy("component").agg(F.min("doc").alias("component_id"))
    labels = labels.join(least.hint("merge"), "component").select(F.col("key_a").alias("x"), F.col("key_b").alias("y"), F.col("n").alias("z"), "component", "component_id")
    return materialise(labels, "labels"), sketched


def _texts_of(plain: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``cls, text`` for the classes wanted. A filter sized by their number keeps most other texts from the exact join."""
    wanted = materialise(wanted, "wanted")
    bloom = bloom_of(wanted.select(F.xxhash64("doc").alias("h")))
    shared = plain.sparkSession.sparkContext.broadcast(bloom) if bloom else None

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for b in batches:
            texts = b.column(1)
            if shared is not None:
                texts = texts.filter(pa.array(shared.value.may_hold(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
            keys = [_keys(shingles(t.as_py(), k)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int64()), pa.array([x[2] for x in keys], pa.int64()), texts], names=["x", "y", "z", "text"])

    found = plain.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(candidates, "x long, y long, z long, text string")
    found = found.join(wanted.hint("merge"), (F.col("key_a") == F.col("x")) & (F.col("key_b") == F.col("y")) & (F.col("n") == F.col("z")))
    # A class has more rows here only if other copies passed the filter or repeat the id; repeats are verified alike.
    return materialise(found.select("cls", "text"), "texts")


SET_KEY = ("n", "key_a", "key_b")


def _set_keys(k: int):
    """The keys of a text's shingle set, as of a sketch."""

    @F.pandas_udf("n long, key_a long, key_b long")
    def keys(texts: pd.Series) -> pd.DataFrame:
        rows = [(n, a, b) if n else (0, 0, 0) for a, b, n in (_keys(shingles(t, k)) for t in texts)]
        return pd.DataFrame(rows, columns=list(SET_KEY))

    return keys


def one_of_each(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: the row with the smallest (id, set).

    Rows are judged by id and shingle set, so rows with one id and different texts are documents of
    their own. Of rows with one id and equal sets the one with the smallest text stays. Rows
    with a null id, and of each id one row without words, are components of their own and stay. Only rows whose id may
    be one that goes or repeats are shuffled with their columns: a filter sized by the number of these
    ids tells, and an exact join on id and set follows it.
    """
    key = ("doc_id", *SET_KEY)
    found = _rows(docs, k, num, den).filter("doc_id IS NOT NULL").withColumns({c: F.coalesce(c, F.lit(0)) for c in SET_KEY})
    sets = found.groupBy("component", *key).agg(F.count("*").alias("rows"))
    sets = materialise(sets, "sets")
    first = materialise(sets.filter("n > 0").groupBy(F.col("component").alias("c")).agg(F.min(F.struct(*key)).alias("first")), "first")
    judged = sets.join(first.hint("merge"), F.col("component") == F.col("c"), "left").withColumn("stays", (F.col("n") == 0) | (F.struct(*key) == F.col("first")))
    odd = judged.filter("NOT stays OR rows > 1").select(*(F.col(c).alias(f"odd_{c}") for c in key), "stays")
    odd = materialise(odd, "odd")
    own = docs["doc_id"].cast("long")
    hit = own.isNotNull() & may_hold(bloom_of(odd.select(F.xxhash64("odd_doc_id").alias("h"))), docs.sparkSession)(F.xxhash64(own))
    # Clashing names can't reach these: the row travels as a struct.
    suspects = docs.filter(hit).select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), own.alias("id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("said"))
    # Written first: two Python functions in one stage would keep twice as many workers in memory.
    suspects = materialise(suspects, "suspects").withColumn("set", _set_keys(k)("said"))
    same = (F.col("id") == F.col("odd_doc_id")) & (F.col("set.n") == F.col("odd_n")) & (F.col("set.key_a") == F.col("odd_key_a")) & (F.col("set.key_b") == F.col("odd_key_b"))
    judged = materialise(suspects.join(odd.hint("merge"), same, "left").select("row", "id", "said", "set", "stays"), "judged")
    alone = judged.filter("stays IS NULL").select("row.*")
    repeated = judged.filter("stays").groupBy("id", "set").agg(F.min_by("row", F.struct("said", F.col("row.text").isNull())).alias("row")).select("row.*")
    return docs.filter(~hit).unionByName(alone).unionByName(repeated)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * inter >= 90 * (p.n + q.n - inter)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id
FROM words LEFT JOIN sizes USING (doc_id)
"""
