"""Near-duplicate detection by an LSH forest: sorted signature orders whose neighbours are candidates.

1. Documents with equal shingle sets are one class. A class has a signature for each of TREES
   orders: DEPTH min-hashes of 16 bits. Each order is the sorted list of its signatures, dealt
   by ranges, so that an order of any size is many tasks and equal signatures may be cut apart.
2. Classes next to each other in an order that share LEAST_DEPTH min-hashes or more are
   candidates; in a large group of near copies these few already tie everything together.
   Candidates of the first order are verified first, those of the others only where they are
   still in different components.
3. A region is the classes of one order that share a prefix. Regions with one component are
   done. In the others all pairs from different components are candidates where they are at
   most REGION times the region's classes; a denser region goes one min-hash deeper, until it
   is sparse or DEPTH is reached. Regions that are dense at the last depth are cut into tiles of
   two blocks of classes; a task has the sets of a tile and tells only links that join components.
4. What a class may miss follows from the depths of its regions: a pair at the threshold t is
   missed by an order of depth d with probability 1 - t^d. Classes whose product over all orders
   is above MISSED get further orders, until it is not.

Candidates whose 64 two-bit min-hashes agree in fewer places than any pair at the threshold
does, but for a chance of UNLIKE, are dropped where they are met; those min-hashes are ones that
places are seldom as deep as to share. Every link is confirmed on the full sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import begin_task, drop_folders, hand_back, materialise, scratch, table
from .components import components
from .jaccard_join import _keys, _mixed, _texts_of, shingles

#: Orders of one forest, min-hashes of each, and how many of these candidates share at least (those of one long).
TREES, DEPTH, LEAST_DEPTH = 32, 6, 4
#: Candidates for each class of a region, on average, beyond which the region goes deeper.
REGION = 8
#: Classes, and shingles of these, of one block of a dense region.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: The probability of missing a pair at the threshold above which a class gets more orders.
MISSED = 1e-6
#: The probability that a pair at the threshold is taken for unlike by two-bit min-hashes.
UNLIKE = 1e-8
#: Shingles whose min-hashes are taken at a time.
ROWS = 2048

SKETCH = "doc_id long, n long, key_a long, key_b long, sign array<long>"


def _multipliers(forest: int) -> np.ndarray:
    return np.random.default_rng(forest).integers(0, 1 << 63, TREES * DEPTH, np.uint64) << np.uint64(1) | np.uint64(1)


def _sign(s: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Two longs for each order, which as numbers sort by their min-hashes, the first one first, and two of 32 two-bit min-hashes each."""
    least = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), ROWS):
        np.minimum(least, (s[k : k + ROWS, None] * by).min(axis=0), out=least)
    hashes = (_mixed(least) >> np.uint64(48)).astype(np.uint64)
    hashes = hashes.reshape(TREES, DEPTH)
    bits = (hashes.T[::-1].ravel()[:64] & np.uint64(3)).reshape(2, 32) << np.arange(0, 64, 2, dtype=np.uint64)
    orders = np.zeros((TREES, 8), ">u2")
    orders[:, :DEPTH] = hashes
    return np.concatenate([orders.view(">i8").astype(np.int64).ravel(), np.bitwise_or.reduce(bits, axis=1).view(np.int64)])


@functools.cache
def least_agreeing(num: int, den: int) -> int:
    """How many of 64 two-bit min-hashes agree at least in a pair at the threshold, but for a chance of UNLIKE."""
    p, below, k = num / den + (1 - num / den) / 4, 0.0, 0
    while (below := below + math.comb(64, k) * p**k * (1 - p) ** (64 - k)) <= UNLIKE:
        k += 1
    return k


_PAIRS_OF_BITS = 0x5555555555555555


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = ~(a ^ b).view(np.uint64)
    return np.bitwise_count(same & (same >> np.uint64(1)) & np.uint64(_PAIRS_OF_BITS))


def _alike(a: tuple[str, str], b: tuple[str, str], num: int, den: int) -> Column:
    """The same test on columns."""
    same = [F.bitwise_not(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b)]
    agreeing = [F.bit_count(x.bitwiseAND(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_PAIRS_OF_BITS))) for x in same]
    return agreeing[0] + agreeing[1] >= least_agreeing(num, den)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        by = _multipliers(0)
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingles(t.as_py(), k)
                out.append((i, len(s), *_keys(s)[:2], _sign(s, by)) if len(s) else (i, 0, None, None, None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=["doc_id", "n", "key_a", "key_b", "sign"])
        hand_back()

    return run


def _signed(k: int, forest: int):
    """Signatures of a further forest, from texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        by = _multipliers(forest)
        for b in batches:
            sets = [shingles(t.as_py(), k) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_sign(s, by) for s in sets], pa.list_(pa.int64()))], names=["cls", "n", "sign"])
        hand_back()

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for b in batches:
            for at in range(0, b.num_rows, 64):  # texts may be long
                some = b.slice(at, 64)
                sets = [shingles(t.as_py(), k).view(np.int64) for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "grams"])
        hand_back()

    return run


CROWD = "tree int, k1 long, k2 long, cls long, n long, s1 long, s2 long, prev long, prev_n long, agreeing int, part int, edge int"


def _crowd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range, the rows that share LEAST_DEPTH min-hashes with a neighbour, and its first (edge 1) and last row (edge 2; 3 if both).

    ``prev`` and ``prev_n`` are of the row before, if that is the neighbour, and ``agreeing`` counts the two-bit min-hashes that both have.
    """
    begin_task()
    part, held = TaskContext.get().partitionId(), None

    def told(rows: np.ndarray, wanted: np.ndarray) -> pa.RecordBatch:
        tree, alike, edge = rows[0, wanted], rows[7, wanted], rows[11, wanted]
        none = alike == 0
        cols = [pa.array(tree.astype(np.int32)), *(pa.array(rows[i, wanted]) for i in range(1, 7)), *(pa.array(rows[i, wanted], mask=none) for i in (8, 9)), pa.array(rows[10, wanted].astype(np.int32), mask=none), pa.array(np.full(len(tree), part, np.int32)), pa.array(edge.astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in CROWD.split(", ")])

    for b in batches:
        if not b.num_rows:
            continue
        own = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
        rows = np.concatenate([own, np.zeros((5, own.shape[1]), np.int64)])  # alike, prev, prev_n, agreeing, edge
        if held is None:
            rows[11, 0] = 1
        else:
            rows = np.concatenate([held, rows], axis=1)
        rows[7, 1:] = (rows[0, 1:] == rows[0, :-1]) & (rows[1, 1:] == rows[1, :-1])
        rows[8, 1:], rows[9, 1:] = rows[3, :-1], rows[4, :-1]
        rows[10, 1:] = sum(_agreeing(rows[i, 1:], rows[i, :-1]).astype(np.int64) for i in (5, 6))
        yield told(rows[:, :-1], np.flatnonzero((rows[7, :-1] > 0) | (rows[7, 1:] > 0) | (rows[11, :-1] > 0)))
        held = rows[:, -1:]  # whether the next row is alike isn't known yet
    if held is not None:
        held[11] |= 2
        yield told(held, np.array([0]))


def _neighbours(forest: DataFrame, num: int, den: int) -> DataFrame:
    """``tree, k1, k2, cls, n, s1, s2, prev, prev_n, agreeing`` of the rows of crowded places: those with a neighbour, or at the edge of a range.

    Ranges end with the class as last key, so equal signatures are dealt to many tasks; where a
    range begins, the row before it is the last of the range before.
    """
    ranged = forest.repartitionByRange("tree", "k1", "k2", "cls").sortWithinPartitions("tree", "k1", "k2", "cls")
    crowd = materialise(ranged.mapInArrow(_crowd, CROWD), "crowd")
    before = lambda c: F.lag(c).over(Window.orderBy("part", "edge"))  # noqa: E731  two rows a range at most
    own = ["tree", "k1", "k2", "cls", "n", "s1", "s2"]
    seams = crowd.filter("edge > 0").select(*own, "edge", *(before(c).alias(f"b_{c}") for c in own)).filter("edge IN (1, 3) AND tree = b_tree AND k1 = b_k1")
    # Their bits are compared only so far as to say that they may link.
    seams = seams.select(*own, F.col("b_cls").alias("prev"), F.col("b_n").alias("prev_n"), F.when(_alike(("s1", "s2"), ("b_s1", "b_s2"), num, den), 64).otherwise(0).alias("agreeing"))
    return crowd.drop("part", "edge").unionByName(seams)


def _pairs_of(crowd: DataFrame, num: int, den: int) -> DataFrame:
    """``lo, hi, tree``: neighbours that may link by their sizes and two-bit min-hashes, with the first order that has them."""
    near = crowd.filter(F.col("prev").isNotNull() & (F.col("agreeing") >= least_agreeing(num, den)) & (F.least("n", "prev_n") * den >= F.greatest("n", "prev_n") * num))
    return near.groupBy(F.least("cls", "prev").alias("lo"), F.greatest("cls", "prev").alias("hi")).agg(F.min("tree").alias("tree"))


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of distinct pairs (lo, hi), those that link, as (a, b). The sets of a pair meet in one row."""
    left = pairs.select("lo", "hi").join(sets.select(F.col("cls").alias("lo"), F.col("grams").alias("ga")).hint("merge"), "lo")
    both = left.join(sets.select(F.col("cls").alias("hi"), F.col("grams").alias("gb")).hint("merge"), "hi")
    common = F.size(F.array_intersect("ga", "gb"))
    return both.filter(common * den >= (F.size("ga") + F.size("gb") - common) * num).select(F.col("lo").alias("a"), F.col("hi").alias("b"))


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs whose classes are in different components; ``joined`` has those (vertex, component) that links reach."""
    for side in ("lo", "hi"):
        other = joined.select(F.col("vertex").alias(f"v_{side}"), F.col("component").alias(f"c_{side}"))
        pairs = pairs.join(other.hint("merge"), F.col(side) == F.col(f"v_{side}"), "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side))
    return pairs.filter("c_lo <> c_hi").select("lo", "hi")


#: What names a region: its order and depth, and the min-hashes that it shares.
PLACE = ["tree", "depth", "k1", "p"]


def _across(held: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs from different components of the regions whose members are given: pairs of components first, then their members, so no pair within one is made."""
    held = materialise(held, "regions")
    parts = held.select(*PLACE, "component").distinct()
    x, y = parts.withColumnRenamed("component", "cx"), parts.withColumnRenamed("component", "cy")
    sides = materialise(x.join(y.hint("merge"), PLACE).filter("cx < cy"), "sides")
    a = held.select(*PLACE, F.col("component").alias("cx"), F.col("cls").alias("a"), F.col("n").alias("na"), F.col("s1").alias("a1"), F.col("s2").alias("a2"))
    b = held.select(*PLACE, F.col("component").alias("cy"), F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    met = sides.join(a.hint("merge"), [*PLACE, "cx"]).join(b.hint("merge"), [*PLACE, "cy"])
    met = met.filter(_alike(("a1", "a2"), ("b1", "b2"), num, den) & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num))
    return met.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()


def _prefix(depth: int) -> Column:
    """The min-hashes of the second long that a region of this depth shares."""
    return F.lit(0).cast("long") if depth == LEAST_DEPTH else F.shiftright("k2", 16 * (8 - depth))


def _regions(crowd: DataFrame, joined: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Candidates (lo, hi) of the regions with several components, each at the depth at which it is sparse; members of those that never are; and ``cls, tree, depth`` where that is not the least."""
    members = crowd.select("tree", "k1", "k2", "cls", "n", "s1", "s2").distinct().join(joined.select(F.col("vertex").alias("cls"), "component").hint("merge"), "cls", "left")
    left = materialise(members.withColumn("component", F.coalesce("component", "cls")), "members")
    sparse, deep = [], None
    for depth in range(LEAST_DEPTH, DEPTH + 1):
        left = left.withColumn("p", _prefix(depth)).withColumn("depth", F.lit(depth))
        parts = left.groupBy(*PLACE, "component").agg(F.count("*").cast("double").alias("c"))
        # Twice the pairs across components: all ordered pairs less those within.
        regions = parts.groupBy(*PLACE).agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("within"), F.count("*").alias("parts")).filter("parts > 1")
        across = (F.col("size") * F.col("size") - F.col("within")) / 2
        regions = materialise(regions.select(*PLACE, (across <= REGION * F.col("size")).alias("sparse")), "places")
        sparse.append(left.join(regions.filter("sparse").select(*PLACE).hint("merge"), PLACE).select(*PLACE, "component", "cls", "n", "s1", "s2"))
        dense = regions.filter("NOT sparse")
        if dense.isEmpty():
            left = None
            break
        left = materialise(left.join(dense.select(*PLACE).hint("merge"), PLACE), "dense")
        if depth < DEPTH:
            left = left.drop("p", "depth")
            told = left.select("cls", "tree", F.lit(depth + 1).alias("depth"))
            deep = told if deep is None else deep.unionByName(told)
    pairs = _across(functools.reduce(DataFrame.unionByName, sparse), num, den)
    return pairs, left, None if deep is None else deep.groupBy("cls", "tree").agg(F.max("depth").alias("depth"))


def _dense_links(left: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that join components inside dense regions, each tile of two blocks in a task with its sets."""
    sizes = left.groupBy(*PLACE).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    held = left.join(materialise(sizes, "blocks").hint("merge"), PLACE).join(sets.hint("merge"), "cls")
    held = held.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    held = held.select(*PLACE, "cls", "component", "own", "s1", "s2", "grams", F.explode(tiles).alias("tile")).select(*PLACE, "tile.i", "tile.j", "cls", "component", "own", "s1", "s2", "grams")
    least = least_agreeing(num, den)

    def join(table: pa.Table) -> pa.Table:
        cls, component, own, s1, s2 = (table.column(c).to_numpy() for c in ("cls", "component", "own", "s1", "s2"))
        grams = [g.values.to_numpy().view(np.uint64) for g in table.column("grams")]
        size = np.array([len(g) for g in grams])
        names, group = np.unique(component, return_inverse=True)
        root = list(range(len(names)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out, within = [], table.column("i")[0].as_py() == table.column("j")[0].as_py()
        for k in range(len(cls)):
            other = np.arange(k + 1, len(cls)) if within else k + 1 + np.flatnonzero(own[k + 1 :] != own[k])
            other = other[(group[other] != group[k]) & (np.minimum(size[other], size[k]) * den >= np.maximum(size[other], size[k]) * num)]
            agreeing = _agreeing(s1[other], s1[k]).astype(np.int64) + _agreeing(s2[other], s2[k])
            other, agreeing = other[agreeing >= least], agreeing[agreeing >= least]
            for m in other[np.argsort(-agreeing, kind="stable")].tolist():
                x, y = find(group[k]), find(group[m])
                if x != y:
                    both = len(np.intersect1d(grams[k], grams[m], assume_unique=True))
                    if both * den >= (size[k] + size[m] - both) * num:
                        root[x] = y
                        out.append((int(min(cls[k], cls[m])), int(max(cls[k], cls[m]))))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return held.groupBy(*PLACE, "i", "j").applyInArrow(join, "a long, b long")


def _short(deep: DataFrame, log_missed: DataFrame | None, num: int, den: int) -> DataFrame:
    """``cls, missed`` (a logarithm) of classes that may miss a pair at the threshold too often; regions not deepened have the least depth."""
    t = num / den
    missed = lambda d: math.log(1 - t**d)
    more = F.element_at(F.array(*(F.lit(missed(d) - missed(LEAST_DEPTH)) for d in range(LEAST_DEPTH, DEPTH + 1))), F.col("depth") - LEAST_DEPTH + 1)
    now = deep.groupBy("cls").agg((F.sum(more) + TREES * missed(LEAST_DEPTH)).alias("missed"))
    if log_missed is not None:
        now = now.join(log_missed.select("cls", F.col("missed").alias("was")).hint("merge"), "cls").select("cls", (F.col("missed") + F.col("was")).alias("missed"))
    return now.filter(F.col("missed") > math.log(MISSED))


def _ordered(signed: DataFrame) -> DataFrame:
    """``tree, k1, k2, cls, n, s1, s2``: a row for each class and order."""
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.element_at("sign", 2 * t + 1).alias("k1"), F.element_at("sign", 2 * t + 2).alias("k2")))
    bits = (F.element_at("sign", 2 * TREES + i).alias(f"s{i}") for i in (1, 2))
    return signed.select("cls", "n", *bits, F.explode(trees).alias("o")).select("o.tree", "o.k1", "o.k2", "cls", "n", "s1", "s2")


def _region_links(plain: DataFrame, classes: DataFrame, pairs: DataFrame, dense: DataFrame | None, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among the pairs of sparse regions and inside dense ones; the sets of both are fetched at once."""
    if dense is None:
        return _links(pairs, _sets_of(plain, classes, pairs, k), num, den)
    sets = _sets_of(plain, classes, pairs.unionByName(dense.select(F.col("cls").alias("lo"), F.col("cls").alias("hi"))), k)
    return _links(pairs, sets, num, den).unionByName(_dense_links(dense, sets, num, den))


def _grown(joined: DataFrame | None, find: Callable[[DataFrame], DataFrame], candidates: DataFrame, more: bool = False) -> DataFrame | None:
    """Components (vertex, component) with the links (a, b) that a step finds among its candidates, if it has any (or ``more`` of another kind).

    Links found now are between components, so these are the vertices of a much smaller graph.
    """
    candidates = materialise(candidates, "candidates")
    if not more and candidates.isEmpty():
        return joined
    found = materialise(find(candidates), "verified")
    if found.isEmpty():
        return joined
    ends = found
    for side in ("a", "b") if joined is not None else ():
        other = joined.select(F.col("vertex").alias("v"), F.col("component").alias("c"))
        ends = ends.join(other.hint("merge"), F.col(side) == F.col("v"), "left").withColumn(side, F.coalesce("c", side)).drop("v", "c")
    grown = materialise(components(ends), "grown")
    if joined is None:
        return grown
    top = grown.select(F.col("vertex").alias("v"), F.col("component").alias("c"))
    moved = joined.join(top.hint("merge"), F.col("component") == F.col("v"), "left").select("vertex", F.coalesce("c", "component").alias("component"))
    # A component is named by its smallest vertex, so of the two rows of one the smaller is right.
    return materialise(moved.unionByName(grown).groupBy("vertex").agg(F.min("component").alias("component")), "components")


def _linked(plain: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame | None:
    """``vertex, component`` of the classes (cls, doc, key_a, key_b, n, sign) that link with any; None if none does."""
    joined = missed = None
    signed, forest = classes, 0
    while True:
        crowd = materialise(_neighbours(_ordered(signed), num, den), "crowded")
        if crowd.filter("prev IS NOT NULL").isEmpty():
            return joined
        near = materialise(_pairs_of(crowd, num, den), "neighbours")
        sets = _sets_of(plain, classes, near, k)
        for pairs in (near.filter("tree = 0"), near.filter("tree > 0")):
            if joined is not None:
                pairs = _apart(pairs, joined)
            joined = _grown(joined, lambda c: _links(c, sets, num, den), pairs)
        pairs, dense, deep = _regions(crowd, _no_components(plain.sparkSession) if joined is None else joined, num, den)
        joined = _grown(joined, lambda c: _region_links(plain, classes, c, dense, k, num, den), pairs.select("lo", "hi"), dense is not None)
        if deep is None:
            return joined
        missed = materialise(_short(deep, missed, num, den), "missed")
        if missed.isEmpty():
            return joined
        forest += 1
        again = classes.select("cls", "doc", "key_a", "key_b", "n").join(missed.select(F.col("cls").alias("c")).hint("merge"), F.col("cls") == F.col("c"), "left_semi")
        again = _texts_of(plain, again, k).dropDuplicates(["cls"])
        signed = materialise(again.mapInArrow(_signed(k, forest), "cls long, n long, sign array<long>"), "signed")


def _sets_of(plain: DataFrame, classes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``cls, grams`` of the classes in pairs (lo, hi)."""
    named = pairs.select(F.explode(F.array("lo", "hi")).alias("c")).distinct()
    wanted = classes.select("cls", "doc", "key_a", "key_b", "n").join(named.hint("merge"), F.col("cls") == F.col("c"), "left_semi")
    texts = _texts_of(plain, wanted, k).dropDuplicates(["cls"])
    return materialise(texts.mapInArrow(_sets(k), "cls long, grams array<long>"), "sets")


def _no_components(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "vertex long, component long")


def near_duplicates(docs: DataFrame, k: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Sets are of distinct k-word shingles of words between white space, A-Z lower-cased; documents
    link when den * intersection >= num * union. ``component_id`` is the smallest doc_id reachable
    over links, its own included; ``kept`` says that it is the row's own. Words fewer than k are one
    shingle; null, empty and blank texts have an empty set, link with nothing and are kept. Rows
    that repeat an id are documents of their own. A null id is no smallest id: a component of null
    ids alone has a null component_id and keeps its rows. An empty table gives none. Columns besides
    doc_id and text are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch() as made:
        wide = materialise(plain.mapInArrow(_sketch(k), SKETCH), "wide")
        narrow = materialise(wide.drop("sign"), "sketches")
        classes = wide.filter("n > 0").groupBy("key_a", "key_b", "n").agg(F.min("doc_id").alias("doc"), F.any_value("sign").alias("sign"))
        classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
        reached = _linked(plain, classes, k, num, den)
        joined = classes.select("cls", F.col("cls").alias("component"))
        if reached is not None:
            reached = reached.select(F.col("vertex").alias("v"), F.col("component").alias("c"))
            joined = classes.select("cls").join(reached.hint("merge"), F.col("cls") == F.col("v"), "left").select("cls", F.coalesce("c", "cls").alias("component"))
        labels = classes.select("key_a", "key_b", "n", "doc", "cls").join(joined.hint("merge"), "cls")
        least = materialise(labels.groupBy("component").agg(F.min("doc").alias("component_id")), "least")
        labels = labels.join(least.hint("merge"), "component").select(F.col("key_a").alias("x"), F.col("key_b").alias("y"), F.col("n").alias("z"), "component_id")
        labels = materialise(labels, "labels")
    drop_folders(spark, [f for f in made.folders if "/sketches-" not in f and "/labels-" not in f])
    out = narrow.join(labels.hint("merge"), (F.col("key_a") == F.col("x")) & (F.col("key_b") == F.col("y")) & (F.col("n") == F.col("z")), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * inter >= 85 * (p.n + q.n - inter)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
found AS (SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM words LEFT JOIN sizes USING (doc_id))
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM found
"""
