"""Language-model scores of whole texts by a gated recurrent network.

Words are counted over all training texts. The HEAD most frequent are words of the network;
every other belongs to one of TAILS classes by its last two bytes, within which its
probability is its share of the class's counts, and all words never seen share one slot
that weighs as much as the class's words seen once. So every word has a probability and
those of all words and one unseen word for each tail class sum to one.

Texts are split twice: to count words, and to write each text's symbols once. The network is
trained on the symbols of every training text, in ROUNDS over disjoint parts of them: each
task goes over its own texts from the common weights, and the weights are averaged. Scoring
reads the symbols again.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begin_task, bucket, drop_folders, hand_back, materialise, scratch
from .gru import Gru

FOLDS, HELD_OUT = 7, 2
HEAD, TAILS = 2048, 32
#: Further words, by frequency, whose counts tasks hold, so that only rarer ones meet their counts in a join.
HELD = 60_000
#: Shares of the training texts, in sixteenths, that the rounds go over, and their rates.
ROUNDS = ((0, 2, 0.02), (2, 7, 0.012), (7, 16, 0.006))
#: Tokens that a task gathers for one pass over lanes; distinct words that it counts before it hands them on.
GATHER, COUNTED = 4_000_000, 300_000
#: Bytes of texts that are cut into words at a time.
SPLIT = 1 << 22
#: Weights in a row when they are averaged.
BLOCK = 8192
END = ""


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


def _split(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """Some texts at a time: how many, which of them each word is of, and the words as of :func:`words_of`, cut by Arrow."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SPLIT, "right")))
        found = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, end - at)))
        of, words = pc.list_parent_indices(found), found.flatten()
        full = pc.greater(pc.binary_length(words), 0)  # white space at either end gives empty ones
        yield end - at, of.filter(full).to_numpy(), words.filter(full)
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin_task()
    held, rows = [], 0

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()

    def told(found: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in found.to_batches():
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(_tails_of(b.column("word"))), b.column("n")], names=["word", "tail", "n"])

    for b in batches:
        for n, _, words in _split(b.column(0)):
            counts = words.value_counts()
            held += [pa.table({"word": counts.field(0), "n": counts.field(1)}), pa.table({"word": pa.array([END]), "n": pa.array([n], pa.int64())})]
            rows += len(counts) + 1
            if rows > COUNTED:
                held = [summed()]
                rows = len(held[0])
                if rows > COUNTED:
                    yield from told(held[0])
                    held, rows = [], 0
                else:
                    rows = 0  # as many again before they are summed again
    if held:
        yield from told(summed())


@cache
def _tails() -> np.ndarray:
    """Tail classes by a word's last two bytes; a byte alone is at 65536 on."""
    two = [zlib.crc32(bytes((a, b))) % TAILS for a in range(256) for b in range(256)]
    return np.array(two + [zlib.crc32(bytes((b,))) % TAILS for b in range(256)], np.int32)


def tails_of(words: list[bytes]) -> np.ndarray:
    """The tail classes of many words at once."""
    return _tails_of(pa.array(words, pa.binary()))


def _tails_of(words: pa.Array) -> np.ndarray:
    """The same for a column of words; that of the empty word is 0, as its checksum is."""
    if not len(words):
        return np.zeros(0, np.int32)
    _, offsets, data = words.buffers()
    cuts = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    size, ends = np.diff(cuts), cuts[1:]
    data = np.frombuffer(data or b"", np.uint8)
    if not len(data):
        return np.zeros(len(words), np.int32)
    last, before = data[np.maximum(ends - 1, 0)].astype(np.int32), data[np.maximum(ends - 2, 0)].astype(np.int32)
    return np.where(size > 0, _tails()[np.where(size > 1, (before << 8) + last, 65536 + last)], 0).astype(np.int32)


class Model:
    """The head words with their counts, what tail classes weigh, totals, and the network's weights."""

    def __init__(self, head: list[tuple[str, int]], tails: dict[int, tuple[int, int]], tokens: int, distinct: int, held: list[tuple[str, int]] = ()):
        self.head = {w.encode("utf-8", "surrogatepass"): k for k, (w, _) in enumerate(head)}
        self.counts = np.array([n for _, n in head], np.float64)
        self.mass = np.array([tails.get(k, (0, 0))[0] for k in range(TAILS)], np.float64)
        self.once = np.array([tails.get(k, (0, 0))[1] for k in range(TAILS)], np.float64)
        self.tokens, self.distinct = tokens, distinct
        self.net = Gru(self.counts, self.mass + self.once)
        #: Of further frequent words, the logarithms for base_score and within their tail class.
        words = [w.encode("utf-8", "surrogatepass") for w, _ in held]
        n = np.array([n for _, n in held], np.float64)
        #: All of these words, those of the head first, for Arrow to look up.
        self.words = pa.array([*self.head, *words], pa.binary())
        self.held_base = np.log10(n + 1)
        self.held_within = np.log10(n / (self.mass + self.once + 1)[tails_of(words)]) if words else n


def count_words(train: DataFrame) -> DataFrame:
    """``word, tail, n`` over all texts; the end of a text is the empty word."""
    counts = train.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "word string, tail int, n long")
    return materialise(counts.groupBy("word", "tail").agg(F.sum("n").alias("n")), "words")


def start_model(counts: DataFrame) -> Model:
    totals = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == END, F.col("n")))).first()
    words, want = counts.filter(F.col("word") != END), HEAD - 1 + HELD
    # A bound that only a few more words than wanted reach, from a small histogram, so that partitions send the driver these alone.
    step = F.floor(F.log2("n") * 16)
    bound, so_far = None, 0
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True):
        bound, so_far = r["step"], so_far + r["words"]
        if so_far >= want:
            break
    often = words if bound is None else words.filter(step >= bound)
    often = [tuple(r) for r in often.orderBy(F.desc("n"), "word").limit(want).select("word", "n").collect()]
    head, held = often[: HEAD - 1], often[HEAD - 1 :]
    head = [(END, totals[2] or 0), *head]
    names = counts.sparkSession.createDataFrame([(w,) for w, _ in head], "word string")
    rest = counts.join(F.broadcast(names), "word", "left_anti").groupBy("tail").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once"))
    return Model(head, {r["tail"]: (r["n"], r["once"]) for r in rest.collect()}, totals[0] or 0, totals[1], held)


def train(model: Model, symbols: DataFrame) -> Model:
    """Train on all rows of (part, symbols): each task from the common weights, which are then averaged by tokens."""
    spark, part = symbols.sparkSession, F.col("part")
    tasks_read = symbols.rdd.getNumPartitions()
    for lo, hi, rate in ROUNDS:
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin_task()
            m, state, held, size, seen = shared.value, {}, [], 0, 0
            net = Gru(m.counts, m.mass + m.once).load(m.net.flat())
            for b in batches:
                for t in b.column(0):
                    held.append(np.frombuffer(t.as_buffer(), "<u2").astype(np.int32))
                    size += len(held[-1])
                    if size >= GATHER:
                        net.train(held, state, rate)
                        held, size, seen = [], 0, seen + size
            net.train(held, state, rate)
            seen += size
            del held
            if seen:
                flat = net.flat()
                blocks = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([task] * len(blocks), pa.int32()), pa.array(range(len(blocks)), pa.int32()), pa.array([float(seen)] * len(blocks)), pa.array(blocks, pa.list_(pa.float32()))], names=["task", "block", "weight", "values"])

        # As many tasks as the round's share of the texts, so that each has enough of them to fill its lanes beside the longest.
        mine = symbols.filter((part >= lo) & (part < hi)).select("symbols").coalesce(max(1, round(tasks_read * (hi - lo) / 16)))
        trained = mine.mapInArrow(run, "task int, block int, weight double, values array<float>")
        trained = materialise(trained, "weights")
        tasks = trained.select("task").distinct().count()
        if not tasks:
            continue
        # Two steps, so that no group holds more than about the root of the number of tasks.
        some = trained.withColumn("task", F.pmod("task", F.lit(int(math.isqrt(tasks)) + 1))).groupBy("task", "block").applyInArrow(_mean, "task int, block int, weight double, values array<float>")
        some = some.withColumn("task", F.lit(0)).groupBy("task", "block").applyInArrow(_mean, "task int, block int, weight double, values array<float>")
        rows = sorted(some.select("block", "values").collect())
        model.net.load(np.concatenate([np.array(r["values"], np.float32) for r in rows]))
    return model


def _mean(table: pa.Table) -> pa.Table:
    w = table.column("weight").to_numpy()
    total = None
    for x, v in zip(w, table.column("values")):
        part = x * np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
        total = part if total is None else total + part
    mean = (total / w.sum()).astype(np.float32)
    return pa.table({"task": table.column("task").slice(0, 1), "block": table.column("block").slice(0, 1), "weight": pa.array([w.sum()]), "values": pa.array([mean], pa.list_(pa.float32()))})


SYMBOLS = "doc_id long, part int, symbols binary, head_base double, held_within double, tail_words array<string>, tail_counts array<int>"


def _spell(shared):
    """Texts to symbols, and what counts say of them: logarithms of frequent words, and each text's rarer words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        m = shared.value
        n_head, log_head = len(m.counts), np.log10(np.append(m.counts + 1, np.ones(TAILS)))
        for b in batches:
            at = 0
            for n, of, words in _split(b.column(2)):
                # Each distinct word is looked up once; a text is the numbers of its words and the end, 0.
                coded = words.dictionary_encode()
                names, code = coded.dictionary, coded.indices.to_numpy()
                place = pc.fill_null(pc.index_in(names.cast(pa.binary()), value_set=m.words), -1).to_numpy()
                other = (place < 0) | (place >= n_head)
                symbol = np.where(other, n_head + _tails_of(names), place)
                frequent = np.where(other & (place >= 0), place - n_head, -1)
                s = np.zeros(len(code) + n, np.int32)
                s[np.arange(len(code)) + of] = symbol[code]
                cuts = np.searchsorted(of, np.arange(n + 1)) + np.arange(n + 1)
                weight, symbols = log_head[s], s.astype("<u2")
                known = np.flatnonzero(frequent[code] >= 0)
                mine, held = np.searchsorted(of[known], np.arange(n + 1)), frequent[code[known]]
                base = [float(weight[i:j].sum()) + float(m.held_base[held[k:l]].sum()) for i, j, k, l in zip(cuts, cuts[1:], mine, mine[1:])]
                within = [float(m.held_within[held[k:l]].sum()) for k, l in zip(mine, mine[1:])]
                rare = np.flatnonzero((other & (frequent < 0))[code])
                each, times = np.unique(of[rare].astype(np.int64) * max(1, len(names)) + code[rare], return_counts=True)
                of_each, word = np.divmod(each, max(1, len(names)))
                starts = pa.array(np.searchsorted(of_each, np.arange(n + 1)).astype(np.int32))
                columns = [
                    pa.array([symbols[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()), pa.array(base, pa.float64()), pa.array(within, pa.float64()),
                    pa.ListArray.from_arrays(starts, names.take(pa.array(word))), pa.ListArray.from_arrays(starts, pa.array(times.astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(1).slice(at, n), *columns], names=["doc_id", "part", "symbols", "head_base", "held_within", "tail_words", "tail_counts"])
                at += n

    return run


SCORED = "row long, n_tokens long, network double"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        net = shared.value.net

        def scored(rows: list, texts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(net.score(texts) / math.log(10))], names=["row", "n_tokens", "network"])

        rows, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                rows.append(i)
                texts.append(np.frombuffer(t.as_buffer(), "<u2").astype(np.int32))
                size += len(texts[-1])
                if size >= GATHER:
                    yield scored(rows, texts)
                    rows, texts, size = [], [], 0
        if rows:
            yield scored(rows, texts)
        del rows, texts
        hand_back()

    return run


def lm_score(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from the rows where ``learn`` holds, from all without it. Null texts are
    empty and score their end alone. Without such rows every token is unseen; base_score is
    then 0. A word of any length is one token. Rows repeat as they come, with null ids too; an
    empty table gives none. Columns besides doc_id, text and those of ``learn`` are ignored.
    """
    spark = docs.sparkSession
    with scratch() as made:
        out = _scores(docs, F.lit(True) if learn is None else F.coalesce(learn, F.lit(False)))
    drop_folders(spark, [f for f in made.folders if not any(f"/{name}-" in f for name in ("symbols", "network", "sums"))])
    return out


def _scores(docs: DataFrame, learn: Column) -> DataFrame:
    spark = docs.sparkSession
    # Sixteen parts of the training texts; -1 for texts that are not learned from.
    part = F.when(learn, F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(16))).otherwise(-1).cast("int")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.col("text").cast("string").alias("text"))
    counts = count_words(plain.filter("part >= 0").select("text"))
    model = start_model(counts)
    symbols = plain.mapInArrow(_spell(spark.sparkContext.broadcast(model)), SYMBOLS).withColumn("row", F.monotonically_increasing_id())
    symbols = materialise(symbols, "symbols")
    model.head, model.words, model.held_base, model.held_within = {}, None, None, None  # tasks from here on need the network alone
    model = train(model, symbols)
    network = materialise(symbols.select("row", "symbols").mapInArrow(_score(spark.sparkContext.broadcast(model)), SCORED), "network")

    # What the network leaves to counts: each document's distinct tail words against the count of each.
    tail = symbols.select("row", F.explode(F.arrays_zip("tail_words", "tail_counts")).alias("t")).select("row", F.col("t.tail_words").alias("word"), F.col("t.tail_counts").alias("m"))
    tail = tail.join(counts.select("word", F.col("n").alias("c"), "tail").hint("merge"), "word", "left")
    weighs = [float(x) for x in (model.mass + model.once + 1)]
    slots = [float(x) for x in (model.once + 1)]
    at = F.coalesce("tail", F.crc32(F.substring(F.encode("word", "utf-8"), -2, 2)) % TAILS).cast("int") + 1
    within = F.log10(F.coalesce(F.col("c").cast("double"), F.element_at(F.lit(slots), at)) / F.element_at(F.lit(weighs), at))
    sums = tail.groupBy("row").agg(F.sum(F.col("m") * within).alias("within"), F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("tail_base"), F.sum(F.when(F.col("c").isNull(), F.col("m")).otherwise(0)).alias("unknown"))
    sums = materialise(sums, "sums")
    end_known = 0 if model.counts[0] else 1
    out = symbols.select("row", "doc_id", "head_base", "held_within").join(network.hint("merge"), "row").join(sums.hint("merge"), "row", "left")
    return out.select(
        "doc_id", "n_tokens", (F.col("n_tokens") - end_known - F.coalesce("unknown", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", F.lit(0.0)) - F.col("n_tokens") * math.log10(model.tokens + model.distinct + 1)).alias("base_score"),
        (F.col("network") + F.col("held_within") + F.coalesce("within", F.lit(0.0))).alias("score"),
    )


def held_out():
    return F.coalesce(bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))


def op2_gru_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = lm_score(docs, ~held_out())
    return found.withColumn("held_out", held_out()).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
