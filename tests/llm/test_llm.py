"""The operators against brute force on small fixtures with nulls, empties, repeats, ties and long texts."""

import hashlib
import html
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfline.llm import blooms, chat_format, decontaminate, exact_dedup, gru, html_extract, jaccard_join, language_id, license_scan, lm_score, lsh_forest, packing, phrases, token_orc, tokens, variants
from shelfline.llm.common import materialise, shared_dir
from shelfline.llm.components import components
from shelfline.llm.dom_blocks import blocks_of

SF = "/root/testdata/sf0.001"
rng = random.Random(3)


def prose(n, words="the of and ocean stone river walks slowly under bright moon tree bird song early light".split()):
    return " ".join(rng.choice(words) for _ in range(n))


# ------------------------------------------------------------------------------- exact dedup


def brute_dedup(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub("[ \t-\r]+", " ", t or "")].append((i is None, i, k))
    out = []
    for norm, members in groups.items():
        first = min(members, key=lambda m: (m[0], m[1] if m[1] is not None else 0, m[2]))
        ids = [i for _, i, _ in members]
        out += [(i, first[1], len(members), hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


TEXTS = ["a  b", "a\tb", "a b", None, "", " ", "  ", "a b", "ü x", "ü x", "long " * 30000, "long " * 30000, "c"]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, docs_of, weak):
    ids = [5, 3, 9, 1, 2, 7, 8, 3, 10, 11, 12, 13, None]
    df = docs_of(TEXTS, ids)
    digest = (lambda c: F.substring(exact_dedup.sha256_of(c), 1, 1)) if weak else exact_dedup.sha256_of
    got = exact_dedup.exact_dedup(df, digest=digest).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute_dedup(list(zip(ids, TEXTS)))
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in got})
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_drop_copies_keeps_columns(spark, docs_of):
    df = docs_of(TEXTS + ["a b"], [5, 3, 9, 1, 2, 7, 8, 3, 10, 11, 12, 13, None, 3])
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted([3, 1, 7, 10, 11, 12, None], key=repr)


def test_digest_index_levels(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN_OUT", 3)
    index, want = exact_dedup.DigestIndex(spark), {}
    for r in range(7):
        rows = [(rng.choice([None, *range(90)]), f"d{rng.randint(0, 30)}") for _ in range(40)] + [(500 + r, f"only-{r}")]
        for i, d in rows:
            ids, n = want.get(d, ([], 0))
            want[d] = (ids + [i] * (i is not None), n + 1)
        index.insert(spark.createDataFrame(rows, "id long, digest string").repartition(3))
    # Seven inserts: two merges of three runs of level 0, and one run over.
    assert [len(x) for x in index.levels] == [1, 2]
    flat = {d: (min(ids, default=None), n) for d, (ids, n) in want.items()}
    some = ["d3", "d7", "only-6", "none"]
    assert {r["digest"]: (r["keep_id"], r["n"]) for r in index.lookup(some).collect()} == {d: flat[d] for d in some if d in flat}
    index.lookup(["only-6"])
    assert len(index.asked) < len(index.runs)
    index.compact()
    assert [len(x) for x in index.levels] == [0, 1]
    rows = index.entries().collect()
    assert sorted((r["n"], r["keep_id"] is None, r["keep_id"] or 0) for r in rows) == sorted((n, i is None, i or 0) for i, n in flat.values())
    for part in index.entries().rdd.glom().collect():
        assert [(r["a"], r["b"]) for r in part] == sorted({(r["a"], r["b"]) for r in part})


def test_filters_are_sized_by_keys(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    bloom = blooms.bloom_of(keys)
    there, other = (np.array([r[0] for r in spark.range(*x).select(F.xxhash64("id")).collect()], np.int64).view(np.uint64) for x in ((0, 20_000), (50_000, 70_000)))
    assert bloom.may_hold(there).all() and bloom.may_hold(other).mean() < 0.05
    assert bloom.bits > blooms.bloom_of(keys.limit(10)).bits
    assert blooms.bloom_of(keys, most_bits=1 << 16) is None


def test_exact_dedup_without_a_filter(spark, docs_of, monkeypatch):
    monkeypatch.setattr(exact_dedup, "bloom_of", lambda hashes: None)
    got = exact_dedup.exact_dedup(docs_of(TEXTS)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute_dedup(list(enumerate(TEXTS)))


# -------------------------------------------------------------------------------- chat format


def test_chat_format_round_trip(spark):
    nasty = ["<|turn|>", "a<|over|>b", "~0", "~1~", "<|says|>", "x<|o", "ver|>", "", None, "</s>[INST] ok [/INST]", "é€😀", "<|over|><|turn|>user<|says|>hi<|over|>", "plain < text", "~"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<|says|>", None]), rng.choice(nasty)) for c in range(40) for t in range(5)]
    rows += [(7, 0, "user", "tie"), (None, 1, "assistant", "n"), (3, None, "assistant", "no turn"), (3, 2, "assistant", "same"), (3, 2, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("body", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.chat_format(df)).collect()}
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((-(1 << 62) if t is None else t, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    made = materialise(chat_format.chat_format(df), "made")
    texts, heard = {r["conv_id"]: r["formatted"] for r in made.collect()}, defaultdict(str)
    for r in chat_format.loss_spans(made).orderBy("conv_id", "start").collect():
        heard[r["conv_id"]] += texts[r["conv_id"]][r["start"] : r["start"] + r["length"]].replace("~1", "<").replace("~0", "~")
    assert {c: hashlib.sha256(heard[c].encode()).hexdigest() for c in convs} == {c: r["loss_sha256"] for c, r in got.items()}
    plain = chat_format.chat_format(spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")).collect()[0]["formatted"]
    assert plain == "<|turn|>user<|says|>hi<|over|>"
    assert chat_format.chat_format(df.limit(0)).count() == 0
    assert "Python" not in chat_format.chat_format(df)._jdf.queryExecution().toString()


# ---------------------------------------------------------------------------- decontamination


def brute_contamination(docs, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins[tuple(w[k : k + 13])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def cases():
    items = [(k, prose(n)) for k, n in enumerate([30, 13, 14, 5, 1, 20])] + [(10, None), (11, " .. "), (2, "Moon-Tree bird")]
    docs = []
    for k in range(60):
        parts = [prose(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(items)[1] or ""
            parts.append(t.upper() if rng.random() < 0.3 else t)
            parts.append(prose(rng.randint(0, 10), ["zebra", "über", "x1", "stone"]))
        docs.append((k, "\n".join(parts)))
    return docs + [(100, None), (101, ""), (5, docs[5][1]), (None, docs[6][1]), (102, (items[0][1] + " ") * 400)], items


@pytest.mark.parametrize("block", [decontaminate.BLOCK_CHARS, 150])
def test_decontaminate(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    docs, items = cases()
    items = [x for x in items if x[0] != 4]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(d, b).collect()
    want = brute_contamination(docs, items)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got), key=repr) == want
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
    bad = {(i, n) for i, n, h, _ in want if h and 20 * h >= n}
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns and kept.count() == sum((i, n) not in bad for i, n, _, _ in want)
    assert decontaminate.decontaminate(d, b.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0


def test_scan_in_small_shards(monkeypatch):
    docs, items = cases()
    for words, many in ((50, 40_000), (13, 7), (1 << 19, 3)):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", words)
        monkeypatch.setattr(decontaminate, "SHARD_DOCS", many)
        scan = decontaminate.Scan(decontaminate.Windows([(str(i), t) for i, t in items]))
        out = [b for i, t in docs for b in scan.add(i, t)] + ([scan.end()] if scan.docs else [])
        got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["items"]))) for b in out for r in b.to_pylist()]
        assert sorted(got, key=repr) == brute_contamination(docs, items)


def test_fm_index_counts_and_locates():
    copied = [rng.randint(2, 4) for _ in range(200)]
    text = [x for _ in range(30) for x in [rng.randint(2, 4) for _ in range(rng.randint(3, 60))] + [1]] + copied + [1] + copied
    index = decontaminate.FMIndex(np.array(text, np.int32))
    ends = text + [0]
    assert decontaminate.suffix_array(np.array(ends, np.int32)).tolist() == sorted(range(len(ends)), key=lambda k: ends[k:])
    assert decontaminate.suffix_array(np.array([5, 1 << 22, 5, 0])).tolist() == [3, 2, 0, 1] and decontaminate.suffix_array(np.zeros(1, np.int32)).tolist() == [0]
    for n in (1, 2, 5):
        pats = np.array(list(itertools.product([2, 3, 4, 9], repeat=n))[:200])
        lo, hi = index.search(pats)
        for p, a, b in zip(pats.tolist(), lo, hi):
            want = [k for k in range(len(text)) if text[k : k + n] == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# --------------------------------------------------------------------------- n-gram Jaccard join


def brute_join(rows, k=3, num=90, den=100):
    sets = []
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets.append({tuple(w[j : j + min(k, len(w))]) for j in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return sorted(((i, len(sets[x]), least.get(root(x)) if sets[x] else i) for x, (i, _) in enumerate(rows)), key=repr)


def near_rows():
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 25, 60, 200]))]
        rows.append(list(base))
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(copy[: len(copy) - rng.randint(0, 2)] or copy)
    rng.shuffle(rows)
    out = [(k + 1, " ".join(w)) for k, w in enumerate(rows)]
    return out + [(500, None), (501, ""), (502, " \n"), (503, "One"), (504, "one"), (505, "one two"), (None, out[0][1]), (3, out[9][1]), (3, out[2][1])]


def test_jaccard_join(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("clash")).repartition(3)
    got = jaccard_join.jaccard_join(df).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_join(rows)
    stays = jaccard_join.one_of_each(df.filter("doc_id <> 3"))
    plain = [r for r in rows if r[0] is not None and r[0] != 3]
    assert stays.columns == df.columns
    assert sorted(r["doc_id"] for r in stays.collect()) == sorted({c for _, _, c in brute_join(plain)})


@pytest.mark.parametrize("filtered", [True, False])
def test_one_of_each_keeps_rows_whole(spark, monkeypatch, filtered):
    if not filtered:
        monkeypatch.setattr(jaccard_join, "bloom_of", lambda hashes: None)
    base = " ".join(f"w{k}" for k in range(60))
    near = base + " end"
    rows = [(1, base), (2, near), (3, "alone one"), (4, None), (4, None), (None, near), (5, "alone two"), (5, "alone two"), (6, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("odd_id", "stays", "rows", "h", "component_id")}).repartition(3)
    got = jaccard_join.one_of_each(df)
    assert got.columns == df.columns
    want = [(1, base), (3, "alone one"), (4, None), (5, "alone two"), (None, near)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert jaccard_join.one_of_each(df.limit(0)).collect() == []


def test_one_of_each_judges_rows_not_ids(spark, docs_of):
    """Rows with one id and different texts are documents of their own; of rows with one id and equal sets one stays."""
    a, b = prose(80), prose(80, ["lamp", "door", "hill", "sand", "wolf", "rain"])
    near = a + " x"
    rows = [(1, a), (1, b), (2, "c d e f"), (3, near), (1, a.upper()), (1, a + "  "), (None, a), (None, a), (4, None), (4, ""), (4, " "), (5, b), (6, near), (6, b + " y")]
    df = docs_of([t for _, t in rows], [i for i, _ in rows])
    got = Counter((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(df).collect())
    assert got == Counter([(1, a.upper()), (1, b), (2, "c d e f"), (None, a), (None, a), (4, "")])
    again = Counter((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(df.repartition(7)).collect())
    assert again == got


def test_least_shared_never_refuses_a_link():
    for _ in range(300):
        n = rng.randint(1, 120)
        x = [rng.random() for _ in range(n)]
        y = x[: n - rng.randint(0, max(0, n // 15))] + [rng.random() for _ in range(rng.randint(0, n // 15))]
        both = len(set(x) & set(y))
        if 100 * both >= 90 * (len(x) + len(y) - both):
            low = [set(sorted(s)[: int(jaccard_join._low(np.array([len(s)]))[0])]) for s in (x, y)]
            for s in (x, y):
                assert len(low[0] & low[1]) >= jaccard_join.least_shared(len(s), 90, 100)


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (200, 200), (300, 250), (250, 260), (300, 260)] + [(7, 1000 + k) for k in range(50)]
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{1000 + k: 1 for k in range(50)}, 100: 100, 101: 100, 250: 250, 260: 250, 300: 250}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ----------------------------------------------------------------------------- tokens, packing

ODD = ["Hello  world\n\nfoo", "", None, " ", "\n \n a", "don't stop's 12345 x1y", "tab\tsep   nbsp em \x1c fs", "İstanbul ǅ ﬁ é é", "日本語 テスト 😀👍🏽", "<|endoftext|> x <|startoftext|>", "a" * 3000, "  lead", "trail  ", "we've I'll 's", "word, Word. (word) word! word!! .. . a. I, ßa, éa.", "́a b", "x" + " y" * 40000]


@pytest.mark.parametrize("name,byte_level", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_ids_equal_the_librarys(name, byte_level, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "SLICE", 5000)
    t = Tokenizer.from_file(public_tokenizers.path(name))
    for cache in (500_000, 10):
        monkeypatch.setattr(tokens, "CACHE_CHUNKS", cache)
        monkeypatch.setattr(tokens, "CACHE_NEWER", cache)
        e = tokens.Encoder(public_tokenizers.path(name), byte_level)
        texts = ODD + [prose(3000), "The " + prose(50).upper()] + ODD
        for text, raw in zip(texts, e.documents(texts), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


PARTS = [" ", "  ", "\n", " \n", "\n\n", "\r\n", "\t", "\xa0", "\u3000", "\x1c", "\x85", "a", "B", "word", "don't", "'s", "'ll", "x1", "٣٥", ".", "!!", "é", "e\u0301", "\u0301", "ß", "İ", "ǅ", "ﬁ", "日本", "👍🏽", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "\0", "\x01", "a\u0327\u0301", "\u200b", "\ufeff", "_", "the", "###"]


@pytest.mark.parametrize("name,byte_level", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_fuzzed_ids_equal_the_librarys(name, byte_level, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "SLICE", 40)
    t, e = Tokenizer.from_file(public_tokenizers.path(name)), tokens.Encoder(public_tokenizers.path(name), byte_level)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(20_000)]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(raw, "<u4").tolist() for raw in e.documents(texts)] == want


def test_token_orc(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    ids = [9, 4, None, 2, 30, 5, 5, *range(100, 100 + len(ODD) - 7)]
    df = spark.createDataFrame(list(zip(ids, ODD)), "doc_id long, text string").withColumn("part", F.lit("clash"))
    token_orc.write_tokens(df, str(tmp_path / "t"))
    got = [tuple(r) for r in token_orc.with_crc32(token_orc.read_tokens(spark, str(tmp_path / "t"))).collect()]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, want = 0, []
    for i, text in zip(ids, ODD):
        x = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    assert sorted(((i, n, crc) for i, _, n, crc in got), key=repr) == sorted(want, key=repr)
    by_start = sorted(got, key=lambda r: r[1])
    assert [i for i, *_ in by_start] == sorted(ids, key=lambda i: (i is not None, i or 0))
    for _, start, n, _ in by_start:
        assert start == at
        at += n
    plan = token_orc.read_tokens(spark, str(tmp_path / "t")).filter("doc_id = 4")
    assert plan.count() == 1
    token_orc.write_tokens(df.limit(0), str(tmp_path / "none"))
    assert token_orc.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_best_fit_and_bound():
    for _ in range(30):
        lengths = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 9))), reverse=True)
        bins, offsets, left = packing.best_fit_decreasing(lengths, 100)
        assert all(x >= 0 for x in left)
        best = min(max(a) + 1 for a in itertools.product(range(min(4, len(lengths))), repeat=len(lengths)) if all(sum(n for n, b in zip(lengths, a) if b == k) <= 100 for k in range(4))) if len(lengths) <= 6 and sum(lengths) < 330 else None
        bound = packing.lower_bound(np.array(lengths), 100)
        assert bound <= len(left) and (best is None or bound <= best)
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 6), 100) == 3


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_EACH", 40)
    rows = [(rng.choice([None, *range(300)]), k % 3, 0, rng.randint(1, 4096), 0) for k in range(400)] + [(1, 0, 0, 4096, 0)] * 3
    got = packing.pack(spark.createDataFrame(rows, packing.PIECE_SCHEMA)).collect()
    assert sorted(((r["doc_id"], r["piece"], r["length"]) for r in got), key=repr) == sorted(((r[0], r[1], r[3]) for r in rows), key=repr)
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(seqs) <= 1.05 * packing.lower_bound(np.array([r[3] for r in rows]))
    assert packing.pack(spark.createDataFrame([], packing.PIECE_SCHEMA)).count() == 0


def test_pieces(spark, docs_of):
    got = packing.pieces(docs_of(ODD)).collect()
    assert {r["doc_id"] for r in got} == set(range(len(ODD)))
    assert [(r["start"], r["length"]) for r in got if r["doc_id"] == 1] == [(0, 1)]
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in got:
        ids = (t.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids + [1])[r["start"] : r["start"] + 4096]
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    long = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == len(ODD) - 1)
    assert [x[1] for x in long] == [4096 * k for k in range(len(long))] and all(x[2] == 4096 for x in long[:-1])


# ------------------------------------------------------------------------------- language id


def test_language_id(spark, monkeypatch):
    rows = [(k, prose(30, w), lang) for k in range(60) for lang, w in [("en", "the and of that with this from when".split()), ("xx", "zu qua vix ork plem drot".split())][k % 2 : k % 2 + 1]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f = language_id.learn(df)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "THE AND"), (5, "plem drot"), (6, "日本"), (None, "the")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in language_id.identify(odd, f).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "xx"]
    assert got[6]["lang_pred"] in ("en", "xx") and got[6]["score"] == 0 and got[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    text = prose(4000, ["the", "drot", "été", "x"])
    whole = f.predict([text, "a", text])
    monkeypatch.setattr(language_id, "SLICE", 1000)
    assert [np.round(x, 9).tolist() if not isinstance(x[0], str) else x for x in f.predict([text, "a", text])] == [np.round(x, 9).tolist() if not isinstance(x[0], str) else x for x in whole]
    none = language_id.learn(df.limit(0))
    assert [r["lang_pred"] for r in language_id.identify(odd.limit(1), none).collect()] == ["und"]


def test_language_id_held_out_accuracy(spark):
    found = language_id.op6_language_id(spark, SF).filter("held_out").select("doc_id", "lang_pred")
    right = found.join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_filters_return_all_languages():
    grams = {"a": np.arange(100), "b": np.arange(50, 150), "c": np.arange(140, 400)}
    f = language_id.Filters(["a", "b", "c"], {k: v.astype(np.int64) for k, v in grams.items()}, "a")
    mask = f.languages(np.arange(400).astype(np.int64))[0]
    for bit, lang in enumerate("abc"):
        assert all(mask[g] >> bit & 1 for g in grams[lang])


# ----------------------------------------------------------------------------------- LM score


def test_lm_score_base_and_counts(spark):
    docs = [(k, prose(rng.randint(0, 60))) for k in range(40)] + [(50, None), (51, ""), (52, "newword another THE")]
    train = docs[:30]
    learn = F.col("doc_id") < 30
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("clash"))
    got = {r["doc_id"]: r for r in lm_score.lm_score(df, learn).collect()}
    c = Counter(w for _, t in train for w in [*(t or "").lower().split(), ""])
    n, v = sum(c.values()), len(c)
    for i, t in docs:
        ws = [*(t or "").lower().split(), ""]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert -1000 < r["score"] < 0
    empty = lm_score.lm_score(df.limit(2), F.lit(False)).collect()
    assert len(empty) == 2 and empty[0]["base_score"] == 0 and empty[0]["n_known"] == 0
    assert lm_score.lm_score(df.limit(0)).count() == 0
    words = [w.encode() for w in ("a", "é", "the", "日本", "x1")]
    assert lm_score.tails_of(words).tolist() == [lm_score.tail_of(w) for w in words]


def test_lm_words_cut_by_arrow_are_looked_up_once(monkeypatch):
    chars = ["a", "B", "É", "\x1c", "\x85", "\u00a0", " ", " ", "\t", "\x0b", "\x0c", "\r", "\n", "\x00", "x."]
    texts = [None, "", " ", " a b ", *("".join(rng.choices(chars, k=rng.randint(0, 40))) for _ in range(300)), "the rare " * 2000 + "THE"]

    class Asked(dict):
        times = 0

        def get(self, *args):
            Asked.times += 1
            return super().get(*args)

    model = lm_score.Model([("", 3), ("the", 2)], {}, 10, 5, [("a", 2)])
    model.head = Asked(model.head)

    class Shared:
        value = model

    monkeypatch.setattr(lm_score, "SPLIT", 3000)
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "part", "text"])
    told = [r for b in lm_score._spell(Shared)([rows]) for r in b.to_pylist()]
    assert [r["doc_id"] for r in told] == list(range(len(texts))) and Asked.times < 4000
    for t, r in zip(texts, told):
        words = lm_score.words_of(t)
        assert np.frombuffer(r["symbols"], "<u2").tolist() == [*(model.head[w] if w in model.head else 2 + lm_score.tail_of(w) for w in words), 0]
        assert dict(zip(r["tail_words"], r["tail_counts"], strict=True)) == Counter(w.decode() for w in words if w not in (b"the", b"a"))
    counted = Counter()
    monkeypatch.setattr(lm_score, "COUNTED", 20)
    for b in lm_score._count([rows.select(["text"])]):
        for r in b.to_pylist():
            counted[r["word"]] += r["n"]
            assert r["tail"] == lm_score.tail_of(r["word"].encode())
    assert counted == Counter(w.decode() for t in texts for w in [*lm_score.words_of(t), b""])


def test_gru_probabilities_sum_to_one_and_state_is_carried():
    net = gru.Gru(np.array([5.0, 9, 3, 2, 1]), np.array([4.0, 2.0]))
    net.p = {k: v + (0.3 * np.random.default_rng(1).normal(size=v.shape)).astype(np.float32) if k != "wb" else v for k, v in net.p.items()}
    each = [math.exp(net.score([np.array([y])])[0]) for y in range(7)]
    assert math.isclose(sum(each), 1, rel_tol=1e-4)
    text = np.array([rng.randint(0, 6) for _ in range(500)])
    alone, among = net.score([text])[0], net.score([np.array([1, 2]), text, text[:70]])
    assert math.isclose(alone, among[1], rel_tol=1e-4)
    cut = net.score([text[:40]])[0], net.score([text[:41]])[0]
    assert cut[1] < cut[0]


def some_net(seed=1):
    net = gru.Gru(np.array([5.0, 9, 3, 2, 1, *range(80)]), np.array([4.0, 2.0]))
    r = np.random.default_rng(seed)
    net.p = {k: (v if k == "wb" else v + 0.3 * r.normal(size=v.shape)).astype(np.float32) for k, v in net.p.items()}
    return net


def literal_score(net, text):
    """The sum of log-probabilities, symbol by symbol in 64 bits."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    sig = lambda v: 1 / (1 + np.exp(-v))
    h, x, n, total = np.zeros(gru.HIDDEN), net.head + net.n_tails, gru.HIDDEN, 0.0
    for y in text:
        a, b = p["e"][x], h @ p["u"]
        z, r = sig(a[:n] + b[:n]), sig(a[n : 2 * n] + b[n : 2 * n])
        h = z * h + (1 - z) * np.tanh(a[2 * n :] + r * b[2 * n :])
        cls = y // gru.CLASS if y < net.head else y - net.head + net.n_head_classes
        e = h @ p["c"] + p["cb"]
        total += e[cls] - np.log(np.exp(e).sum())
        if y < net.head:
            w = h @ p["w"][cls] + p["wb"][cls]
            total += w[y % gru.CLASS] - np.log(np.exp(w).sum())
        x = y
    return total


def test_gru_forward_equals_literal():
    net = some_net()
    texts = [np.array([rng.randint(0, 86) for _ in range(n)]) for n in (1, 2, 31, 32, 33, 150, 700)]
    for got, text in zip(net.score(texts), texts):
        assert math.isclose(got, literal_score(net, text), rel_tol=1e-4)


def test_gru_gradient_equals_differences(monkeypatch):
    net, taken = some_net(2), {}
    monkeypatch.setattr(gru.Gru, "_adam", lambda self, grads, state, rate, scale: taken.update(grads))
    texts = [np.array([rng.randint(0, 86) for _ in range(n)]) for n in (30, 12, 7)]  # within one window, so nothing is truncated
    net.train(texts, {}, 0.1)
    for name, g in taken.items():
        flat = np.argsort(-np.abs(g).ravel())[: 40 : 5]
        for k in flat.tolist():
            at, step, both = np.unravel_index(k, g.shape), 1e-2, []
            for sign in (1, -1):
                was = net.p[name][at].copy()
                net.p[name][at] += sign * step
                both.append(sum(literal_score(net, t) for t in texts))
                net.p[name][at] = was
            assert math.isclose(-(both[0] - both[1]) / (2 * step), g[at], rel_tol=0.02, abs_tol=2e-3), (name, at)


def test_gru_gradient_and_training():
    net = gru.Gru(np.ones(5), np.ones(2))
    text = np.array([0, 1, 2, 3, 4, 5, 6] * 12)
    before = net.score([text])[0]
    state = {}
    for _ in range(60):
        net.train([text, text[3:]], state, 0.02)
    assert net.score([text])[0] > before + 20


def test_gru_narrow_windows_are_taken_together_but_cut_as_before(monkeypatch):
    net, taken, outputs = some_net(3), [], []
    monkeypatch.setattr(gru.Gru, "_adam", lambda self, grads, state, rate, scale: taken.append((scale, grads)))
    whole = gru.Gru._output
    monkeypatch.setattr(gru.Gru, "_output", lambda self, *given: outputs.append(1) or whole(self, *given))
    texts = [np.array([rng.randint(0, 86) for _ in range(n)]) for n in (700, 130, 5)]
    net.train(texts, {}, 0.1)
    assert len(taken) == len(outputs) == 1  # 22 outputs, one a window, before
    (scale, together), sizes = taken[0], 1 / taken[0][0]
    taken.clear()
    monkeypatch.setattr(gru, "STEP_SYMBOLS", 1)
    net.train(texts, {}, 0.1)
    assert len(taken) == 22 and round(sizes) == 835 == round(sum(1 / s for s, _ in taken))
    for name, g in together.items():
        assert np.allclose(g, sum(gs[name] for _, gs in taken), rtol=1e-3, atol=2e-3), name


def test_lm_beats_base(spark):
    held = lm_score.op2_gru_lm_score(spark, SF).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


# ------------------------------------------------------------------------------- HTML extraction


@pytest.fixture(scope="module")
def crf():
    return html_extract.train()


def test_extraction_of_known_pages(spark, crf):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    got = {r["page_id"]: r for r in html_extract.extract(pages.withColumn("text", F.lit(1)), crf).collect()}
    right = 0
    for p in pages.collect():
        body = re.search("<article>(.*?)</article>", p["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]+>", " ", body)).split())
        right += got[p["page_id"]]["text"] == want
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])
    assert right >= 0.98 * len(got)


def test_extraction_held_out_accuracy(crf):
    right = total = 0
    for page, labels in html_extract.labelled_pages(120, 991):
        blocks = blocks_of(page)
        assert [b.text for b in blocks] == [" ".join(t.split()) for t, _ in labels]
        y = crf.decode(html_extract.rows_of(blocks))
        right, total = right + sum(a == b for a, (_, b) in zip(y, labels)), total + len(y)
    assert right > 0.98 * total


#: Pages written by hand in layouts of their own, with the text that a reader would take from each.
WRITTEN = [
    ('<div id="top"><a href="/">Главная</a></div><div class="post"><h2>Старый мост</h2><p>Мост стоит над рекой уже двести лет и до сих пор открыт для пешеходов.</p><p>Весной его починят.</p></div><div id="bottom">Copyright 2021</div>', 'Старый мост Мост стоит над рекой уже двести лет и до сих пор открыт для пешеходов. Весной его починят.'),
    ('<div class="sidebar"><h3>Archive</h3><ul><li><a href=/1>May</a></li><li><a href=/2>June</a></li></ul></div><div class="entry-body"><h1>Keeping bees</h1><p>Bees need water, flowers and quiet, and a keeper who looks in on them each week.</p><blockquote>No bees, no honey.</blockquote></div><ol class="commentlist"><li>I kept bees once, and it was lovely.</li></ol>', 'Keeping bees Bees need water, flowers and quiet, and a keeper who looks in on them each week. No bees, no honey.'),
    ('<main><p>The first half of the story is told before the notice in the middle.</p><div class="ad-slot">Buy shoes now!</div><p>The second half of it comes after that, and then it ends.</p><form><label>Mail</label><button>Subscribe</button></form></main>', 'The first half of the story is told before the notice in the middle. The second half of it comes after that, and then it ends.'),
    ('<body><nav><a href=/>Home</a> <a href=/b>Blog</a></nav><h1>On rivers</h1><p>The river rises in the hills and falls to the sea after a long way.</p><p>Boats go up it in spring, when the water is high enough for them.</p><footer>© 2020 A. Writer</footer></body>', 'On rivers The river rises in the hills and falls to the sea after a long way. Boats go up it in spring, when the water is high enough for them.'),
    ('<article><p>هذا نص عن الأنهار والجبال التي تمر بها القوافل في الشتاء؟</p></article>', 'هذا نص عن الأنهار والجبال التي تمر بها القوافل في الشتاء؟'),
    ('<div class=menu><a href=/>Start</a></div><div id=content><h1>Books to read</h1><p>These are the ones that we liked best this year.</p><ul><li><a href=/1>A long walk in winter</a></li><li><a href=/2>The salt road</a></li></ul></div><div id=footer>All rights reserved.</div>', 'Books to read These are the ones that we liked best this year. A long walk in winter The salt road'),
    ('<table><tr><td><a href=/>Home</a></td><td><a href=/x>News</a></td></tr><tr><td colspan=2><p>Our town has built a new bridge over the canal this year.</p><p>It took eight months and cost less than had been planned.</p></td></tr><tr><td>Copyright 2019 Town Paper. All rights reserved.</td></tr></table>', 'Our town has built a new bridge over the canal this year. It took eight months and cost less than had been planned.'),
    ('<div class="header">新闻网</div><main><h1>大桥通车</h1><p>今年春天，城里的新大桥终于通车了，人们走上街头庆祝。</p><p>工程用了八个月。</p></main><div class="footer">版权所有</div>', '大桥通车 今年春天，城里的新大桥终于通车了，人们走上街头庆祝。 工程用了八个月。'),
    ('<main><section><header><h2>Baking bread</h2></header><p>Flour, water, salt and time are all that it takes to bake a loaf.</p></section></main><aside><h3>Related</h3><ul><li><a href=/c>Cakes</a></li></ul></aside><section id="comments"><p>Great post, thanks!</p></section>', 'Baking bread Flour, water, salt and time are all that it takes to bake a loaf.'),
    ('<div><div><h1>Night trains</h1><div>They leave at ten and arrive at dawn, which suits most of those who take them.</div><div>Few seats are left by then.</div></div></div><div class="cookie-banner">We use cookies. <button>OK</button></div>', 'Night trains They leave at ten and arrive at dawn, which suits most of those who take them. Few seats are left by then.'),
    ('<article><p>Yes.</p></article>', 'Yes.'),
    ('<p>Only one paragraph is on this page, and it is the text.</p>', 'Only one paragraph is on this page, and it is the text.'),
]


def test_extraction_of_written_pages(crf):
    wrong = [(page, got) for page, want in WRITTEN if (got := html_extract.main_text(page, crf)) != want]
    assert wrong == []


def test_viterbi_equals_brute_force(crf):
    page = next(html_extract.labelled_pages(1, 5))[0]
    rows = html_extract.rows_of(blocks_of(page))[:9]
    s = crf.scores(rows)
    best = max(itertools.product((0, 1), repeat=len(rows)), key=lambda y: sum(s[k, v] for k, v in enumerate(y)) + sum(crf.t[a, b] for a, b in zip(y, y[1:])))
    assert crf.decode(rows) == list(best)


def test_deep_nesting_is_linear():
    import time

    for page in ("<div>" * 60_000 + "deep" + "</div>" * 60_000, "<b>" * 60_000 + "deep" + "<p>x" * 20, "<a href=x>" * 30_000 + "y" + "</a>" * 30_000):
        began = time.process_time()
        assert blocks_of(page)[0].text in ("deep", "y")
        assert time.process_time() - began < 5


def test_blocks_edges(spark, crf):
    assert blocks_of(None) == blocks_of("") == blocks_of("<p> </p><script>x<p>y") == []
    said = lambda page: [b.text for b in blocks_of(page)]
    assert said('<p>a</p><svg class="icon"/><p>b</p>') == ["a", "b"] == said("<p>a<p>b<svg><text>c</text></svg>")
    assert said("<p>a<select><p>b") == ["a", "b"] and said("<canvas>" * 3000 + "x") == ["x"]
    assert said("<html><head><title>t</title><meta x><p>a<p>b") == ["a", "b"] == said("<head><link>a<p>b")
    assert said("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds") == ["so x=2 holds"]
    assert said("<head><title>a<b>c</title><style>p{}</style></head>d") == ["d"] and said("<noscript>a</noscript>b<template><p>c</template>") == ["b"]
    b = blocks_of('<div>a&amp;b<b>c</b>\n d<br>e<p>f<p>g</div>tail<a href="x>y">z</a> &eacute;&#8364;&nbsp;q<!-- no --><style>n{}</style>')
    assert [x.text for x in b] == ["a&bc d", "e", "f", "g", "tailz é€ q"]
    odd = spark.createDataFrame([(1, None, None), (None, "u", "<p>"), (2, "u", "<article><p>" + "word " * 200000 + ".</p></article>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.extract(odd, crf).collect()}
    assert got[1]["text"] == "" and got[None]["n_chars"] == 0 and got[2]["n_chars"] == 200000 * 5 + 1
    assert html_extract.extract(odd.limit(0), crf).count() == 0


# ---------------------------------------------------------------------------------- license scan


def test_license_scan(spark, docs_of):
    t = license_scan.Templates(license_scan.TEMPLATES)
    texts = [None, "", "four words are few", "Licensed under CC BY-NC 4.0."]
    for _ in range(60):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(rng.choice(list(license_scan.TEMPLATES.values()))).split()
            if rng.random() < 0.4 and len(w) > 20:
                w[rng.randrange(len(w))] = "changed"
            parts += [" ".join(w).upper() if rng.random() < 0.2 else " ".join(w), prose(rng.randint(0, 30))]
        texts.append(" ".join(parts))
    hit = total = 0
    for text in texts:
        s = license_scan.shingle_hashes(text)
        if len(s):
            brute, found = {x[0] for x in t.scan(s, verify_all=True)}, {x[0] for x in t.scan(s)}
            assert found <= brute
            hit, total = hit + len(found), total + len(brute)
    assert hit == total > 20
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(texts)).collect()}
    assert got[0]["n_matches"] == got[1]["n_matches"] == got[2]["n_matches"] == 0 and got[2]["n_words"] == 4
    assert got[3]["licenses"] == ["CC-BY-NC-4.0"] and [tuple(s) for s in got[3]["spans"]] == [("CC-BY-NC-4.0", 0, 7)]


# ------------------------------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept, seen = [], set()
    for i, t in rows:
        norm = re.sub("[ \t-\r]+", " ", t)
        if any(c.isalpha() for c in t) and norm not in seen:
            seen.add(norm)
            kept.append((i, t))
    stays = {c for _, _, c in brute_join(kept)}
    kept = [r for r in kept if r[0] in stays]
    bad = {i for i, n, h, _ in brute_contamination(kept, items) if h and 20 * h >= n}
    want = {i for i, _ in kept} - bad
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in got.collect()} == want
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "language_id" and shared_dir(spark)


def test_plain_words_are_encoded_as_the_library_does():
    """Every character that the plain pattern takes, inside a word and alone, with and without punctuation after it."""
    from tokenizers import Tokenizer

    from shelfline.llm.token_orc import vocabulary_path
    from shelfline.llm.tokens import _LETTERS, Encoder

    path = vocabulary_path("word_bpe_49k.json")
    mine, plain = Encoder(path, False), Tokenizer.from_file(path)
    letters = [chr(c) for c in range(0x250, 0x10000) if not 0xD800 <= c < 0xE000 and _LETTERS.fullmatch(chr(c))] + [chr(c) for c in range(0x250) if _LETTERS.fullmatch(chr(c))]
    marks = [chr(c) for c in range(0x21, 0x7F) if _LETTERS.fullmatch("a" + chr(c)) and not chr(c).isalpha()]
    assert len(letters) > 20000 and "'" not in marks and len(marks) == 31
    texts = [" ".join(f"a{c}b {c} {c}{marks[i % 31]} {c}b{marks[i % 29]}{marks[i % 23]}" for i, c in enumerate(letters[at : at + 200])) for at in range(0, len(letters), 200)]
    for text, got in zip(texts, mine.documents(texts)):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


# ------------------------------------------------------------------- phrases, LSH forest, spelling variants


def brute_phrases(rows, least, top):
    """Phrases by plain dictionaries of word tuples."""
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    counts[lang][tuple(w[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        found, kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}, []
        for p, a in found.items():
            inside = (b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if any(100 * b >= 80 * a for b in inside):
                continue
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize("window", [7, 1 << 20])
def test_phrases(spark, window, monkeypatch):
    draw = random.Random(5)
    words = ["a", "b", "c", "Über", "d e", "𝒳", "f"]
    rows = [("".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(draw.randrange(60))), draw.choice(["en", "de", None, "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", "en"), (" \t.", "fr"), ("one two three " * 40, "en"), ("A b c. " * 50, "en"), ("x y " * 3000, "long")]
    monkeypatch.setattr(phrases, "WINDOW", window)
    df = spark.createDataFrame([(t, g, 1, "p", 2) for t, g in rows], "text string, lang string, n long, piece string, words int")
    for least, top in ((5, 2000), (2, 7)):
        got = sorted(map(tuple, phrases.mine(df, least, top, buckets=3).collect()))
        assert got == brute_phrases(rows, least, top)
    assert phrases.mine(df.limit(0)).count() == 0
    assert phrases.mine(df.filter("text = ''")).count() == 0


def test_phrases_leave_nothing_behind(spark, docs_of, tmp_path):
    assert phrases.spill_folder() != phrases.spill_folder()
    parts = list(phrases._take_apart(2)(iter([])))
    assert parts == []


def brute_variants(rows, every, least):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in around.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(around[w]), n[form[w]] if w in form else None) for w in n)


def test_variants(spark):
    draw = random.Random(8)
    stems = ["hello", "hallo", "hellos", "helloss", "straße", "strasse", "Éclair", "éclair", "abcde", "abcdef", "abcdefg", "aaaaaa", "aaaaa", "naïve×x"]

    def misspelt(w):
        i = draw.randrange(len(w))
        return draw.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + draw.choice("abß") + w[i:], w[:i] + draw.choice("xyé") + w[i + 1 :]])

    rows = [(k, " ".join(misspelt(draw.choices(stems, range(1, len(stems) + 1))[0]) for _ in range(draw.randrange(40)))) for k in range(150)]
    rows += [(None, "hello hello Hello hellö"), (3, None), (4, ""), (5, "1 2 3 漢字漢字漢字"), (6, "abcde" * 2000), (7, "HELLO hello_hello"), (7, "HELLO hello_hello"), (8, "word " * 5000), (9, "planetss " * 3 + "planets " * 8 + "planet " * 20)]
    df = spark.createDataFrame([(i, t, "w", 1, "f") for i, t in rows], "doc_id long, text string, word string, n long, form string")
    for every in (97, 3):
        got = sorted(map(tuple, variants.variants(df, every=every).select("word", "form", "root", "n", "n_near", "form_n").collect()))
        assert got == brute_variants(rows, every, 3)
        assert any(a[1] and a[2] != a[1] for a in got), "no chain of forms in the fixture"
    assert variants.variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        variants.variants(df, ratio=1)


def test_lsh_forest(spark, docs_of, monkeypatch):
    draw = random.Random(11)
    texts = [None, "", " \t", "one", "ONE", "one two", "a b c", "a  b\tc"]
    for size in (40, 400):
        for _ in range(6):
            base = [draw.choice("the of and stone river walks slowly under bright moon tree".split()) + str(draw.randrange(90)) for _ in range(size)]
            texts.append(" ".join(base))
            for share in (0.01, 0.03, 0.05, 0.06, 0.2):
                texts.append(" ".join(w if draw.random() > share else "x" + str(draw.randrange(9)) for w in base))
    texts += [texts[10]] * 3
    ids = list(range(100, 100 + len(texts)))
    ids[20], ids[21] = None, ids[22]
    df = docs_of(texts, ids)

    def expected():
        sets = [set() if not (w := [x for x in re.split("[ \t-\r]+", (t or "").lower()) if x]) else {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for t in texts]
        root = list(range(len(texts)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in itertools.combinations(range(len(texts)), 2):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
        least = defaultdict(list)
        for i in range(len(texts)):
            least[find(i)].append(ids[i])
        comp = [min((x for x in least[find(i)] if x is not None), default=None) if sets[i] else ids[i] for i in range(len(texts))]
        return sorted(((ids[i], len(sets[i]), comp[i], ids[i] == comp[i]) for i in range(len(texts))), key=repr)

    want = expected()
    assert len({r[2] for r in want}) > 20
    assert sorted(map(tuple, lsh_forest.near_duplicates(df).collect()), key=repr) == want
    assert lsh_forest.near_duplicates(df.limit(0)).count() == 0


def test_lsh_forest_regions_deepen(spark):
    """Dense places go deeper, classes in them get more orders, and no pair across components is lost at the last depth."""
    rows = [(t, 7, (3 << 48) + (c // 4 << 32), c, 10, 0, 0) for t in range(2) for c in range(40)] + [(0, 9, 5, c, 10, 0, 0) for c in (0, 50)]
    crowd = spark.createDataFrame(rows, "tree int, k1 long, k2 long, cls long, n long, s1 long, s2 long")
    alone = lsh_forest._no_components(spark)
    old, lsh_forest.REGION = lsh_forest.REGION, 2
    try:
        pairs, dense, deep = lsh_forest._regions(crowd, alone, 85, 100)
        got = {tuple(r) for r in pairs.distinct().collect()}
        inner = {(a, b) for a, b in itertools.combinations(range(40), 2) if a // 4 == b // 4}
        assert got == inner | {(0, 50)} and dense is None
        assert {r["depth"] for r in deep.collect()} == {lsh_forest.DEPTH}
        short = lsh_forest._short(deep, None, 85, 100)
        t = 0.85
        missed = (1 - t**lsh_forest.DEPTH) ** 2 * (1 - t**lsh_forest.LEAST_DEPTH) ** (lsh_forest.TREES - 2)
        assert (missed > lsh_forest.MISSED) == bool(short.count())
        # Those of one component are no candidates, and a region of one component is no region.
        whole = spark.createDataFrame([(c, 0) for c in range(40)], "vertex long, component long")
        pairs, _, deep = lsh_forest._regions(crowd, whole, 85, 100)
        assert {tuple(r) for r in pairs.collect()} == {(0, 50)} and deep is None
    finally:
        lsh_forest.REGION = old


def test_lsh_forest_further_orders(spark, docs_of, monkeypatch):
    """With all regions dense, tiles find the links; with every class short of orders, further ones are made; the result stays."""
    draw = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(w if draw.random() > share else f"x{draw.randrange(9)}" for w in base) for share in (0.004, 0.01, 0.015, 0.03) for _ in range(10)] + [" ".join(draw.sample(base, 120)) for _ in range(5)]
    df = docs_of(texts)
    want = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["doc_id"] == r["component_id"]) for r in jaccard_join.jaccard_join(df, 3, 85, 100).collect())
    assert 6 < len({r[2] for r in want}) < 40
    monkeypatch.setattr(lsh_forest, "REGION", 0)
    monkeypatch.setattr(lsh_forest, "BLOCK", 5)
    made, signed = [], lsh_forest._signed
    monkeypatch.setattr(lsh_forest, "_signed", lambda k, forest: made.append(forest) or signed(k, forest))
    monkeypatch.setattr(lsh_forest, "MISSED", 1e-10)
    assert sorted(map(tuple, lsh_forest.near_duplicates(df).collect())) == want and made == [1]


def test_lsh_forest_order_and_seams(spark):
    """Ranges cut anywhere have the same neighbours as the whole order."""
    draw = random.Random(2)
    bits = {c: tuple(draw.choice([draw.getrandbits(63), -draw.getrandbits(63), 3]) for _ in range(2)) for c in range(60)}
    rows = [(t, draw.randrange(4), draw.randrange(3), c, 5, *bits[c]) for t in range(2) for c in range(60)]
    forest = spark.createDataFrame(rows, "tree int, k1 long, k2 long, cls long, n long, s1 long, s2 long")
    least = lsh_forest.least_agreeing(85, 100)
    agree = lambda a, b: sum((x >> i & 3) == (y >> i & 3) for x, y in zip(bits[a], bits[b]) for i in range(0, 64, 2))
    found = lsh_forest._neighbours(forest, 85, 100).filter("prev IS NOT NULL").collect()
    assert all((r["agreeing"] >= least) == (agree(r["prev"], r["cls"]) >= least) for r in found)
    got = {(r["prev"], r["cls"], r["tree"]) for r in found}
    order = sorted(r[:4] for r in rows)
    assert got == {(x[3], y[3], y[0]) for x, y in zip(order, order[1:]) if x[:2] == y[:2]}
    both = spark.createDataFrame([(*bits[a], *bits[b], a, b) for a in range(60) for b in range(60)], "a1 long, a2 long, b1 long, b2 long, a int, b int")
    assert {(r["a"], r["b"]) for r in both.filter(lsh_forest._alike(("a1", "a2"), ("b1", "b2"), 85, 100)).collect()} == {(a, b) for a in range(60) for b in range(60) if agree(a, b) >= least}
    sign = lsh_forest._sign(np.arange(50, dtype=np.uint64) * np.uint64(977), lsh_forest._multipliers(0))
    assert len(sign) == 2 * lsh_forest.TREES + 2 and (sign == lsh_forest._sign(np.arange(50, dtype=np.uint64)[::-1] * np.uint64(977), lsh_forest._multipliers(0))).all()
