"""The pipeline's stages on rows of every odd kind, one after another as ``run`` applies them."""

import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline

#: Columns whose names the stages use inside.
EXTRA = {"row": "r", "digest": "d", "n": 1, "cls": 2, "stays": True, "component": 3, "hit": "h"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, n int, cls int, stays boolean, component int, hit string"


def corpus():
    draw = random.Random(21)
    spoken = {"aa": "balo meri tonu sika dorem pali ventu karo".split(), "bb": "schwirk drungel pfatz knorbel strimpf zwack".split()}

    def prose(lang, n):
        return " ".join("".join(draw.choices(spoken[lang], k=2)) for _ in range(n))

    rows = [(k, prose(lang := draw.choice(["aa", "bb"]), 60), lang) for k in range(80)]
    passage = prose("aa", 30)
    a, b = prose("aa", 80), prose("bb", 80)
    rows += [
        (100, None, "aa"), (101, "", None), (102, " \t\n", "bb"), (103, "123 456 !!", "aa"), (104, "совсем другие слова на этом месте", None),
        (110, a, None), (110, b, None),  # one id on two texts: both stay
        (111, a.replace(" ", "  "), None), (110, a, None),  # exact copies, one of them with the same id
        (112, a + " balomeri", None), (109, b + " zwackzwack", None),  # near copies; 109 is the smaller id
        (None, prose("aa", 40), None), (None, prose("bb", 40), "bb"),
        (120, prose("bb", 20) + " " + passage, None), (121, prose("bb", 2000) + " " + passage, None),  # contaminated; too little of it
        (130, prose("aa", 60_000), "aa"), (131, "balo", None), (132, "balo", None),
    ]
    return rows, passage


@pytest.fixture()
def folder(spark, tmp_path):
    rows, passage = corpus()
    spark.createDataFrame([(i, t, g, "s", 0, *EXTRA.values()) for i, t, g in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def ids(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_on_odd_rows(spark, folder, tmp_path):
    sf, rows = folder
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/stage-{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{k}")
        if k < 4:
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
            assert {tuple(r[c] for c in EXTRA) for r in docs.collect()} == {tuple(EXTRA.values())}
            kept.append(ids(docs))
    whole = Counter((i, t) for i, t, _ in rows)
    text = lambda i: [t for j, t, _ in rows if j == i]
    gone = Counter({(100, None): 1, (101, ""): 1, (102, " \t\n"): 1, (103, "123 456 !!"): 1, (104, text(104)[0]): 1})
    assert kept[0] == whole - gone
    gone = Counter({(111, text(111)[0]): 1, (110, text(110)[0]): 1, (132, "balo"): 1})
    assert kept[1] == kept[0] - gone
    # Of a and its near copies the row of 110 stays, of b and its near copy that of 109: rows are judged, not ids.
    assert kept[2] == kept[1] - Counter([(112, text(112)[0]), (110, text(110)[1])])
    assert kept[3] == kept[2] - Counter([(120, text(120)[0])])
    pieces = docs.collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(i for (i, _), n in kept[3].items() for _ in range(n))
    assert all(0 < r["length"] <= 4096 for r in pieces) and any(r["piece"] > 0 for r in pieces)
    fill = Counter()
    for r in pieces:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096


def test_run_on_nothing(spark, folder, tmp_path_factory):
    sf, _ = folder
    at = tmp_path_factory.mktemp("empty")
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(at)).count() == 0


def test_folders_go_when_a_run_ends_or_fails(spark, folder, monkeypatch):
    from pathlib import Path

    from shelfline.llm.common import shared_dir

    sf, rows = folder
    at = Path(shared_dir(spark).removeprefix("file:")) / "shelfline"
    steps = lambda: {f for f in at.glob("*") if not f.name.startswith("digests")} if at.exists() else set()
    before = steps()

    def broken(spark, docs, sf_dir):
        raise RuntimeError("this stage fails")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], ("broken", broken)])
    with pytest.raises(RuntimeError, match="this stage fails"):
        corpus_pipeline.run(spark, sf)
    assert steps() == before
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[:2])
    assert corpus_pipeline.run(spark, sf).count() == len(rows) - 8
    assert len(steps() - before) == 1, "only the result's folder stays"


def test_folds_of_the_fixture():
    """The fixture's labelled rows lie on both sides of the held-out fold."""
    rows, _ = corpus()
    assert {zlib.crc32(str(i).encode()) % 4 == 2 for i, _, g in rows if g and i is not None} == {True, False}
