"""The corpus pipeline: stages that each take the documents that the one before kept.

Texts are never changed, and columns besides doc_id, text and lang pass through whatever
their names. Null, empty and letterless texts go in the first stage; rows that repeat a text
go in the second, whatever their ids. Rows with one id and different texts are documents of
their own: near copies are judged by row, and of a component the row with the smallest id
stays (ties by its shingle set, then its text). Null ids stay and are documents of their own. An empty
table gives an empty result of the same columns. A benchmark without words drops nothing.
"""

from __future__ import annotations

import contextvars
import functools

from pyspark.sql import DataFrame, SparkSession

from shelfline.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing
from shelfline.llm.common import drop_folders, materialise, scratch

#: Folders that the stage before left: of a run in its own list, of stages called by themselves by their input.
_OF_RUN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("folders of a run", default=None)
_OF_INPUT: dict[str, list[str]] = {}


#: Chunks whose ids a worker of the packing stage keeps: fewer than where packing is all that a job does, for memory.
CHUNKS = 120_000


def _stage(work):
    """A stage whose steps' folders the next one drops: its result is written before the next begins. One that fails drops its own."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = _OF_RUN.get()
        left = own if own is not None else _OF_INPUT.setdefault(sf_dir, [])
        drop_folders(spark, left)
        left.clear()
        with scratch() as made:
            try:
                out = work(spark, docs, sf_dir)
            except BaseException:
                drop_folders(spark, made.folders)
                raise
        left += made.folders
        return out

    return run_stage


@_stage
def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification, learned from the labelled documents; those in no language learned go."""
    return language_id.keep_identified(docs)


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact deduplication; of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join; one document of each group that links tie together stays."""
    return jaccard_join.one_of_each(docs)


@_stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination; contaminated documents go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left into sequences of tokens."""
    return packing.pack_documents(docs, CHUNKS)


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's rows written as Parquet and read again by the next.

    What stages wrote goes as soon as nothing reads it, and also when a stage fails; only the
    result's folder stays.
    """
    left: list[str] = []
    before: list[str] = []
    mine = _OF_RUN.set(left)
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES:
            with scratch() as made:
                docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            drop_folders(spark, before)  # what the stage read is no longer needed once its own rows are written
            before = made.folders[-1:]
        before = []
        return docs
    finally:
        drop_folders(spark, left + before)
        _OF_RUN.reset(mine)


#: Language identification and packing can't be said in SQL; tests hold the pipeline to brute force.
ORACLE_SQL = None
