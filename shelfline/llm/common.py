"""What the operators share: the shared folder, materialised steps, row preparation."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark import TaskContext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where a session on one machine names none (tests) a folder of its own is made and
    remembered for the session; on a cluster the setting is required.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shelfline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/shelfline/{name}-{uuid.uuid4().hex}"


class Scratch:
    """The folders that steps were written to inside a ``with`` block of :func:`scratch`, in order."""

    def __init__(self) -> None:
        self.folders: list[str] = []


_SCRATCHES: list[Scratch] = []


@contextlib.contextmanager
def scratch() -> Iterator[Scratch]:
    """Notes the folders that :func:`materialise` makes, so that whoever knows when they are no longer read can drop them."""
    mine = Scratch()
    _SCRATCHES.append(mine)
    try:
        yield mine
    finally:
        _SCRATCHES.remove(mine)


def drop_folders(spark: SparkSession, folders: list[str]) -> None:
    """Delete written steps that nothing reads any more, and let Spark drop the shuffle files of plans that are gone."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in folders:
        at = jvm.org.apache.hadoop.fs.Path(f)
        at.getFileSystem(conf).delete(at, True)
    gc.collect()
    jvm.System.gc()  # shuffle files go with the plans that own them, once the driver's collector has found these


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: cuts the lineage in a way that survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    for s in _SCRATCHES:
        s.folders.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hand_back() -> None:
    """At the end of a task that held much: workers are reused, so what it freed goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library, which keeps its own counsel


_KEPT: dict = {}


def begin_task() -> None:
    """Called first by every task: what a worker keeps for the tasks of one stage goes when a task of another comes."""
    here = TaskContext.get()
    if _KEPT and here is not None and _KEPT["stage"] != here.stageId():
        _KEPT.clear()
        hand_back()


def kept_for_stage(make: Callable[[], T]) -> T:
    """An object that the tasks of a stage share in a worker, one after another."""
    begin_task()
    if not _KEPT:
        _KEPT.update(stage=TaskContext.get().stageId(), held=make())
    return _KEPT["held"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale and the other letters."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_of(c: str | Column) -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def bucket(c: Column, n: int) -> Column:
    """The remainder of the CRC-32 of a value's decimal text: the folds of the contracts."""
    return F.crc32(c.cast("string").cast("binary")) % n
