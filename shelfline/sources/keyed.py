"""Stored tables with keys: files in buckets by key, of which a merge reads and rewrites only those that it touches.

A bucket is a partition of the table's folder, by a hash of the key and, if the table has one, by
a slice such as the day. A merge reads the buckets of its rows (partition pruning), joins them by
key and puts the merged rows in their place by dynamic partition overwrite; an insert only adds
files. Writers of one table take turns, as the commit protocol of plain files asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET, SLICE, SHARE = "_bucket", "_slice", "_share"
#: Touched buckets are named in the reading filter; beyond so many, all are read.
NAMED = 1000


class KeyedTable:
    """A table with one row for each key.

    schema: of the rows, as DDL. keys: columns that tell rows apart. buckets: how many parts a
    merge can leave alone (of each slice). slice_by: an expression over the rows that is the same
    whenever a key comes back, such as the day of its creation; slices that a merge doesn't name
    aren't even listed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64, slice_by: str | None = None):
        self.spark, self.path, self.keys, self.buckets, self.slice_by = spark, path.rstrip("/"), list(keys), buckets, slice_by
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = [f.name for f in self.schema.fields]
        self.parts = ([SLICE] if slice_by else []) + [BUCKET]

    def _placed(self, rows: DataFrame) -> DataFrame:
        return self._with_parts(rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields)))

    def _with_parts(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        return rows.withColumn(SLICE, F.expr(self.slice_by).cast("string")) if self.slice_by else rows

    def _stored(self) -> DataFrame:
        kinds = ", ".join(f"{p} {'int' if p == BUCKET else 'string'}" for p in self.parts)
        whole = self.spark.createDataFrame([], self.schema).schema
        for f in self.spark.createDataFrame([], kinds).schema.fields:
            whole = whole.add(f)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(self.path)

    def read(self) -> DataFrame:
        """All rows."""
        return self._stored().select(*self.columns)

    def touched(self, rows: DataFrame) -> DataFrame:
        """The stored rows of the buckets that ``rows`` (placed) fall into: the only ones that are read."""
        named = rows.select(*self.parts).distinct().limit(NAMED + 1).collect()
        stored = self._stored()
        if len(named) > NAMED:
            return stored.join(rows.select(*self.parts).distinct(), self.parts, "left_semi").select(*stored.columns)
        if self.slice_by:
            stored = stored.filter(F.col(SLICE).isin([r[SLICE] for r in named if r[SLICE] is not None]) | (F.col(SLICE).isNull() if any(r[SLICE] is None for r in named) else F.lit(False)))
        return stored.filter(F.col(BUCKET).isin([r[BUCKET] for r in named]))

    def merge(self, rows: DataFrame, order: list, keep_first: list[str] = ()) -> None:
        """Upsert: of each key the last row by ``order`` replaces the stored one, but the first one's values stay in ``keep_first``."""
        if any(rows.schema[f.name].dataType != f.dataType for f in self.schema.fields):  # the order is that of the values as they come
            rows, order = self._placed(_last(rows, self.keys, order, keep_first)), []
        new = self._with_parts(rows)
        old = self.touched(new)
        # Stored rows come before all new ones of their key, so the last row and the first one's values say it all:
        # rows are dealt once, sorted once, and written as they lie.
        both = self._dealt(new.withColumn("_new", F.lit(True)).unionByName(old.withColumn("_new", F.lit(False)), allowMissingColumns=True))
        met = _last(both, [*self.parts, SHARE, *self.keys], ["_new", *order], keep_first)
        rows = met.select(*self.columns, *self.parts)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.parts).parquet(self.path)

    def insert(self, rows: DataFrame, order: list) -> None:
        """First write wins: rows whose key is not stored yet are added, of each key the first by ``order``; nothing stored is rewritten."""
        new = self._placed(rows.withColumn("_n", F.row_number().over(Window.partitionBy(*self.keys).orderBy(*order))).filter("_n = 1"))
        old = self.touched(new).select(*(F.col(k).alias(f"_old_{k}") for k in (*self.keys, BUCKET)))
        fresh = new.join(old, _all([new[k].eqNullSafe(old[f"_old_{k}"]) for k in (*self.keys, BUCKET)]), "left_anti")
        fresh.repartition(*self.parts).write.mode("append").partitionBy(*self.parts).parquet(self.path)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows dealt by bucket and, where there are more tasks than buckets, by a share of its keys."""
        shares = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        share = F.pmod(F.hash(*self.keys), F.lit(shares)).cast("int")
        return rows.withColumn(SHARE, share).repartition(*self.parts, SHARE)


def _last(rows: DataFrame, keys: list[str], order: list, keep_first: list[str]) -> DataFrame:
    """Of each key the last row, with the first one's values in ``keep_first``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rows.withColumn("_n", F.row_number().over(w)).withColumn("_last", F.count("*").over(whole))
    return out.withColumns({c: F.first(c).over(whole) for c in keep_first}).filter("_n = _last")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def commit(rows: DataFrame, path: str, table: str = "table") -> None:
    """Add rows of several tables in one job: ``table`` says which a row is of. Either all of them are there afterwards or none.

    Files become visible when the job commits, so a task that fails leaves no table with rows
    that the others lack.
    """
    # Tasks of a size, however few files the rows came from: each sorts what it writes by table.
    rows.hint("rebalance").write.mode("append").partitionBy(table).parquet(path)


def committed(spark: SparkSession, path: str, name: str, columns: list[str], table: str = "table") -> DataFrame:
    """One table of those that :func:`commit` wrote, read from its own files alone."""
    return spark.read.parquet(path).filter(F.col(table) == name).select(*columns)
