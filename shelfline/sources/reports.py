"""Reports as JSON files: written as lines by all tasks, read as lines or as whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_report(report: DataFrame, path: str) -> None:
    """Each row a JSON line, null fields kept; an earlier report at the path is replaced."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_report(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """Rows of a report; ``whole`` for files that are one document or array each. What a schema names and a row lacks is null."""
    return spark.read.schema(schema).option("multiLine", str(whole).lower()).json(path)
