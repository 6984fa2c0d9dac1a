"""Writes that may be repeated: partition overwrite, append of what is missing, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overwrite_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Replace exactly the partitions that ``rows`` has; running it again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_missing(rows: DataFrame, path: str, *keys: str) -> None:
    """Append one row of each key that the folder does not have yet.

    For one writer at a time: keys are looked up before rows are appended, and two writers may add the same one.
    """
    spark, rows = rows.sparkSession, rows.dropDuplicates(list(keys))
    try:
        have = spark.read.parquet(path).select(*keys)
        rows = rows.join(have, list(keys), "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").parquet(path)


def audit(rows: DataFrame, path: str) -> None:
    """Append events with a content hash each; nothing is ever rewritten."""
    rows.withColumn("sha256", F.sha2(F.to_json(F.struct(*rows.columns)), 256)).write.mode("append").parquet(path)


def manifest(files: DataFrame) -> DataFrame:
    """(path, length, sha256) of stored files in order of their paths."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path")
