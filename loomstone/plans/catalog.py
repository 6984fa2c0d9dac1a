"""Where queries are registered: a name, a callable of (spark, sf_dir) and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of one folder, read when they are named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over four tasks a core. Spark cuts a table into tasks by its bytes; where every row of a table of few
    bytes is much work (a file is made of it and read), that would be one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` as a query."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return f

    return add
