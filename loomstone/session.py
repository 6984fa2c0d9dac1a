"""Session defaults: UTC, adaptive execution, Arrow; sizes of partitions stay with the cluster's own settings."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "loomstone", master: str | None = None, shuffle: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle))
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a temporary one serves on a local master; on a cluster, whose machines share none, it is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if before.isDefined():
            root = before.get()
        elif spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="loomstone-")
            spark.sparkContext.setCheckpointDir(root)
            delete_at_exit(spark, root)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return root if urlparse(root).scheme else "file://" + root


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's file system remove ``path`` when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, written below the shared folder and read back: what is dear to make and used several times is made once."""
    at = f"{shared_folder(rows.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(at)
    delete_at_exit(rows.sparkSession, at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)
