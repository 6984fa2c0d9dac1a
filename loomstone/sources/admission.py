"""Files through quarantine: taken in, judged by their content, and promoted in two phases that a restart can finish.

Folders of a store: ``quarantine`` (files as they came, by batch), ``intent`` (what a batch will admit or refuse, and each file's
hash), ``accepted`` (promoted files) and ``done`` (what was promoted, written last). Readers go by ``done`` alone: a batch
whose promotion stopped half way has no admitted file, and ``finish`` carries it out from its intent; doing it twice changes
nothing, as files are written whole under private names and moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import operations
from loomstone.sources import readers


class Store:
    """A store in a folder that driver and executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _batches(self, table: str) -> set[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        return {n for n in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/{n}/_SUCCESS"))}

    def take_in(self, files: DataFrame, batch: str) -> None:
        """Files (path, content) into quarantine as one batch, with what will become of each; paths are unique."""
        files.select("path", "content", F.length("content").cast("long").alias("length")).write.mode("overwrite").parquet(f"{self.root}/quarantine/{batch}")
        held = self.spark.read.parquet(f"{self.root}/quarantine/{batch}")
        readers.admitted(held).select("path", "sha256", "reason").write.mode("overwrite").parquet(f"{self.root}/intent/{batch}")

    def promote(self, batch: str) -> None:
        """Write what the batch's intent admits, check each file's hash as read back against it, and record the batch as done."""
        intent = self.spark.read.parquet(f"{self.root}/intent/{batch}")
        held = self.spark.read.parquet(f"{self.root}/quarantine/{batch}")
        files = held.join(intent.where("reason IS NULL").select("path"), "path", "left_semi").select("path", "content")
        written = operations.write_files(files, f"{self.root}/accepted/{batch}").withColumnRenamed("sha256", "found")
        checked = intent.join(written, "path", "left").withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(~F.col("found").eqNullSafe(F.col("sha256")), "changed while it was promoted"))
        checked.select("path", "sha256", "reason").write.mode("overwrite").parquet(f"{self.root}/done/{batch}")

    def finish(self) -> list[str]:
        """Promote the batches that have an intent and are not done; their names."""
        left = sorted(self._batches("intent") - self._batches("done"))
        for batch in left:
            self.promote(batch)
        return left

    def state(self) -> DataFrame:
        """(batch, path, sha256, state, reason) of every file with an intent: QUARANTINED, ADMITTED or REFUSED."""
        done, out = self._batches("done"), None
        for batch in sorted(self._batches("intent")):
            rows = self.spark.read.parquet(f"{self.root}/{'done' if batch in done else 'intent'}/{batch}").withColumn("batch", F.lit(batch))
            status = F.when(F.lit(batch not in done), "QUARANTINED").when(F.col("reason").isNull(), "ADMITTED").otherwise("REFUSED")
            rows = rows.select("batch", "path", "sha256", status.alias("state"), "reason")
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], "batch string, path string, sha256 string, state string, reason string") if out is None else out

    def accepted(self) -> DataFrame:
        """(batch, path) of the admitted files, which lie below ``accepted``."""
        return self.state().where("state = 'ADMITTED'").select("batch", "path")
