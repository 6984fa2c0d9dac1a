"""Streams of job and request events: windows, deduplication, stale jobs, idempotent batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators.governance import STALE_MINUTES, stale_jobs


def events(spark: SparkSession, folder: str, like: DataFrame, *, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deduplicated(stream: DataFrame, *keys: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: a delivery that comes again is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def tumbling(stream: DataFrame, *by: str, at: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window (extension)."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(stream: DataFrame, *by: str, at: str = "ts", width: str = "60 seconds", step: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """Requests per client in sliding windows; ``n`` over the limit marks a client."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, width, step), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n")


def sessions(stream: DataFrame, by: str, *, at: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions closed by a gap (extension)."""
    counted = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def run(stream: DataFrame, sink: str, checkpoint: str, *, mode: str = "append", every: str | None = None):
    """Write a stream as Parquet: what there is now, or every so often; the checkpoint makes a restart exact."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", sink)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def sweep(spark: SparkSession, read_jobs, path: str, checkpoint: str, *, minutes: int = STALE_MINUTES, every: str | None = "5 minutes", now: Column | None = None):
    """Mark jobs in work for too long as failed, every so often (or once, where ``every`` is None); each job is marked once.

    ``read_jobs()`` gives the jobs as they stand; marks (id, status, error_message) are appended below ``path``.
    """
    from loomstone.sources import sinks

    def each(_: DataFrame, number: int) -> None:
        found = stale_jobs(read_jobs(), F.current_timestamp() if now is None else now, minutes)
        sinks.append_missing(found.select("id", "status", "error_message"), path, "id")

    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = clock.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def idempotent(handle, done_path: str):
    """For foreachBatch: ``handle(batch, number)`` is skipped for a batch number whose handling was finished before.

    That is at least once: a crash between the end of ``handle`` and its marker runs the batch again, so ``handle`` should
    write under the number that it is given (or overwrite partitions), which makes the effect exactly once.
    """

    def each(batch: DataFrame, number: int) -> None:
        marker = batch.sparkSession.createDataFrame([(number,)], "batch long")
        try:
            new = batch.sparkSession.read.parquet(done_path).where(F.col("batch") == number).isEmpty()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            new = True
        if new:
            handle(batch, number)
            marker.write.mode("append").parquet(done_path)

    return each
