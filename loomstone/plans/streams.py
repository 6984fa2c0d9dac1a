"""Queries of streams with timers, state and offsets, each over the events in several batches with a restart between."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.plans.catalog import Tables, query
from loomstone.plans.governance import LIMITED
from loomstone.session import shared_folder
from loomstone.sources import readers
from loomstone.streaming import jobs, state

#: How far out of order events may come.
LATE = "1 day"


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"


def _in_batches(t: Tables, rows: DataFrame, closing: DataFrame, shape) -> DataFrame:
    """``shape`` of a stream that finds the first half of ``rows`` (by ts), ends, is started again, finds the rest, ends, and
    finds ``closing``, which moves the watermark past all of them; what it wrote in the three runs."""
    at = _folder(t)
    state.stateful(t.spark)
    middle = rows.agg(F.expr("timestamp_micros(CAST((unix_micros(min(ts)) + unix_micros(max(ts))) / 2 AS LONG))").alias("m"))
    halves = rows.join(F.broadcast(middle), how="cross").withColumn("late", F.col("ts") > F.col("m")).drop("m")
    out = None
    for part in (halves.where("NOT late").drop("late"), halves.where("late").drop("late"), closing):
        part.write.mode("append").parquet(f"{at}/in")
        out = shape(jobs.events(t.spark, f"{at}/in", rows, files_per_batch=1000))
        jobs.run(out, f"{at}/out", f"{at}/state").awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{at}/out")


def _closing(rows: DataFrame, **changes) -> DataFrame:
    """One row, a year after the last."""
    last = rows.agg(F.max("ts").alias("last"))
    end = rows.orderBy(F.desc("ts")).limit(1).join(F.broadcast(last), how="cross").withColumn("ts", F.expr("last + INTERVAL 365 DAYS")).drop("last")
    return end.withColumns({k: F.lit(v) for k, v in changes.items()}).select(rows.columns)


@query("str_01_timers", """
WITH j AS (SELECT event_id // 2 AS job, event_id, ts, event_type = 'click' AS working FROM events)
SELECT job, event_id, 'FAILED' AS status FROM j WHERE working AND NOT EXISTS (SELECT 1 FROM j k WHERE k.job = j.job AND NOT k.working AND k.ts BETWEEN j.ts AND j.ts + INTERVAL 30 MINUTE)""")
def str_01(t: Tables):
    """Jobs of two events each: one that stays in work for half an hour fails when its timer fires."""
    rows = t.events.select("event_id", F.expr("event_id div 2").alias("job"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "click", "PROCESSING").otherwise("COMPLETED").alias("state"))
    shape = lambda s: state.stale_jobs(s, job="job", at="ts", key="event_id", state="state", late=LATE)
    return _in_batches(t, rows, _closing(rows, job=-1, state="COMPLETED"), shape)


@query("str_02_rate_limit_stream", LIMITED)
def str_02(t: Tables):
    """The decisions of the batch form, made as the watermark passes."""
    rows = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    shape = lambda s: state.rate_limited(s, client="user_id", at="ts", key="event_id", limit=3, window=36_000.0, late=LATE).select("event_id", "allowed")
    return _in_batches(t, rows, _closing(rows, user_id=-1), shape)


@query("str_05_offsets", "SELECT CAST(event_id AS VARCHAR) AS record_id, 'production' AS record_type, CAST(event_id % 30 AS INTEGER) AS changed_day, event_type AS kind, 1 AS times FROM events")
def str_05(t: Tables):
    """Exports of events, day by day, pulled as a stream that is stopped and started again while more days come."""
    at = _folder(t)
    t.spark.dataSource.register(readers.ExternalRecords)
    days = t.events.select(F.col("event_id").alias("record_id"), (F.col("event_id") % 30).alias("changed_day"), F.col("event_type").alias("kind"), (F.col("event_id") % 30).alias("day"))
    for upto in (10, 11, 30):
        part = days.where((F.col("day") < upto) & (F.col("day") >= {10: 0, 11: 10, 30: 11}[upto]))
        part.write.mode("append").partitionBy("day").json(f"{at}/exports")
        stream = t.spark.readStream.format("external_records").option("system", "sap").option("exports", f"{at}/exports").load()
        jobs.run(stream, f"{at}/out", f"{at}/state").awaitTermination()
    rows = t.spark.read.schema(stream.schema).parquet(f"{at}/out")
    return rows.groupBy("record_id", "record_type", "changed_day", F.col("data")["kind"].alias("kind")).agg(F.count("*").cast("int").alias("times"))
