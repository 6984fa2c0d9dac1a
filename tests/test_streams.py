"""Timers, the rate limit and offsets of streams against brute force, in several batches and over restarts."""

import json
import random
from datetime import datetime, timedelta

from loomstone.sources import readers
from loomstone.streaming import jobs, state

START = datetime(2024, 1, 1)


def batches(spark, tmp_path, parts, schema, shape):
    """What a stream writes that is stopped and started again after each part."""
    at = f"file://{tmp_path}"
    state.stateful(spark)
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{at}/in")
        out = shape(jobs.events(spark, f"{at}/in", spark.createDataFrame([], schema), files_per_batch=1000))
        jobs.run(out, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out").collect()


def limited(rows, limit, window):
    out, kept = {}, {}
    for at, key, client in sorted((at, key, client) for key, client, at in rows):
        own = kept[client] = [k for k in kept.get(client, []) if (at - k).total_seconds() < window]
        out[key] = len(own) < limit
        if out[key]:
            own.append(at)
    return out


def test_rate_limit_of_unordered_requests(spark, tmp_path):
    """Each part is shuffled and reaches back an hour into the part before."""
    rng, rows = random.Random(1), []
    parts = []
    for p in range(3):
        part = [(1000 * p + i, rng.choice([1, 2, 3, None]), START + timedelta(seconds=p * 7200 - 3000 * (i % 2) + rng.randint(0, 3500))) for i in range(150)]
        rows += part
        parts.append(part)
    parts.append([(10**6, 9, START + timedelta(days=9))])
    shape = lambda s: state.rate_limited(s, client="client", at="ts", key="id", limit=4, window=600.0, late="2 hours")
    got = batches(spark, tmp_path, parts, "id long, client long, ts timestamp", shape)
    assert {r.id: r.allowed for r in got} == limited(rows, 4, 600) and len(got) == len(rows)


def test_stale_jobs_by_timers(spark, tmp_path):
    rng, rows, parts = random.Random(2), [], []
    for p in range(3):
        part = [(1000 * p + i, rng.randint(0, 12), START + timedelta(minutes=p * 400 - 100 * (i % 2) + rng.randint(0, 399)), rng.choice(["PROCESSING", "DONE"])) for i in range(80)]
        rows += part
        parts.append(part)
    parts.append([(10**6, 99, START + timedelta(days=9), "DONE")])
    shape = lambda s: state.stale_jobs(s, job="job", at="ts", key="id", state="state", minutes=30, late="3 hours")
    got = batches(spark, tmp_path, parts, "id long, job long, ts timestamp, state string", shape)
    stale = {i for i, j, at, s in rows if s == "PROCESSING" and not any(k == j and x != "PROCESSING" and at <= b <= at + timedelta(minutes=30) for _, k, b, x in rows)}
    assert {r.id for r in got} == stale and len(got) == len(stale) and stale


def test_exports_are_pulled_once_over_restarts(spark, tmp_path):
    spark.dataSource.register(readers.ExternalRecords)
    folder = tmp_path / "exports"
    put = lambda day, name, ids: ((folder / f"day={day}").mkdir(parents=True, exist_ok=True), (folder / f"day={day}" / name).write_text("".join(json.dumps({"record_id": i, "changed_day": day}) + "\n" for i in ids)))

    def pull():
        stream = spark.readStream.format("external_records").option("system", "dms").option("exports", f"file://{folder}").load()
        jobs.run(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
        return sorted(int(r.record_id) for r in spark.read.schema(stream.schema).parquet(f"file://{tmp_path}/out").collect())

    folder.mkdir()
    assert pull() == []
    put(3, "a.json", [1, 2])
    put(12, "a.json", [3])
    assert pull() == [1, 2, 3]
    put(12, "b.json", [4])
    put(12, "_part.json", [99])
    assert pull() == [1, 2, 3, 4] and pull() == [1, 2, 3, 4]
    put(13, "a.json", [5])
    put(101, "a.json", [6])
    assert pull() == [1, 2, 3, 4, 5, 6]



def test_state_is_kept_by_bucket_and_not_by_key(spark, tmp_path):
    """Two buckets serve three hundred jobs, in state rows as few as the undecided events."""
    rows = [(i, i // 2, START + timedelta(minutes=i % 50), "PROCESSING" if i % 3 else "DONE") for i in range(600)]
    shape = lambda s: state.stale_jobs(s, job="job", at="ts", key="id", state="state", minutes=30, late="1 hour", buckets=2)
    got = batches(spark, tmp_path, [rows, [(10**6, -1, START + timedelta(days=9), "DONE")]], "id long, job long, ts timestamp, state string", shape)
    stale = {i for i, j, at, s in rows if s == "PROCESSING" and not any(k == j and x != "PROCESSING" and at <= b <= at + timedelta(minutes=30) for _, k, b, x in rows)}
    assert {r.id for r in got} == stale and {r.job for r in got} == {i // 2 for i in stale}
    kept = spark.read.format("statestore").option("path", f"file://{tmp_path}/state").option("stateVarName", "timer").load()
    assert kept.count() <= 2
