"""Running the engine: backups with refusal and verification, health probes, and identities."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import governance as gv

HEALTHY, DEGRADED, UNAVAILABLE, NOT_CONFIGURED = "HEALTHY", "DEGRADED", "UNAVAILABLE", "NOT_CONFIGURED"


class Refused(RuntimeError):
    """An operation that would overwrite or lose data."""


# backups ----------------------------------------------------------------------------------------------------------
def occupied(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds any file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getContentSummary(at).getFileCount() > 0


def back_up(files: DataFrame, folder: str) -> DataFrame:
    """Write files (path, content) as an archive with its manifest (path, length, sha256); returns the manifest."""
    spark = files.sparkSession
    if occupied(spark, folder):
        raise Refused(f"backup folder holds files: {folder}")
    files.select("path", "content").write.parquet(f"{folder}/files")
    stored = spark.read.parquet(f"{folder}/files")
    stored.select("path", F.length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256")).orderBy("path").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """(path, status) of an archive's files against its manifest."""
    files = spark.read.parquet(f"{folder}/files").select("path", F.sha2("content", 256).alias("sha256"))
    return gv.manifest_check(files, spark.read.parquet(f"{folder}/manifest"))


def expired(backups: DataFrame, keep: int, *, at: str = "created_at", name: str = "name") -> DataFrame:
    """The backups beyond the ``keep`` latest (of equal times and names all, if one of them is beyond).

    The last one to keep comes from a sort that holds ``keep`` rows of each task; the others are found by comparing with it.
    """
    last = backups.select(F.col(at).alias("__at"), F.col(name).alias("__name")).orderBy(F.desc("__at"), F.desc("__name")).limit(keep).orderBy("__at", "__name").limit(1)
    older = (F.col(at) < F.col("__at")) | (F.col(at) == F.col("__at")) & (F.col(name) < F.col("__name")) | F.col(at).isNull() & F.col("__at").isNotNull()
    return backups.join(F.broadcast(last), older).drop("__at", "__name") if keep else backups


def write_files(files: DataFrame, target: str) -> DataFrame:
    """Write files (path, content) below a shared folder, each under a private name and then moved; (path, sha256) as read back."""

    def run(batches):
        import hashlib
        import uuid

        from pyarrow import fs

        disk, root = fs.FileSystem.from_uri(target)
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                at = f"{root.rstrip('/')}/{path}"
                disk.create_dir(at.rsplit("/", 1)[0], recursive=True)
                private = f"{at}.{uuid.uuid4().hex}"
                with disk.open_output_stream(private) as f:
                    f.write(bytes(content))
                disk.move(private, at)
                with disk.open_input_stream(at) as f:
                    out.append((path, hashlib.sha256(f.read()).hexdigest()))
            yield pd.DataFrame(out, columns=["path", "sha256"])

    return files.select("path", "content").mapInPandas(run, "path string, sha256 string")


def restore(spark: SparkSession, folder: str, target: str, *, force: bool = False) -> DataFrame:
    """Write an archive's files below ``target``; (path, status) of every file as read back against the manifest.

    Refused where the target holds files, unless forced, and where the archive does not match its manifest, forced or not.
    Names that lead out of the target are refused too. Files are written when the result is.
    """
    if not force and occupied(spark, target):
        raise Refused(f"restore target holds files: {target}")
    files = spark.read.parquet(f"{folder}/files")
    bad = verified(spark, folder).where("status <> 'OK'").limit(1).collect()
    if bad:
        raise Refused(f"backup does not match its manifest: {bad[0].path} is {bad[0].status}")
    if not files.where(F.col("path").rlike(r"^/|(^|/)\.\.(/|$)")).isEmpty():
        raise Refused("backup holds names that lead out of the target")
    return gv.manifest_check(write_files(files, target), spark.read.parquet(f"{folder}/manifest"))


# health -----------------------------------------------------------------------------------------------------------
def probe(name: str, check: Callable[[], str | None] | None, *, required: bool = True) -> tuple[str, str, str | None, bool, float]:
    """(component, status, detail, required, milliseconds); a check returns nothing when well and a reason when degraded."""
    if check is None:
        return name, NOT_CONFIGURED, None, required, 0.0
    began = time.perf_counter()
    try:
        reason = check()
        status = DEGRADED if reason else HEALTHY
    except Exception as e:  # whatever a component raises is its state, not the probe's
        status, reason = UNAVAILABLE, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return name, status, reason, required, round((time.perf_counter() - began) * 1000, 1)


def probes(spark: SparkSession, checks: dict[str, Callable[[], str | None] | None], *, optional: tuple[str, ...] = ()) -> DataFrame:
    """One row per component: component, status, detail, required, latency_ms."""
    rows = [probe(name, check, required=name not in optional) for name, check in checks.items()]
    return spark.createDataFrame(rows, "component string, status string, detail string, required boolean, latency_ms double")


def built_in(spark: SparkSession, tables: dict[str, str], folder: str) -> dict[str, Callable[[], str | None]]:
    """Checks of executors, of the shared folder, of tables (name to path) and of running streams."""

    def executors():
        return None if spark.range(0, 100, 1, 4).selectExpr("sum(id) AS s").first().s == 4950 else "wrong result"

    def storage():
        spark.range(3).write.mode("overwrite").parquet(f"{folder}/probe")
        return None if spark.read.parquet(f"{folder}/probe").count() == 3 else "rows were lost"

    def table(path):
        return lambda: "empty" if spark.read.parquet(path).isEmpty() else None

    def streams():
        failed = [q.name or q.id for q in spark.streams.active if q.exception() is not None]
        return f"failed: {failed}" if failed else None

    return {"executors": executors, "storage": storage, **{f"table {n}": table(p) for n, p in tables.items()}, "streams": streams}


def health(probed: DataFrame) -> DataFrame:
    """(status): DOWN if a required component is unavailable, DEGRADED if any is not well, else UP."""
    down = F.coalesce(F.bool_or(F.col("required") & (F.col("status") == UNAVAILABLE)), F.lit(False))
    weak = F.coalesce(F.bool_or(F.col("status").isin(DEGRADED, UNAVAILABLE)), F.lit(False))
    return probed.agg(F.when(down, "DOWN").when(weak, "DEGRADED").otherwise("UP").alias("status"))


class Spans:
    """Timed operations: name, attributes, milliseconds, and OK or the error that went through."""

    def __init__(self):
        self.rows: list[tuple] = []

    @contextmanager
    def timed(self, operation: str, **attributes):
        """What is set on the yielded dictionary is kept with the span; errors are noted and go on."""
        began, status, error = time.perf_counter(), "OK", None
        try:
            yield attributes
        except BaseException as e:
            status, error = "ERROR", f"{type(e).__name__}: {e}"
            raise
        finally:
            self.rows.append((len(self.rows) + 1, operation, status, error, {k: str(v) for k, v in attributes.items()}, round((time.perf_counter() - began) * 1000, 1)))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "span int, operation string, status string, error string, attributes map<string,string>, latency_ms double")


# identities -------------------------------------------------------------------------------------------------------
def secret(salt: Column, password: Column) -> Column:
    """What is stored of a password (repeated, salted SHA-256)."""
    once = lambda x: F.sha2(F.concat_ws(":", salt, x), 256)
    out = once(password)
    for _ in range(8):
        out = once(out)
    return out


def authenticated(attempts: DataFrame, users: DataFrame, provider: str = "local") -> DataFrame:
    """Attempts (attempt_id, username, password) with user_id, roles and status.

    ``users`` has username, user_id, salt, secret, active and roles. Unknown users and wrong passwords read alike. Other
    providers than the local one need a directory that is not here: they fail closed.
    """
    if provider != "local":
        return attempts.select("attempt_id", F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("array<string>").alias("roles"), F.lit("PROVIDER_UNAVAILABLE").alias("status"))
    both = attempts.join(users.withColumnRenamed("username", "__name"), F.lower("username") == F.lower("__name"), "left")
    right = F.coalesce(secret(F.col("salt"), F.col("password")) == F.col("secret"), F.lit(False))
    ok = right & F.col("active")
    status = F.when(ok, "OK").when(right, "INACTIVE").otherwise("INVALID_CREDENTIALS")
    return both.select("attempt_id", F.when(ok, F.col("user_id")).alias("user_id"), F.when(ok, F.col("roles")).alias("roles"), status.alias("status"))
