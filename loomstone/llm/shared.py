"""Shared folders, materialised tables and Arrow helpers used by every operator of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.session import delete_at_exit, shared_folder

#: Arrow batches handed to Python stay small even when single texts are long.
ARROW_ROWS = 1000


_MARKED: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the folder that driver and executors share; removed when the application ends."""
    root = f"{shared_folder(spark).rstrip('/')}/loomstone-{spark.sparkContext.applicationId}"
    if root not in _MARKED:
        delete_at_exit(spark, root)
        _MARKED.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut, and losing executors costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Keys that hold more than one in so many rows are hot; there are fewer of them than this.
HOT_KEYS = 10_000


def hot(rows: DataFrame, key: str, count: str | None = None, least: int = 1000) -> DataFrame | None:
    """(key, salts) of the keys that hold more than ``least`` rows and more than one in ``HOT_KEYS``; None if there is none.

    ``salts`` is in how many parts a key is dealt, so that none is larger than that. ``count`` names a column that already
    counts the rows of a key, which then is unique. Fewer than ``HOT_KEYS`` keys come back, whatever the input.
    """
    total = rows.agg(F.sum(count) if count else F.count("*")).first()[0] or 0
    most = max(least, -(-total // HOT_KEYS))
    if total <= most:
        return None
    counted = rows.select(key, F.col(count).alias("__n")) if count else rows.groupBy(key).agg(F.count("*").alias("__n"))
    found = written(counted.where(F.col("__n") > most).select(key, F.ceil(F.col("__n") / most).cast("int").alias("__salts")), "hot")
    return None if found.isEmpty() else found


def salted(left: DataFrame, right: DataFrame, on: list[str], heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique: rows of the hot keys (of ``on[0]``) are dealt over their salts.

    The rows of ``right`` for a hot key are repeated, in all at most twice ``HOT_KEYS`` times for each value of the other keys.
    """
    if heavy is None:
        return left.join(right, on, how)
    few = F.broadcast(heavy)
    salts = F.coalesce("__salts", F.lit(1))
    dealt = left.join(few, on[0], "left").withColumn("__salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("__salts")
    repeated = right.join(few, on[0], "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return dealt.join(repeated, [*on, "__salt"], how).drop("__salt")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive (never raised, only lowered)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000") or 0) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def filesystem(uri: str):
    """A pyarrow filesystem and the path in it, for writing plain files from tasks to the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def publish(uri: str, data_writer) -> None:
    """Write a file under a private name, then move it to ``uri``: retried and speculative attempts can't mix.

    Attempts of one task write equal bytes, so whichever move comes last changes nothing.
    """
    files, path = filesystem(uri)
    private = f"{path}.{uuid.uuid4().hex}"
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(private) as out:
        data_writer(out)
    files.move(private, path)


#: What worker processes keep between tasks, by owner: functions that let go of it.
_KEPT: dict[str, object] = {}


def kept(owner: str):
    """A function's result stays in the worker process for ``owner``'s next tasks, until another operator's task starts."""

    def wrap(f):
        held = lru_cache(maxsize=1)(f)
        _KEPT[owner] = held.cache_clear
        return held

    return wrap


def tidy(owner: str | None = None) -> None:
    """Let go of what other operators kept in this worker process, and give free memory back to the system."""
    for name, clear in _KEPT.items():
        if name != owner:
            clear()
    gc.collect()
    trim()


def trim() -> None:
    """Give free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def worker(f, owner: str | None = None):
    """A function of batches that starts from a tidy process."""

    def run(batches):
        tidy(owner)
        yield from f(batches)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
