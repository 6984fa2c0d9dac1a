"""Sequential folds per key, many keys to a task: one Python call per key would cost more than the fold."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many rows a bucket of keys holds on average; a bucket, with all rows of its keys, is what a task holds at once.
BUCKET_ROWS = 20_000


def in_buckets(rows: DataFrame, key: str, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` applied to buckets of rows that hold all rows of their keys; their number follows the counted rows."""
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET_ROWS))
    return rows.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).groupBy("__bucket").applyInPandas(lambda g: run(g.drop(columns="__bucket")), schema)


def in_order(rows: DataFrame, key: str, at: str, start: Callable[[], object], step: Callable[[object, object], object], name: str, kind: str) -> DataFrame:
    """``rows`` with a column ``name``: ``step(state, at)`` of each key's rows in the order of ``at``.

    Rows stream through their task in sorted batches; of a key only its state is held, however many rows it has.
    """
    place, when = rows.columns.index(key), rows.columns.index(at)

    def run(batches):
        now, state = object(), None
        for b in batches:
            out = []
            for k, x in zip(b.iloc[:, place].astype(object).where(b.iloc[:, place].notna(), None), b.iloc[:, when], strict=True):
                if k != now:
                    now, state = k, start()
                out.append(step(state, x))
            yield b.assign(**{name: out})

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{name}` {kind}"
    return rows.repartition(key).sortWithinPartitions(key, at).mapInPandas(run, schema)


def per_key(rows: DataFrame, key: str, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fold`` applied to the rows of every key (a null key is one), results together."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([fold(g) for _, g in group.groupby(key, sort=False, dropna=False)], ignore_index=True)

    return in_buckets(rows, key, run, schema)
