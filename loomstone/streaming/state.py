"""Streams with state and timers of their own: stale jobs, and the exact rate limit.

Both wait for the watermark before they decide, so the order in which rows arrive does not matter, and both keep state in the
state store only for as long as a decision can depend on it. A restart from the checkpoint goes on where the last batch ended.
They need the RocksDB state store (``stateful`` sets it for the queries that are started next).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomstone.operators.governance import REQUESTS_PER_MINUTE, STALE_MINUTES

#: Buckets of keys that share a state and a timer.
BUCKETS = 1024
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """Queries started from now on keep state in RocksDB, which timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _micros(at: pd.Series) -> pd.Series:
    return at.astype("datetime64[us]").astype("int64")


class _Waiting(StatefulProcessor):
    """Rows of a bucket of keys held until the watermark has passed them, then handed on by key, in order of (at, id).

    A call for a key costs some milliseconds whatever it does, so one call serves a bucket; it has one timer, the first that a
    row needs.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "key string, at long, id long, what string")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, micros: int) -> None:
        """The bucket's timer, at ``micros`` or earlier."""
        at = micros // 1000 + 1
        now = self.timer.get()
        if now is None or at < now[0]:
            if now is not None:
                self.handle.deleteTimer(now[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        text = lambda column: [x if isinstance(x, str) else None for x in column]
        for r in rows:
            at = _micros(r["at"])
            self.waiting.appendList(list(zip(text(r["client"]), at.tolist(), r["id"].tolist(), text(r["what"]), strict=True)))
            first = int(at.min()) if first is None else min(first, int(at.min()))
        if first is not None:
            self._wake(self.due(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held: dict[str | None, list[tuple]] = {}
        for k, *row in self.waiting.get():
            held.setdefault(k, []).append(tuple(row))
        out, rest = [], []
        self.before()
        for k, rows in held.items():
            found, left = self.decide(k, sorted(rows), until)
            out += [(k, *x) for x in found]
            rest += [(k, *x) for x in left]
        self.after(until)
        if rest:
            self.waiting.put(rest)
            self._wake(min((self.due(r[1]) for r in rest if self.waits(r[1:])), default=until + 86_400_000_000))
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "result"])

    def due(self, at: int) -> int:
        """When a row can be decided on."""
        return at

    def waits(self, row: tuple) -> bool:
        """Whether a row is still to be decided on."""
        return True

    def decide(self, key: str | None, held: list[tuple], until: int) -> tuple[list[tuple], list[tuple]]:
        """(ids and results, rows to hold on to) of a key once the watermark is at ``until``."""
        raise NotImplementedError

    def before(self) -> None:
        """Called before the decisions of a bucket."""

    def after(self, until: int) -> None:
        """Called after them."""

    def close(self) -> None:
        pass


class _Limiter(_Waiting):
    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle) -> None:
        super().init(handle)
        self.allowed = handle.getListState("allowed", "key string, at long")

    def before(self):
        self.kept: dict[str | None, list[int]] = {}
        for key, at in self.allowed.get():
            self.kept.setdefault(key, []).append(at)

    def decide(self, key, held, until):
        kept, out, i = sorted(self.kept.get(key, [])), [], 0
        while i < len(held) and held[i][0] <= until:
            at = held[i][0]
            kept = [k for k in kept if at - k < self.window]
            good = len(kept) < self.limit
            if good:
                kept.append(at)
            out.append((held[i][1], str(good).lower()))
            i += 1
        self.kept[key] = kept
        return out, held[i:]

    def after(self, until):
        """Requests to come are later than the watermark, so allowed ones a window before it no longer count."""
        kept = [(key, at) for key, ats in self.kept.items() for at in ats if until - at < self.window]
        if kept:
            self.allowed.put(kept)
        else:
            self.allowed.clear()


class _Stale(_Waiting):
    """``what`` is "start" for a job taken into work and anything else for one that went on."""

    def __init__(self, patience: int):
        self.patience = patience

    def due(self, at: int) -> int:
        return at + self.patience

    def waits(self, row) -> bool:
        return row[2] == "start"

    def decide(self, key, held, until):
        moves = [r[0] for r in held if r[2] != "start"]
        out, rest = [], []
        for r in held:
            if r[2] != "start":
                if r[0] + self.patience > until:
                    rest.append(r)
            elif self.due(r[0]) > until:
                rest.append(r)
            elif (i := bisect_left(moves, r[0])) == len(moves) or moves[i] > self.due(r[0]):
                out.append((r[1], "FAILED"))
        least = min((r[0] for r in rest if r[2] == "start"), default=None)
        return out, [r for r in rest if r[2] == "start" or least is None or r[0] >= least]


def _run(stream: DataFrame, processor: StatefulProcessor, at: str, late: str, buckets: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64("client"), F.lit(buckets)).alias("bucket")
    rows = stream.withWatermark(at, late).select("*", bucket).groupBy("bucket")
    return rows.transformWithStateInPandas(statefulProcessor=processor, outputStructType="key string, id long, result string", outputMode="Append", timeMode="EventTime")


def rate_limited(requests: DataFrame, *, client: str, at: str, key: str, limit: int = REQUESTS_PER_MINUTE, window: float = 60.0, late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """(client, key, allowed) of a stream of requests by a sliding window in which rejected ones do not count.

    A request is decided on when the watermark has passed it; of a client the requests after the watermark and the allowed
    ones of the last window (``limit`` at most) are held. Requests at one time go by their keys (longs). Clients (of a simple
    type) share the state of a bucket; a checkpoint keeps its number of buckets.
    """
    rows = requests.selectExpr(f"CAST(`{client}` AS STRING) AS client", f"`{at}` AS at", f"CAST(`{key}` AS LONG) AS id", "CAST(NULL AS STRING) AS what")
    out = _run(rows, _Limiter(limit, int(window * 1_000_000)), "at", late, buckets)
    return out.selectExpr(f"CAST(key AS {requests.schema[client].dataType.simpleString()}) AS `{client}`", f"id AS `{key}`", "result = 'true' AS allowed")


def stale_jobs(events: DataFrame, *, job: str, at: str, key: str, state: str, working: str = "PROCESSING", minutes: int = STALE_MINUTES, late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """(job, key, status): events that took a job into work (state ``working``) and were followed by no other within ``minutes``.

    A job's timer fires when the watermark is ``minutes`` past such an event; nothing is scanned again. Other events of a job
    are held only as long as an undecided one may need them. Jobs (of a simple type) share the state of a bucket.
    """
    rows = events.selectExpr(f"CAST(`{job}` AS STRING) AS client", f"`{at}` AS at", f"CAST(`{key}` AS LONG) AS id", f"CASE WHEN `{state}` = '{working}' THEN 'start' ELSE 'move' END AS what")
    out = _run(rows, _Stale(minutes * 60_000_000), "at", late, buckets)
    return out.selectExpr(f"CAST(key AS {events.schema[job].dataType.simpleString()}) AS `{job}`", f"id AS `{key}`", "result AS status")
