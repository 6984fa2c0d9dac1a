"""Operator 13: whitened leading components of embeddings by incremental eigendecomposition.

Entries c become the whole numbers floor(1024 c) + 100000, and every figure is about these. A partition keeps the spectrum
(eigenvalues and eigenvectors) of the scatter of the rows it has seen: a block of rows is centred and reduced to a triangular
factor, whose at most d rows are rank-one updates, and one more update moves the mean. An update solves the secular equation
of the eigenvalues between the old ones, after deflation (directions it does not touch stay, equal eigenvalues are rotated
onto one), and takes the eigenvectors from a vector fitted to the roots found, which keeps them orthogonal. Spectra of
partitions are combined by successive rank-one updates, a few to a task, until one is left. Its basis then is refined by
Rayleigh-Ritz: a pass sums the covariance within the basis, whose small eigenproblem is solved, so that the components are
good to double precision; another pass measures how far the whitened rows are from unit covariance.

What reaches the driver are single spectra: d * d numbers, whatever the number of rows.

Defined results: rows whose vector is null or empty or holds null or non-finite entries go, and an empty table gives no row;
null and repeated keys stay one row each; equal rows count as often as they occur; other columns are ignored. Components
without variance (an eigenvalue that is rounding error beside the largest) have no whitened value and give no row, so a single
row, or equal rows only, give none. Components are signed so that their largest entry is positive. Vectors of different
lengths, and entries beyond 2 ** 43, are an error.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import shared

#: Entries of the rows that are reduced to one triangular factor (at least twice as many rows as entries in a row), and spectra that one task combines.
BLOCK, FAN = 1 << 20, 16
EPS = np.finfo(float).eps


def _roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ascending, distinct d and positive z2: each root of 1 + sum(z2 / (d - x)) as (index of the nearest d, distance from it).

    Root i lies between d[i] and d[i + 1], the last within sum(z2) above d[-1]. Distances are found by bisection of their
    logarithm, so that tiny ones keep their relative precision.
    """
    k = len(d)
    gap = np.append(np.diff(d), z2.sum())
    middle = d + gap / 2
    left = 1 + (z2 / (d - middle[:, None])).sum(1) >= 0
    left[-1] = True
    base = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    delta, sign = d - d[base][:, None], np.where(left, 1.0, -1.0)
    high = np.where(np.arange(k) == k - 1, gap, gap / 2)
    other = z2.sum() / np.minimum(gap, np.append(np.inf, gap[:-1])) * 2
    low = np.minimum(z2[base] / (1 + other) / 4, high)
    low, high = np.log2(np.maximum(low, 1e-300)), np.log2(high)
    for _ in range(64):
        half = (low + high) / 2
        at = sign * np.exp2(half)
        above = (1 + (z2 / (delta - at[:, None])).sum(1) >= 0) == left
        high, low = np.where(above, half, high), np.where(above, low, half)
    return base, sign * np.exp2((low + high) / 2)


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum (ascending values, vectors in columns) of ``vectors diag(values) vectors' + rho v v'``, for rho >= 0."""
    z = vectors.T @ v
    size = float(z @ z)
    if rho * size <= 0:
        return values, vectors
    z, rho = z / np.sqrt(size), rho * size
    values, vectors = values.copy(), vectors.copy()
    small = 8 * EPS * max(float(np.abs(values).max()), rho)
    kept = []
    for i in np.flatnonzero(rho * np.abs(z) > small).tolist():
        if kept:
            j = kept[-1]
            r = np.hypot(z[i], z[j])
            c, s = z[i] / r, -z[j] / r
            if abs((values[i] - values[j]) * c * s) <= small:
                z[i], z[j] = r, 0.0
                vectors[:, [j, i]] = np.stack([vectors[:, j] * c + vectors[:, i] * s, vectors[:, i] * c - vectors[:, j] * s], 1)
                values[j], values[i] = values[j] * c * c + values[i] * s * s, values[j] * s * s + values[i] * c * c
                kept.pop()
        kept.append(i)
    if kept:
        kept = np.array(kept)
        d, zk = values[kept], z[kept]
        base, mu = _roots(d, rho * zk * zk)
        apart = (d[base] - d[:, None]) + mu  # [j, i]: root i minus d[j]
        # the vector of which the roots found are exact: products over all roots and all other d
        between = d[None, :] - d[:, None]
        np.fill_diagonal(between, 1.0)
        ratio = apart.copy()
        n = len(d)
        for j in range(n):
            ratio[j, :j] /= between[j, :j]
            ratio[j, j : n - 1] /= between[j, j + 1 :]
        fitted = np.sqrt(np.abs(np.prod(ratio, axis=1)))
        turned = np.copysign(fitted, zk)[:, None] / apart
        turned /= np.linalg.norm(turned, axis=0)
        values[kept], vectors[:, kept] = d[base] + mu, vectors[:, kept] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Rows seen, their exact sums, and the spectrum of their scatter about the mean (entries less 100000)."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.values, self.vectors = n, sums, values, vectors

    @staticmethod
    def empty(d: int) -> Spectrum:
        return Spectrum(0, np.zeros(d, np.int64), np.zeros(d), np.eye(d))

    def _move(self, n: int, sums: np.ndarray) -> None:
        """The update for the distance of two means; n and sums of the other rows join this one's."""
        if self.n and n:
            apart = sums / n - self.sums / self.n
            self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.n * n / (self.n + n))
        self.n, self.sums = self.n + n, self.sums + sums

    def add(self, rows: np.ndarray) -> None:
        """A block of rows (whole numbers less 100000)."""
        sums = rows.sum(0)
        for v in np.linalg.qr(rows - sums / len(rows), mode="r"):
            self.values, self.vectors = rank_one(self.values, self.vectors, v)
        self._move(len(rows), sums)

    def merge(self, other: Spectrum) -> None:
        for e, v in zip(other.values.tolist(), other.vectors.T, strict=True):
            self.values, self.vectors = rank_one(self.values, self.vectors, v, max(e, 0.0))
        self._move(other.n, other.sums)

    SCHEMA = "part long, n long, sums binary, spread binary, basis binary"

    def row(self, part: int) -> pa.Table:
        return _row(part, self.n, self.sums, self.values, self.vectors)

    @staticmethod
    def of(r: dict) -> Spectrum:
        values = np.frombuffer(r["spread"])
        return Spectrum(r["n"], np.frombuffer(r["sums"], np.int64).copy(), values.copy(), np.frombuffer(r["basis"]).reshape(len(values), -1).copy())


def _row(part: int, n: int, sums: np.ndarray, spread: np.ndarray, basis: np.ndarray) -> pa.Table:
    data = {k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in (("sums", sums), ("spread", spread), ("basis", basis))}
    return pa.table({"part": pa.array([part], pa.int64()), "n": pa.array([n], pa.int64())} | data)


def _one(rows: DataFrame, merge, parts: int) -> dict | None:
    """Rows of ``parts`` partitions combined a few to a task, level by level, until one is left."""
    while True:
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN))

        def run(key, group):
            shared.tidy()
            return merge(key[0].as_py(), sorted(group.to_pylist(), key=lambda r: (r["n"], r["sums"], r["spread"], r["basis"])))

        rows, parts = rows.groupBy("part").applyInArrow(run, Spectrum.SCHEMA), -(-parts // FAN)
        if parts <= 1:
            found = rows.first()
            return None if found is None else found.asDict()


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Whole numbers (less 100000) of a list column without nulls."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(1024 * flat).astype(np.int64).reshape(-1, d)


def _partition(d: int, block: int):
    from pyspark import TaskContext

    def run(batches):
        shared.tidy()
        state, held, size = Spectrum.empty(d), [], 0
        for b in batches:
            held.append(_matrix(b.column("x"), d))
            size += len(held[-1])
            while size >= block:
                rows = np.concatenate(held)
                state.add(rows[:block])
                held, size = [rows[block:]], size - block
        if size:
            state.add(np.concatenate(held))
        if state.n:
            yield from state.row(TaskContext.get().partitionId()).to_batches()

    return run


def _merged(part: int, rows: list[dict]) -> pa.Table:
    state = Spectrum.of(rows[-1])
    for r in rows[:-1]:
        state.merge(Spectrum.of(r))
    return state.row(part)


def _deviations(batch: pa.RecordBatch, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, which is the same for x less 100000."""
    return n * _matrix(batch.column("x"), len(sums)) - sums


def _moments(n: int, sums: np.ndarray, turn: np.ndarray):
    """Rows projected by ``turn``: per partition their number, mean and scatter about the mean."""
    from pyspark import TaskContext

    def run(batches):
        shared.tidy()
        k = turn.shape[1]
        state = [0, np.zeros(k), np.zeros((k, k))]
        for b in batches:
            y = _deviations(b, n, sums) / n @ turn
            if len(y):
                middle = y.mean(0)
                state = _joined(state, [len(y), middle, (y - middle).T @ (y - middle)])
        if state[0]:
            yield from _row(TaskContext.get().partitionId(), state[0], np.zeros(0, np.int64), state[1], state[2]).to_batches()

    return run


def _joined(a: list, b: list) -> list:
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return [n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)]


def _summed(part: int, rows: list[dict]) -> pa.Table:
    states = [[r["n"], np.frombuffer(r["spread"]), np.frombuffer(r["basis"]).reshape(len(r["spread"]) // 8, -1)] for r in rows]
    state = states[0]
    for s in states[1:]:
        state = _joined(state, s)
    return _row(part, state[0], np.zeros(0, np.int64), state[1], state[2])


def _covariance(rows: DataFrame, n: int, sums: np.ndarray, turn: np.ndarray, parts: int) -> np.ndarray:
    found = _one(rows.mapInArrow(_moments(n, sums, turn), Spectrum.SCHEMA), _summed, parts)
    return np.frombuffer(found["basis"]).reshape(turn.shape[1], -1) / n


def fit(rows: DataFrame, d: int, *, block: int | None = None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, int] | None:
    """(rows, exact sums less 100000 each, falling eigenvalues, components in columns, partitions) of a list column ``x``."""
    parts = rows.rdd.getNumPartitions()
    found = _one(rows.mapInArrow(_partition(d, block or max(2 * d, BLOCK // d)), Spectrum.SCHEMA), _merged, parts)
    if found is None:
        return None
    state = Spectrum.of(found)
    basis = np.linalg.qr(state.vectors)[0]
    inner, turn = np.linalg.eigh(_covariance(rows, state.n, state.sums, basis, parts))
    vectors = basis @ turn[:, ::-1]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(d)])
    return state.n, state.sums, inner[::-1], vectors, parts


def _results(n: int, sums: np.ndarray, turn: np.ndarray, explained: np.ndarray, error: float):
    k = turn.shape[1]

    def run(batches):
        shared.tidy()
        for b in batches:
            if not b.num_rows:
                continue
            y = _deviations(b, n, sums)
            largest = int(max(y.max(initial=0), -y.min(initial=0)))
            if largest * largest * max(1, y.shape[1]) < 1 << 63:
                deviation = pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([Decimal(sum(int(v) ** 2 for v in r)) for r in y.tolist()], pa.decimal128(38, 0))
            row = np.repeat(np.arange(len(y)), k)
            yield pa.record_batch({
                "key": b.column("key").take(pa.array(row)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), "n": pa.array(np.full(len(row), n)),
                "deviation": deviation.take(pa.array(row)), "whitened": pa.array((y / n @ turn).reshape(-1)), "explained": pa.array(np.tile(explained, len(y))), "identity_error": pa.array(np.full(len(row), error)),
            })

    return run


def whiten(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = 8, block: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error: a row for each vector and component."""
    shared.small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.where((F.size("x") > 0) & F.forall("x", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    seen = rows.agg(F.min(F.size("x")), F.max(F.size("x")), F.max(F.aggregate("x", F.lit(0.0), lambda m, c: F.greatest(m, F.abs(c))))).first()
    empty = vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    if seen[0] is None:
        return empty
    if seen[0] != seen[1]:
        raise ValueError(f"vectors of {seen[0]} to {seen[1]} entries")
    if seen[2] >= 2.0**43:
        raise ValueError("entries beyond 2 ** 43")
    d = seen[1]
    n, sums, values, basis, parts = fit(rows, d, block=block)
    k = min(components, int((values > d * 16 * EPS * max(values[0], 0.0)).sum()))
    if not k:
        return empty
    turn = basis[:, :k] / np.sqrt(values[:k])
    error = float(np.abs(_covariance(rows, n, sums, turn, parts) - np.eye(k)).max())
    return rows.mapInArrow(_results(n, sums, turn, values[:k] / values.sum(), error), schema).withColumnRenamed("key", key)
