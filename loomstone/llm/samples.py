"""Bounded labelled samples for fitting, folds by checksum, and small numeric helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key falls into part 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(parts)), F.lit(0))


def bounded(rows: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label at most, chosen by a hash of ``key``, so the choice does not depend on order.

    The counts of labels are collected (labels are classes, not data); beyond them nothing is.
    """
    counts = [r for r in rows.groupBy(label).count().collect() if r[0] is not None]
    if not counts:
        return rows.limit(0)
    keep = F.lit(False)
    for name, n in counts:
        share = min(1.0, per_label / n)
        keep = keep | ((F.col(label) == F.lit(name)) & (F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    return rows.where(keep)


def sums_by(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` (one- or two-dimensional) by ascending ``owner``, for owners 0..n-1."""
    out = np.zeros((n, *values.shape[1:]), np.float64)
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[first]] = np.add.reduceat(values, first, axis=0)
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
