"""A deterministic hash embedding of texts, for when no neural model is present, and the incremental index over it."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import providers

DIM, MODEL = 384, "deterministic-hash"
#: Fixed value: weight of a word pair.
PAIR = 1.5


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", (text or "").lower())


def word_features(word: str) -> list[tuple[str, float]]:
    """(feature, weight) of a word: it under two seeds, its character trigrams."""
    base = math.log1p(len(word))
    return [(f"s0:{word}", base), (f"s1:{word}", base / 2), *((f"c:{word[i : i + 3]}", 0.4) for i in range(len(word) - 2))]


def features(text: str | None) -> list[tuple[str, float]]:
    """(feature, weight): those of the words, then word pairs."""
    found = words(text)
    return [f for w in found for f in word_features(w)] + [(f"b:{a}_{b}", PAIR) for a, b in zip(found, found[1:], strict=False)]


def place(feature: str, dim: int = DIM) -> tuple[int, int]:
    """(axis, sign) of a feature."""
    h = hashlib.sha256(feature.encode()).digest()
    return int.from_bytes(h[:4], "big") % dim, 1 if h[4] % 2 == 0 else -1


def places(features: list[str], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Axes and signs of features."""
    sha = hashlib.sha256
    h = np.frombuffer(b"".join([sha(f).digest() for f in map(str.encode, features)]), np.uint8).reshape(-1, 32)
    return h[:, :4].copy().view(">u4").ravel().astype(np.int64) % dim, 1 - 2 * (h[:, 4] % 2).astype(np.int64)


def _word_table(names: list[str], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many features words have, and the axes and signed weights of these, word after word, in the order of ``word_features``."""
    size = np.array([max(len(w), 2) for w in names], np.int64)
    first = np.cumsum(size) - size
    code, parts = pd.factorize(np.array([w[i : i + 3] for w in names for i in range(len(w) - 2)], object))
    third = np.ones(size.sum(), bool)
    third[first] = third[first + 1] = False
    axes, weights = np.empty(len(third), np.int64), np.empty(len(third))
    base = np.array([math.log1p(len(w)) for w in names], float)
    for at, weight, (axis, sign) in ((first, base, places([f"s0:{w}" for w in names], dim)), (first + 1, base / 2, places([f"s1:{w}" for w in names], dim))):
        axes[at], weights[at] = axis, weight * sign
    axis, sign = places([f"c:{c}" for c in parts], dim)
    axes[third], weights[third] = axis[code], 0.4 * sign[code]
    return size, axes, weights


def embed_all(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """One unit row per text, the first axis for an empty one; each distinct word, part of a word and pair is hashed once."""
    found = [words(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(row) for row in found])
    code, names = pd.factorize(np.array([w for row in found for w in row], object))
    names = names.tolist()
    size, axes, weights = _word_table(names, dim)
    n = size[code]
    at = np.repeat((np.cumsum(size) - size)[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    inside = owner[1:] == owner[:-1]
    pair, pairs = pd.factorize(code[:-1][inside] * len(names) + code[1:][inside])
    pair_axes, pair_signs = places([f"b:{names[p // len(names)]}_{names[p % len(names)]}" for p in pairs.tolist()], dim)
    # a text's words come before its pairs, as in ``features``
    axis = np.concatenate([np.repeat(owner, n) * dim + axes[at], owner[1:][inside] * dim + pair_axes[pair]])
    out = np.bincount(axis, np.concatenate([weights[at], PAIR * pair_signs[pair]]), len(texts) * dim).reshape(len(texts), dim)
    length = np.sqrt((out * out).sum(axis=1))
    out[length == 0, 0] = 1.0
    return out / np.where(length == 0, 1.0, length)[:, None]


def embed(text: str | None, dim: int = DIM) -> list[float]:
    return embed_all([text], dim)[0].tolist()


def _embed_series(texts: pd.Series) -> pd.Series:
    rows = [x if isinstance(x, str) else None for x in texts]
    return pd.Series([v for at in range(0, len(rows), 64) for v in embed_all(rows[at : at + 64])], index=texts.index, dtype=object)


def embed_column(text: Column) -> Column:
    """The hash embedding of a text column, by Arrow batches."""
    return F.pandas_udf(_embed_series, "array<float>")(text)


def missing(chunks: DataFrame, embeddings: DataFrame, model: str = MODEL, *, key: str = "id") -> DataFrame:
    """Chunks without an embedding of this model."""
    done = embeddings.where(F.col("model_name") == model).select(F.col("chunk_id").alias(key))
    return chunks.join(done, key, "left_anti")


def index(chunks: DataFrame, embeddings: DataFrame, model: str = MODEL, *, provider=embed_column, key: str = "id", content: str = "content") -> DataFrame:
    """Rows to append for chunks not yet embedded by the model."""
    new = missing(chunks, embeddings, model, key=key)
    return new.select(F.col(key).alias("chunk_id"), F.lit(model).alias("model_name"), provider(F.col(content)).alias("vector")).withColumn("dimensions", F.size("vector"))


def loaded(name: str, loaders: dict[str, Callable[[], Callable[[Column], Column]]]) -> tuple[Callable[[Column], Column], str, str]:
    """(provider, model name, status): the model of a setting if it can be loaded, else the hash embedding."""
    return providers.load(name, {**loaders, MODEL: lambda: embed_column}, MODEL)


def coverage(chunks: DataFrame, embeddings: DataFrame, *, key: str) -> DataFrame:
    """(total, embedded, coverage_pct) of chunks by distinct embedded chunk."""
    total = chunks.agg(F.countDistinct(key).alias("total"))
    done = embeddings.agg(F.countDistinct("chunk_id").alias("embedded"))
    pct: Column = F.when(F.col("total") > 0, F.round(F.col("embedded") / F.col("total") * 100, 2)).otherwise(0.0)
    return total.crossJoin(done).withColumn("coverage_pct", pct)
