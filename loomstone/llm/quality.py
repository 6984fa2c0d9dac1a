"""Operator 1: quality by ordinal cumulative-link regression on graded ratings.

A text is a hashed bag: byte trigrams of it as it stands (case, digits and punctuation included), weighted so that they
sum to one, and binned statistics (share of repeated words, of upper-case, of punctuation, word length, text length). All
grades share one weight vector; ``P(grade >= k) = sigmoid(f - cut_k)`` with rising cuts, fitted by gradient steps in numpy
on a bounded sample. A text gets its expected grade, every tail probability, and whether the tail from ``at_least`` on selects it.

Defined results: null and empty texts have only the statistics' features; without two grades among the ratings every text
gets the grade seen (0 if none) and is not selected; rows stay one to one, equal rows too; a text with several ratings
counts with its highest; ratings, languages, sources and keys are never inputs of a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import samples, shared, textblocks

BUCKETS, STATS, BINS = 1 << 15, 6, 16


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the byte trigrams of a block, borders of texts as spaces."""
    data, begins = textblocks.spaced(raw, offsets)
    x = np.concatenate([[0x20], data, [0x20]]).astype(np.uint32)
    n = len(x) - 2
    last = x[2:].copy()
    last[begins[1:] - 1] = 0x20
    code = ((x[:n] * np.uint32(0x01000193)) ^ x[1 : n + 1]) * np.uint32(0x01000193) ^ last
    code ^= code >> np.uint32(13)
    code *= np.uint32(0x85EBCA6B)
    return np.searchsorted(begins, np.arange(n), "right") - 1, (code >> np.uint32(17)).astype(np.int64)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One bin number per statistic and text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner, word = textblocks.words(raw, offsets)
    count = np.bincount(owner, minlength=n)
    order = np.lexsort((word, owner))
    o, w = owner[order], word[order]
    fresh = np.ones(len(o), bool)
    fresh[1:] = (o[1:] != o[:-1]) | (w[1:] != w[:-1])
    kinds = np.bincount(o[fresh], minlength=n)
    text = np.repeat(np.arange(n), size)
    share = lambda mask: np.bincount(text[mask], minlength=n) / np.maximum(size, 1)
    letter = ((raw | 0x20) >= 0x61) & ((raw | 0x20) <= 0x7A) | (raw >= 0x80)
    upper = (raw >= 0x41) & (raw <= 0x5A)
    values = [kinds / np.maximum(count, 1), share(upper), share(~letter & (raw > 0x20)), np.minimum(size / np.maximum(count, 1) / 16, 1), np.log2(size + 1) / 24, share(raw == 0x0A) * 8]
    return np.stack([np.clip((v * BINS).astype(np.int64), 0, BINS - 1) + i * BINS for i, v in enumerate(values)], axis=1)


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    stats: np.ndarray
    cuts: np.ndarray

    def value(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for first, last, raw, offsets in textblocks.blocks(column, 1 << 19):
            owner, code = trigrams(raw, offsets)
            mean = samples.sums_by(owner, self.weights[code], last - first) / np.maximum(np.bincount(owner, minlength=last - first), 1)
            out[first:last] = mean + self.stats[statistics(raw, offsets)].sum(axis=1)
        return out

    def tails(self, column: pa.Array) -> np.ndarray:
        """P(grade >= k) for every grade but the lowest."""
        return samples.sigmoid(self.value(column)[:, None] - self.cuts)

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades)


def fit(texts: list[str], ratings: list[int], *, epochs: int = 12, batch: int = 32, rate: float = 0.5, ridge: float = 1e-5, seed: int = 3) -> Model | None:
    """Cumulative-link likelihood, Adagrad steps over shuffled batches, classes of equal total weight."""
    grades = sorted(set(ratings))
    if len(grades) < 2:
        return None
    level = np.searchsorted(grades, ratings)
    weight = len(level) / (len(grades) * np.bincount(level)[level])
    bags, bins = [], np.zeros((len(texts), STATS), np.int64)
    for first, last, raw, offsets in textblocks.blocks(pa.array(texts, pa.large_string())):
        owner, code = trigrams(raw, offsets)
        both, n = np.unique(owner * BUCKETS + code, return_counts=True)
        at = np.searchsorted(both, np.arange(last - first + 1) * BUCKETS)
        bags += [(both[a:b] % BUCKETS, n[a:b] / max(1, n[a:b].sum())) for a, b in zip(at[:-1], at[1:], strict=True)]
        bins[first:last] = statistics(raw, offsets)
    w, s = np.zeros(BUCKETS), np.zeros(STATS * BINS)
    first_cut, gaps = 0.0, np.zeros(len(grades) - 2)
    gw, gs, gc = np.full(BUCKETS, 1e-4), np.full(STATS * BINS, 1e-2), np.full(len(grades) - 1, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for pick in np.array_split(rng.permutation(len(texts)), -(-len(texts) // batch)):
            cuts = first_cut + np.concatenate([[0], np.cumsum(np.exp(gaps))])
            f = np.array([w[bags[i][0]] @ bags[i][1] for i in pick]) + s[bins[pick]].sum(axis=1)
            # likelihood of grade k is sigmoid(cut_k - f) - sigmoid(cut_(k-1) - f)
            edge = samples.sigmoid(np.concatenate([np.full((len(pick), 1), -60), cuts - f[:, None], np.full((len(pick), 1), 60)], axis=1))
            rows = np.arange(len(pick))
            hi, lo = edge[rows, level[pick] + 1], edge[rows, level[pick]]
            p = np.maximum(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
            scale = weight[pick] / len(pick)
            df = (dhi - dlo) * scale
            dcut = np.zeros((len(pick), len(grades) + 1))
            dcut[rows, level[pick] + 1] -= dhi * scale
            dcut[rows, level[pick]] += dlo * scale
            dcut = dcut[:, 1:-1].sum(axis=0)
            for i, g in zip(pick, df, strict=True):
                code, share = bags[i]
                step = g * share * 50
                gw[code] += step**2
                w[code] -= rate * 50 * (step / np.sqrt(gw[code]) * 0.02 + ridge * w[code])
            for j in range(STATS):
                step = np.bincount(bins[pick, j], df, len(s))
                gs += step**2
                s -= rate * 0.2 * step / np.sqrt(gs) * (step != 0)
            step = np.concatenate([[dcut.sum()], np.cumsum(dcut[::-1])[::-1][1:] * np.exp(gaps)])
            gc += step**2
            step = rate * 0.2 * step / np.sqrt(gc)
            first_cut, gaps = first_cut - step[0], gaps - step[1:]
    return Model(grades, w, s, first_cut + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def learn(docs: DataFrame, ratings: DataFrame, *, key: str = "doc_id", text: str = "text", rating: str = "rating", per_grade: int = 800, max_chars: int = 20_000) -> Model | None:
    """Fit on rated rows outside the held-out fold: about ``per_grade`` of each grade, of at most ``max_chars`` characters."""
    marked = ratings.where((samples.fold(key, 5) != 0) & F.col(rating).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(rating).cast("int").alias("y"))
    picked = samples.bounded(marked, "y", "k", per_grade)
    got = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") <= max_chars).join(F.broadcast(picked), "k").collect()
    got.sort(key=lambda r: (r.k, r.t))
    return fit([r.t for r in got], [r.y for r in got])


def grade(docs: DataFrame, ratings: DataFrame, *, key: str = "doc_id", text: str = "text", rating: str = "rating", at_least: int = 1) -> DataFrame:
    """doc_id, held_out, expected_grade, tail, tails (P(grade >= k), by k) and selected of every row.

    ``tail`` is the probability of at least grade ``at_least`` (the next one seen, or the highest); 0.5 selects.
    """
    shared.small_batches(docs.sparkSession)
    model = learn(docs, ratings, key=key, text=text, rating=rating)

    def run(batches):
        for b in batches:
            n = b.num_rows
            tails = model.tails(b.column(1)) if model else np.zeros((n, 1))
            top = tails[:, min(tails.shape[1] - 1, max(0, int(np.searchsorted(model.grades, at_least)) - 1))] if model else tails[:, 0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * tails.shape[1], pa.int32()), pa.array(tails.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.expected(tails) if model else top), pa.array(top), lists, pa.array(top >= 0.5)], ["doc_id", "expected_grade", "tail", "tails", "selected"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(shared.worker(run), "doc_id long, expected_grade double, tail double, tails array<double>, selected boolean").select("doc_id", (samples.fold("doc_id", 5) == 0).alias("held_out"), "expected_grade", "tail", "tails", "selected")
