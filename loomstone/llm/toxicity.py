"""Operator 4: toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel of two words is the sum, over all subsequences of three symbols, of the products of their weights, where an
occurrence that spans ``s`` symbols (six at most) weighs ``DECAY ** s``; it is divided by the words' own norms. So
inserted characters and gaps weaken a match instead of destroying it. Characters that are no letter or digit are skipped
inside a word, and runs of single letters are one word, which brings "i.d.i.o.t" and "i d i o t" back together.

Fitting, on a bounded sample of labelled documents: words of toxic sentences that occur in many different contexts there
and hardly elsewhere are the positive strings (with a character inserted too), words of clean sentences and mere parts of
positive words the negative ones (hard ones are mined); a few of both are Nyström landmarks; a hinge loss gives a weight to each landmark. The decision is linear in the subsequences, so
the landmarks fold into one table of subsequence weights and scoring a word is a sum of table entries. The labelled
documents are the bags of a multiple-instance problem: their evidence is the margin of the worst word and the share of such
words, as what is an insult's likeness once in a clean text is repeated in a toxic one; a logistic curve
over the labelled documents turns evidence into scores.

Defined results: null, empty and wordless texts get the score of no evidence; without labels of both kinds every score is
0; rows stay one to one, equal rows too; labels, languages, sources and keys are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import samples, shared, textblocks

SYMBOLS, REACH, DECAY = 32, 5, 0.7
PAIRS = [(i, j) for j in range(2, REACH + 1) for i in range(1, j)]
#: Margin of a text without any word.
NOTHING = -3.0
#: The least share of positive words that counts, and words that a text is taken to have besides its own, so that short texts are not all or nothing.
RARE = (0.002, 5.0)
#: The least slope of either evidence: texts without such words still go by their worst one.
LEAST_SLOPE = 1.0
#: Margins from here on use exact norms; below, the least norm of the word's length bounds the margin from above.
CERTAIN = -1.5

_SYMBOL = np.full(256, -1, np.int64)
for _i in range(26):
    _SYMBOL[65 + _i] = _SYMBOL[97 + _i] = _i
_SYMBOL[48:58] = 31
for _i in range(0x80, 0xC0):
    _SYMBOL[_i] = 26 + _i % 5


def strings(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts, ends, text number) of the words of a block; runs of one-symbol words count as one word.

    A run of four and more stands without its first and without its last symbol as well: "a m o r o n" holds "moron".
    """
    data, begins = textblocks.spaced(raw, offsets)
    code = _SYMBOL[data]
    fill = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    code[1:][fill] = 26 + (data[1:][fill].astype(np.int64) + 0x20) % 5
    starts, ends = textblocks.word_spans(data)
    at = np.concatenate([[0], np.cumsum(code >= 0)])
    symbols = code[code >= 0]
    starts, ends, owner = at[starts], at[ends], np.searchsorted(begins, starts, "right") - 1
    keep = ends > starts
    starts, ends, owner = starts[keep], ends[keep], owner[keep]
    if len(starts) > 1:
        single = ends - starts == 1
        glue = np.concatenate([[False], single[1:] & single[:-1] & (owner[1:] == owner[:-1])])
        first = np.flatnonzero(~glue)
        pieces = np.diff(np.append(first, len(ends)))
        starts, ends, owner = starts[first], ends[np.append(first[1:], len(ends)) - 1], owner[first]
        runs = np.flatnonzero((pieces > 1) & (ends - starts >= 4))
        if len(runs):
            order = np.argsort(np.concatenate([np.arange(len(starts)), runs, runs]), kind="stable")
            starts = np.concatenate([starts, starts[runs] + 1, starts[runs]])[order]
            ends = np.concatenate([ends, ends[runs], ends[runs] - 1])[order]
            owner = np.concatenate([owner, owner[runs], owner[runs]])[order]
    return symbols, starts, ends, owner


def distinct(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words laid side by side: (symbols, starts, ends) and the number of each word in them."""
    names = textblocks.span_hashes(symbols.astype(np.uint8), starts, ends)
    codes, values = pd.factorize(names)
    first = np.empty(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    size = (ends - starts)[first]
    cut = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(cut[-1]) + np.repeat(starts[first] - cut[:-1], size)
    return symbols[place], cut[:-1], cut[1:], codes


def subsequences(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence, weight) of every occurrence, by word."""
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    words, codes, weights = [], [], []
    n = len(symbols)
    for i, j in PAIRS:
        if n > j:
            at = np.flatnonzero(owner[: n - j] == owner[j:])
            words.append(owner[at])
            codes.append((symbols[at] * SYMBOLS + symbols[at + i]) * SYMBOLS + symbols[at + j])
            weights.append(np.full(len(at), DECAY ** (j + 1)))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    who = np.concatenate(words)
    order = np.argsort(who, kind="stable")
    return who[order], np.concatenate(codes)[order], np.concatenate(weights)[order]


def own_weight(size: np.ndarray) -> np.ndarray:
    """The norm of a word without repeated subsequences, from its length: the least norm that its length allows."""
    return np.sqrt(np.maximum(sum(np.maximum(size - j, 0) * DECAY ** (2 * (j + 1)) for _, j in PAIRS), DECAY**6))


def norms(who: np.ndarray, what: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The exact norm of each word: repeated subsequences add up before they are squared."""
    both, inverse = np.unique(who * SYMBOLS**3 + what, return_inverse=True)
    total = np.bincount(inverse, weight, len(both))
    return np.sqrt(np.maximum(np.bincount(both // SYMBOLS**3, total**2, n), DECAY**6))


def encoded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts, ends) of single words, in order; a word without symbols has none."""
    raw, offsets = textblocks.text_bytes(pa.array(words, pa.large_string()))
    symbols, starts, ends, owner = strings(raw, offsets)
    begin, end = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    begin[owner], end[owner] = starts, ends
    order = np.concatenate([np.arange(a, b) for a, b in zip(begin, end, strict=True)]) if len(words) else np.zeros(0, np.int64)
    cut = np.concatenate([[0], np.cumsum(end - begin)])
    return symbols[order.astype(np.int64)], cut[:-1], cut[1:]


def profile(words: list[str]) -> np.ndarray:
    """One row of normalised subsequence weights per word."""
    symbols, starts, ends = encoded(words)
    who, what, weight = subsequences(symbols, starts, ends)
    out = np.zeros((len(words), SYMBOLS**3))
    np.add.at(out, (who, what), weight)
    return out / norms(who, what, weight, len(words))[:, None]


@dataclass
class Model:
    table: np.ndarray
    bias: float
    slope: np.ndarray
    shift: float

    def words(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Margins of words, 1 at most; one under ``CERTAIN`` may stand above its exact value, for a norm not computed."""
        who, what, weight = subsequences(symbols, starts, ends)
        value = samples.sums_by(who, self.table[what] * weight, len(starts))
        out = value / own_weight(ends - starts) + self.bias
        near = np.flatnonzero(out > CERTAIN)
        if len(near):
            keep = np.isin(who, near)
            out[near] = value[near] / norms(np.searchsorted(near, who[keep]), what[keep], weight[keep], len(near)) + self.bias
        return np.minimum(out, 1.0)

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Of each text, the largest margin of its words, and the logarithm of the share of such words (each weighs its margin + 1, within 0 and 1)."""
        out = np.tile([NOTHING, np.log(RARE[0])], (len(column), 1))
        for first, last, raw, offsets in textblocks.blocks(column, 1 << 19):
            symbols, starts, ends, owner = strings(raw, offsets)
            if len(starts):
                *parts, codes = distinct(symbols, starts, ends)
                value = self.words(*parts)[codes]
                here = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                out[first + owner[here], 0] = np.maximum(NOTHING, np.maximum.reduceat(value, here))
                share = np.add.reduceat(np.clip(value + 1.0, 0.0, 1.0), here) / (np.diff(np.append(here, len(owner))) + RARE[1])
                out[first + owner[here], 1] = np.log(RARE[0] + share)
        return out

    def margins(self, column: pa.Array) -> np.ndarray:
        """Of each text, the largest margin of its words."""
        return self.evidence(column)[:, 0]

    def scores(self, column: pa.Array) -> np.ndarray:
        return samples.sigmoid(self.evidence(column) @ self.slope + self.shift)


def _sentences(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for w in text.lower().split():
        out[-1].append(w)
        if w[-1] in ".!?":
            out.append([])
    return out


def _contexts(texts: list[str]) -> dict[str, set]:
    """For every word the different word pairs around it: copies of one sentence count once."""
    out: dict[str, set] = {}
    for text in texts:
        for s in _sentences(text):
            for i, w in enumerate(s):
                out.setdefault(w.strip(".,;:!?\"'()"), set()).add((s[i - 1] if i else "", s[i + 1] if i + 1 < len(s) else ""))
    return out


def witnesses(toxic: list[str], clean: list[str]) -> dict[str, int]:
    """Words of toxic sentences with their number of contexts, where that number stands far out against clean ones."""
    bad, good = _contexts(toxic), _contexts(clean)
    sizes = sum(map(len, toxic)) + 1, sum(map(len, clean)) + 1
    out = {}
    for w, c in bad.items():
        seen, expected = len(c), (len(good.get(w, ())) + 0.3) * sizes[0] / sizes[1]
        if len(w) >= 3 and seen >= 3 + len(toxic) / 100 and seen >= 12 * expected + 2:
            out[w] = seen
    return out


def _landmarks(words: dict[str, int], rows: np.ndarray, names: list[str], most: int) -> list[int]:
    """Positive words by their number of contexts, skipping those that a chosen one nearly equals."""
    chosen: list[int] = []
    for i in sorted(range(len(names)), key=lambda i: (-words[names[i]], names[i])):
        if len(chosen) < most and (not chosen or (rows[chosen] @ rows[i]).max() < 0.9):
            chosen.append(i)
    return chosen


def fit(toxic: list[str], clean: list[str], *, landmarks: int = 128, positives: int = 600, negatives: int = 3000, rounds: int = 4, seed: int = 11) -> Model | None:
    """Nyström features, a hinge loss in numpy, then a logistic curve over the documents' margins.

    At most ``positives`` witness words, those of the most contexts, and ``negatives`` other words are the labelled strings.
    """
    if not toxic or not clean:
        return None
    rng = np.random.default_rng(seed)
    found = witnesses(toxic, clean)
    if not found:
        return None
    names = sorted(found, key=lambda w: (-found[w], w))[:positives]
    ordinary = sorted({w.strip(".,;:!?\"'()") for t in clean for s in _sentences(t) for w in s} - set(found) - {""})
    good = [ordinary[i] for i in np.sort(rng.choice(len(ordinary), min(len(ordinary), negatives), replace=False))]
    pool = encoded(ordinary)
    rows = profile(names)
    marks = [names[i] for i in _landmarks(found, rows, names, landmarks * 3 // 4)]
    marks += good[:: max(1, len(good) // (landmarks // 4))][: landmarks // 4]
    basis = profile(marks)
    value, vector = np.linalg.eigh(basis @ basis.T)
    whiten = vector / np.sqrt(np.maximum(value, 1e-6 * value.max()))

    def features(words: list[str]) -> np.ndarray:
        """Kernels with the landmarks, whitened."""
        symbols, starts, ends = encoded(words)
        out = []
        for at in range(0, len(words), 2000):
            a, b = starts[at : at + 2000], ends[at : at + 2000]
            who, what, weight = subsequences(symbols[a[0] : b[-1]], a - a[0], b - a[0])
            out.append(samples.sums_by(who, basis.T[what] * weight[:, None], len(a)) / norms(who, what, weight, len(a))[:, None])
        return np.concatenate(out) @ whiten

    parts = sorted(({w[:i] for w in names for i in range(3, len(w))} | {w[i:] for w in names for i in range(1, len(w) - 2)}) - set(found))
    # an insult with one more character in it is an insult still
    longer = [w[:i] + "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] + w[i:] for w in names if len(w) >= 5 for i in rng.choice(np.arange(1, len(w)), 2, replace=False)]
    pos, more, easy, near = features(names), features(longer) if longer else np.zeros((0, len(marks))), features(good), set(parts)
    for _ in range(rounds):
        hard = features(sorted(near))
        sizes = [len(pos), len(more), len(easy), len(hard)]
        w, b = _hinge(np.vstack([pos, more, easy, hard]), np.repeat([1.0, 1.0, -1.0, -1.0], sizes), np.repeat([1 / len(pos), 0.5 / len(pos), 1 / len(easy), 0.5 / len(pos)], sizes))
        model = Model(basis.T @ (whiten @ w), b, np.ones(2), 0.0)
        value = model.words(*pool)
        near |= {ordinary[i] for i in np.argsort(-value, kind="stable")[:300] if value[i] > -0.5}
    found_in = model.evidence(pa.array([*toxic, *clean], pa.large_string()))
    model.slope, model.shift = _logistic(found_in, np.concatenate([np.ones(len(toxic)), np.zeros(len(clean))]))
    return model


def _hinge(rows: np.ndarray, y: np.ndarray, c: np.ndarray, *, steps: int = 250, reg: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared hinge loss with a weight for each row, by accelerated gradient steps."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    rate = 1 / (2 * np.linalg.eigvalsh(x.T @ (x * c[:, None]))[-1] + reg)
    w, v, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (-2 * x.T @ (c * slack * y) + reg * v)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


def _logistic(rows: np.ndarray, y: np.ndarray, least: float = LEAST_SLOPE) -> tuple[np.ndarray, float]:
    """Slopes and shift of the smoothed logistic fit of labels on a few columns, by Newton steps; slopes below ``least`` are held there."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([rows, np.ones((len(rows), 1))])
    ridge, w, free = np.append(np.full(rows.shape[1], 1e-3), 1e-9), np.append(np.ones(rows.shape[1]), 0.0), np.ones(x.shape[1], bool)
    while True:
        for _ in range(100):
            p = samples.sigmoid(x @ w)
            s, part = p * (1 - p), x[:, free]
            step = np.linalg.solve(part.T @ (part * s[:, None]) + np.diag(ridge[free]), part.T @ (p - target) + ridge[free] * w[free])
            w[free] -= step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        under = np.append(w[:-1] < least, False) & free
        if not under.any():
            return w[:-1], float(w[-1])
        w[under], free = least, free & ~under


def learn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = 1200, max_chars: int = 20_000) -> Model | None:
    """Fit on labelled rows outside the held-out fold: about ``per_label`` of each label, of at most ``max_chars`` characters.

    The sampled keys are bounded by ``per_label``, so the texts come by a broadcast join.
    """
    marked = labels.where((samples.fold(key, 5) != 0) & F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).alias("y")).groupBy("k").agg(F.max("y").alias("y"))
    picked = samples.bounded(marked, "y", "k", per_label)
    got = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") <= max_chars).join(F.broadcast(picked), "k").collect()
    got.sort(key=lambda r: (r.k, r.t))
    return fit([r.t for r in got if r.y == 1], [r.t for r in got if r.y == 0])


def score(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    shared.small_batches(docs.sparkSession)
    model = learn(docs, labels, key=key, text=text, label=label)

    def run(batches):
        for b in batches:
            value = model.scores(b.column(1)) if model else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(shared.worker(run), "doc_id long, score double, predicted int").select("doc_id", (samples.fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
