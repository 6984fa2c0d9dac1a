"""Operator 2: language of whole texts by averaged hashed subword embeddings and a linear softmax, with rejection.

Subwords are the runs of 2, 3 and 4 bytes of lower-cased words with their borders (tokens with digits or signs of addresses
are no words), hashed into ``BUCKETS``; a text is the
mean of their embeddings. Embeddings and softmax are fitted by stochastic gradient descent in numpy on a bounded sample
(``per_language`` texts of at most ``max_chars`` characters of each language; windows of them too, so that short texts
are known). Mean and softmax weights are both linear, so prediction looks up one row of logits for each subword.

A softmax is sure of texts in languages it never saw, so rejection asks how usual a text's subwords are in the language
predicted: the mean of their log lifts (frequency in that language's sample against an even spread). Its bound is
calibrated on texts kept apart, between what nearly all of them reach and what nearly all negatives stay under: the same
texts with their letters shuffled, and their lifts in the languages other than their own (each language left out once).
Short texts scatter more, so the bound falls with one over the root of the number of subwords, by three times as much as
windows of the texts kept apart need. A text of two known languages is not rejected. The temperature of the scores is fitted on the
texts kept apart too.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; with no labelled text at all
every text is. Rows stay one to one, equal rows too; languages, sources and keys are never inputs of a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import samples, shared, textblocks

BUCKETS, DIM, SIZES = 1 << 15, 16, (2, 3, 4)
UNKNOWN = "und"
#: Subwords from which a text counts as long when the bound is set.
LONG_TEXT = 200
#: How far the bound falls at least, times the root of the number of subwords, so that short texts are kept.
LEAST_SLACK = 4.0
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


_NO_WORD = np.zeros(256, bool)
_NO_WORD[[*range(0x30, 0x3A), *b"@=_"]] = True


def worded(data: np.ndarray) -> np.ndarray:
    """The bytes with blanks in place of tokens that hold a digit or one of @ = _: numbers, addresses and keys are no words."""
    odd = np.flatnonzero(_NO_WORD[data])
    if not len(odd):
        return data
    blank = np.flatnonzero(textblocks._SPACE[data])
    edges = np.concatenate([[-1], blank, [len(data)]])
    token = np.unique(np.searchsorted(edges, odd, "right") - 1)
    step = np.zeros(len(data) + 1, np.int8)
    step[edges[token] + 1] += 1
    step[edges[token + 1]] -= 1
    return np.where(np.cumsum(step[:-1], dtype=np.int8) > 0, np.uint8(0x20), data)


def subwords(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every subword of a block, by text."""
    data, begins = textblocks.spaced(raw, offsets)
    data = np.concatenate([[0x20], textblocks._LOWER[worded(data)], [0x20, 0x20, 0x20]]).astype(np.uint8)
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    data[upper] += 0x20
    data = np.where(_LETTER[data], data, 0x20).astype(np.uint32)
    blank = data == 0x20
    n = len(data) - 4
    owner = np.searchsorted(begins, np.arange(n), "right") - 1
    owner[0] = 0
    owners, codes = [], []
    for size in SIZES:
        code = np.full(n, 0x9E37 * size, np.uint32)
        good = ~(blank[:n] & blank[size - 1 : n + size - 1])
        for j in range(size):
            code = (code ^ data[j : n + j]) * np.uint32(0x01000193)
            if 0 < j < size - 1:
                good &= ~blank[j : n + j]
        code ^= code >> np.uint32(15)
        at = np.flatnonzero(good)
        owners.append(owner[at])
        codes.append((code[at] * np.uint32(0x85EBCA6B)) >> np.uint32(17))
    who, what = np.concatenate(owners), np.concatenate(codes)
    order = np.argsort(who, kind="stable") if len(offsets) > 2 else slice(None)
    return np.minimum(who[order], len(offsets) - 2), what[order].astype(np.int64)


@dataclass
class Model:
    """``table``: logits and then log lifts of every subword, one column for each language."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    bound: float = -np.inf
    slack: float = 0.0

    def means(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the logits, the mean lifts and the number of subwords."""
        n, k = len(offsets) - 1, len(self.bias)
        total, count = np.zeros((n, 2 * k)), np.zeros(n)
        for first, last, part, cuts in _parts(raw, offsets):
            owner, code = subwords(part, cuts)
            total[first:last] += samples.sums_by(owner, self.table[code], last - first)
            count[first:last] += np.bincount(owner, minlength=last - first)
        total /= np.maximum(count, 1)[:, None]
        return total[:, :k] + self.bias, total[:, k:], count

    def judge(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the number of the best language, its probability, and whether the text is known."""
        logits, lifts, count = self.means(raw, offsets)
        p = samples.softmax(logits / self.temperature)
        rows, best = np.arange(len(p)), p.argmax(axis=1)
        return best, p[rows, best], lifts[rows, best] >= self.bound - self.slack / np.sqrt(np.maximum(count, 1))


def _parts(raw: np.ndarray, offsets: np.ndarray, limit: int = 1 << 19):
    """Blocks of whole texts; a text over ``limit`` bytes comes alone."""
    column = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
    return textblocks.blocks(column, limit)


def _lift(texts: list[str], prior: float = 0.5) -> np.ndarray:
    """Of each subword the logarithm of its smoothed frequency in ``texts`` against an even spread."""
    count = np.full(BUCKETS, prior)
    for _, _, raw, offsets in textblocks.blocks(pa.array(texts, pa.large_string())):
        count += np.bincount(subwords(raw, offsets)[1], minlength=BUCKETS)
    return np.log(count / count.sum() * BUCKETS)


def shuffled(text: str, rng: np.random.Generator) -> str:
    """The text with its characters other than spaces in random order."""
    inner = [c for c in text if c != " "]
    order = iter(rng.permutation(len(inner)).tolist())
    return "".join(c if c == " " else inner[next(order)] for c in text)


def windows(text: str, rng: np.random.Generator) -> list[str]:
    """The text and a few short stretches of it."""
    parts, out = text.split(), [text]
    for size in (2, 8, 30):
        if len(parts) > size:
            at = int(rng.integers(0, len(parts) - size + 1))
            out.append(" ".join(parts[at : at + size]))
    return out


def fit(texts: list[str], langs: list[str], *, epochs: int = 6, rate: float = 6.0, batch: int = 32, seed: int = 7, tolerance: float = 0.0005) -> Model | None:
    """Embeddings, softmax, lifts, temperature and rejection bound from labelled texts (every fifth text only calibrates)."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, used = order[::5], np.delete(order, np.s_[::5])
    pairs = [(w, names.index(langs[i])) for i in used for w in windows(texts[i], rng)]
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    target = np.array([y for _, y in pairs], np.int64)
    steps, done = epochs * -(-len(pairs) // batch), 0
    for epoch in range(epochs):
        order = np.random.default_rng(seed + epoch).permutation(len(pairs))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x = _sparse([pairs[i][0] for i in pick])
            step = rate * (1 - done / steps)
            hidden = np.stack([(table[c] * f[:, None]).sum(axis=0) for c, f in x])
            wrong = samples.softmax(hidden @ weights + bias).astype(np.float32)
            wrong[np.arange(len(pick)), target[pick]] -= 1
            back = wrong @ weights.T
            weights -= step / len(pick) * hidden.T @ wrong
            bias -= 0.1 * step / len(pick) * wrong.sum(axis=0)
            for (c, f), g in zip(x, back, strict=True):
                table[c] -= step * f[:, None] * g
            done += 1
    lifts = np.stack([_lift([texts[i] for i in used if langs[i] == name]) for name in names], axis=1)
    model = Model(names, np.concatenate([table @ weights, lifts], axis=1).astype(np.float32), bias)
    if len(held):
        _calibrate(model, [texts[i] for i in held], [names.index(langs[i]) for i in held], rng, tolerance)
    return model


def _sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = [(np.zeros(0, np.int64), np.zeros(0, np.float32))] * len(texts)
    for first, last, raw, offsets in textblocks.blocks(pa.array(texts, pa.large_string())):
        owner, code = subwords(raw, offsets)
        both, n = np.unique(owner * BUCKETS + code, return_counts=True)
        cuts = np.searchsorted(both, np.arange(last - first + 1) * BUCKETS)
        for i in range(last - first):
            part = slice(cuts[i], cuts[i + 1])
            out[first + i] = both[part] % BUCKETS, (n[part] / max(1, n[part].sum())).astype(np.float32)
    return out


def _calibrate(model: Model, texts: list[str], target: list[int], rng: np.random.Generator, tolerance: float) -> None:
    pairs = [(w, y) for x, y in zip(texts, target, strict=True) for w in windows(x, rng)]
    means = lambda rows: model.means(*textblocks.text_bytes(pa.array(rows, pa.large_string())))
    truth = np.array([y for _, y in pairs])
    rows = np.arange(len(truth))
    logits, lifts, count = means([w for w, _ in pairs])
    grid = np.geomspace(0.05, 5, 60)
    losses = [-np.log(samples.softmax(logits / t)[rows, truth] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    _, whole, size = means(texts)
    long = size >= LONG_TEXT if (size >= LONG_TEXT).any() else size >= 0
    own = whole[np.arange(len(texts)), target]
    others = np.where(np.arange(len(model.languages)) == np.array(target)[:, None], -np.inf, whole).max(axis=1)
    negative = np.concatenate([others[np.isfinite(others) & long], means([shuffled(x, rng) for x in texts])[1].max(axis=1)[long]])
    high, low = np.quantile(own[long], tolerance), np.quantile(negative, 0.99)
    model.bound = float(min(high, low + 0.3 * max(0.0, high - low)))
    # predicted rather than true languages: a window may be taken for a neighbour, and is known all the same
    missing = (model.bound - lifts[rows, logits.argmax(axis=1)]) * np.sqrt(np.maximum(count, 1))
    model.slack = float(max(LEAST_SLACK, 3 * np.quantile(missing, 1 - tolerance)))


def learn(docs: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = 600, max_chars: int = 20_000) -> Model | None:
    """Fit on the bounded sample of labelled rows outside the held-out fold (checksum of the key modulo 4 is 2)."""
    rows = docs.where((samples.fold(key, 4) != 2) & F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(label).alias("y"), F.col(text).alias("t"))
    got = samples.bounded(rows, "y", "k", per_language).where(F.length("t") <= max_chars).collect()
    got.sort(key=lambda r: (str(r.k), r.t))
    return fit([r.t for r in got], [r.y for r in got])


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_ = np.zeros(len(offsets) - 1, bool)
    ascii_[np.searchsorted(offsets, np.flatnonzero(_LETTER[raw] & (raw < 0x80)), "right") - 1] = True
    for i in np.flatnonzero(~ascii_ & (np.diff(offsets) > 0)):
        ascii_[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode())
    return ascii_


def predict(docs: DataFrame, model: Model | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with lang_pred, score and rejected appended; other columns of ``docs`` stay, but for ones so named."""
    shared.small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score", "rejected") and c != text])
    place, names = docs.columns.index(text), [*docs.columns, "lang_pred", "score", "rejected"]

    def run(batches):
        for b in batches:
            shared.trim()
            raw, offsets = textblocks.text_bytes(b.column(place))
            lettered = has_letter(raw, offsets) if model else np.zeros(b.num_rows, bool)
            if model and b.num_rows:
                best, p, known = model.judge(raw, offsets)
                pred = [model.languages[j] if ok else UNKNOWN for j, ok in zip(best, lettered, strict=True)]
                score = np.where(lettered, np.clip(p, 0, 1), 0.0)
            else:
                pred, score, known = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), lettered
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(~(lettered & known))], names)

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", lang_pred string, score double, rejected boolean"
    return docs.mapInArrow(shared.worker(run), schema)


def identify(docs: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    model = learn(docs, key=key, text=text, label=label)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return predict(rows, model).select("doc_id", (samples.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, columns as they were; the model is fitted on ``docs`` itself."""
    model = learn(docs, key=key, text=text, label=label)
    place = docs.columns.index(text)

    def run(batches):
        for b in batches:
            shared.trim()
            raw, offsets = textblocks.text_bytes(b.column(place))
            good = has_letter(raw, offsets)
            if b.num_rows:
                good &= model.judge(raw, offsets)[2]
            yield b.filter(pa.array(good))

    return docs.mapInArrow(shared.worker(run), docs.schema) if model else docs.limit(0)
