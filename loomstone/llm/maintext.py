"""Operator 12: the main text of web pages by a tree-structured graphical model over their blocks.

A page is a tree (``dom``): block elements, and runs of text as leaves. Every node is article or not. Potentials of a node
come from its element, the words of its classes and ids, its length, links and place; potentials of a child and its parent
from the kinds of both. Sum-product message passing, upward and then downward, gives each run's exact marginal, and runs
that are more likely article than not are the main text, in page order. The potentials are learned from labelled pages
(HTML with ``data-main``) by gradient ascent on their likelihood, whose gradient is counts less marginals.

Defined results: a null or empty page, and one without article, has the empty text and 0 characters; keys may be null and
rows repeated; an empty table gives no row; columns other than key, url and html are ignored. A break (``br``) is white space
inside its block; table cells and list items are blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import labelled_pages, shared
from loomstone.llm.dom import Page

#: Labelled pages to learn from, rounds of ascent, and the weight of a parameter's square.
PAGES, ROUNDS, DECAY = 1000, 120, 5e-3
#: Characters of HTML that one message passing takes, about.
TOGETHER = 4 << 20

KINDS = {"html": 0, "body": 0, "article": 2, "main": 2, "ul": 3, "ol": 3, "dl": 3, "li": 3, "dd": 3, "dt": 3, "menu": 3} | dict.fromkeys("p pre blockquote h1 h2 h3 h4 h5 h6 figure figcaption".split(), 4)
KINDS |= dict.fromkeys("table tbody thead tfoot tr td th caption".split(), 5) | dict.fromkeys("nav aside footer header form fieldset legend dialog search".split(), 6)
LEAF = 7
#: Numeric features: name, number of bins.
BINS = (("length", 10), ("links", 6), ("length, links", 60), ("leaves", 8), ("mean length", 10), ("paragraphs", 6), ("place", 10), ("end", 6), ("bars", 2), ("copyright", 2))


@dataclass
class Forest:
    """Pages' nodes together: parents before children; features as (node, feature) pairs; edge kind of every node to its parent."""

    parent: np.ndarray
    page: np.ndarray
    label: np.ndarray
    text: list[str]
    node: np.ndarray
    feature: np.ndarray
    edge: np.ndarray
    levels: list[np.ndarray]

    @property
    def leaves(self) -> np.ndarray:
        return np.array([bool(x) for x in self.text], bool)


class Words:
    """Numbers of marks; unknown ones go by the longest known mark that they begin or end with (four letters at least)."""

    def __init__(self, known: dict[str, int] | None = None):
        self.known, self.grows = dict(known or {}), known is None
        self._seen: dict[str, tuple[int, ...]] = {}

    def __call__(self, mark: str) -> tuple[int, ...]:
        if self.grows:
            return (self.known.setdefault(mark, len(self.known)),)
        found = self._seen.get(mark)
        if found is None:
            own = self.known.get(mark)
            found = (own,) if own is not None else ()
            if own is None and mark.startswith("c:"):
                parts = [next((self.known["c:" + x] for x in pieces if "c:" + x in self.known), None) for pieces in ([mark[2 : 2 + n] for n in range(min(24, len(mark) - 2), 3, -1)], [mark[-n:] for n in range(min(24, len(mark) - 2), 3, -1)])]
                found = tuple({x for x in parts if x is not None})
            if len(self._seen) < 100_000:
                self._seen[mark] = found
        return found


def _bin(x: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(np.log2(1 + x).astype(np.int64), most - 1)


def forest(pages: list[Page], words: Words) -> Forest:
    base = np.cumsum([0, *(len(p.parent) for p in pages)])
    parent = np.concatenate([np.where((q := np.array(p.parent)) < 0, -1, q + b) for p, b in zip(pages, base, strict=False)]) if pages else np.zeros(0, np.int64)
    n = len(parent)
    page = np.repeat(np.arange(len(pages)), np.diff(base))
    tag = [t for p in pages for t in p.tag]
    text = [t for p in pages for t in p.text]
    leaf = np.array([not t for t in tag], bool)
    size = np.array([len(t) for t in text], np.int64)
    links = np.array([x for p in pages for x in p.links], np.int64)
    levels = []
    at = np.flatnonzero(parent < 0)
    order = np.argsort(parent, kind="stable")
    first, last = np.searchsorted(parent[order], np.arange(n)), np.searchsorted(parent[order], np.arange(n), "right")
    while len(at):
        levels.append(at)
        count = last[at] - first[at]
        at = order[np.repeat(first[at] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    leaves, paragraphs = leaf.astype(np.int64), np.array([t == "p" for t in tag], np.int64)
    for at in levels[:0:-1]:
        for x in (size, links, leaves, paragraphs):
            x += np.bincount(parent[at], x[at], n).astype(np.int64)
    share = np.searchsorted([0.02, 0.1, 0.3, 0.6, 0.9], links / np.maximum(size, 1), "right")
    rank = np.cumsum(leaf) - 1
    start, total = rank[base[:-1]] + 1 - leaf[base[:-1]] if n else rank, np.maximum(np.bincount(page, leaf, len(pages)), 1)
    place = np.minimum(9, 10 * np.maximum(rank - start[page], 0) / total[page]).astype(np.int64) if n else rank
    end = np.array([0 if not t else 1 + ".!?:".find(t[-1]) if t[-1] in ".!?:" else 5 for t in text], np.int64)
    bars = np.array([any(c in t for c in "|»·") for t in text], np.int64)
    sign = np.array(["©" in t for t in text], np.int64)
    values = (_bin(size, 10), share, _bin(size, 10) * 6 + share, _bin(leaves, 8), _bin(size / np.maximum(leaves, 1), 10), _bin(paragraphs, 6), place, end, bars, sign)
    nodes, features, offset = [], [], 0
    for (_, width), value in zip(BINS, values, strict=True):
        nodes.append(np.arange(n))
        features.append(offset + leaf * width + value)
        offset += 2 * width
    some, marks = [], []
    for i, (t, own) in enumerate(zip(tag, (m for p in pages for m in p.marks), strict=True)):
        up = "u:" + tag[parent[i]] if not t else "t:" + t
        for mark in (up, *own):
            for number in words(mark):
                some.append(i)
                marks.append(offset + number)
    kind = np.array([KINDS.get(t, 1) if t else LEAF for t in tag], np.int64)
    edge = np.where(parent < 0, 0, kind[parent] * (LEAF + 1) + kind)
    label = np.array([x for p in pages for x in p.label], np.int64)
    return Forest(parent, page, label, text, np.concatenate([*nodes, np.array(some, np.int64)]), np.concatenate([*features, np.array(marks, np.int64)]), edge, levels)


EDGES = (LEAF + 1) ** 2


def marginals(f: Forest, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chance of each node to be article, joint chances [node, parent's value, own value], log partition of each node's tree).

    Upward, a node sends its parent the sum over its own values of its potentials and its children's messages; downward, a
    parent sends each child all that it knows but that child's own message.
    """
    n = len(f.parent)
    potential = np.zeros((n, 2))
    potential[:, 1] = np.bincount(f.node, weights[f.feature], n)
    pair = edges[f.edge]  # [node, parent's value, own value]
    inside, message = potential.copy(), np.zeros((n, 2))
    for at in f.levels[:0:-1]:
        message[at] = np.logaddexp(*np.moveaxis(pair[at] + inside[at][:, None, :], 2, 0))
        for value in (0, 1):
            inside[:, value] += np.bincount(f.parent[at], message[at, value], n)
    outside = np.zeros((n, 2))
    joint = np.zeros((n, 2, 2))
    top = np.logaddexp(inside[:, 0], inside[:, 1])
    for at in f.levels[1:]:
        up = f.parent[at]
        above = outside[up] + inside[up] - message[at]
        whole = above[:, :, None] + pair[at] + inside[at][:, None, :]
        outside[at] = np.logaddexp(*np.moveaxis(above[:, :, None] + pair[at], 1, 0))
        joint[at] = np.exp(whole - top[up][:, None, None])
        top[at] = top[up]
    chance = np.exp(inside[:, 1] + outside[:, 1] - top)
    return chance, joint, top


@dataclass
class Model:
    weights: np.ndarray
    edges: np.ndarray
    known: dict[str, int]


def fit(html: list[str], *, rounds: int = ROUNDS, decay: float = DECAY) -> Model:
    """Potentials from labelled pages; at most a few thousand, which one process holds."""
    words = Words()
    f = forest([Page(h) for h in html], words)
    size = 2 * sum(width for _, width in BINS) + len(words.known)
    weights, edges = np.zeros(size), np.zeros((EDGES, 2, 2))
    inner = np.flatnonzero(f.parent >= 0)
    truth = f.label.astype(float)
    seen = np.zeros((EDGES, 2, 2))
    np.add.at(seen, (f.edge[inner], f.label[f.parent[inner]], f.label[inner]), 1.0)
    moments = [np.zeros(size + edges.size), np.zeros(size + edges.size)]
    for step in range(1, rounds + 1):
        chance, joint, _ = marginals(f, weights, edges)
        expected = np.stack([np.bincount(f.edge[inner], joint[inner, a, b], EDGES) for a in (0, 1) for b in (0, 1)], 1).reshape(EDGES, 2, 2)
        slope = np.concatenate([np.bincount(f.feature, (truth - chance)[f.node], size), (seen - expected).ravel()])
        slope -= decay * len(html) * np.concatenate([weights, edges.ravel()]) / 10
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.99 * moments[1] + 0.01 * slope * slope
        move = 0.1 * moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        weights, edges = weights + move[:size], edges + move[size:].reshape(edges.shape)
    return Model(weights, edges, words.known)


@lru_cache(maxsize=2)
def learned(pages: int = PAGES) -> Model:
    """The model of the first so many labelled pages."""
    return fit([labelled_pages.page(i) for i in range(pages)])


def main_texts(html: list[str | None], model: Model, words: Words) -> list[str]:
    f = forest([Page(h) for h in html], words)
    own = marginals(f, model.weights, model.edges)[0] >= 0.5
    parts: list[list[str]] = [[] for _ in html]
    for i in np.flatnonzero(own & f.leaves).tolist():
        parts[f.page[i]].append(f.text[i])
    return ["\n".join(x) for x in parts]


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page; ``model`` is by default learned from the labelled pages."""
    shared.small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model or learned())

    def run(batches):
        held, words = sent.value, Words(sent.value.known)
        for b in batches:
            column, first, texts = b.column("html").to_pylist(), 0, []
            while first < len(column):
                last, size = first, 0
                while last < len(column) and (last == first or size + len(column[last] or "") < TOGETHER):
                    size += len(column[last] or "")
                    last += 1
                texts += main_texts(column[first:last], held, words)
                first = last
            yield pa.record_batch({"key": b.column("key"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long"
    return rows.mapInArrow(shared.worker(run), schema).withColumnRenamed("key", key)
