"""Operator 3: stupid-backoff language-model scores from corpus n-gram counts, every document scored by all the others.

A document's word at position i scores ``c(w[i-2..i]) / c(w[i-2..i-1])`` where that trigram occurs outside the document,
else ``ALPHA`` times the bigram's ratio, else ``ALPHA ** 2`` times the word's share of all words, else, for a word seen
nowhere else, ``ALPHA ** 3`` over the number of words. Counts are those of all other documents (of the corpus without the
document's own), so a text does not confirm itself.

The counts are relational: documents are dealt into blocks by hash; a block explodes its n-grams, keeps the distinct ones
with their counts and sends them, packed, to the count table's hash partition that owns them. A partition sums the counts
and joins the totals back to the blocks; a block looks its positions up and sums per document. No partition is keyed by a
word or context, so frequent ones weigh one entry per block. A step of this exchange deals a block's n-grams over at most
``2 ** packets.STEP_BITS`` partitions; larger tables take further steps, in which groups of blocks are merged first, so
packets grow in proportion to the text. N-grams are compared by hashes of 48 bits and more, as their number grows.

Defined results: null, empty and wordless texts have no words and the score null; rows stay one to one, equal rows too (an
equal row is another document); an empty table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import packets, shared, textblocks
from loomstone.llm.packets import narrow, pack, unpack

ORDER, ALPHA = 3, 0.4
PACKETS = "frag long, block long, payload binary"


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, word hash) of all words of a column, in order."""
    owners, hashes = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
    for first, _, raw, offsets in textblocks.blocks(column):
        owner, word = textblocks.words(raw, offsets)
        owners.append((owner + first).astype(np.int32))
        hashes.append(word)
    return np.concatenate(owners), np.concatenate(hashes)


def grams(owner: np.ndarray, word: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the last word, hash of ``bits`` bits) of every n-gram of one order within a text."""
    n = len(word) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[order - 1 :] == owner[:n])
    code = np.full(len(at), order, np.uint64)
    for j in range(order):
        code = (code + word[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return at + order - 1, textblocks.mix(code) >> np.uint64(64 - bits)


def _rows(frag: list[int], block: list[int], payload: list[bytes]) -> pa.Table:
    return pa.table({"frag": pa.array(frag, pa.int64()), "block": pa.array(block, pa.int64()), "payload": pa.array(payload, pa.binary())})


def _dealt(code: np.ndarray, count: np.ndarray, parent: int, bits: int, step: int) -> tuple[list[int], list[bytes]]:
    """Ascending codes of ``bits`` bits with their counts, one packet for each value of their first ``step`` bits that occurs."""
    own = code >> np.uint64(bits - step)
    cut = np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint64(1))) if len(own) else np.zeros(0, np.int64)
    frags, payloads = [], []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(code)], strict=True):
        rest = code[a:b] & np.uint64((1 << bits - step) - 1)
        frags.append(parent << step | int(own[a]))
        payloads.append(pack(narrow(np.diff(rest, prepend=np.uint64(0))), narrow(count[a:b])))
    return frags, payloads


def _explode(bits: int, step: int):
    """A block of documents to its distinct n-grams per order and hash partition; its number of words is of order 0."""

    def run(key, group):
        shared.tidy()
        owner, word = words(group["t"].combine_chunks())
        frags, payloads = _dealt(np.zeros(1, np.uint64), np.array([len(word)], np.int64), 0, bits, step)
        for order in range(1, ORDER + 1):
            distinct, count = np.unique(grams(owner, word, order, bits)[1], return_counts=True)
            more = _dealt(distinct, count, order, bits, step)
            frags, payloads = frags + more[0], payloads + more[1]
        return _rows(frags, [key[0].as_py()] * len(frags), payloads)

    return run


def _summed(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(distinct codes, summed counts, the number of each packet's codes among them, each packet's counts)."""
    parts = [unpack(p) for p in payloads]
    codes = [np.cumsum(p[0].astype(np.uint64)) for p in parts]
    flat, count = np.concatenate(codes), np.concatenate([p[1] for p in parts]).astype(np.int64)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    which = np.empty(len(flat), np.int64)
    which[order] = np.cumsum(new) - 1
    cut = np.cumsum([0, *map(len, codes)])
    return ranked[first], np.add.reduceat(count[order], first), [which[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], [p[1].astype(np.int64) for p in parts]


def _merge(bits: int, step: int):
    """Packets of one hash partition and one group of blocks, merged and dealt again by ``step`` more bits."""

    def run(key, group):
        shared.tidy()
        code, total, _, _ = _summed(group["payload"].to_pylist())
        frags, payloads = _dealt(code, total, key[0].as_py(), bits, step)
        return _rows(frags, [key[1].as_py()] * len(frags), payloads)

    return run


def _totals(key, group):
    """One hash partition of a count table: the counts of its n-grams over all other blocks, joined back to each block."""
    shared.tidy()
    _, total, which, own = _summed(group["payload"].to_pylist())
    back = [pack(narrow(total[w] - n)) for w, n in zip(which, own, strict=True)]
    return _rows([key[0].as_py()] * len(back), group["block"].to_pylist(), back)


def _return(key, group, back):
    """What a group of blocks got back for its merged packets, handed to each of its blocks."""
    shared.tidy()
    if not group.num_rows:
        return _rows([], [], [])
    _, total, which, own = _summed(group["payload"].to_pylist())
    back = back.sort_by("frag")["payload"].to_pylist()
    total = total + np.concatenate([unpack(p)[0].astype(np.int64) for p in back])
    out = [pack(narrow(total[w] - n)) for w, n in zip(which, own, strict=True)]
    return _rows([key[0].as_py()] * len(out), group["block"].to_pylist(), out)


def others(counted: DataFrame, bits: int, plan: list[int]) -> DataFrame:
    """For every packet (frag, block) the counts of its n-grams in all other blocks.

    ``bits`` of the hash are not yet dealt by; ``plan`` holds the steps still to come, and a group of blocks is as large as
    the step is wide.
    """
    if not plan:
        return counted.groupBy("frag").applyInArrow(_totals, PACKETS)
    step, counted = plan[0], shared.written(counted, "gram-packets")
    group = F.shiftright("block", step).alias("group")
    merged = counted.groupBy("frag", group).applyInArrow(_merge(bits, step), PACKETS)
    back = others(merged, bits - step, plan[1:]).select("frag", "block", "payload", F.shiftright("frag", step).alias("parent"))
    return counted.groupBy("frag", group).cogroup(back.groupBy("parent", "block")).applyInArrow(_return, PACKETS)


def _others(owner: np.ndarray, at: np.ndarray, code: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """At each position (0..n-1) the count of the n-gram that ends there, in all other documents."""
    out = np.zeros(n, np.int64)
    if len(at):
        _, which, count = np.unique(code, return_inverse=True, return_counts=True)
        total = (rest + count)[which]
        own = np.ones(len(at), np.int64)
        many = np.flatnonzero(count[which] > 1)
        if len(many):
            both = owner[at[many]].astype(np.int64) * len(rest) + which[many]
            _, inverse, times = np.unique(both, return_inverse=True, return_counts=True)
            own[many] = times[inverse]
        out[at] = total - own
    return out


def _score(bits: int, step: int):
    def run(docs, back):
        shared.tidy()
        owner, word = words(docs["t"].combine_chunks())
        n, rows = len(word), docs.num_rows
        frag = back["frag"].to_numpy()
        payloads = back["payload"].to_pylist()
        order_of, by = frag >> step, np.argsort(frag, kind="stable")
        counts = [np.concatenate([np.zeros(0, np.int64), *(unpack(payloads[i])[0].astype(np.int64) for i in by if order_of[i] == k)]) for k in range(ORDER + 1)]
        corpus = int(counts[0][0]) + n
        size = np.bincount(owner, minlength=rows)
        seen = []
        for order in range(1, ORDER + 1):
            at, code = grams(owner, word, order, bits)
            seen.append(_others(owner, at, code, counts[order], n))
        outside = np.maximum(corpus - size, 1)[owner]
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(seen[0] > 0, ALPHA ** (ORDER - 1) * seen[0] / outside, ALPHA**ORDER / outside)
            level = np.where(seen[0] > 0, 1, 0)
            for order in range(2, ORDER + 1):
                context = np.concatenate([[1], seen[order - 2][:-1]]) if n else seen[0]
                use = seen[order - 1] > 0
                value = np.where(use, ALPHA ** (ORDER - order) * seen[order - 1] / np.maximum(context, 1), value)
                level = np.where(use, order, level)
        total = np.bincount(owner, np.log(value), rows)
        cols = [docs["k"].combine_chunks(), pa.array(size, pa.int64()), pa.array(total), pa.array(total / np.maximum(size, 1), mask=size == 0)]
        cols += [pa.array(np.bincount(owner[level == k], minlength=rows), pa.int64()) for k in range(ORDER + 1)]
        return pa.table(cols, names=["doc_id", "n_words", "log_score", "mean_log_score", "n_unseen", "n_unigram", "n_bigram", "n_trigram"])

    return run


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", block_bytes: int = 8 << 20, step_bits: int = packets.STEP_BITS) -> DataFrame:
    """doc_id, n_words, log_score (natural logarithm, summed), mean_log_score and the number of words scored at each level."""
    shared.small_batches(docs.sparkSession)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    blocks = int(max(2, -(-total // block_bytes)))
    bits = packets.hash_bits(ORDER * total // 2)
    first, *more = packets.steps(packets.bits_for(blocks), step_bits)
    dealt = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.pmod(F.xxhash64(key, text), F.lit(blocks)).alias("block"))
    counted = dealt.groupBy("block").applyInArrow(_explode(bits, first), PACKETS)
    schema = "doc_id long, n_words long, log_score double, mean_log_score double, n_unseen long, n_unigram long, n_bigram long, n_trigram long"
    return dealt.groupBy("block").cogroup(others(counted, bits - first, more).groupBy("block")).applyInArrow(_score(bits, first), schema)


#: The same rows in DuckDB, logarithms rounded.
ORACLE = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
tokens AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM split),
grams AS (SELECT doc_id, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i-1] || ' ' || w[i] END AS g2, CASE WHEN i > 2 THEN w[i-2] || ' ' || w[i-1] || ' ' || w[i] END AS g3 FROM tokens),
counted AS (
  SELECT doc_id, i,
    count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY g1, doc_id) AS c1,
    CASE WHEN g2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY g2, doc_id) END AS c2,
    CASE WHEN g3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY g3, doc_id) END AS c3,
    count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS others
  FROM grams),
ctx AS (SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS p1, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS p2 FROM counted),
scored AS (
  SELECT doc_id, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS level,
    ln(CASE WHEN c3 > 0 THEN c3 / p2 WHEN c2 > 0 THEN 0.4 * c2 / p1 WHEN c1 > 0 THEN 0.16 * c1 / greatest(others, 1) ELSE 0.064 / greatest(others, 1) END) AS s FROM ctx)
SELECT d.doc_id, count(s) AS n_words, round(coalesce(sum(s), 0), 3) AS log_score, round(avg(s), 5) AS mean_log_score,
  count(*) FILTER (level = 0) AS n_unseen, count(*) FILTER (level = 1) AS n_unigram, count(*) FILTER (level = 2) AS n_bigram, count(*) FILTER (level = 3) AS n_trigram
FROM documents d LEFT JOIN scored x ON d.doc_id = x.doc_id GROUP BY d.doc_id
"""
