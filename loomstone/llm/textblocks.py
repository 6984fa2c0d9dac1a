"""Whole texts as byte arrays: words, word hashes and shingle hashes by numpy, a bounded block of bytes at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (xor-shift and multiply, twice)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch, and where each begins; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, bytes, offsets): whole texts, together about ``limit`` bytes; a longer one stands alone."""
    raw, offsets = text_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with one space after each text, so that no word crosses from one text into the next."""
    lengths = np.diff(offsets)
    out = np.full(len(raw) + len(lengths), 0x20, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(len(lengths)), lengths)] = raw
    return out, offsets + np.arange(len(offsets))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of other bytes than space and 0x09-0x0D; ``raw`` ends with a space."""
    inner = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inner, prepend=False, append=False))
    return edge[0::2], edge[1::2]


_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Spans of more bytes are hashed by BLAKE2b, one by one.
LONG_SPAN = 64


def eights(raw: np.ndarray) -> np.ndarray:
    """At every position the eight bytes from there on as one number (zeros past the end)."""
    room = np.zeros(len(raw) // 8 * 8 + 16, np.uint8)
    room[: len(raw)] = raw
    return np.lib.stride_tricks.as_strided(room.view("<u8"), (len(raw) + 1,), (1,))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans.

    Up to seven bytes the hash is a bijection of the bytes and their number, so these never collide with one another. Up to
    ``LONG_SPAN`` bytes two lanes take eight bytes at a time and are mixed into one; longer spans are hashed by BLAKE2b.
    """
    at, size = eights(raw), ends - starts
    first = at[starts] & _MASK[np.minimum(size, 8)]
    out = mix(first | (size.astype(np.uint64) << np.uint64(56)))
    some = np.flatnonzero(size > 7)
    one, two = mix(first[some] ^ _MULT), mix(first[some] * _MULT + size[some].astype(np.uint64))
    for j in range(8, min(LONG_SPAN, int(size.max(initial=0))), 8):
        on = np.flatnonzero(size[some] > j)
        part = at[starts[some[on]] + j] & _MASK[np.minimum(size[some[on]] - j, 8)]
        one[on], two[on] = mix(one[on] ^ part), mix((two[on] + part) * _MULT)
    out[some] = mix(one ^ (two << np.uint64(23) | two >> np.uint64(41)))
    for i in np.flatnonzero(size > LONG_SPAN):
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def spans_differ(here: np.ndarray, starts: np.ndarray, size: np.ndarray, there: np.ndarray, other_starts: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Which spans have other bytes than the spans beside them; ``here`` and ``there`` are ``eights`` of the data."""
    out = size != other_size
    left, at = np.flatnonzero(~out & (size > 0)), 0
    while len(left):
        mask = _MASK[np.minimum(size[left] - at, 8)]
        same = (here[starts[left] + at] ^ there[other_starts[left] + at]) & mask == 0
        out[left[~same]] = True
        at += 8
        left = left[same & (size[left] > at)]
    return out


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word of a block in order, A-Z lower-cased."""
    raw, offsets = spaced(raw, offsets)
    raw = _LOWER[raw] if lower else raw
    starts, ends = word_spans(raw)
    return np.searchsorted(offsets, starts, "right") - 1, span_hashes(raw, starts, ends)


_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[[0x20, 0x09]] = True


def pieced_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, piece number, start, end) of every word of a block, and its lower-cased bytes.

    Words are runs of other bytes than space, tab and the piece ends ``.,;:!?`` and 0x0A-0x0D; a text's end ends a piece too.
    """
    raw, offsets = spaced(raw, offsets)
    raw = _LOWER[raw]
    raw[offsets[1:] - 1] = 0x0A
    edge = np.flatnonzero(np.diff(~_BETWEEN[raw], prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    piece = np.searchsorted(np.flatnonzero(_BREAK[raw]), starts)
    return np.searchsorted(offsets, starts, "right") - 1, piece, starts, ends, raw


def shingles(owner: np.ndarray, hashes: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, hash) of the k-word shingles, by text and then hash.

    A text of fewer words has its whole sequence as one shingle; the number of words is part of the hash.
    """
    n = len(hashes)
    if not n:
        return owner[:0], hashes[:0]
    full = np.zeros(0, np.int64)
    if n >= k:
        full = np.flatnonzero(owner[k - 1 :] == owner[: n - k + 1])
    code = np.zeros(len(full), np.uint64)
    for j in range(k):
        code = (code + hashes[full + j]) * _MULT
        code ^= code >> np.uint64(29)
    code = mix(code + np.uint64(k))
    texts, first, count = np.unique(owner, return_index=True, return_counts=True)
    short = count < k
    extra = np.zeros(int(short.sum()), np.uint64)
    for j in range(k - 1):
        on = count[short] > j
        step = (extra[on] + hashes[first[short][on] + j]) * _MULT
        extra[on] = step ^ (step >> np.uint64(29))
    extra = mix(extra + count[short].astype(np.uint64))
    who, what = np.concatenate([owner[full], texts[short]]), np.concatenate([code, extra])
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    keep = np.ones(len(who), bool)
    keep[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
    return who[keep], what[keep]


class SpanIds:
    """Token ids of byte spans: equal spans go through the model once and are kept, ``keep`` of them at most.

    Kept spans are found by hash and taken only where their bytes are equal. ``encode`` gives the ids of a list of texts,
    one after another, and for each id the number of its text.
    """

    def __init__(self, encode, dtype, keep: int = 600_000):
        self.encode, self.dtype, self.keep = encode, dtype, keep
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.begins, self.sizes = np.zeros(0, self.dtype), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.data, self.stops = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.view = eights(self.data)

    def _add(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slots of new spans."""
        parts = [raw[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        flat, owner = self.encode([x.decode() for x in parts])
        sizes = np.bincount(owner, minlength=len(parts))
        slots = len(self.sizes) + np.arange(len(parts))
        self.begins = np.concatenate([self.begins, (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
        self.ids = np.concatenate([self.ids, flat.astype(self.dtype)])
        self.data = np.concatenate([self.data, np.frombuffer(b"".join(parts), np.uint8)])
        self.stops = np.concatenate([self.stops, self.stops[-1] + np.cumsum(ends - starts)])
        self.view = eights(self.data)
        return slots

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans one after another, number of ids of each span)."""
        import pandas as pd

        if len(self.keys) > self.keep or len(self.data) > 16 * self.keep:
            self._clear()
        codes, distinct = pd.factorize(span_hashes(raw, starts, ends))
        at = np.searchsorted(self.keys, distinct)
        slots = np.full(len(distinct), -1, np.int64)
        inside = np.flatnonzero(at < len(self.keys))
        inside = inside[self.keys[at[inside]] == distinct[inside]]
        slots[inside] = self.slots[at[inside]]
        new = np.flatnonzero(slots < 0)
        if len(new):
            first = np.empty(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            slots[new] = self._add(raw, starts[first[new]], ends[first[new]])
            keys, held = np.concatenate([self.keys, distinct[new]]), np.concatenate([self.slots, slots[new].astype(np.int32)])
            order = np.argsort(keys, kind="stable")
            self.keys, self.slots = keys[order], held[order]
        slot = slots[codes]
        # spans of up to seven bytes never share a hash with one another, and a longer one shows by its length
        check = np.flatnonzero((ends - starts > 7) | (self.stops[slot + 1] - self.stops[slot] > 7))
        own = slot[check]
        other = check[spans_differ(eights(raw), starts[check], ends[check] - starts[check], self.view, self.stops[own], self.stops[own + 1] - self.stops[own])]
        if len(other):
            slot[other] = self._add(raw, starts[other], ends[other])
        size = self.sizes[slot].astype(np.int64)
        ends_ = np.cumsum(size)
        total = int(ends_[-1]) if len(ends_) else 0
        return self.ids[np.arange(total) + np.repeat(self.begins[slot] - (ends_ - size), size)], size


def code_points(raw: np.ndarray) -> np.ndarray:
    """At each byte, the code point that it belongs to, where all are below U+0800; other bytes get some number above."""
    out = raw.astype(np.int32)
    lead = np.flatnonzero((raw[:-1] >= 0xC2) & (raw[:-1] < 0xE0)) if len(raw) else np.zeros(0, np.int64)
    value = ((raw[lead].astype(np.int32) & 0x1F) << 6) | (raw[lead + 1] & 0x3F)
    out[lead], out[lead + 1] = value, value
    return out
