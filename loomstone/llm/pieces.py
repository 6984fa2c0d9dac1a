"""Operator 10: SentencePiece models run by the tokenizers library, with parity checked against sentencepiece itself.

``read_model`` parses the model protobuf; ``build`` makes a tokenizer of it: normaliser, metaspace marker, unigram scores
(or, for a BPE model, the merges that the piece scores imply), byte fallback and decoder. Texts are encoded batch by
batch on several threads.

Defined results: a null text counts as empty and has no ids; white space that the model's normaliser drops is lost on
decoding, which ``round_trip`` reports; every row is kept, repeated ones too; of the input only ``keys`` stay, and a key
named like a result column gives way to it.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import shared, textblocks

MARK = "▁"
#: Field numbers and codes of the public model protobuf (fixed values of that format).
PIECE, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def read_model(data: bytes) -> PieceModel:
    model = PieceModel()
    for number, value in fields(data):
        if number == PIECE:
            parts = dict(fields(value))
            model.pieces.append((parts.get(1, b"").decode(), struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0, parts.get(3, NORMAL)))
        elif number == TRAINER:
            parts = dict(fields(value))
            model.kind, model.byte_fallback = parts.get(3, UNIGRAM), bool(parts.get(35, 0))
        elif number == NORMALIZER:
            parts = dict(fields(value))
            model.charsmap = parts.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(parts.get(i, 1)) for i in (3, 4, 5))
    return model


def separable(model: PieceModel) -> bool:
    """True where no piece runs from another character into a marker: then marker runs cut a text without loss."""
    return not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER))


def build(model: PieceModel, single: bool = False):
    """The whole tokenizer or, without normaliser, pre-tokenizer and decoder, one of single normalised segments."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = next((p for p, _, kind in model.pieces if kind == UNKNOWN), None)

    def core():
        if model.kind == UNIGRAM:
            return models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=ids.get(unknown), byte_fallback=model.byte_fallback)
        normal = {p for p, _, kind in model.pieces if kind in (NORMAL, USER)}
        joins = [(-score, ids[p[:i]], ids[p[i:]], p[:i], p[i:]) for p, score, kind in model.pieces if kind == NORMAL for i in range(1, len(p)) if p[:i] in normal and p[i:] in normal]
        return models.BPE(ids, [x[3:] for x in sorted(joins)], unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    steps += [normalizers.Prepend(MARK if model.escape else " ")] * model.dummy_prefix + [normalizers.Replace(" ", MARK)] * model.escape
    whole = Tokenizer(core())
    whole.add_tokens([AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER])
    if single:
        return whole
    whole.normalizer = normalizers.Sequence(steps)
    if separable(model):
        whole.pre_tokenizer = pre_tokenizers.Split(Regex(SEGMENT), "isolated")
    whole.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    return whole


SEGMENT = f"{MARK}+[^{MARK}]*|[^{MARK}]+"


class PieceCoder:
    """Encode and decode batches of whole texts; distinct segments go through the model once.

    Where no piece runs from another character into a marker, a text is cut before each run of spaces without changing its
    ids. A text that holds the marker itself, or a model that changes other characters than spaces, takes the library's own
    normaliser and pre-tokenizer instead.
    """

    def __init__(self, path: str, threads: int = 1):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        model = read_model(data)
        self.model, self.single = model, build(model, single=True)
        plain = model.escape and model.dummy_prefix and not model.charsmap and not model.squeeze
        self.cuts = plain and separable(model) and not any(kind == USER for _, _, kind in model.pieces)
        self.spans = textblocks.SpanIds(self._segments, np.int32, 300_000)
        self.bytes_of, self.begins, self.sizes, self.is_byte = self._tables(model)
        self.strip = model.dummy_prefix
        self.judge = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.threads = threads

    @cached_property
    def whole(self):
        """The whole tokenizer, made where a text or an id sequence needs it."""
        return build(self.model)

    def _segments(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments and the number of the segment of each, in one batch for each thread."""
        texts = [x.replace(" ", MARK) for x in texts]
        step = max(1, -(-len(texts) // self.threads))
        got = self.single.encode_batch([texts[i : i + step] for i in range(0, len(texts), step)], is_pretokenized=True, add_special_tokens=False)
        return np.concatenate([np.array(e.ids, np.int32) for e in got]), np.concatenate([np.array(e.word_ids, np.int64) + i * step for i, e in enumerate(got)])

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """ids of every text of the column, in order."""
        if not self.cuts:
            return self._whole(["" if x is None else x for x in column.to_pylist()])
        out: list[np.ndarray] = []
        for first, last, raw, offsets in textblocks.blocks(column):
            n = last - first
            marked = np.zeros(n, bool)
            at = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)) if len(raw) > 2 else np.zeros(0, np.int64)
            marked[np.searchsorted(offsets, at, "right") - 1] = True
            begins = offsets + np.arange(n + 1)
            data = np.full(len(raw) + n, 0x20, np.uint8)
            data[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = raw
            space = data == 0x20
            start = space.copy()
            start[1:] &= ~space[:-1]
            start[begins[:-1]] = True
            starts = np.flatnonzero(start)
            ends = np.append(starts[1:], len(data))
            owner = np.searchsorted(begins, starts, "right") - 1
            keep = ~(marked | (np.diff(offsets) == 0))[owner]
            starts, ends, owner = starts[keep], ends[keep], owner[keep]
            ids, sizes = self.spans(data, starts, ends)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, sizes, n).astype(np.int64))])
            out += [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            for i in np.flatnonzero(marked):
                out[first + i] = self._whole([raw[offsets[i] : offsets[i + 1]].tobytes().decode()])[0]
        return out

    def _tables(self, model: PieceModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The decoder's output for each id: bytes side by side, where each begins, its length, whether it is a byte piece."""
        parts = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]
        sizes = np.array([len(x) for x in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes, np.array([kind == BYTE for _, _, kind in model.pieces])

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of id sequences. Where byte pieces form no valid text, the library's decoder places replacement signs."""
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        size = self.sizes[flat]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        data = self.bytes_of[np.arange(total) + np.repeat(self.begins[flat] - (ends - size), size)].tobytes()
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, ids)])].tolist()
        out = []
        for x, a, b in zip(ids, cuts[:-1], cuts[1:], strict=True):
            try:
                out.append(data[a + 1 if self.strip and data[a : a + 1] == b" " and b > a else a : b].decode())
            except UnicodeDecodeError:
                out.append(self.whole.decode(x.tolist(), skip_special_tokens=False))
        return out

    def agrees(self, texts: list[str], ids: list[np.ndarray]) -> list[bool]:
        """Whether sentencepiece gives the same ids."""
        return [np.array_equal(a, b) for a, b in zip(ids, self.judge.encode(texts, num_threads=self.threads), strict=True)]


def groups_of(texts: list[str], limit: int = 1 << 19) -> Iterator[slice]:
    """Slices of whole texts of about ``limit`` characters together."""
    first, held = 0, 0
    for i, x in enumerate(texts):
        held += len(x)
        if held >= limit:
            yield slice(first, i + 1)
            first, held = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def model_path(path: str | None = None) -> str:
    """The public SentencePiece model, or another file."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@shared.kept("pieces")
def _coder(path: str, threads: int) -> PieceCoder:
    return PieceCoder(path, threads)


def encode(docs: DataFrame, *, keys: tuple[str, ...] = ("doc_id",), text: str = "text", path: str | None = None, threads: int = 2, with_ids: bool = True, with_text: bool = False, verify: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``keys``, n_tokens, ids_crc32, decoded_sha256, round_trip, parity and, if wanted, ids and decoded (the text that the ids give).

    The whole text is encoded and its ids are decoded again. ``parity`` is null unless ``verify``.
    """
    shared.small_batches(docs.sparkSession)
    made = {"n_tokens", "ids_crc32", "decoded_sha256", "round_trip", "parity", "ids", *["decoded"] * with_text}
    keys = tuple(k for k in keys if k.lower() not in made)
    rows = docs.select(*[F.col(f"`{k}`") for k in keys], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes[:-1]) + ", n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean, parity boolean" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches):
        coder = _coder(model_path(path), threads)
        for b in batches:
            shared.tidy("pieces")
            texts = b.column(len(keys)).to_pylist()
            for s in groups_of(texts):
                part = texts[s]
                ids = coder.encode(b.column(len(keys)).slice(s.start, s.stop - s.start))
                back = coder.decode(ids)
                cols = [b.column(i).slice(s.start, s.stop - s.start) for i in range(len(keys))]
                cols += [pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                cols += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]), pa.array([x == y for x, y in zip(back, part, strict=True)])]
                cols.append(pa.array(coder.agrees(part, ids) if verify else [None] * len(ids), pa.bool_()))
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32())))
                if with_text:
                    cols.append(pa.array(back, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [*keys, "n_tokens", "ids_crc32", "decoded_sha256", "round_trip", "parity", *["ids"] * with_ids, *["decoded"] * with_text])

    return rows.mapInArrow(shared.worker(run, "pieces"), schema)
