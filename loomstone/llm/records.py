"""Operator 7: token ids as length-delimited binary records with masked checksums and a separate offset index.

File format (little-endian). ``part-NNNNN.rec`` is a run of frames::

    uint64 length | uint32 masked checksum of those 8 bytes | payload | uint32 masked checksum of the payload

A checksum is CRC-32, rotated right by 15 bits plus a constant, so that a checksum of data that hold checksums stays
useful. The payload is ``int64 key | uint8 key present | uint8 bytes per id | uint32 ids`` and then the ids.
``part-NNNNN.idx`` has one ``int64 key | uint64 frame offset | uint64 frame bytes | uint64 ids`` entry per record, so a
reader may visit the frames in any order (``shuffled``) without scanning.

Defined results: a null text is an empty one (only the end id is stored); a null key is stored as absent and sorts
first; equal keys keep one record each; an empty table gives no record; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import random
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm import shared, textblocks

FRAME, PAYLOAD, INDEX = struct.Struct("<QI"), struct.Struct("<qBBI"), np.dtype([("key", "<i8"), ("at", "<u8"), ("size", "<u8"), ("ids", "<u8")])
#: The constant added to a rotated checksum (fixed value of the masked-checksum record convention).
MASK_DELTA = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(key: int | None, ids: np.ndarray) -> bytes:
    body = PAYLOAD.pack(key or 0, key is not None, ids.itemsize, len(ids)) + ids.tobytes()
    length = struct.pack("<Q", len(body))
    return length + struct.pack("<I", masked(length)) + body + struct.pack("<I", masked(body))


def unframe(data: bytes) -> tuple[int | None, np.ndarray]:
    """Key and ids of one frame; ValueError where a length or checksum does not hold."""
    length, check = FRAME.unpack_from(data)
    body = data[FRAME.size : FRAME.size + length]
    if check != masked(data[:8]) or len(body) != length or struct.unpack_from("<I", data, FRAME.size + length)[0] != masked(body):
        raise ValueError("damaged record")
    key, present, width, count = PAYLOAD.unpack_from(body)
    return (key if present else None), np.frombuffer(body, f"<u{width}", count, PAYLOAD.size)


LETTER, NUMBER, SPACE, OTHER, STOP = range(5)


def _classes(limit: int = 0x250) -> np.ndarray:
    """Character classes of the byte-level pre-tokenizer's pattern, for code points below ``limit``."""
    return np.array([SPACE if chr(i).isspace() and i not in range(0x1C, 0x20) else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(i))[0], OTHER) for i in range(limit)], np.int8)


class BatchEncoder:
    """ids of whole texts by the tokenizers library; each distinct pre-token goes through the model once.

    Byte-level BPE never merges across pre-tokens, so equal pre-tokens have equal ids. The pre-tokens of a block of texts
    are found at once by character classes; a text with characters from U+0250 or with rare control characters, on which
    regular-expression engines may differ, and a text that holds an added token of the model is encoded whole instead.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.spans = textblocks.SpanIds(self._apart, self.dtype)
        self.table = _classes()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        e = self.model.encode(texts, is_pretokenized=True, add_special_tokens=False)
        return np.array(e.ids, self.dtype), np.array(e.word_ids, np.int64)

    def _added_at(self, data: bytes) -> list[int]:
        """Where strings of added tokens begin."""
        out = []
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                out.append(at)
                at = data.find(token, at + 1)
        return out

    def pre_tokens(self, raw: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens of texts that each end at one of ``stops`` (a byte that is no text)."""
        points = textblocks.code_points(raw)
        kind = self.table[np.minimum(points, len(self.table) - 1)]
        kind[stops] = STOP
        follow = (raw >= 0x80) & (raw < 0xC0)
        start = np.empty(len(raw), bool)
        start[0], start[1:] = True, kind[1:] != kind[:-1]
        # a space before a word belongs to it; of white space before a word, the last character stands apart
        last = np.flatnonzero(start[1:] & (kind[:-1] == SPACE) & (kind[1:] != STOP))
        start[last] = True
        start[last[raw[last] == 0x20] + 1] = False
        # contractions at the start of a run of other characters
        mark = np.flatnonzero(start & (raw == 0x27))
        mark = mark[mark + 2 < len(raw)]
        one, two = raw[mark + 1], raw[mark + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for at, size in ((mark[short], 2), (mark[long], 3)):
            start[at + 1] = False
            after = at + size
            same = kind[after] == LETTER
            start[after[same]] = True
        begins = np.flatnonzero(start & ~follow)
        ends = np.append(begins[1:], len(raw))
        real = kind[begins] != STOP
        return begins[real], ends[real]

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        """ids of every text of the column, in order."""
        for first, last, raw, offsets in textblocks.blocks(column):
            lengths = np.diff(offsets)
            n = last - first
            odd_byte = (raw >= 0xCA) | ((raw >= 0x1C) & (raw < 0x20))
            odd_byte[:-1] |= (raw[:-1] == 0xC2) & ((raw[1:] == 0x85) | (raw[1:] == 0xA0))
            odd = np.zeros(n, bool)
            odd[np.searchsorted(offsets, np.flatnonzero(odd_byte), "right") - 1] = True
            odd[[np.searchsorted(offsets, at, "right") - 1 for at in self._added_at(raw.tobytes())]] = True
            spaced, begins = textblocks.spaced(raw, offsets)
            starts, ends = self.pre_tokens(spaced, begins[1:] - 1)
            owner = np.searchsorted(begins, starts, "right") - 1
            if odd.any():
                keep = ~odd[owner]
                starts, ends, owner = starts[keep], ends[keep], owner[keep]
            ids, sizes = self.spans(spaced, starts, ends)
            per_text = np.bincount(owner, sizes, n).astype(np.int64)
            cuts = np.concatenate([[0], np.cumsum(per_text)])
            for i in range(n):
                if odd[i]:
                    yield np.array(self._ids([raw[offsets[i] : offsets[i] + lengths[i]].tobytes().decode()])[0], self.dtype)
                else:
                    yield ids[cuts[i] : cuts[i + 1]]


def write(docs: DataFrame, encoder: Callable[[], BatchEncoder], *, key: str = "doc_id", text: str = "text", end_id: int = 0, file_bytes: int = 32 << 20, root: str | None = None) -> DataFrame:
    """Encode ``text`` and write record files in ascending ``key`` order; returns the manifest (one row per file).

    One range shuffle of (key, text) orders the files; every task then streams its range into one file and its index.
    ``encoder`` makes the encoder on the worker. ``file_bytes`` is the mean number of text bytes behind a file. Files go
    below ``root``, a shared folder; without one into scratch, which ends with the application.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    root = root or shared.scratch(spark, "records")
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    files = max(1, -(-total // file_bytes))

    def run(batches):
        part, encode, entries, state = TaskContext.get().partitionId(), encoder(), [], {"at": 0}

        def fill(out):
            for b in batches:
                for k, ids in zip(b.column(0).to_pylist(), encode(b.column(1)), strict=True):
                    data = frame(k, np.append(ids, np.array([end_id], ids.dtype)))
                    out.write(data)
                    entries.append((k or 0, state["at"], len(data), len(ids) + 1))
                    state["at"] += len(data)

        name = f"{root}/part-{part:05d}"
        shared.publish(f"{name}.rec", fill)
        index = np.array(entries, INDEX)
        shared.publish(f"{name}.idx", lambda out: out.write(index.tobytes()))
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "n_records": [len(index)], "n_ids": [int(index["ids"].sum())], "n_bytes": [state["at"]]})

    ordered = rows.repartitionByRange(int(files), "k").sortWithinPartitions("k")
    return shared.written(ordered.mapInArrow(shared.worker(run, "records"), "part long, path string, n_records long, n_ids long, n_bytes long"), "records-manifest")


def frames(path: str, order: Callable[[np.ndarray], np.ndarray] | None = None, block: int = 4 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of one file, in file order or in the order that ``order`` gives the index; memory stays at ``block`` bytes."""
    files, at = shared.filesystem(f"{path}.idx")
    with files.open_input_stream(at) as f:
        index = np.frombuffer(f.read(), INDEX)
    with files.open_input_file(at[:-4] + ".rec") as f:
        if order is not None:
            for i in order(index):
                yield unframe(f.read_at(int(index["size"][i]), int(index["at"][i])))
            return
        first = 0
        while first < len(index):
            last = max(first + 1, int(np.searchsorted(index["at"], index["at"][first] + block, "left")))
            begin = int(index["at"][first])
            data = f.read_at(int(index["at"][last - 1] + index["size"][last - 1]) - begin, begin)
            for i in range(first, last):
                here = int(index["at"][i]) - begin
                yield unframe(data[here : here + int(index["size"][i])])
            first = last


def shuffled(path: str, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Every record of a file once, in an order that ``seed`` fixes, by the offset index."""

    def order(index):
        picks = list(range(len(index)))
        random.Random(seed).shuffle(picks)
        return picks

    return frames(path, order)


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files; ``start`` counts the ids of all before it."""
    files = max(1, manifest.count())
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for key, ids in frames(path):
                    rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 20_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return manifest.select("path", before.alias("start")).repartition(files).mapInArrow(shared.worker(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


@shared.kept("records")
def _byte_level(path: str | None) -> BatchEncoder:
    import public_tokenizers

    return BatchEncoder(path or public_tokenizers.path("byte_bpe_50k.json"))


def byte_level_encoder(path: str | None = None) -> Callable[[], BatchEncoder]:
    """The public byte-level vocabulary (or another file of the same kind), opened once in each worker process."""
    return partial(_byte_level, path)
