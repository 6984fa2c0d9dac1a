"""Operator 9: media payloads as ordered lists of content-defined chunks in a deduplicated store.

A payload is cut where a rolling gear hash of its last 32 bytes has its top bits clear, so equal stretches give equal
chunks wherever they lie. Chunk digests are deduplicated by Spark aggregates and joins: every digest keeps one stored
place, each payload an ordered list of places, from which it is rebuilt and verified. A map task keeps a digest once, and
joins on digests see that one row of it, so a digest in a third of all payloads weighs one row per pack.

Store: every map task writes the chunks that are new to it, compressed one by one, into one pack file of the shared
folder. Chunks that other packs hold too lose their place; packs that are dead for more than ``max_dead`` are rewritten
with their live chunks only. The stored form of a payload is its chunk list (count, then length and digest of each chunk)
followed by its chunks as stored.

Defined results: a null text is an empty payload (64 zero bytes); every row is kept, equal rows and equal keys too; an
empty table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import shared, textblocks

#: Chunk sizes in bytes: least, mean as a power of two, most.
LEAST, MEAN_BITS, MOST = 1024, 12, 16384
UNIT = 64
LEVEL = 3
GEAR = (textblocks.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The 32-byte rolling gear hash at every position: h = 2h + table[byte], by doubling windows."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[step:] += h[:-step] << np.uint32(step)
        h = wider
    return h


def padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payloads side by side: each text's bytes, then zeros up to a positive multiple of 64."""
    lengths = np.diff(offsets)
    sizes = np.maximum(UNIT, -(-lengths // UNIT) * UNIT)
    begins = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[np.arange(len(raw)) + np.repeat(begins - offsets[:-1], lengths)] = raw
    return out, np.append(begins, len(out))


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For every payload the ends of its chunks."""
    spots = np.flatnonzero(gear(data) >> np.uint32(32 - MEAN_BITS) == 0) + 1 if len(data) >= 32 else np.zeros(0, np.int64)
    out = []
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends = []
        while end - begin > LEAST:
            i = int(np.searchsorted(spots, begin + LEAST))
            begin = min(end, begin + MOST, int(spots[i]) if i < len(spots) else end)
            ends.append(begin)
        if begin < end:
            ends.append(end)
        out.append(ends)
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=20).digest()


CHUNKS = "pack long, row long, key long, n_bytes long, seq int, digest binary, size int, at long, stored int"


def pack_path(root: str, pack: int, turn: int) -> str:
    return f"{root}/pack-{pack:06d}-{turn}.bin"


def chunk(docs: DataFrame, root: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut every payload and write the packs; one row per chunk of each payload, with the place of its bytes."""
    shared.small_batches(docs.sparkSession)
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    types = [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int32()]

    def run(batches):
        pack, places, done, press = TaskContext.get().partitionId(), {}, [], zstandard.ZstdCompressor(level=LEVEL)

        def fill(out):
            row = at = 0
            for b in batches:
                rows: list[tuple] = []
                keys = b.column(0)
                for first, last, raw, offsets in textblocks.blocks(b.column(1)):
                    data, begins = padded(raw, offsets)
                    sizes = np.diff(offsets)
                    for i, ends in enumerate(cuts(data, begins)):
                        begin = int(begins[i])
                        for seq, end in enumerate(ends):
                            piece = data[begin:end].tobytes()
                            name = digest(piece)
                            if name not in places:
                                stored = press.compress(piece)
                                out.write(stored)
                                places[name] = (at, len(stored))
                                at += len(stored)
                            rows.append((pack, row, keys[first + i].as_py(), int(sizes[i]), seq, name, end - begin, *places[name]))
                            begin = end
                        row += 1
                if rows:
                    done.append(pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names))

        shared.publish(pack_path(root, pack, 0), fill)
        yield from done

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return shared.written(rows.mapInArrow(shared.worker(run), CHUNKS), "media-chunks")


def places(chunks: DataFrame, root: str, *, max_dead: float = 0.25) -> DataFrame:
    """One place per digest (pack, turn, at, stored); packs with too many dead bytes are rewritten and the old ones deleted."""
    spark = chunks.sparkSession
    once = chunks.groupBy("digest", "pack").agg(F.min("at").alias("at"), F.min("stored").alias("stored"))
    kept = once.groupBy("digest").agg(F.min(F.struct("pack", "at", "stored")).alias("p")).select("digest", F.col("p.pack").alias("pack"), F.lit(0).alias("turn"), F.col("p.at").alias("at"), F.col("p.stored").alias("stored"))
    held = chunks.groupBy("pack").agg(F.max(F.col("at") + F.col("stored")).alias("held"))
    live = kept.groupBy("pack").agg(F.sum("stored").alias("live"))
    thin = shared.written(held.join(live, "pack", "left").where(F.coalesce("live", F.lit(0)) < (1 - max_dead) * F.col("held")).select("pack"), "media-thin")
    if thin.isEmpty():
        return kept

    def rewrite(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        pack, ats, sizes = group["pack"][0].as_py(), group["at"].to_pylist(), group["stored"].to_pylist()
        files, path = shared.filesystem(pack_path(root, pack, 0))

        def fill(out):
            with files.open_input_file(path) as f:
                for at, size in zip(ats, sizes, strict=True):
                    out.write(f.read_at(size, at))

        shared.publish(pack_path(root, pack, 1), fill)
        moved = np.cumsum([0, *sizes[:-1]]).astype(np.int64)
        return group.set_column(group.column_names.index("at"), "at", pa.array(moved)).set_column(group.column_names.index("turn"), "turn", pa.array(np.ones(len(sizes), np.int32)))

    packed = kept.join(thin, "pack", "left_semi").select("digest", "pack", "turn", "at", "stored").groupBy("pack").applyInArrow(rewrite, "digest binary, pack long, turn int, at long, stored int")
    out = shared.written(kept.join(thin, "pack", "left_anti").select("digest", "pack", "turn", "at", "stored").unionByName(packed), "media-places")
    files, _ = shared.filesystem(root)
    for r in thin.toLocalIterator():
        files.delete_file(shared.filesystem(pack_path(root, r.pack, 0))[1])
    return out


class Packs:
    """Chunks by place; blocks of recently read packs stay in memory."""

    def __init__(self, root: str, block: int = 4 << 20, keep: int = 12):
        self.root, self.block, self.keep, self.files, self.blocks = root, block, keep, OrderedDict(), OrderedDict()

    def _open(self, pack: int, turn: int):
        if (f := self.files.get((pack, turn))) is None:
            files, path = shared.filesystem(pack_path(self.root, pack, turn))
            f = self.files[pack, turn] = files.open_input_file(path)
            if len(self.files) > 64:
                self.files.popitem(last=False)[1].close()
        return f

    def _block(self, pack: int, turn: int, n: int) -> bytes:
        if (data := self.blocks.get((pack, turn, n))) is None:
            data = self.blocks[pack, turn, n] = self._open(pack, turn).read_at(self.block, n * self.block)
            if len(self.blocks) > self.keep:
                self.blocks.popitem(last=False)
        else:
            self.blocks.move_to_end((pack, turn, n))
        return data

    def read(self, pack: int, turn: int, at: int, size: int) -> bytes:
        n = at // self.block
        data = self._block(pack, turn, n)[at - n * self.block : at - n * self.block + size]
        while len(data) < size:
            n += 1
            data += self._block(pack, turn, n)[: size - len(data)]
        return data


def recipe(sizes: list[int], names: list[bytes]) -> bytes:
    """The ordered chunk list as bytes."""
    return struct.pack("<I", len(sizes)) + b"".join(struct.pack("<I", n) + d for n, d in zip(sizes, names, strict=True))


def features(payload: bytes, chunks: int) -> str:
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    mean = float((counts * np.arange(256)).sum() / len(payload))
    spread = float(np.sqrt((counts * (np.arange(256) - mean) ** 2).sum() / len(payload)))
    return f"chunks={chunks};mean={mean:.4f};std={spread:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};distinct={int((counts > 0).sum())}"


def lists(chunks: DataFrame, kept: DataFrame, *, pack_bytes: int = 64 << 20) -> DataFrame:
    """One row per payload: its ordered chunk list with the stored place of each chunk.

    Payloads of one pack stay together, so a task reads few packs; there is a task for about ``pack_bytes`` of payload.
    """
    least = shared.shuffle_width(chunks.sparkSession)
    width = max(least, -(-(chunks.agg(F.sum("size")).first()[0] or 0) // pack_bytes))
    places_ = chunks.select("digest", "pack").distinct().join(kept.select("digest", F.struct("pack", "turn", "at", "stored").alias("place")), "digest")
    joined = chunks.select("pack", "row", "key", "n_bytes", "seq", "digest", "size").join(places_, ["pack", "digest"])
    return (
        joined.repartition(width, "pack")
        .groupBy("pack", "row")
        .agg(F.first("key").alias("key"), F.first("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(F.struct("seq", "digest", "size", "place"))).alias("list"))
        .sortWithinPartitions("pack", "row")
    )


def rebuild(recipes: DataFrame, root: str, measure, schema: str) -> DataFrame:
    """Rebuild every payload from its chunk list, each chunk checked by digest, and apply ``measure`` to it.

    ``measure(key, n_bytes, payload, stored form)`` gives the values of one row of ``schema``.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        packs, open_ = Packs(root), zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for r in b.to_pylist():
                pieces, stored = [], []
                for c in r["list"]:
                    p = c["place"]
                    stored.append(packs.read(p["pack"], p["turn"], p["at"], p["stored"]))
                    pieces.append(open_.decompress(stored[-1], max_output_size=c["size"]))
                    if digest(pieces[-1]) != c["digest"]:
                        raise ValueError("a stored chunk does not match its digest")
                form = recipe([c["size"] for c in r["list"]], [c["digest"] for c in r["list"]]) + b"".join(stored)
                rows.append(measure(r["key"], r["n_bytes"], b"".join(pieces), form, len(pieces)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)

    return recipes.select("key", "n_bytes", "list").mapInArrow(shared.worker(run), schema)


def describe(docs: DataFrame, *, key: str = "doc_id", text: str = "text", max_dead: float = 0.25, root: str | None = None) -> DataFrame:
    """Store every text as a chunked payload below ``root`` (else in scratch), read it back and describe it."""
    root = root or shared.scratch(docs.sparkSession, "media")
    chunks = chunk(docs, root, key=key, text=text)
    kept = places(chunks, root, max_dead=max_dead)

    def measure(name, n_bytes, payload, form, count):
        return name, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(form), hashlib.sha256(form).hexdigest(), features(payload, count)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rebuild(lists(chunks, kept), root, measure, schema)
