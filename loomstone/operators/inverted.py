"""A positional inverted index as partitioned tables, for the rows of ``retrieval.lexical`` and ``retrieval.matches`` without a scan.

Tables of a generation (folder ``g=N``), each in parts by batch:

* ``postings``: (token, field, block, keys, ns, positions) by bucket of the token's hash, sorted by token within files.
  A row is a token in a block of texts of one task: the keys that hold it, how often each does, and the positions, key after key;
* ``grams``: (gram, tokens between spaces) by bucket of the gram's first two characters, so that substrings find the tokens that hold them;
* ``keys``: the keys of a batch, how many postings each has and in which block; ``dead``: keys whose postings of earlier batches
  no longer count;
* ``ready``: written last; batches without it do not exist for readers, so a writer that stops half way leaves nothing.

Tokens are runs of other characters than blanks of a lower-cased text. Positions count on by one over a single space and by
two over any other separator, so that neighbours in a phrase are exactly one apart. A changed chunk is a new batch with its key
in ``dead``; readers leave out postings of dead keys (merge on read) until ``compact`` writes the next generation without them.

One writer at a time. Keys are unique within a batch; null texts have no postings; null keys cannot be looked up and are left
out. Substring and phrase queries of any length are exact; a phrase with other separators than single spaces is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.operators import retrieval

BUCKETS = 64
#: At most so many tokens are named in a filter, which prunes files and row groups; more are joined.
NAMED = 1000
#: A block takes texts until they are so many bytes, its grams so many tokens.
BLOCK_BYTES, BLOCK_TOKENS = 16 << 20, 100_000
_GAP = r" *[\x09-\x0D][\x20\x09-\x0D]*| {2,}"


def _bucket(column: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    return new


def _block(texts: pa.Table, fields: list[str]) -> Iterator[pa.RecordBatch]:
    """Postings of a block: texts split at spaces, places counted, tokens numbered and brought together."""
    texts = texts.combine_chunks()
    keys = texts["key"].chunk(0)
    number = int.from_bytes(hashlib.blake2b(str(keys[0].as_py()).encode(), digest_size=8).digest(), "big", signed=True)
    for i, f in enumerate(fields):
        runs = pc.split_pattern(texts[f"text{i}"].chunk(0), " ")
        row, words = pc.list_parent_indices(runs).to_numpy(), pc.list_flatten(runs).dictionary_encode()
        length = pc.fill_null(pc.list_value_length(runs), 0).to_numpy()
        at = np.arange(len(row)) - (np.cumsum(length) - length)[row]
        kept = ~pc.is_in(words.dictionary, pa.array(["", "\n"], words.dictionary.type)).to_numpy(zero_copy_only=False)
        code = words.indices.to_numpy()
        some = np.flatnonzero(kept[code]) if len(code) else np.zeros(0, int)
        some = some[np.argsort(code[some], kind="stable")]
        if not len(some):
            continue
        code, row, at = code[some], row[some], at[some]
        first, posting = _starts(code), _starts(code, row)
        owner, token = np.cumsum(posting) - 1, np.flatnonzero(first)
        n_places, n_keys = np.diff(token, append=len(code)), np.diff(owner[token], append=posting.sum())
        whole = lambda v: pa.array(v, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [words.dictionary.take(pa.array(code[token])), pa.array([f] * len(token)), pa.array(np.full(len(token), number)), _lists(n_keys, keys.take(pa.array(row[posting]))),
             _lists(n_keys, whole(np.diff(np.flatnonzero(posting), append=len(code)))), _lists(n_places, whole(at))],
            ["token", "field", "block", "keys", "ns", "positions"],
        )


def _blocks(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        step = max(1, len(b) * BLOCK_BYTES // max(b.nbytes, 1))
        for at in range(0, len(b), step):
            held.append(b.slice(at, step))
            size += held[-1].nbytes
            if size >= BLOCK_BYTES:
                yield from _block(pa.Table.from_batches(held), fields)
                held, size = [], 0
    if held:
        yield from _block(pa.Table.from_batches(held), fields)


def _without(rows: pa.Table, gone: pa.Table) -> pa.Table:
    """Postings of a block without those of some keys."""
    if not len(rows) or not len(gone):
        return rows
    rows = rows.combine_chunks()
    keys, ns, positions = (rows[c].chunk(0) for c in ("keys", "ns", "positions"))
    flat, n = pc.list_flatten(keys), pc.list_flatten(ns)
    stays = ~pc.is_in(flat, gone["key"].combine_chunks()).to_numpy(zero_copy_only=False)
    place = np.repeat(stays, n.to_numpy())
    n_keys, n_places = (np.bincount(pc.list_parent_indices(x).to_numpy()[of], minlength=len(rows)) for x, of in ((keys, stays), (positions, place)))
    new = {"keys": _lists(n_keys, flat.filter(pa.array(stays))), "ns": _lists(n_keys, n.filter(pa.array(stays))), "positions": _lists(n_places, pc.list_flatten(positions).filter(pa.array(place)))}
    return pa.table({c: new.get(c, rows[c]) for c in rows.column_names}).filter(pa.array(n_keys > 0))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every three characters of tokens padded by two at their end, so that each character begins one, with their tokens."""

    def made(tokens: list[str]) -> pa.RecordBatch:
        found: dict[str, list[str]] = {}
        for t in sorted(tokens):
            padded = t + "\n\n"
            for g in {padded[i : i + 3] for i in range(len(t))}:
                found.setdefault(g, []).append(t)
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(map(" ".join, found.values()), pa.string())], ["gram", "tokens"])

    held: list[str] = []
    for b in batches:
        held += b.column(0).to_pylist()
        if len(held) >= BLOCK_TOKENS:
            yield made(held)
            held = []
    if held:
        yield made(held)


def _entries(columns: list[str]) -> Column:
    """The keys of a row of postings; with "n" their counts, with "at" every position."""
    if columns == ["at"]:
        return F.arrays_zip(F.flatten(F.zip_with("keys", "ns", F.array_repeat)).alias("key"), F.col("positions").alias("at"))
    if columns == ["n"]:
        return F.arrays_zip(F.col("keys").alias("key"), F.col("ns").alias("n"))
    return F.transform("keys", lambda k: F.struct(k.alias("key")))


class Index:
    """An index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # which batches there are
    def _children(self, path: str, prefix: str) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        done = [n for n in names if n.startswith(prefix) and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
        return sorted(int(n[len(prefix) :]) for n in done)

    @property
    def generation(self) -> int:
        """The last generation that is complete."""
        return max(self._children(f"{self.root}/complete", "g="), default=0)

    def batches(self) -> list[int]:
        return self._children(f"{self.root}/g={self.generation}/ready", "batch=")

    def _read(self, table: str) -> DataFrame:
        """A table's rows of the batches that exist."""
        path, have = f"{self.root}/g={self.generation}/{table}", self.batches()
        if not have:
            raise ValueError(f"no index in {self.root}")
        return self.spark.read.option("basePath", path).parquet(*[f"{path}/batch={b}" for b in have])

    # writing
    def _write(self, generation: int, batch: int, postings: DataFrame, keys: DataFrame, dead: DataFrame) -> None:
        root = f"{self.root}/g={generation}"
        place = lambda table: f"{root}/{table}/batch={batch}"
        rows = postings.withColumn("bucket", _bucket(F.col("token"), self.buckets))
        # large buckets (a word that is everywhere) are split over several files
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(place("postings"))
        kept = self.spark.read.schema(rows.schema).parquet(place("postings"))
        grams = kept.select("token").distinct().mapInArrow(_grams, "gram string, tokens string")
        grams = grams.withColumn("bucket", _bucket(F.substring("gram", 1, 2), self.buckets))
        grams.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(place("grams"))
        counts = kept.select("block", F.explode("keys").alias("key")).groupBy("key", "block").agg(F.count("*").alias("n_postings"))
        keys.join(counts, "key", "left").select("key", "block", F.coalesce("n_postings", F.lit(0)).alias("n_postings")).write.mode("overwrite").parquet(place("keys"))
        dead.select("key").write.mode("overwrite").parquet(place("dead"))
        self.spark.range(1).select(F.lit(batch).alias("id")).coalesce(1).write.mode("overwrite").parquet(place("ready"))

    def _postings(self, chunks: DataFrame, key: str, columns: list[str]) -> DataFrame:
        texts = chunks.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[F.regexp_replace(F.lower(c), _GAP, " \n ").alias(f"text{i}") for i, c in enumerate(columns)])
        schema = f"token string, field string, block long, keys array<{texts.schema['key'].dataType.simpleString()}>, ns array<int>, positions array<int>"
        return texts.mapInArrow(lambda batches: _blocks(batches, columns), schema)

    def append(self, chunks: DataFrame, *, key: str, columns: list[str]) -> int:
        """Chunks with new keys, and new contents of keys that are there already, as one batch; its number."""
        batch = max(self.batches(), default=0) + 1
        keys = chunks.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
        dead = keys.join(self._read("keys").select("key").distinct(), "key", "left_semi") if batch > 1 else keys.where("false")
        self._write(self.generation, batch, self._postings(chunks, key, columns), keys, dead)
        return batch

    def delete(self, keys: DataFrame, *, key: str) -> int:
        """Chunks of the given keys no longer count, as one batch; its number."""
        batch = max(self.batches(), default=0) + 1
        self._write(self.generation, batch, self._read("postings").drop("batch", "bucket").where("false"), self._read("keys").select("key").where("false"), keys.select(F.col(key).alias("key")).distinct())
        return batch

    def compact(self) -> int:
        """The next generation: live postings only, in one batch. Readers change over when it is complete; its number."""
        following = self.generation + 1
        postings, keys = self._read("postings").drop("bucket"), self._read("keys")
        live = self.live(keys).select("key").distinct()
        # a block's keys that no longer count meet its postings
        gone = keys.where(F.col("block").isNotNull()).join(self._dead(), "key").where("batch < since").select("batch", "block", "key")
        by = ["batch", "block"]
        left = postings.groupBy(*by).cogroup(gone.groupBy(*by)).applyInArrow(_without, postings.schema).drop("batch")
        self._write(following, 1, left, live, live.where("false"))
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/complete/g={following}")
        return following

    def _dead(self) -> DataFrame:
        return self._read("dead").groupBy("key").agg(F.max("batch").alias("since"))

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (key, batch) of keys that no later batch has replaced or deleted."""
        return rows.join(self._dead(), "key", "left").where(F.coalesce(F.col("batch") >= F.col("since"), F.lit(True))).drop("since")

    def status(self) -> DataFrame:
        """One row: generation, batches, keys that count, postings that count and that no longer do."""
        keys = self._read("keys")
        live = self.live(keys).agg(F.count("*").alias("live_keys"), F.coalesce(F.sum("n_postings"), F.lit(0)).alias("live_postings"))
        return live.crossJoin(keys.agg(F.coalesce(F.sum("n_postings"), F.lit(0)).alias("stored"))).select(F.lit(self.generation).alias("generation"), F.lit(len(self.batches())).alias("batches"), "live_keys", "live_postings", (F.col("stored") - F.col("live_postings")).alias("dead_postings"))

    # reading
    def _tokens(self, part: str, fits) -> DataFrame:
        """Tokens that hold ``part``, read from its first gram's bucket; ``fits`` is the exact condition."""
        grams = self._read("grams").where(F.startswith(F.col("gram"), F.lit(part[:3])))
        if len(part) >= 2:
            grams = grams.where(F.col("bucket") == self._number(_bucket(F.lit(part[:2]), self.buckets)))
        return grams.select(F.explode(F.split("tokens", " ")).alias("token")).where(fits(F.col("token"))).distinct()

    def _number(self, bucket: Column) -> int:
        return self.spark.range(1).select(bucket).first()[0]

    def _of(self, tokens: DataFrame, columns: list[str]) -> DataFrame:
        """Live postings of some tokens (with their other columns): few are named in the filter, more are joined."""
        named = tokens.limit(NAMED + 1).withColumn("bucket", _bucket(F.col("token"), self.buckets)).collect()
        rows = self._read("postings")
        if len(named) <= NAMED:
            tokens = self.spark.createDataFrame([r[:-1] for r in map(tuple, named)], tokens.schema)
            rows = rows.where(F.col("bucket").isin(sorted({r.bucket for r in named})) & F.col("token").isin([r.token for r in named])) if named else rows.where("false")
            rows = rows.join(F.broadcast(tokens), "token")
        else:
            rows = rows.join(tokens.withColumn("bucket", _bucket(F.col("token"), self.buckets)), ["bucket", "token"])
        return self.live(rows.select("field", "batch", *tokens.columns, F.explode(_entries(columns)).alias("entry")).select("field", "batch", *tokens.columns, "entry.*"))

    def lexical(self, query: str, *, key: str, columns: dict[str, int] | None = None, pool: int = 30) -> DataFrame:
        """The rows of ``retrieval.lexical`` over the live chunks."""
        tokens, columns = retrieval.query_tokens(query), columns or retrieval.WEIGHTS
        if not tokens:
            return self._read("keys").select(F.col("key").alias(key), F.lit(0).alias("hits"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
        found = reduce(DataFrame.unionByName, [self._tokens(t, lambda c, t=t: F.contains(c, F.lit(t))) for t in dict.fromkeys(tokens)]).distinct()
        times = reduce(lambda a, b: a + b, [tx.occurrences(F.col("token"), t) for t in tokens])
        weight = reduce(lambda c, x: c.when(F.col("field") == x[0], x[1]), columns.items(), F.when(F.lit(False), 0)).otherwise(0)
        hits = self._of(found.select("token", times.alias("times")), ["n"]).groupBy("key").agg(F.sum(F.col("times") * F.col("n") * weight).cast("int").alias("hits")).where("hits > 0")
        score = F.round(F.least(F.lit(1.0), 0.2 + 0.1 * F.col("hits")), 4)
        top = hits.select(F.col("key").alias(key), "hits", score.alias("score")).orderBy(F.desc("score"), F.desc("hits"), key).limit(pool)
        return retrieval.ranked(top, [F.desc("score"), F.desc("hits"), F.col(key)])

    def _phrase(self, phrase: str, field: str) -> DataFrame:
        """Keys (some several times) whose field holds the phrase: its parts' postings, brought to where the phrase begins, meet at one position."""
        parts = phrase.split(" ")
        if "" in parts or any(c in phrase for c in "\t\n\v\f\r"):
            raise ValueError("a phrase is words between single spaces")
        last = len(parts) - 1
        places = []
        for i, p in enumerate(parts):
            if not last:
                fits = lambda c, p=p: F.contains(c, F.lit(p))
            else:
                fits = (lambda c, p=p: F.endswith(c, F.lit(p))) if i == 0 else (lambda c, p=p: F.startswith(c, F.lit(p))) if i == last else (lambda c, p=p: c == p)
            rows = self._of(self._tokens(p, fits), ["at"] if last else []).where(F.col("field") == field)
            places.append(rows.select("key", (F.col("at") - i).alias("at")) if last else rows.select("key"))
        if not last:
            return places[0]
        # a place holds one token, so a part meets a place once at most
        met = reduce(DataFrame.unionByName, places).groupBy("key", "at").agg(F.count("*").alias("parts"))
        return met.where(F.col("parts") == len(parts)).select("key")

    def _word(self, word: str, field: str) -> DataFrame:
        """Keys (some several times) whose field has the whole word."""
        return self._of(self._tokens(word, lambda c: F.array_contains(tx.words(c), word)), []).where(F.col("field") == field).select("key")

    def matches(self, query: str, *, key: str, column: str) -> DataFrame:
        """Keys of the rows that ``retrieval.matches`` keeps; the query wants one word or phrase at least."""
        q = retrieval.parse_query(query)
        wanted = [self._phrase(p, column) for p in q["phrases"]] + [self._word(w, column) for w in q["all"]]
        clauses = [(r, i) for i, r in enumerate(wanted)]
        clauses += [(self._word(w, column), len(wanted)) for w in q["any"]] + [(self._word(w, column), -1) for w in q["none"]]
        need = len(wanted) + bool(q["any"])
        if not need:
            raise ValueError("a query of unwanted words only")
        rows = reduce(DataFrame.unionByName, [r.select("key", F.lit(i).alias("clause")) for r, i in clauses])
        has = {i: F.max((F.col("clause") == i).cast("int")) for i in range(-1, need)}
        met = rows.groupBy("key").agg(reduce(lambda a, b: a + b, [has[i] for i in range(need)]).alias("met"), has[-1].alias("unwanted"))
        return met.where((F.col("met") == need) & (F.col("unwanted") == 0)).select(F.col("key").alias(key))
