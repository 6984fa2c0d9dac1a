"""Operator 11: phrase collocations by Toivonen mining, exact per language.

A sample of the documents proposes phrases that may be frequent: it is mined on its own at a lowered threshold. One pass over
all documents then counts the proposals and their negative border together: every phrase whose first part without its last
word and whose last part without its first word are both proposed (so the border is never listed; only those of its members
that occur are counted), and every single word. Where a member of the border turns out frequent, the sample had missed it: it
is proposed now, and another pass counts just the phrases that this brings in. Passes go on until no counted phrase is
frequent without having been proposed; then nothing frequent can be uncounted, whatever the sample held.

Proposals travel to the tasks as a bit set of a bounded size (two bits for a phrase, at most ``2 ** MOST_BITS`` bits). A
phrase that the bit set takes in by chance is counted in vain and changes no result, so the bound costs work, never rows;
borders and expansions are defined by the bit set itself. Phrases are dealt and summed by 64-bit hashes of language and words,
each task's occurrences added up before they are shuffled; texts of the frequent ones are found by a last pass.

Defined results: null texts count as empty and null languages as ``und``; keys play no part but in the sample; repeated rows
count as often as they occur; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm import shared, textblocks

LONGEST, LEAST, FIRST = 5, 100, 2000
#: One bucket of documents in so many is the sample, and a phrase is proposed from this share of its expected count on.
SAMPLE, LOWERED = 8, 0.6
#: Bits of the largest bit set (32 MiB).
MOST_BITS = 28
#: Occurrences that a task adds up before it hands their counts on.
HELD = 8_000_000
#: Documents fall into ``2 ** PLACES`` buckets by hash; a counted phrase remembers one in which it occurs.
PLACES = 12


class Proposals:
    """A bit set of phrase hashes; two of ``2 ** bits`` bits stand for each."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits, self.data = bits, np.zeros(1 << bits - 3, np.uint8) if data is None else data

    def has(self, code: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        out = np.ones(len(code), bool)
        for shift in (64 - self.bits, 64 - 2 * self.bits):
            at = code >> np.uint64(shift) & mask
            out &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out

    def joined(self, codes: DataFrame) -> Proposals:
        """With the hashes of a table as well: bit sets of buckets are made by an aggregate, so at most the whole set is collected."""
        mask = (1 << self.bits) - 1
        places = [F.shiftrightunsigned("code", 64 - self.bits), F.shiftrightunsigned("code", 64 - 2 * self.bits).bitwiseAND(F.lit(mask).cast("long"))]
        at = codes.select(F.explode(F.array(*places)).alias("at"))
        rows = at.groupBy(F.expr("at div 32768").alias("bucket")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("part"))
        data = np.zeros(max(1 << self.bits - 3, 4096), np.uint8)
        data[: len(self.data)] = self.data
        for r in rows.toLocalIterator():
            data[4096 * r.bucket : 4096 * (r.bucket + 1)] |= np.frombuffer(r.part, np.uint8)
        return Proposals(self.bits, data)

    @staticmethod
    def room_for(count: int) -> Proposals:
        return Proposals(max(15, min(MOST_BITS, (32 * count).bit_length())))


def lang_code(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _lang_codes(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct languages, their hashes, the number of each row's)."""
    held = column.fill_null("und").dictionary_encode() if column.null_count else column.dictionary_encode()
    names = held.dictionary.to_pylist()
    return names, np.array([lang_code(x) for x in names], np.uint64), held.indices.to_numpy(zero_copy_only=False)


def _blocks(batch: pa.RecordBatch):
    """(languages, language number, bucket, piece and hash (of language and word) of each word, lower-cased bytes, starts, ends)."""
    names, codes, of_row = _lang_codes(batch.column("lang"))
    buckets = batch.column("bucket").to_numpy().astype(np.uint16)
    for first, _, raw, offsets in textblocks.blocks(batch.column("text"), 1 << 21):
        owner, piece, starts, ends, raw = textblocks.pieced_words(raw, offsets)
        lang = of_row[first + owner]
        yield names, lang, buckets[first + owner], piece, textblocks.mix(textblocks.span_hashes(raw, starts, ends) ^ codes[lang]), raw, starts, ends


def _longer(code: np.ndarray, at: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the phrases of k words from ``at`` on, from those of k - 1 words."""
    return textblocks.mix((code[at] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) + word[at + k - 1])


def _windows(word: np.ndarray, piece: np.ndarray, now: Proposals, before: Proposals | None = None, open_from: int = LONGEST + 1):
    """For each number of words k: (k, starts of the phrases to count, their hashes).

    To count are phrases of proposed parts (by ``now``) that were not to be counted by ``before``; phrases of ``open_from``
    words and more pass as proposed.
    """
    n = len(word)
    yield 1, np.arange(n), word
    code, on, was = word, now.has(word), before.has(word) if before is not None else None
    for k in range(2, LONGEST + 1):
        if n < k:
            return
        m = n - k + 1
        at = np.flatnonzero(on[:m] & on[1 : m + 1] & (piece[:m] == piece[k - 1 :]))
        longer = np.zeros(m, np.uint64)
        longer[at] = _longer(code, at, word, k)
        if was is None:
            yield k, at, longer[at]
        else:
            new = at[~(was[at] & was[at + 1])]
            yield k, new, longer[new]
            held = np.zeros(m, bool)
            held[at] = before.has(longer[at]) & was[at] & was[at + 1]
            was = held
        code, on = longer, np.zeros(m, bool)
        on[at] = True if k >= open_from else now.has(longer[at])


def _counts(codes: list[np.ndarray], buckets: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct codes, their number and one of their buckets in one long."""
    code = np.concatenate(codes)
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    number = np.diff(np.append(first, len(code))) << PLACES | np.concatenate(buckets)[order[first]]
    return pa.record_batch({"code": pa.array(code[first].view(np.int64)), "n": pa.array(number)})


def count(docs: DataFrame, now: Proposals, before: Proposals | None = None, *, words: tuple[int, int] = (1, LONGEST), open_from: int = LONGEST + 1, least: int = LEAST) -> DataFrame:
    """(code, n, bucket) of the counted phrases of ``words[0]`` to ``words[1]`` words that occur ``least`` times or more, written."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((now.bits, now.data, None if before is None else before.data))

    def run(batches):
        shared.tidy()
        bits, data, old = sent.value
        new, past = Proposals(bits, data), None if old is None else Proposals(bits, old)
        codes, buckets, size = [], [], 0
        for batch in batches:
            for _, _, bucket, piece, word, *_ in _blocks(batch):
                for k, at, code in _windows(word, piece, new, past, open_from):
                    if k > words[1]:
                        break
                    if k >= words[0]:
                        codes.append(code)
                        buckets.append(bucket[at])
                        size += len(code)
                if size > HELD:
                    yield _counts(codes, buckets)
                    codes, buckets, size = [], [], 0
        if size:
            yield _counts(codes, buckets)

    # a task has added up its own already, so rows are dealt as they are
    rows = docs.mapInArrow(run, "code long, n long").repartition("code").groupBy("code")
    rows = rows.agg(F.sum(F.shiftright("n", PLACES)).alias("n"), F.min(F.col("n").bitwiseAND(F.lit((1 << PLACES) - 1).cast("long"))).alias("bucket"))
    out = shared.written(rows.where(F.col("n") >= least), "phrase-counts")
    sent.destroy()
    return out


def propose(docs: DataFrame, sample: int, least: int) -> Proposals:
    """What a sample proposes: its words, then pairs of proposed words, then longer phrases all of whose pairs are proposed."""
    part = docs.where(F.col("bucket") % sample == 0)
    singles = count(part, Proposals(15), words=(1, 1), least=least)
    found = Proposals.room_for(4 * singles.count()).joined(singles)
    found = found.joined(count(part, found, words=(2, 2), least=least))
    return found.joined(count(part, found, words=(3, LONGEST), open_from=3, least=least))


def prepared(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """text, lang and the bucket of every document."""
    return docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.pmod(F.xxhash64(key, text), F.lit(1 << PLACES)).cast("int").alias("bucket"))


def frequent(docs: DataFrame, *, least: int = LEAST, sample: int = SAMPLE, lowered: float = LOWERED) -> tuple[DataFrame, int]:
    """(code, n, bucket) of every phrase of 1 to 5 words that occurs ``least`` times or more, and the passes over ``prepared`` documents."""
    now = propose(docs, sample, max(2, int(lowered * least / sample)))
    counted, passes = count(docs, now, least=least), 1
    while True:
        sent = docs.sparkSession.sparkContext.broadcast((now.bits, now.data))

        def missed(batches, sent=sent):
            held = Proposals(*sent.value)
            for b in batches:
                yield b.filter(pa.array(~held.has(b.column("code").to_numpy().view(np.uint64))))

        border = shared.written(counted.select("code").mapInArrow(missed, "code long"), "phrase-border")
        if border.isEmpty():
            return counted, passes
        wider = now.joined(border)
        counted = counted.unionByName(count(docs, wider, now, words=(2, LONGEST), least=least))
        now, passes = wider, passes + 1


def _placed(code: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return textblocks.mix(code + (bucket.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _texts(docs: DataFrame, counted: DataFrame, held: Proposals) -> DataFrame:
    """(lang, phrase, code, words): texts of the counted phrases, and the words of a language (phrase null).

    A phrase is read only in documents of the bucket that its count remembers, once for a task, so there are hardly more rows
    than phrases, however many tasks hold them.
    """

    def place(batches):
        for b in batches:
            yield pa.record_batch({"code": pa.array(_placed(b.column("code").to_numpy().view(np.uint64), b.column("bucket").to_numpy()).view(np.int64))})

    spots = Proposals(held.bits).joined(counted.select("code", "bucket").mapInArrow(place, "code long"))
    sent = docs.sparkSession.sparkContext.broadcast((held.bits, held.data, spots.data))

    def run(batches):
        shared.tidy()
        bits, data, here = sent.value
        wanted, near, seen, total = Proposals(bits, data), Proposals(bits, here), np.zeros(0, np.uint64), {}
        for batch in batches:
            for names, lang, bucket, piece, word, raw, starts, ends in _blocks(batch):
                for i, n in enumerate(np.bincount(lang, minlength=len(names)).tolist()):
                    total[names[i]] = total.get(names[i], 0) + n
                langs, phrases, codes = [], [], []
                for k, at, code in _windows(word, piece, wanted):
                    own = near.has(_placed(code, bucket[at]))
                    code, first = np.unique(code[own], return_index=True)
                    new = ~np.isin(code, seen)
                    spots = at[own][first[new]]
                    data = raw.tobytes() if len(spots) else b""
                    for i in spots.tolist():
                        phrases.append(b" ".join([data[starts[j] : ends[j]] for j in range(i, i + k)]))
                    langs += [names[x] for x in lang[spots].tolist()]
                    codes.append(code[new])
                if phrases:
                    fresh = np.concatenate(codes)
                    seen = np.concatenate([seen if len(seen) < HELD else seen[:0], fresh])
                    texts = pa.array(phrases, pa.binary()).cast(pa.string())
                    yield pa.record_batch({"lang": pa.array(langs, pa.string()), "phrase": texts, "code": pa.array(fresh.view(np.int64)), "words": pa.nulls(len(langs), pa.int64())})
        if total:
            yield pa.record_batch({"lang": pa.array(list(total), pa.string()), "phrase": pa.nulls(len(total), pa.string()), "code": pa.nulls(len(total), pa.int64()), "words": pa.array(list(total.values()), pa.int64())})

    return docs.mapInArrow(run, "lang string, phrase string, code long, words long")


def mine(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", least: int = LEAST, first: int = FIRST, sample: int = SAMPLE, lowered: float = LOWERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    a, l, r are the counts of the phrase and of the two parts of its lowest-scoring cut, n the language's words, and score is
    floor(1000 a n / (l r)) in decimals of 38 digits (counts below 10 ** 16). Phrases inside a longer one as frequent go.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    rows = prepared(docs, key, text, lang)
    counted, _ = frequent(rows, least=least, sample=sample, lowered=lowered)
    exact = Proposals.room_for(counted.count()).joined(counted)
    told = shared.written(_texts(rows, counted, exact).groupBy("lang", "phrase", "code").agg(F.sum("words").alias("words")), "phrase-texts")
    sizes = F.broadcast(told.where("phrase IS NULL").select("lang", F.col("words").alias("n")))
    texts = told.where("phrase IS NOT NULL").select("lang", "phrase", "code")
    phrases = shared.written(texts.join(counted, "code").select("lang", "phrase", F.col("n").alias("f"), F.split("phrase", " ").alias("w")), "phrases")

    longer = phrases.where(F.size("w") >= 2)
    inner = longer.where(F.size("w") >= 3).select("lang", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.size("w") - 1), " "))).alias("phrase"), F.col("f").alias("within"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("within").alias("within"))
    kept = longer.join(inner, ["lang", "phrase"], "left").where(F.coalesce("within", F.lit(0)) < F.col("f")).drop("within")

    cut = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"), "w")
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        parts = phrases.select(F.col("phrase").alias(side), "lang", F.col("f").alias(name))
        cut = shared.written(cut, "phrase-cuts")
        cut = shared.salted(cut, parts, [side, "lang"], shared.hot(cut, side))
    big = {c: F.col(c).cast("decimal(16,0)") for c in ("a", "n", "l", "r")}
    scored = cut.join(sizes, "lang").withColumn("score", F.expr("1000 * CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0))").cast("decimal(38,0)"))
    scored = scored.withColumn("lr", (big["l"] * big["r"]).cast("decimal(38,0)")).withColumn("score", F.expr("score div lr"))
    low = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = low.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w)) AS n FROM split GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
grams AS (SELECT lang, w[i : i + k - 1] AS g FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 100),
inner_ AS (
  SELECT lang, g, max(f) AS within FROM (SELECT lang, g[1 : len(g) - 1] AS g, f FROM f WHERE len(g) >= 3 UNION ALL SELECT lang, g[2 : len(g)] AS g, f FROM f WHERE len(g) >= 3) GROUP BY lang, g),
kept AS (SELECT f.* FROM f LEFT JOIN inner_ i ON f.lang = i.lang AND f.g = i.g WHERE len(f.g) >= 2 AND coalesce(i.within, 0) < f.f),
cuts AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM kept),
scored AS (
  SELECT c.lang, c.g, c.a, c.k, l.f AS l, r.f AS r, s.n, (1000 * c.a::HUGEINT * s.n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.g = c.g[1 : c.k] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.k + 1 : len(c.g)] JOIN sizes s ON s.lang = c.lang),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM low)
SELECT lang, rank::BIGINT AS rank, array_to_string(g, ' ') AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
