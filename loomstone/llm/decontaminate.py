"""Operator 8: benchmark items inside documents, by a size-partitioned MinHash containment search. DataFrame functions only.

Words are runs of letters and digits of the lower-cased text; shingles are five words (a shorter text is one shingle).
With ``short_inside`` documents also have shingles of the lengths of shorter items, so that these are found inside longer
texts; without, only in texts that consist of nothing else, which is what ``ORACLE`` counts.
Items are partitioned by their number of shingles, in powers of two. An item's sketch is its ``s`` least shingle hashes,
where ``s`` belongs to the partition: one more than the shingles that an item of the partition's largest size may miss at
the wanted containment. So a document that holds enough of an item holds at least ``need`` hashes of its sketch: the
search loses nothing, and what it finds is verified by exact shingle containment.

A sketch is the only thing that every document shingle meets, and it has about a quarter of an item's shingles. It is
broadcast only where its counted rows are within ``broadcast_rows``; beyond, both sides are shuffled by hash.

Defined results: null texts and texts without words hold nothing and match nothing; equal rows give one pair; of rows
with equal keys the best one counts, of rows without a key too (they are reported under a null key, and each is dropped for
what its own text holds); an empty table gives no pairs; other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm import shared

WORDS = 5
CONTAINMENT_PERCENT = 75


def word_list(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def shingle_list(words: Column, make, kind: str, lengths: tuple[int, ...] = ()) -> Column:
    """Distinct shingles of a word array; ``make`` turns the words of one, given as columns, into a value of type ``kind``.

    ``lengths`` (under ``WORDS``): a longer array has the shingles of these lengths too.
    """
    n, empty = F.size(words), F.array().cast(f"array<{kind}>")
    full = F.transform(F.sequence(F.lit(1), n - WORDS + 1), lambda i: make(*(F.element_at(words, i + j) for j in range(WORDS))))
    short = F.array(make(*(F.coalesce(F.get(words, F.lit(j)), F.lit("")) for j in range(WORDS - 1))))
    inner = [F.when(n > k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: make(*(F.element_at(words, i + j) if j < k else F.lit("") for j in range(WORDS - 1))))).otherwise(empty) for k in lengths]
    return F.array_distinct(F.concat(F.when(n >= WORDS, full).when(n > 0, short).otherwise(empty), *inner))


def hashes(words: Column, lengths: tuple[int, ...] = ()) -> Column:
    return shingle_list(words, F.xxhash64, "bigint", lengths)


def strings(words: Column, lengths: tuple[int, ...] = ()) -> Column:
    return shingle_list(words, lambda *w: F.concat_ws(" ", *w), "string", lengths)


def short_lengths(items: DataFrame, text: str) -> tuple[int, ...]:
    """The numbers of words, under ``WORDS``, that items have."""
    n = F.size(word_list(text))
    return tuple(sorted(r.n for r in items.select(n.alias("n")).where((F.col("n") > 0) & (F.col("n") < WORDS)).distinct().collect()))


def allowed_misses(n: Column, percent: int) -> Column:
    """Shingles that an item of ``n`` may miss: n - ceil(n * percent / 100)."""
    return n - F.ceil(n * F.lit(percent) / 100)


def sketches(items: DataFrame, *, key: str, text: str, percent: int = CONTAINMENT_PERCENT) -> DataFrame:
    """(item_id, n, need, h): the sketch of every item, its size partition's number of least hashes."""
    hashed = items.select(F.col(key).alias("item_id"), word_list(text).alias("w")).select("item_id", F.sort_array(hashes(F.col("w"))).alias("hs"))
    sized = hashed.where(F.size("hs") > 0).withColumn("n", F.size("hs"))
    largest = F.pow(F.lit(2), F.floor(F.log2("n")) + 1).cast("int") - 1
    taken = F.least(F.col("n"), allowed_misses(largest, percent) + 1)
    return sized.withColumn("s", taken.cast("int")).select("item_id", "n", (F.col("s") - allowed_misses(F.col("n"), percent)).alias("need"), F.explode(F.slice("hs", 1, F.col("s"))).alias("h"))


def search(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", percent: int = CONTAINMENT_PERCENT, broadcast_rows: int = 500_000, short_inside: bool = False) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of every document that holds ``percent`` of an item's shingles."""
    lengths = short_lengths(items, item_text) if short_inside else ()
    each = holders(docs, items, key=key, text=text, item_key=item_key, item_text=item_text, percent=percent, broadcast_rows=broadcast_rows, lengths=lengths)
    best = each.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"))
    return best.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def small(rows: DataFrame, most: int):
    """How to join ``rows``: broadcast where they are counted to be ``most`` at most."""
    return F.broadcast(rows) if rows.count() <= most else rows


def holders(docs: DataFrame, items: DataFrame, *, key: str, text: str, item_key: str, item_text: str, percent: int, broadcast_rows: int, lengths: tuple[int, ...]) -> DataFrame:
    """(doc_id, text_hash, item_id, n_shingles, n_found) of every document text that holds ``percent`` of an item's shingles."""
    sketch = shared.written(sketches(items, key=item_key, text=item_text, percent=percent), "item-sketches")
    texts = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), word_list(text).alias("w"))
    who = F.struct("doc_id", "text_hash").alias("who")
    seen = texts.select(who, F.explode(hashes(F.col("w"), lengths)).alias("h"))
    hits = seen.join(small(sketch, broadcast_rows), "h").groupBy("who", "item_id").agg(F.count("*").alias("hits"), F.first("need").alias("need"))
    found = shared.written(hits.where("hits >= need").select("who", "item_id"), "item-candidates")
    wanted = items.select(F.col(item_key).alias("item_id"), word_list(item_text).alias("w")).select("item_id", strings(F.col("w")).alias("g"))
    wanted = shared.written(wanted.select("item_id", F.size("g").cast("long").alias("n_shingles"), F.explode("g").alias("g")), "item-shingles")
    held = texts.select(who, "w").join(found.select("who").distinct(), "who", "left_semi").select("who", F.explode(strings(F.col("w"), lengths)).alias("g")).distinct()
    pairs = held.join(small(wanted, broadcast_rows), "g").join(found, ["who", "item_id"], "left_semi")
    each = pairs.groupBy("who", "item_id").agg(F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n_found"))
    return each.where(F.col("n_found") * 100 >= F.col("n_shingles") * percent).select("who.doc_id", "who.text_hash", "item_id", "n_shingles", "n_found")


def drop_leaks(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", percent: int = CONTAINMENT_PERCENT, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of ``docs`` whose key holds no item, short ones included; a row without a key goes for its own text."""
    lengths = short_lengths(items, item_text)
    leaks = holders(docs, items, key=key, text=text, item_key=item_key, item_text=item_text, percent=percent, broadcast_rows=broadcast_rows, lengths=lengths)
    gone = shared.written(leaks.select("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("text_hash")).distinct(), "leaks")
    mark = F.struct(docs[key].alias("doc_id"), F.when(docs[key].isNull(), F.xxhash64(docs[text])).alias("text_hash"))
    gone = gone.select(F.struct("doc_id", "text_hash").alias(shared.free_name(docs, "gone")))
    return docs.join(small(gone, broadcast_rows), mark == gone[gone.columns[0]], "left_anti")


#: The same rows in DuckDB: exact containment of every item in every document.
ORACLE = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 'i', item_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
grams AS (
  SELECT DISTINCT side, id, text, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM words),
sizes AS (SELECT id, count(*) AS n_shingles FROM grams WHERE side = 'i' GROUP BY id),
held AS (SELECT d.id AS doc_id, d.text, i.id AS item_id, count(*) AS n_found FROM grams d JOIN grams i ON d.side = 'd' AND i.side = 'i' AND d.g = i.g GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, max(n_found) AS n_found, max(n_found) / n_shingles AS containment
FROM held JOIN sizes ON item_id = sizes.id WHERE n_found * 100 >= n_shingles * 75 GROUP BY doc_id, item_id, n_shingles
"""
