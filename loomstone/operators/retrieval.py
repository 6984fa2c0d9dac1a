"""Lexical, dense and fused retrieval over chunk tables.

The lexical order is the re-score's: raw weighted hits break its ties, then the key (the database rank that a text engine
would add has no counterpart here, and words are matched as lower-case substrings without stemming).
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.functions import vectors as vx

#: Constant of reciprocal rank fusion.
RRF_K = 60
WEIGHTS = {"content": 1, "title": 3, "heading": 2}


def query_tokens(query: str, most: int = 5) -> list[str]:
    """Tokens of more than one character of a query, the first ``most``."""
    return [w for w in query.lower().split() if len(w) > 1][:most]


def parse_query(query: str) -> dict[str, list[str]]:
    """Quoted phrases, wanted words, unwanted words (a leading minus) and alternatives (joined by OR)."""
    import re

    phrases = re.findall(r'"([^"]+)"', query.lower())
    rest = re.sub(r'"[^"]*"', " ", query)
    out: dict[str, list[str]] = {"phrases": phrases, "all": [], "any": [], "none": []}
    words = rest.split()
    for i, w in enumerate(words):
        if w == "OR":
            continue
        if w.startswith("-") and len(w) > 1:
            out["none"].append(w[1:].lower())
        elif "OR" in (words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""):
            out["any"].append(w.lower())
        else:
            out["all"].append(w.lower())
    return out


def matches(rows: DataFrame, query: str, column: str) -> DataFrame:
    """Rows that satisfy a parsed query: whole tokens for words, contiguous text for phrases."""
    q, low = parse_query(query), F.lower(F.col(column))
    have = tx.words(F.col(column))
    for p in q["phrases"]:
        rows = rows.where(F.contains(low, F.lit(p)))
    for w in q["all"]:
        rows = rows.where(F.array_contains(have, w))
    if q["any"]:
        rows = rows.where(F.arrays_overlap(have, F.array(*map(F.lit, q["any"]))))
    if q["none"]:
        rows = rows.where(~F.arrays_overlap(have, F.array(*map(F.lit, q["none"]))))
    return rows


def weighted_hits(tokens: list[str], columns: dict[str, int]) -> Column:
    return reduce(add, [F.lit(w) * tx.occurrences(F.col(c), t) for c, w in columns.items() for t in tokens])


def lexical(chunks: DataFrame, query: str, *, key: str, columns: dict[str, int] | None = None, pool: int = 30) -> DataFrame:
    """The ``pool`` best chunks for a query: (key, hits, score, rank)."""
    tokens, columns = query_tokens(query), columns or WEIGHTS
    if not tokens:
        return chunks.select(key).where(F.lit(False)).select(key, F.lit(0).alias("hits"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    found = chunks.where(reduce(or_, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t)) for c in columns for t in tokens]))
    hits = found.select(key, weighted_hits(tokens, columns).alias("hits"))
    score = F.when(F.col("hits") > 0, F.round(F.least(F.lit(1.0), 0.2 + 0.1 * F.col("hits")), 4)).otherwise(0.1)
    top = hits.withColumn("score", score).orderBy(F.desc("score"), F.desc("hits"), key).limit(pool)
    return ranked(top, [F.desc("score"), F.desc("hits"), F.col(key)])


def dense(vectors: DataFrame, query: DataFrame, *, key: str, vector: str, pool: int = 30) -> DataFrame:
    """The ``pool`` nearest vectors by exact cosine: (key, score, rank). ``query`` has one row with column ``q``."""
    scored = vectors.crossJoin(F.broadcast(query.limit(1))).select(key, vx.similarity_score(vx.cosine(F.col(vector), F.col("q"))).alias("score"))
    return ranked(scored.orderBy(F.desc("score"), key).limit(pool), [F.desc("score"), F.col(key)])


def ranked(top: DataFrame, order: list[Column]) -> DataFrame:
    """Ranks 1..N of an already limited result."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuse(lexical_rows: DataFrame, dense_rows: DataFrame, *, key: str, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: (key, lexical_rank, dense_rank, method, rrf)."""
    a = lexical_rows.select(key, F.col("rank").alias("lexical_rank"))
    b = dense_rows.select(key, F.col("rank").alias("dense_rank"))
    part = lambda c, w: F.coalesce(F.lit(w) / (RRF_K + F.col(c)), F.lit(0.0))
    method = F.when(F.col("lexical_rank").isNull(), "DENSE").when(F.col("dense_rank").isNull(), "KEYWORD").otherwise("HYBRID")
    return a.join(b, key, "full").select(key, "lexical_rank", "dense_rank", method.alias("method"), (part("lexical_rank", weights[0]) + part("dense_rank", weights[1])).alias("rrf"))


def signature(*columns: Column, content: Column) -> Column:
    """What makes two results the same: their place and the first 80 characters, trimmed."""
    return F.concat_ws("|", *columns, F.regexp_replace(F.substring(content, 1, 80), r"^\s+|\s+$", ""))


def deduplicated(fused: DataFrame, *, key: str, sig: Column, top: int = 10) -> DataFrame:
    """The best result of each signature, ranked after that, scores to six digits."""
    best = fused.withColumn("__n", F.row_number().over(Window.partitionBy(sig).orderBy(F.desc("rrf"), key))).where("__n = 1").drop("__n")
    return ranked(best.orderBy(F.desc("rrf"), key).limit(top), [F.desc("rrf"), F.col(key)]).withColumn("rrf", F.round("rrf", 6))


def single_leg(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rrf", F.round(1 / (RRF_K + F.col("rank")), 6))


def search(chunks: DataFrame, vectors: DataFrame, query_text: str, query_vector: DataFrame, *, mode: str = "HYBRID", key: str = "id", vector: str = "vector", columns: dict[str, int] | None = None, sig: Column | None = None, top: int = 10) -> DataFrame:
    """HYBRID fuses both legs; KEYWORD and SEMANTIC keep one. The candidate pool is max(3 * top, 30) per leg."""
    pool = max(3 * top, 30)
    words = lexical(chunks, query_text, key=key, columns=columns, pool=pool) if mode != "SEMANTIC" else None
    near = dense(vectors, query_vector, key=key, vector=vector, pool=pool) if mode != "KEYWORD" else None
    if mode != "HYBRID":
        return single_leg(words if mode == "KEYWORD" else near).where(F.col("rank") <= top)
    joined = fuse(words, near, key=key).join(chunks, key)
    return deduplicated(joined, key=key, sig=F.col(key).cast("string") if sig is None else sig, top=top).select(key, "lexical_rank", "dense_rank", "method", "rrf", "rank")


def rerank(results: DataFrame, scorer=None, *, text: str = "text") -> DataFrame:
    """Scores of a pairwise model, if one is given as a column function; else the order stays and the status says so."""
    if scorer is None:
        return results.withColumns({"rerank_score": F.lit(None).cast("double"), "rerank_status": F.lit("RERANKER_UNAVAILABLE")})
    return results.withColumns({"rerank_score": scorer(F.col(text)), "rerank_status": F.lit("RERANKED")})
