"""Queries of retrieval, joins, chunking and embedding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import vectors as vx
from loomstone.operators import chunking, embedding, retrieval
from loomstone.plans.catalog import Tables, query

HITS = "(length(lower(text)) - length(replace(lower(text), 'thing', ''))) // 5 + (length(lower(text)) - length(replace(lower(text), 'onre', ''))) // 4"
LEX = f"""
lex0 AS (SELECT doc_id, CAST({HITS} AS INTEGER) AS hits FROM documents WHERE contains(lower(text), 'thing') OR contains(lower(text), 'onre')),
lex AS (SELECT doc_id, hits, round(least(1.0, 0.2 + 0.1 * hits), 4)::DOUBLE AS score, CAST(row_number() OVER (ORDER BY round(least(1.0, 0.2 + 0.1 * hits), 4) DESC, hits DESC, doc_id) AS INTEGER) AS rank FROM lex0 QUALIFY rank <= 30)"""
DENSE = """
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
den0 AS (SELECT vec_id AS doc_id, round(greatest(0.0, least(1.0, (list_cosine_similarity(embedding::DOUBLE[], q) + 1) / 2)), 4) AS score FROM embeddings, q),
den AS (SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM den0 QUALIFY rank <= 30)"""
FUSED = f"""WITH {LEX}, {DENSE},
fused AS (SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, l.rank AS lexical_rank, d.rank AS dense_rank, CASE WHEN l.rank IS NULL THEN 'DENSE' WHEN d.rank IS NULL THEN 'KEYWORD' ELSE 'HYBRID' END AS method, coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0) AS rrf FROM lex l FULL JOIN den d ON l.doc_id = d.doc_id)"""
SEARCH = "thing onre"


def _lexical(t: Tables, pool: int = 30):
    return retrieval.lexical(t.documents, SEARCH, key="doc_id", columns={"text": 1}, pool=pool)


def _ranks_as_double(rows):
    """Ranks of which some are missing, in a type that shows that alike in every client."""
    return rows.withColumns({c: F.col(c).cast("double") for c in ("lexical_rank", "dense_rank")})


def _vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")


def _query_vector(t: Tables):
    return t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))


@query("ret_01_lexical", f"WITH {LEX} SELECT * FROM lex")
def ret_01(t: Tables):
    return _lexical(t)


@query("ret_02_phrase_query", r"SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_\-]+'), 'the') AND contains(lower(text), 'of the') AND NOT list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_\-]+'), 'from')")
def ret_02(t: Tables):
    return retrieval.matches(t.documents, 'the "of the" -from', "text").select("doc_id")


@query("ret_03_dense", f"WITH {DENSE} SELECT * FROM den")
def ret_03(t: Tables):
    return retrieval.dense(_vectors(t), _query_vector(t), key="doc_id", vector="embedding")


@query("ret_04_hybrid_rrf", f"""{FUSED},
sig AS (SELECT f.*, row_number() OVER (PARTITION BY d.source || '|' || regexp_replace(d.text[1:80], '^\\s+|\\s+$', '', 'g') ORDER BY rrf DESC, f.doc_id) AS n FROM fused f JOIN documents d ON f.doc_id = d.doc_id)
SELECT doc_id, lexical_rank::DOUBLE AS lexical_rank, dense_rank::DOUBLE AS dense_rank, method, round(rrf, 6) AS rrf, CAST(row_number() OVER (ORDER BY rrf DESC, doc_id) AS INTEGER) AS rank FROM sig WHERE n = 1 QUALIFY rank <= 10""")
def ret_04(t: Tables):
    sig = retrieval.signature(F.col("source"), content=F.col("text"))
    return _ranks_as_double(retrieval.search(t.documents, _vectors(t), SEARCH, _query_vector(t), key="doc_id", vector="embedding", columns={"text": 1}, sig=sig))


@query("ret_05_single_leg", f"WITH {LEX} SELECT doc_id, hits, score, rank, round(1.0 / (60 + rank), 6)::DOUBLE AS rrf FROM lex WHERE rank <= 10")
def ret_05(t: Tables):
    return retrieval.search(t.documents, _vectors(t), SEARCH, _query_vector(t), mode="KEYWORD", key="doc_id", columns={"text": 1})


@query("ret_06_rerank_bypass", f"WITH {LEX} SELECT doc_id, rank, NULL::DOUBLE AS rerank_score, 'RERANKER_UNAVAILABLE' AS rerank_status FROM lex")
def ret_06(t: Tables):
    return retrieval.rerank(_lexical(t).select("doc_id", "rank"))


@query("ret_07_envelope", f"{FUSED} SELECT method, count(*) AS n, round(sum(rrf), 6) AS rrf, count(lexical_rank) AS n_lexical, count(dense_rank) AS n_dense FROM fused GROUP BY method")
def ret_07(t: Tables):
    fused = retrieval.fuse(_lexical(t), retrieval.dense(_vectors(t), _query_vector(t), key="doc_id", vector="embedding"), key="doc_id")
    return fused.groupBy("method").agg(F.count("*").alias("n"), F.round(F.sum("rrf"), 6).alias("rrf"), F.count("lexical_rank").alias("n_lexical"), F.count("dense_rank").alias("n_dense"))


@query("ret_08_hash_embedding")
def ret_08(t: Tables):
    return t.documents.select("doc_id", embedding.embed_column(F.col("text")).alias("vector"))


@query("ret_10_index_status", "SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(DISTINCT vec_id) FROM embeddings) AS embedded, round((SELECT count(DISTINCT vec_id) FROM embeddings) / (SELECT count(*) FROM documents) * 100, 2) AS coverage_pct")
def ret_10(t: Tables):
    return embedding.coverage(t.documents, t.embeddings.select(F.col("vec_id").alias("chunk_id")), key="doc_id")


@query("ret_11_paragraph_chunks", r"""
WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts FROM documents),
r(doc_id, parts, i, c, size) AS (
  SELECT doc_id, parts, 1, 0, length(parts[1]) FROM p WHERE len(parts) > 0
  UNION ALL SELECT doc_id, parts, i + 1, CASE WHEN size + length(parts[i+1]) > 1000 THEN c + 1 ELSE c END, CASE WHEN size + length(parts[i+1]) > 1000 THEN length(parts[i+1]) ELSE size + length(parts[i+1]) END FROM r WHERE i < len(parts))
SELECT doc_id, CAST(c AS INTEGER) AS chunk_index, count(*) AS n_parts, CAST(sum(length(parts[i])) + 2 * (count(*) - 1) AS BIGINT) AS n_chars FROM r GROUP BY doc_id, c""")
def ret_11(t: Tables):
    chunks = chunking.paragraphs(t.documents, key="doc_id", text="text", cut="\n")
    return chunks.select("doc_id", "chunk_index", F.size(F.split("content", "\n\n")).cast("long").alias("n_parts"), F.length("content").cast("long").alias("n_chars"))


@query("ret_12_table_chunks", """
WITH r AS (SELECT l_suppkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber, l_partkey, l_quantity) - 1) // 25 + 1 AS part FROM lineitem)
SELECT l_suppkey, CAST(part AS INTEGER) AS part, count(*) AS n_rows, CAST(max(part) OVER (PARTITION BY l_suppkey) AS INTEGER) AS total_parts FROM r GROUP BY l_suppkey, part""")
def ret_12(t: Tables):
    rows = t.lineitem.select("l_suppkey", F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_partkey", "l_quantity").alias("o"), F.array(F.col("l_partkey").cast("string"), F.col("l_quantity").cast("string")).alias("cells"))
    return chunking.table_parts(rows, table="l_suppkey", order="o", cells="cells").select("l_suppkey", "part", "n_rows", "total_parts")


@query("ret_13_visual_chunks", "SELECT page_id AS id, '[VISUAL] Untitled' || chr(10) || url AS content FROM pages WHERE length(trim(url)) >= 10")
def ret_13(t: Tables):
    v = t.pages.select(F.col("page_id").alias("id"), F.col("page_id").alias("document_id"), F.lit(1).alias("page_number"), F.lit(None).cast("string").alias("caption"), F.col("url").alias("ocr_text"))
    return chunking.visual_chunks(v).select("id", "content")


@query("src_05_virtual_pages")
def src_05(t: Tables):
    return chunking.virtual_pages(t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")), key="doc_id", text="text")


@query("snk_03_missing_embeddings", "SELECT doc_id FROM documents ANTI JOIN embeddings ON doc_id = vec_id")
def snk_03(t: Tables):
    done = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.lit("m").alias("model_name"))
    return embedding.missing(t.documents, done, "m", key="doc_id").select("doc_id")


# joins ------------------------------------------------------------------------------------------------------------
@query("jon_01_chunk_document", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def jon_01(t: Tables):
    return t.documents.join(t.labels, "doc_id").select("doc_id", "quality")


@query("jon_02_three_way_model", "SELECT d.doc_id, e.label, l.toxic FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id JOIN labels l ON l.doc_id = d.doc_id WHERE e.label = 4")
def jon_02(t: Tables):
    return t.documents.join(t.embeddings.where("label = 4"), F.col("doc_id") == F.col("vec_id")).join(t.labels, "doc_id").select("doc_id", "label", "toxic")


@query("jon_03_organization", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def jon_03(t: Tables):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("jon_04_fact_document", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'")
def jon_04(t: Tables):
    return t.lineitem.where("l_returnflag = 'A'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("jon_06_strata_document", "SELECT o_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def jon_06(t: Tables):
    return t.orders.where("o_orderstatus = 'F'").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last"))


@query("jon_07_count_joins", "SELECT conv_id, count(*) FILTER (role = 'user') AS questions, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY conv_id")
def jon_07(t: Tables):
    q = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("questions"))
    a = t.conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.count("*").alias("answers"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return q.join(a, "conv_id", "full").select("conv_id", zero("questions"), zero("answers"))


@query("jon_08_grouped_join", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def jon_08(t: Tables):
    return t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n")


@query("jon_09_key_merge", f"{FUSED} SELECT doc_id, lexical_rank::DOUBLE AS lexical_rank, dense_rank::DOUBLE AS dense_rank, method, round(rrf, 8) AS rrf FROM fused")
def jon_09(t: Tables):
    fused = retrieval.fuse(_lexical(t), retrieval.dense(_vectors(t), _query_vector(t), key="doc_id", vector="embedding"), key="doc_id")
    return _ranks_as_double(fused.withColumn("rrf", F.round("rrf", 8)))


@query("jon_10_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def jon_10(t: Tables):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("jon_12_adjacent_rows", "SELECT l_orderkey, l_linenumber, l_partkey, (lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))::DOUBLE AS previous FROM lineitem")
def jon_12(t: Tables):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return t.lineitem.withColumn("previous", F.lag("l_partkey").over(w).cast("double")).select("l_orderkey", "l_linenumber", "l_partkey", "previous")


@query("jon_15_left_lookups", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(e.label, -1) AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def jon_15(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left").join(t.embeddings, F.col("doc_id") == F.col("vec_id"), "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("label", F.lit(-1)).alias("label"))


@query("jon_16_fuzzy_names", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON contains(lower(n_name), lower(r_name[1:1])) OR contains(lower(r_name), lower(n_name))")
def jon_16(t: Tables):
    n, r = F.lower("n_name"), F.lower("r_name")
    return t.nation.join(F.broadcast(t.region), F.contains(n, F.substring(r, 1, 1)) | F.contains(r, n)).select("n_nationkey", "r_regionkey")


@query("jon_17_many_to_many", "SELECT DISTINCT s_suppkey, p_brand FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey")
def jon_17(t: Tables):
    return t.supplier.join(t.lineitem, F.col("s_suppkey") == F.col("l_suppkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("s_suppkey", "p_brand").distinct()


@query("sca_27_cosine_score", "SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(0.0, least(1.0, (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2)), 4) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def sca_27(t: Tables):
    a, b = t.embeddings.alias("a"), t.embeddings.alias("b")
    return a.join(b, F.expr("b.vec_id = a.vec_id + 1")).select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), vx.similarity_score(vx.cosine(F.col("a.embedding"), F.col("b.embedding"))).alias("score"))
