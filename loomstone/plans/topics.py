"""Queries of topics and trends (topic = the vector's label, period = four fiscal years dealt over documents)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import hashing, periods
from loomstone.operators import topics as tp
from loomstone.operators import trends as td
from loomstone.plans.catalog import Tables, query
from loomstone.plans.library import TOKENS

CORPUS = """
corpus AS (SELECT d.doc_id, d.text, d.source, d.lang, e.label AS topic, e.embedding, printf('FY%d-%02d', 2020 + d.doc_id % 4, 21 + d.doc_id % 4) AS period FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"""
STOP = ["the", "of", "and", "de", "la", "der"]
COUNTS = f"""{CORPUS}, counts AS (SELECT topic, term, count(*) AS f FROM (SELECT topic, unnest({TOKENS.format('text')}) AS term FROM corpus) GROUP BY ALL)"""
CTFIDF = f"""{COUNTS}, mass AS (SELECT topic, sum(f) AS mass FROM counts GROUP BY 1), total AS (SELECT term, sum(f) AS total FROM counts WHERE term NOT IN ('the','of','and','de','la','der') GROUP BY 1 HAVING sum(f) >= 2),
weighted AS (SELECT topic, term, f, f / mass * ln(1 + (SELECT avg(mass) FROM mass) / total) AS weight FROM counts JOIN total USING (term) JOIN mass USING (topic)),
terms AS (SELECT topic, term, f, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS INTEGER) AS rank FROM weighted QUALIFY rank <= 10)"""
GRID = f"""{CORPUS}, per AS (SELECT period, count(DISTINCT doc_id) AS corpus FROM corpus GROUP BY 1), own AS (SELECT topic, period, count(DISTINCT doc_id) AS n FROM corpus GROUP BY 1, 2),
grid AS (SELECT t.topic, p.period, coalesce(n, 0) AS n, corpus, round(coalesce(n, 0) / corpus * 100, 2) AS share FROM (SELECT DISTINCT topic FROM corpus) t CROSS JOIN per p LEFT JOIN own o ON o.topic = t.topic AND o.period = p.period)"""
LAGGED = f"""{GRID}, s AS (SELECT *, lag(n) OVER w AS pn, lag(share) OVER w AS ps, lag(corpus) OVER w AS pc, coalesce(max(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY topic ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0) = 1 AS earlier FROM grid WINDOW w AS (PARTITION BY topic ORDER BY period)),
trend AS (SELECT topic, period, n, share, n - pn AS change, round(share - ps, 2) AS pp, CASE WHEN ps IS NULL THEN NULL WHEN ps > 0 THEN round((share - ps) / ps * 100, 2) WHEN share > 0 THEN 100.0 ELSE 0.0 END AS growth,
  CASE WHEN pn IS NULL THEN 'INSUFFICIENT_HISTORY' WHEN corpus < 5 OR pc < 5 THEN 'INSUFFICIENT_HISTORY' WHEN n > 0 AND pn = 0 AND earlier THEN 'RECURRING' WHEN pn = 0 AND n >= 2 THEN 'EMERGING' WHEN pn >= 2 AND n = 0 THEN 'DISAPPEARING' WHEN n < 2 OR pn < 2 THEN 'INSUFFICIENT_HISTORY' WHEN round(share - ps, 2) > 2 THEN 'GROWING' WHEN round(share - ps, 2) < -2 THEN 'DECLINING' ELSE 'STABLE' END AS status FROM s)"""


def corpus(t: Tables) -> DataFrame:
    y = (2020 + F.col("doc_id") % 4).cast("int")
    return t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id")).select("doc_id", "text", "source", "lang", F.col("label").alias("topic"), "embedding", periods.label(y).alias("period"))


def _terms(t: Tables) -> DataFrame:
    return tp.c_tf_idf(tp.term_counts(corpus(t), topic="topic", text="text"), topic="topic", stopwords=STOP, min_count=2)


def _grid(t: Tables) -> DataFrame:
    return td.grid(corpus(t), topic="topic", period="period", document="doc_id")


def _series(t: Tables) -> DataFrame:
    return td.series(_grid(t), topic="topic", period="period")


@query("top_01_corpus", f"WITH {CORPUS} SELECT doc_id, topic, period FROM corpus")
def top_01(t: Tables):
    return corpus(t).select("doc_id", "topic", "period")


@query("top_02_fingerprint", f"WITH {CORPUS} SELECT topic, sha256(array_to_string(list_sort(list_distinct(list(CAST(doc_id AS VARCHAR)))), ',') || '|k=10') AS fingerprint FROM corpus GROUP BY 1")
def top_02(t: Tables):
    return corpus(t).groupBy("topic").agg(hashing.fingerprint(F.collect_set(F.col("doc_id").cast("string")), F.lit("k=10")).alias("fingerprint"))


@query("top_03_refusal", "SELECT source, count(*) < 3 OR count(DISTINCT lang) < 2 AS refused FROM documents GROUP BY 1")
def top_03(t: Tables):
    g = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("d"))
    return g.select("source", tp.refused(F.col("n"), F.col("d")).alias("refused"))


@query("top_04_method", "SELECT (SELECT count(*) FROM embeddings) AS n, CASE WHEN (SELECT count(*) FROM embeddings) < 10 THEN 'TFIDF_KEYWORD' WHEN (SELECT count(*) FROM embeddings) < 50 THEN 'NMF_TFIDF' ELSE 'EMBEDDING_CLUSTER_CTFIDF' END AS method")
def top_04(t: Tables):
    return t.embeddings.agg(F.count("*").alias("n")).withColumn("method", tp.method(F.col("n")))


@query("top_06_clusters")
def top_06(t: Tables):
    k = t.embeddings.agg(tp.topic_count(F.count("*"))).first()[0]
    return tp.cluster(t.embeddings.select("vec_id", "embedding"), k).select("vec_id", "topic")


@query("top_07_outliers", f"""
WITH {CORPUS}, long AS (SELECT doc_id, topic, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM corpus),
cent AS (SELECT topic, list(m ORDER BY i) AS c FROM (SELECT topic, i, avg(x) AS m FROM long GROUP BY 1, 2) GROUP BY 1),
dist AS (SELECT doc_id, corpus.topic, 1 - list_cosine_similarity(embedding::DOUBLE[], c) AS d FROM corpus JOIN cent ON corpus.topic = cent.topic)
SELECT topic, count(*) AS n, count(*) FILTER (big) AS n_outliers FROM (SELECT *, count(*) OVER p < 2 OR d > 0.65 OR d > avg(d) OVER p + 1.5 * stddev_pop(d) OVER p AS big FROM dist WINDOW p AS (PARTITION BY topic)) GROUP BY 1""")
def top_07(t: Tables):
    rows = tp.outliers(tp.distances(corpus(t), topic="topic", vector="embedding"), topic="topic")
    return rows.groupBy("topic").agg(F.count("*").alias("n"), F.count_if("outlier").alias("n_outliers"))


@query("top_08_c_tf_idf", f"WITH {CTFIDF} SELECT * FROM terms")
def top_08(t: Tables):
    return _terms(t)


@query("win_03_top_terms", f"WITH {CTFIDF} SELECT topic, term, rank FROM terms WHERE rank <= 3")
def win_03(t: Tables):
    return _terms(t).where("rank <= 3").select("topic", "term", "rank")


@query("agg_09_term_frequency", f"WITH {COUNTS} SELECT topic, sum(f)::BIGINT AS mass, count(*) AS n_terms FROM counts GROUP BY 1")
def agg_09(t: Tables):
    return tp.term_counts(corpus(t), topic="topic", text="text").groupBy("topic").agg(F.sum("f").alias("mass"), F.count("*").alias("n_terms"))


@query("agg_10_topic_counts", f"WITH {CORPUS} SELECT topic, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_documents, round(count(*) / sum(count(*)) OVER () * 100, 2)::DOUBLE AS prevalence_pct FROM corpus GROUP BY 1")
def agg_10(t: Tables):
    return tp.prevalence(corpus(t), topic="topic", document="doc_id")


@query("top_09_contribution", f"WITH {CORPUS}, g AS (SELECT topic, source, count(*) AS n_chunks FROM corpus GROUP BY 1, 2) SELECT topic, source, n_chunks, round(n_chunks / sum(n_chunks) OVER (PARTITION BY source) * 100, 2)::DOUBLE AS contribution_pct FROM g")
def top_09(t: Tables):
    return tp.contribution(corpus(t).withColumn("s", F.lit(1.0)), topic="topic", document="source", similarity="s").select("topic", "source", "n_chunks", "contribution_pct")


@query("top_10_quality", f"WITH {CORPUS}, n AS (SELECT count(*) AS n FROM corpus GROUP BY topic) SELECT min(n) AS least, max(n) AS greatest, round(avg(n), 4) AS mean, median(n)::DOUBLE AS median, round(stddev_pop(n), 4) AS std FROM n")
def top_10(t: Tables):
    return tp.sizes(corpus(t), topic="topic")


query("agg_15_size_distribution", f"WITH {CORPUS}, n AS (SELECT count(*) AS n FROM corpus GROUP BY source) SELECT min(n) AS least, max(n) AS greatest, round(avg(n), 4) AS mean, median(n)::DOUBLE AS median, round(stddev_pop(n), 4) AS std FROM n")(lambda t: tp.sizes(corpus(t), topic="source"))


@query("agg_16_coherence", f"WITH {CORPUS} SELECT a.topic, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS coherence FROM corpus a JOIN corpus b ON a.topic = b.topic AND a.doc_id < b.doc_id GROUP BY 1")
def agg_16(t: Tables):
    return tp.coherence(corpus(t), topic="topic", vector="embedding")


@query("agg_17_diversity", f"WITH {CTFIDF} SELECT round(count(DISTINCT term) / count(*), 4) AS diversity FROM terms")
def agg_17(t: Tables):
    terms = _terms(t)
    return terms.agg(tp.diversity(terms).alias("diversity"))


@query("agg_11_period_totals", f"WITH {GRID} SELECT period, corpus AS documents FROM per")
def agg_11(t: Tables):
    return _grid(t).groupBy("period").agg(F.max("corpus_document_count").alias("documents"))


@query("agg_12_dimension", f"WITH {CORPUS}, g AS (SELECT lang, topic, count(*) AS chunk_count, count(DISTINCT doc_id) AS document_count FROM corpus GROUP BY 1, 2) SELECT *, round(chunk_count / sum(chunk_count) OVER (PARTITION BY lang) * 100, 2)::DOUBLE AS chunk_share_pct FROM g")
def agg_12(t: Tables):
    return td.distribution(corpus(t), dimension="lang", topic="topic", document="doc_id")


query("top_16_dimension_distribution", f"WITH {CORPUS}, g AS (SELECT source, topic, count(*) AS chunk_count, count(DISTINCT doc_id) AS document_count FROM corpus GROUP BY 1, 2) SELECT *, round(chunk_count / sum(chunk_count) OVER (PARTITION BY source) * 100, 2)::DOUBLE AS chunk_share_pct FROM g")(lambda t: td.distribution(corpus(t), dimension="source", topic="topic", document="doc_id"))


@query("jon_14_grid", f"WITH {GRID} SELECT topic, period, n AS document_count, share AS document_share_pct FROM grid")
def jon_14(t: Tables):
    return _grid(t).select("topic", "period", "document_count", "document_share_pct")


@query("top_11_series", f"WITH {LAGGED} SELECT topic, period, n AS document_count, change::DOUBLE AS absolute_change, pp AS percentage_point_change FROM trend")
def top_11(t: Tables):
    return _series(t).select("topic", "period", "document_count", F.col("absolute_change").cast("double").alias("absolute_change"), "percentage_point_change")


@query("top_12_trend_class", f"WITH {LAGGED} SELECT topic, period, status AS trend_status FROM trend")
def top_12(t: Tables):
    return _series(t).select("topic", "period", "trend_status")


@query("top_13_growth", f"WITH {LAGGED} SELECT topic, period, growth AS growth_rate_pct FROM trend")
def top_13(t: Tables):
    return _series(t).select("topic", "period", "growth_rate_pct")


@query("win_05_recurring", f"WITH {LAGGED} SELECT topic, period, earlier AS present_earlier FROM s")
def win_05(t: Tables):
    return _series(t).select("topic", "period", "present_earlier")


PERSIST = f"""WITH {GRID}, g AS (SELECT topic, count(*) AS n_periods, count(*) FILTER (n > 0) AS n_observed, min(period) FILTER (n > 0) AS first_seen, max(period) FILTER (n > 0) AS last_seen, arg_max(n, period) AS latest FROM grid GROUP BY 1)
SELECT topic, n_periods, n_observed, first_seen, last_seen, round(n_observed / n_periods, 4) AS persistence_ratio, CASE WHEN n_periods <= 1 THEN 'INSUFFICIENT_HISTORY' WHEN n_observed = 0 THEN 'DISAPPEARED' WHEN n_observed = 1 AND latest > 0 THEN 'NEW' WHEN latest = 0 THEN 'DISAPPEARED' WHEN n_observed / n_periods >= 0.75 THEN 'PERSISTENT' ELSE 'INTERMITTENT' END AS persistence_class FROM g"""


@query("top_14_persistence", PERSIST)
def top_14(t: Tables):
    return td.persistence(_grid(t), topic="topic", period="period")


@query("win_06_first_last", f"SELECT topic, first_seen, last_seen, n_observed FROM ({PERSIST})")
def win_06(t: Tables):
    return td.persistence(_grid(t), topic="topic", period="period").select("topic", "first_seen", "last_seen", "n_observed")


@query("top_15_period_comparison", f"WITH {GRID} SELECT topic, a.n AS count_a, a.share AS share_a, b.n AS count_b, b.share AS share_b, b.n - a.n AS count_change, round(b.share - a.share, 2) AS pp_change FROM grid a JOIN grid b USING (topic) WHERE a.period = 'FY2020-21' AND b.period = 'FY2022-23'")
def top_15(t: Tables):
    return td.compare(_grid(t), "FY2020-21", "FY2022-23", topic="topic", period="period")


@query("top_17_pair_comparison", f"WITH {CORPUS}, a AS (SELECT DISTINCT topic FROM corpus WHERE source = 'src1'), b AS (SELECT DISTINCT topic FROM corpus WHERE source = 'src7') SELECT coalesce(a.topic, b.topic) AS topic, CASE WHEN b.topic IS NULL THEN 'only_a' WHEN a.topic IS NULL THEN 'only_b' ELSE 'common' END AS side FROM a FULL JOIN b ON a.topic = b.topic")
def top_17(t: Tables):
    from loomstone.operators.filters import differences

    c = corpus(t)
    return differences(c.where("source = 'src1'"), c.where("source = 'src7'"), "topic")


@query("top_18_growing_with_evidence", f"WITH {LAGGED} SELECT t.topic, t.period, t.status AS trend_status, min(c.doc_id) AS evidence FROM trend t JOIN corpus c ON c.topic = t.topic AND c.period = t.period WHERE t.status IN ('GROWING', 'DECLINING', 'EMERGING') GROUP BY 1, 2, 3")
def top_18(t: Tables):
    moving = _series(t).where(F.col("trend_status").isin("GROWING", "DECLINING", "EMERGING")).select("topic", "period", "trend_status")
    return corpus(t).join(F.broadcast(moving), ["topic", "period"]).groupBy("topic", "period", "trend_status").agg(F.min("doc_id").alias("evidence"))


EVOLUTION = f"WITH {CTFIDF}, occ AS (SELECT topic, period, term, count(*) AS n FROM (SELECT topic, period, unnest({TOKENS.format('text')}) AS term FROM corpus) GROUP BY ALL) SELECT o.topic, o.period, o.term, o.n FROM occ o JOIN terms USING (topic, term)"


@query("top_19_term_evolution", EVOLUTION)
def top_19(t: Tables):
    return td.term_evolution(corpus(t), _terms(t), topic="topic", period="period", text="text").select("topic", "period", "term", "n")


@query("agg_13_terms_by_period", f"SELECT term, sum(n) FILTER (period = 'FY2020-21')::DOUBLE AS y0, sum(n) FILTER (period = 'FY2021-22')::DOUBLE AS y1, sum(n) FILTER (period = 'FY2022-23')::DOUBLE AS y2, sum(n) FILTER (period = 'FY2023-24')::DOUBLE AS y3 FROM ({EVOLUTION}) GROUP BY term")
def agg_13(t: Tables):
    years = ["FY2020-21", "FY2021-22", "FY2022-23", "FY2023-24"]
    wide = top_19(t).groupBy("term").pivot("period", years).agg(F.sum("n"))
    return wide.select("term", *[F.col(f"`{y}`").cast("double").alias(f"y{i}") for i, y in enumerate(years)])


@query("top_20_summary", f"WITH {LAGGED} SELECT topic, period, printf('Topic %s (t%s) is %s at %.2f%% of documents.', CAST(topic AS VARCHAR), CAST(topic AS VARCHAR), lower(replace(status, '_', ' ')), share) AS summary FROM trend")
def top_20(t: Tables):
    label = F.concat(F.lit("t"), F.col("topic").cast("string"))
    return _series(t).select("topic", "period", td.summary(F.col("topic"), label, F.col("trend_status"), F.col("document_share_pct")).alias("summary"))


@query("top_21_annexure", f"WITH {CTFIDF} SELECT topic, array_to_string(list(term ORDER BY rank), ';') AS terms FROM terms GROUP BY 1")
def top_21(t: Tables):
    return _terms(t).groupBy("topic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ";").alias("terms"))


@query("top_22_analysis_state", "SELECT source, CASE WHEN count(*) < 3 THEN 'INSUFFICIENT_CORPUS' ELSE 'COMPLETED' END AS status, CASE WHEN count(*) < 3 THEN 10 ELSE 100 END AS progress FROM documents GROUP BY 1")
def top_22(t: Tables):
    return t.documents.groupBy("source").agg(tp.state(F.count("*")).alias("s")).select("source", "s.status", "s.progress")


@query("agg_22_word_cloud", f"WITH {CTFIDF} SELECT term, max(weight) AS weight, arg_max(topic, (weight, -topic)) AS topic FROM terms GROUP BY 1")
def agg_22(t: Tables):
    return _terms(t).groupBy("term").agg(F.max("weight").alias("weight"), F.max_by("topic", F.struct("weight", -F.col("topic"))).alias("topic"))


@query("top_05_topic_count", "SELECT source, count(*) AS n, CASE WHEN count(*) <= 5 THEN 2 WHEN count(*) <= 15 THEN 3 WHEN count(*) <= 50 THEN 4 ELSE least(6, floor(sqrt(count(*) / 2)))::INTEGER END AS k FROM documents GROUP BY 1")
def top_05(t: Tables):
    g = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return g.withColumn("k", tp.topic_count(F.col("n")))


@query("top_05_wanted_count", "SELECT source, greatest(2, least(7, count(*) - 1))::INTEGER AS k FROM documents GROUP BY 1")
def top_05_wanted(t: Tables):
    return t.documents.groupBy("source").agg(tp.topic_count(F.count("*"), 7).alias("k"))


