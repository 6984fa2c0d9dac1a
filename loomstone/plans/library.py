"""Queries over the scalar functions, filters, projections, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import hashing, numbers, periods, text
from loomstone.operators import filters, scope
from loomstone.plans.catalog import Tables, query

FY = "CASE WHEN month({0}) >= 4 THEN year({0}) ELSE year({0}) - 1 END"
FY_LABEL = "printf('FY%d-%02d', {0}, ({0} + 1) % 100)"
TOKENS = "list_filter(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\-]+'), lambda w: regexp_full_match(w, '[a-z0-9_\\-]+')), lambda w: regexp_replace(w, '^[-_]+|[-_]+$', '', 'g')), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+'))"


# scalar functions -------------------------------------------------------------------------------------------------
_ANY_CASE = lambda words: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words).replace(" ", r"[\t-\r ]+")
#: Signs are named as the query's engine has them: only blanks are trimmed, white space is [\t-\r ], letters without regard to case are ASCII ones.
_LEAD = "|".join(map(_ANY_CASE, ("what was", "what is", "what are", "compare", "tell me about", "find", "search for", "show me")))


@query("sca_01_clean_query", rf"""
WITH u AS (SELECT conv_id, turn, trim(text, ' ') AS t FROM conversations WHERE role = 'user'),
c AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(t, '^({_LEAD})[\t-\r ]+', ''), '[^\p{{L}}\p{{M}}\p{{N}}_\t-\r \-./]', ' ', 'g'), '[\t-\r ]+', ' ', 'g'), ' ') AS s FROM u)
SELECT conv_id, turn, CASE WHEN s = '' THEN t ELSE s END AS clean FROM c WHERE t <> ''""")
def sca_01(t: Tables):
    rows = t.conversations.where("role = 'user'").select("conv_id", "turn", "text", text.clean_query(F.col("text")).alias("clean"))
    return rows.where("clean <> trim(text) OR clean <> ''").select("conv_id", "turn", "clean")


@query("sca_04_clean_corpus", r"""
WITH s AS (SELECT doc_id, text, trim(regexp_replace(translate(regexp_replace(text, '[~^|\\]+|[-_=]{3,}', ' ', 'g'), '–—‘’“” ', '--''''"" '), '\s+', ' ', 'g')) AS s FROM documents),
c AS (SELECT doc_id, text, array_to_string(list_filter(string_split(s, ' '), lambda w: regexp_replace(lower(w), '^[.,;:()\[\]{}'']+|[.,;:()\[\]{}'']+$', '', 'g') NOT IN ('page','pages','table','tables','annexure','annexures','figure','figures','plate','plates','drawing','drawings','dated','date','ref','reference','no','vide','etc','herein','thereof','whereas','abovementioned','aforesaid','hereby','sno','sl','sr','total','subtotal','nil','na','n/a','yes','applicable','enclosed','attached','annexed','duly','undersigned','signature','seal','stamp','chapter','para','paragraph','item','serial','sheet','volume','part','section_header')), ' ') AS clean FROM s)
SELECT doc_id, sha256(clean) AS clean_hash, CASE WHEN length(text) > 0 THEN round((length(text) - length(clean)) / length(text), 4) ELSE 0.0 END AS reduction FROM c""")
def sca_04(t: Tables):
    clean = t.documents.withColumn("clean", text.clean_corpus(F.col("text")))
    return clean.select("doc_id", F.sha2("clean", 256).alias("clean_hash"), text.reduction(F.col("text"), F.col("clean")).alias("reduction"))


@query("sca_05_tokens", f"SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY token")
def sca_05(t: Tables):
    return t.documents.select(F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("sca_06_topic_label", "SELECT c_mktsegment, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS label, count(*) AS n FROM customer GROUP BY 1, 2")
def sca_06(t: Tables):
    return t.customer.select("c_mktsegment", text.topic_label(F.array("c_mktsegment")).alias("label")).groupBy("c_mktsegment", "label").agg(F.count("*").alias("n"))


@query("sca_07_parse_number", r"SELECT event_id, TRY_CAST(nullif(regexp_replace(props, '[^\d.\-]', '', 'g'), '') AS DOUBLE) AS k FROM events")
def sca_07(t: Tables):
    return t.events.select("event_id", numbers.parse(F.col("props")).alias("k"))


@query("sca_08_parse_reserve", r"SELECT p_partkey, CAST(round(p_retailprice, 2) AS DOUBLE) AS value, CASE p_partkey % 3 WHEN 0 THEN 'mt' WHEN 1 THEN 'tonnes' ELSE 'gallons' END AS unit, p_partkey % 3 <> 2 AS ok FROM part")
def sca_08(t: Tables):
    unit = F.when(F.col("p_partkey") % 3 == 0, "MT").when(F.col("p_partkey") % 3 == 1, "Tonnes").otherwise("gallons")
    parsed = t.part.select("p_partkey", numbers.parse_reserve(F.concat(F.format_number("p_retailprice", 2), F.lit(" "), unit)).alias("r"))
    return parsed.select("p_partkey", "r.value", "r.unit", "r.ok")


@query("sca_09_snippet", r"""
SELECT doc_id, trim(replace(substring(text, greatest(1, p - 40), p + 5 + 40 - greatest(1, p - 40)), chr(10), ' ')) AS snippet
FROM (SELECT doc_id, text, strpos(text, ' the ') AS p FROM documents) WHERE p > 0""")
def sca_09(t: Tables):
    at = F.expr("position(' the ' IN text)")
    return t.documents.withColumn("p", at).where("p > 0").select("doc_id", text.snippet(F.col("text"), F.col("p"), F.lit(5)).alias("snippet"))


@query("sca_10_sentences", r"""
SELECT doc_id, count(*) AS n_sentences, sum(length(s))::BIGINT AS n_chars FROM (
  SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(regexp_replace(trim(s), '^(?:\d+\.|\*|-)\s*', ''))), lambda s: length(s) > 8)) AS s FROM documents)
GROUP BY doc_id""")
def sca_10(t: Tables):
    s = t.documents.select("doc_id", F.explode(text.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("s")).alias("n_chars"))


@query("sca_11_numbers", r"SELECT doc_id, unnest(regexp_extract_all(text, '\b\d+(?:\.\d+)?%?')) AS number FROM documents")
def sca_11(t: Tables):
    return t.documents.select("doc_id", F.explode(text.numbers(F.col("text"))).alias("number"))


@query("sca_17_cell_refs", "SELECT p_partkey, CASE WHEN i < 26 THEN chr(65 + i) ELSE chr(64 + i // 26) || chr(65 + i % 26) END AS letters, i AS back FROM (SELECT p_partkey, CAST(p_partkey % 700 AS INTEGER) AS i FROM part)")
def sca_17(t: Tables):
    i = (F.col("p_partkey") % 700).cast("int")
    rows = t.part.select("p_partkey", numbers.column_letters(i).alias("letters"))
    return rows.withColumn("back", numbers.column_index(F.col("letters")).cast("int"))


@query("sca_19_stem_tokens", r"SELECT page_id, list_filter(regexp_split_to_array(regexp_replace(lower(url), '\.[a-z0-9]+$', ''), '[^a-z0-9]+'), lambda w: w <> '')[-1] AS last_token FROM pages")
def sca_19(t: Tables):
    return t.pages.select("page_id", F.element_at(text.stem_tokens(F.col("url")), -1).alias("last_token"))


@query("sca_20_validate_period", f"""
WITH p AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, k <> 3 AS ok, CASE k WHEN 0 THEN {FY_LABEL.format('y')} WHEN 1 THEN {FY_LABEL.format('y')} WHEN 2 THEN 'CY' || y ELSE 'Invalid financial year rollover: ' || y || '-' || printf('%02d', (y + 2) % 100) END AS value FROM p""")
def sca_20(t: Tables):
    y, k = F.year("o_orderdate"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.format_string("FY %d-%02d", y, (y + 1) % 100)).when(k == 1, F.format_string("Q2 FY%d-%d", y, y + 1)).when(k == 2, F.format_string("CY%d", y)).otherwise(F.format_string("%d-%02d", y, (y + 2) % 100))
    return t.orders.select("o_orderkey", periods.validate(raw).alias("v")).select("o_orderkey", "v.ok", "v.value")


@query("sca_21_document_period", f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN {FY_LABEL.format('year(o_orderdate)')} ELSE {FY_LABEL.format('(' + FY.format('o_orderdate') + ')')} END AS period FROM orders")
def sca_21(t: Tables):
    title = F.when(F.col("o_orderkey") % 2 == 0, F.format_string("Report FY%d-%02d", F.year("o_orderdate"), (F.year("o_orderdate") + 1) % 100)).otherwise("Report")
    return t.orders.select("o_orderkey", periods.document_period(title, F.col("o_orderdate")).alias("period"))


@query("sca_22_mentioned_periods", f"SELECT o_orderkey, {FY_LABEL.format('year(o_orderdate)')} AS first, {FY_LABEL.format('(year(o_orderdate) + 1)')} AS last, 2 AS n FROM orders")
def sca_22(t: Tables):
    y = F.year("o_orderdate")
    q = F.format_string("compare FY %d-%d with %d/%02d and FY%d-%02d", y, y + 1, y + 1, (y + 2) % 100, y, (y + 1) % 100)
    m = t.orders.select("o_orderkey", periods.mentioned(q).alias("m"))
    return m.select("o_orderkey", F.array_min("m").alias("first"), F.array_max("m").alias("last"), F.size("m").alias("n"))


@query("sca_23_content_period", "SELECT o_orderkey, CASE WHEN y >= 2000 THEN y || '-' || printf('%02d', (y + 1) % 100) WHEN y = 1999 THEN '2000-01' END AS period FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)")
def sca_23(t: Tables):
    y = F.year("o_orderdate")
    content = F.format_string("output of %d-%02d and %d-%02d", y, (y + 1) % 100, y + 1, (y + 2) % 100)
    return t.orders.select("o_orderkey", periods.content_period(content).alias("period"))


@query("sca_24_harmonise_unit", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN round(l_extendedprice / 1000000, 4) ELSE l_extendedprice END AS value FROM lineitem")
def sca_24(t: Tables):
    unit = F.when(F.col("l_linenumber") % 2 == 0, "Tonnes").otherwise("MT")
    return t.lineitem.select("l_orderkey", "l_linenumber", numbers.to_canonical_mass(F.col("l_extendedprice"), unit, F.lit("MT")).alias("value"))


@query("sca_25_clamp", "SELECT c_custkey, greatest(0.0, least(1.0, c_acctbal / 5000))::DOUBLE AS score FROM customer")
def sca_25(t: Tables):
    return t.customer.select("c_custkey", numbers.clamp(F.col("c_acctbal") / 5000).alias("score"))


@query("sca_26_change_formulas", "SELECT p_partkey, round(p_size - p_retailprice, 4) AS change, CASE WHEN abs(p_retailprice) >= 1e-9 THEN round((p_size - p_retailprice) / abs(p_retailprice) * 100, 2) END AS pct, CASE WHEN p_size > 0 THEN round((p_retailprice - p_size) / p_size * 100, 2) WHEN p_retailprice > 0 THEN 100.0 ELSE 0.0 END AS growth FROM part")
def sca_26(t: Tables):
    a, b = F.col("p_retailprice"), F.col("p_size")
    return t.part.select("p_partkey", numbers.absolute_change(a, b).alias("change"), numbers.percentage_change(a, b).alias("pct"), numbers.growth(b, a).alias("growth"))


@query("sca_28_hashes", "SELECT source, sha256(array_to_string(list_sort(list_distinct(list(CAST(doc_id AS VARCHAR)))), ',') || '|v1') AS fingerprint, min(sha256(text)) AS least_text_hash FROM documents GROUP BY source")
def sca_28(t: Tables):
    return t.documents.groupBy("source").agg(hashing.fingerprint(F.collect_set(F.col("doc_id").cast("string")), F.lit("v1")).alias("fingerprint"), F.min(hashing.content(F.col("text"))).alias("least_text_hash"))


@query("sca_29_json_field", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '-1')::INTEGER AS k, coalesce(json_extract_string(props, '$.none'), 'absent') AS missing FROM events")
def sca_29(t: Tables):
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("-1")).cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("absent")).alias("missing"))


@query("sca_30_redact", "SELECT event_id, 'token=[REDACTED] Bearer [REDACTED] user ' || user_id AS line FROM events")
def sca_30(t: Tables):
    line = F.format_string("token=abc%d Bearer x.y%d user %d", "event_id", "event_id", "user_id")
    return t.events.select("event_id", text.redact(line).alias("line"))


@query("sca_31_mime_label", "SELECT label, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'PDF' WHEN 'click' THEN 'CSV' WHEN 'error' THEN 'Text' ELSE 'Other' END AS label FROM events) GROUP BY label")
def sca_31(t: Tables):
    mime = F.when(F.col("event_type") == "view", "application/pdf").when(F.col("event_type") == "click", "text/csv").when(F.col("event_type") == "error", "text/plain").otherwise(F.col("event_type"))
    return t.events.select(text.mime_label(mime).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("sca_32_document_type", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'CLOSURE_PLAN' WHEN 1 THEN 'MINING_PLAN' WHEN 2 THEN 'GEOLOGICAL_REPORT' ELSE 'OTHER' END AS document_type FROM part")
def sca_32(t: Tables):
    k = F.col("p_partkey") % 4
    return t.part.select("p_partkey", text.document_type(F.when(k == 0, "Mine_Closure_2024.pdf").when(k == 1, "Mining-Plan.docx").when(k == 2, "geological report.pdf").otherwise("memo.txt")).alias("document_type"))


@query("sca_34_safe_url", r"SELECT page_id, regexp_matches(url, '^https?://[^/@:]+') AND url NOT LIKE '%@%' AS ok, regexp_replace(url, '://[^/@]*@', '://') AS clean FROM pages")
def sca_34(t: Tables):
    return t.pages.select("page_id", text.safe_url(F.col("url")).alias("u")).select("page_id", "u.ok", "u.clean")


# projections and filters ------------------------------------------------------------------------------------------
@query("prj_01_projection", "SELECT doc_id AS document_id, source AS organization, lang AS document_type, n_chars AS size FROM documents")
def prj_01(t: Tables):
    return t.documents.select(F.col("doc_id").alias("document_id"), F.col("source").alias("organization"), F.col("lang").alias("document_type"), F.col("n_chars").alias("size"))


@query("prj_02_display_columns", "SELECT l_orderkey, l_linenumber, 'Order ' || l_orderkey || ' | P.' || l_linenumber AS provenance, printf('%.2f', l_extendedprice) || ' USD' AS shown FROM lineitem")
def prj_02(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.concat_ws(" | ", F.format_string("Order %d", "l_orderkey"), F.format_string("P.%d", "l_linenumber")).alias("provenance"), F.concat(F.format_string("%.2f", "l_extendedprice"), F.lit(" USD")).alias("shown"))


@query("prj_03_enrichment", "SELECT s_suppkey, coalesce(n_name, 'Unknown Unit') AS organization FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON s_nationkey = n_nationkey")
def prj_03(t: Tables):
    return filters.enriched(t.supplier, t.nation.where("n_nationkey % 2 = 0"), "s_nationkey", "n_nationkey", "n_name", "organization").select("s_suppkey", "organization")


@query("flt_01_scope", "SELECT 'list' AS kind, count(*) AS n FROM documents WHERE source IN ('src1','src2') UNION ALL SELECT 'all', count(*) FROM documents UNION ALL SELECT 'none', 0")
def flt_01(t: Tables):
    return scope.summary(t.documents, "source", {"list": ["src1", "src2"], "all": None, "none": []})


@query("flt_02_equality", "SELECT doc_id FROM documents WHERE source = 'src3' AND lang = 'en'")
def flt_02(t: Tables):
    return filters.equal(t.documents, source="src3", lang="en", doc_id=None).select("doc_id")


@query("flt_03_period_text", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') ILIKE '%1997-0%'")
def flt_03(t: Tables):
    rows = t.orders.withColumn("content", F.date_format("o_orderdate", "yyyy-MM")).withColumn("title", F.lit(""))
    return filters.names_period(rows, "FY1997-0", "content", "title").select("o_orderkey")


@query("flt_04_any_token", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%stre%' OR lower(text) LIKE '%zung%'")
def flt_04(t: Tables):
    return filters.any_token(t.documents, ["stre", "zung"], "text").select("doc_id")


@query("flt_05_corpus", "SELECT doc_id FROM documents WHERE source IN ('src1','src4') AND lang = 'en' AND (text ILIKE '%thing%' OR doc_id IN (SELECT vec_id FROM embeddings WHERE label = 3))")
def flt_05(t: Tables):
    known = t.embeddings.where("label = 3").select(F.col("vec_id").alias("doc_id"))
    return filters.text_or_known(scope.scoped(t.documents, "source", ["src1", "src4"]).where("lang = 'en'"), "text", "thing", known, "doc_id").select("doc_id")


@query("flt_06_facts", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' AND l_extendedprice IS NOT NULL AND year(l_shipdate) = 1998")
def flt_06(t: Tables):
    return t.lineitem.where("l_returnflag <> 'R' AND l_extendedprice IS NOT NULL AND year(l_shipdate) = 1998").select("l_orderkey", "l_linenumber")


@query("flt_07_key_equality", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = lower('bUiLdInG')")
def flt_07(t: Tables):
    return t.customer.where(F.lower("c_mktsegment") == F.lower(F.lit("bUiLdInG"))).select("c_custkey")


@query("flt_08_needs_review", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('R', 'A') OR l_linestatus = 'O'")
def flt_08(t: Tables):
    rows = t.lineitem.withColumns({"validation_status": F.when(F.col("l_returnflag") == "R", "ERROR").when(F.col("l_returnflag") == "A", "WARNING").otherwise("PASS"), "verification_status": F.when(F.col("l_linestatus") == "O", "UNVERIFIED").otherwise("VERIFIED")})
    return filters.needs_review(rows).select("l_orderkey", "l_linenumber")


@query("flt_09_default_status", "SELECT event_id FROM events WHERE event_type <> 'view' AND (user_id % 7 = 0 OR user_id IN (11, 12))")
def flt_09(t: Tables):
    rows = t.events.withColumn("org", F.when(F.col("user_id") % 7 != 0, F.col("user_id").cast("string")))
    return scope.scoped_or_global(rows.where("event_type <> 'view'"), "org", ["11", "12"]).select("event_id")


@query("flt_10_has_chunk", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def flt_10(t: Tables):
    return t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id"), "left_semi").select("doc_id")


@query("flt_11_time_cutoff", "SELECT event_id FROM events WHERE coalesce(CASE WHEN event_type = 'click' THEN ts END, ts - INTERVAL 1 DAY) < TIMESTAMP '2024-01-10 00:00:00'")
def flt_11(t: Tables):
    return filters.started_before(t.events.withColumns({"started_at": F.when(F.col("event_type") == "click", F.col("ts")), "created_at": F.expr("ts - INTERVAL 1 DAY")}), F.lit("2024-01-10").cast("timestamp")).select("event_id")


@query("flt_12_listing", "SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'src5' AND text ILIKE '%la%'")
def flt_12(t: Tables):
    return filters.equal(t.documents, lang="fr", source="src5").where(F.col("text").ilike("%la%")).select("doc_id")


@query("flt_13_visible_organizations", "SELECT n_nationkey FROM nation WHERE n_nationkey = 2 OR n_regionkey = 2")
def flt_13(t: Tables):
    return t.nation.where("n_nationkey = 2 OR n_regionkey = 2").select("n_nationkey")


@query("flt_14_subsidiary_consistency", """
WITH k AS (SELECT doc_id, (text ILIKE '%anone%' OR source = 'src1' OR NOT (source IN ('src2','src3'))) AS keep FROM documents WHERE source IN ('src1','src2','src3','src4'))
SELECT doc_id FROM k WHERE keep OR NOT (SELECT bool_or(keep) FROM k)""")
def flt_14(t: Tables):
    return filters.consistent(scope.scoped(t.documents, "source", ["src1", "src2", "src3", "src4"]), F.col("text"), F.col("source"), "src1", ["src2", "src3"], needle="anone").select("doc_id")


@query("flt_15_child_reads", "SELECT o_orderkey, count(l_linenumber) AS n, list_sort(list(l_linenumber)) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def flt_15(t: Tables):
    kids = t.lineitem.groupBy("l_orderkey").agg(F.count("l_linenumber").alias("n"), F.sort_array(F.collect_list("l_linenumber")).alias("lines"))
    return t.orders.join(kids, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "n", "lines")


# sorts and pages --------------------------------------------------------------------------------------------------
@query("srt_01_top_k", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def srt_01(t: Tables):
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("srt_03_candidate_pool", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 36")
def srt_03(t: Tables):
    k = 12
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(max(3 * k, 30))


@query("srt_04_pages", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def srt_04(t: Tables):
    return t.events.orderBy(F.desc("ts"), "event_id").offset(100).limit(50).select("event_id")


@query("srt_05_corpus_order", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq FROM documents")
def srt_05(t: Tables):
    return t.documents.select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long").alias("seq"))


@query("srt_06_period_key", "SELECT DISTINCT year(o_orderdate)::INTEGER AS y, quarter(o_orderdate)::INTEGER AS part FROM orders UNION SELECT 9999, 0")
def srt_06(t: Tables):
    p = t.orders.select(F.format_string("Q%d FY%d", F.quarter("o_orderdate"), F.year("o_orderdate")).alias("p")).union(t.region.select(F.lit("Lifetime")))
    return p.distinct().select(periods.sort_key(F.col("p")).alias("k")).select(F.col("k.year").alias("y"), "k.part").distinct()


@query("srt_07_union_page", "SELECT kind, id FROM (SELECT 'document' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'page', page_id FROM pages) ORDER BY kind, id LIMIT 40 OFFSET 980")
def srt_07(t: Tables):
    both = t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id")).union(t.pages.select(F.lit("page"), "page_id"))
    return both.orderBy("kind", "id").offset(980).limit(40)


@query("srt_08_limit_per_source", "(SELECT 'd' AS kind, doc_id AS id FROM documents ORDER BY doc_id LIMIT 15) UNION ALL (SELECT 'p', page_id FROM pages ORDER BY page_id LIMIT 15)")
def srt_08(t: Tables):
    return t.documents.orderBy("doc_id").limit(15).select(F.lit("d").alias("kind"), F.col("doc_id").alias("id")).union(t.pages.orderBy("page_id").limit(15).select(F.lit("p"), "page_id"))


#: Pairs that one task makes and counts before they are shuffled.
PAIRS_OF_A_TASK = 2_000_000


# sets -------------------------------------------------------------------------------------------------------------
@query("set_02_union", "SELECT DISTINCT id FROM (SELECT doc_id AS id FROM labels UNION SELECT vec_id FROM embeddings)")
def set_02(t: Tables):
    return t.labels.select(F.col("doc_id").alias("id")).union(t.embeddings.select("vec_id")).distinct()


@query("set_03_intersection", "SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(DISTINCT a.l_partkey) AS shared FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def set_03(t: Tables):
    """Pairs are many more than rows, so they are dealt over tasks by their number: what a task counts stays as small as it was."""
    s = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    each = F.col("n") * (F.col("n") - 1) / 2
    pairs = s.groupBy("l_partkey").agg(F.count("*").alias("n")).agg(F.sum(each)).first()[0] or 0
    s = s.repartition(max(t.spark.sparkContext.defaultParallelism, int(pairs / PAIRS_OF_A_TASK) + 1), "l_partkey")
    both = s.alias("a").join(s.alias("b").hint("shuffle_merge"), "l_partkey").where("a.l_suppkey < b.l_suppkey").select(F.col("a.l_suppkey").alias("a"), F.col("b.l_suppkey").alias("b"))
    return both.groupBy("a", "b").agg(F.count("*").alias("shared"))


@query("set_04_difference", """
WITH a AS (SELECT DISTINCT label FROM embeddings JOIN documents ON vec_id = doc_id WHERE source = 'src1'), b AS (SELECT DISTINCT label FROM embeddings JOIN documents ON vec_id = doc_id WHERE source = 'src2')
SELECT coalesce(a.label, b.label) AS label, CASE WHEN b.label IS NULL THEN 'only_a' WHEN a.label IS NULL THEN 'only_b' ELSE 'common' END AS side FROM a FULL JOIN b ON a.label = b.label""")
def set_04(t: Tables):
    d = t.embeddings.join(t.documents, F.col("vec_id") == F.col("doc_id"))
    return filters.differences(d.where("source = 'src1'").select("label"), d.where("source = 'src2'").select("label"), "label")


@query("set_05_distinct", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def set_05(t: Tables):
    return t.lineitem.where("l_returnflag = 'A'").select("l_suppkey").distinct()


@query("set_06_signature", "SELECT md5(regexp_replace(text[1:80], '^\\s+|\\s+$', '', 'g')) AS sig, min(doc_id) AS keep, count(*) AS n FROM documents GROUP BY 1")
def set_06(t: Tables):
    sig = F.md5(F.regexp_replace(F.substring("text", 1, 80), r"^\s+|\s+$", ""))
    return t.documents.groupBy(sig.alias("sig")).agg(F.min("doc_id").alias("keep"), F.count("*").alias("n"))


@query("set_07_candidates", "SELECT l_suppkey, l_returnflag, l_quantity, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1, 2, 3")
def set_07(t: Tables):
    rows = t.lineitem.withColumns({"value": F.format_string(" %s ", F.col("l_quantity").cast("string")), "seq": F.col("l_orderkey") * 10 + F.col("l_linenumber")})
    kept = filters.first_by(rows, [F.col("l_suppkey"), F.col("l_returnflag"), F.lower(F.trim("value"))], [F.col("seq")])
    return kept.select("l_suppkey", "l_returnflag", "l_quantity", F.col("seq").alias("first"))


@query("set_08_header_jaccard", r"""
WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS s FROM documents)
SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.s, b.s)) / greatest(len(list_distinct(list_concat(a.s, b.s))), 1), 6) AS jaccard FROM w a JOIN w b ON a.doc_id + 1 = b.doc_id""")
def set_08(t: Tables):
    w = t.documents.select("doc_id", F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")).alias("s"))
    pairs = w.alias("a").join(w.alias("b"), F.expr("a.doc_id + 1 = b.doc_id"))
    return pairs.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), F.round(filters.jaccard(F.col("a.s"), F.col("b.s")), 6).alias("jaccard"))


@query("set_09_exact_duplicates", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def set_09(t: Tables):
    return t.documents.groupBy(hashing.content(F.col("text")).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("set_10_missing_and_extra", "SELECT d.doc_id AS id, 'missing' AS side FROM documents d ANTI JOIN embeddings e ON d.doc_id = e.vec_id UNION ALL SELECT vec_id, 'extra' FROM embeddings ANTI JOIN labels ON vec_id = doc_id")
def set_10(t: Tables):
    d, e, lab = t.documents.select(F.col("doc_id").alias("id")), t.embeddings.select(F.col("vec_id").alias("id")), t.labels.select(F.col("doc_id").alias("id"))
    return d.join(e, "id", "left_anti").withColumn("side", F.lit("missing")).union(e.join(lab, "id", "left_anti").withColumn("side", F.lit("extra")))
