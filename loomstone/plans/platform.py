"""Queries of office files, plug-in points, backups, health, identities and periodic sweeps."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import providers
from loomstone.operators import embedding, extraction, governance, grounding, operations, retrieval, visuals
from loomstone.plans.catalog import Tables, query, spread
from loomstone.plans.governance import _csv_files, _visuals
from loomstone.session import shared_folder
from loomstone.sources import office, readers
from loomstone.streaming import jobs


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# office files -----------------------------------------------------------------------------------------------------
def _workbook(names: pd.Series, amounts: pd.Series, counts: pd.Series) -> pd.Series:
    """Three sheets: two header rows with merged ranges, one plain header over ``count`` rows, nothing."""

    def one(name, amount, count):
        merged = [[None, "Production", None, "Quality"], ["Mine", "Raw Coal", "Washed Coal", "Ash %"], [name, amount, 7, "18%"], [name, 1, 2.5, 3]]
        plain = [["No", "Name", None], *([i, name, True, "beyond"] for i in range(count))]
        return office.xlsx_bytes([("Report", merged, ["B1:C1"]), ("Rows & more", plain, []), ("Nothing", [], [])])

    return pd.Series([one(*row) for row in zip(names, amounts.tolist(), counts, strict=True)])


def _workbooks(t: Tables) -> DataFrame:
    count = (F.col("s_suppkey") % 5 + 1).cast("int")
    return spread(t.supplier).select(F.concat(F.lit("f"), "s_suppkey", F.lit(".xlsx")).alias("path"), F.pandas_udf(_workbook, "binary")("s_name", "s_acctbal", count).alias("content"))


@query("src_03_xlsx", """
SELECT 'f' || s_suppkey || '.xlsx' AS path, 1 AS page_number, 1 AS part, 2 AS header_depth, 'Mine;Production | Raw Coal;Production | Washed Coal;Quality | Ash %' AS headers, 2 AS n_rows, s_name || ';' || CAST(s_acctbal::DOUBLE AS VARCHAR) || ';7;18%' AS first_row FROM supplier
UNION ALL SELECT 'f' || s_suppkey || '.xlsx', 2, CAST(i AS INTEGER), 1, 'No;Name;Col_3;Col_4', CAST(least(2, s_suppkey % 5 + 1 - 2 * (i - 1)) AS INTEGER), (2 * (i - 1)) || ';' || s_name || ';True;beyond' FROM supplier, range(1, 4) r(i) WHERE 2 * (i - 1) < s_suppkey % 5 + 1
UNION ALL SELECT 'f' || s_suppkey || '.xlsx', 3, 0, 0, '', 0, NULL FROM supplier""")
def src_03(t: Tables):
    rows = office.xlsx_tables(_workbooks(t), part_rows=2)
    return rows.select("path", "page_number", "part", "header_depth", F.array_join("headers", ";").alias("headers"), F.size("rows").alias("n_rows"), F.array_join(F.get("rows", F.lit(0)), ";").alias("first_row"))


@query("src_03_sheet_pages", """
SELECT 'f' || s_suppkey || '.xlsx' AS path, 1 AS page_number, concat_ws(chr(10), '# Sheet: Report', 'Headers: Mine | Production | Raw Coal | Production | Washed Coal | Quality | Ash %', 'Data:', s_name || ' | ' || CAST(s_acctbal::DOUBLE AS VARCHAR) || ' | 7 | 18%', s_name || ' | 1 | 2.5 | 3') AS text FROM supplier
UNION ALL SELECT 'f' || s_suppkey || '.xlsx', 2, concat_ws(chr(10), '# Sheet: Rows & more', 'Headers: No | Name | Col_3 | Col_4', 'Data:', array_to_string(list_transform(range(0, s_suppkey % 5 + 1), lambda i: i || ' | ' || s_name || ' | True | beyond'), chr(10))) FROM supplier
UNION ALL SELECT 'f' || s_suppkey || '.xlsx', 3, 'Sheet: Nothing (Empty)' FROM supplier""")
def src_03_pages(t: Tables):
    return office.xlsx_pages(office.xlsx_tables(_workbooks(t)))


def _documents(t: Tables) -> DataFrame:
    """A document per supplier: a heading, a text of 3,100 letters, a heading, a text, a table."""
    block = lambda kind, text, rows=None: F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"), (F.lit(None) if rows is None else rows).cast("array<array<string>>").alias("rows"))
    cells = F.array(F.array(F.lit("Mine"), F.lit("")), F.array(F.col("s_name"), F.col("s_suppkey").cast("string")))
    blocks = F.array(block("heading", F.col("s_name")), block("text", F.repeat(F.lit("x"), 3100)), block("heading", F.lit("Annex & more")), block("text", F.lit("the end")), block("table", F.lit(None), cells))
    made = office.render_docx(spread(t.supplier).select("s_suppkey", blocks.alias("blocks")))
    return made.select(F.concat(F.lit("f"), "s_suppkey", F.lit(".docx")).alias("path"), "content", "n_bytes", "sha256")


@query("src_06_docx_pages", "SELECT 'f' || s_suppkey || '.docx' AS path, 1 AS page_number, chr(10) || '## ' || s_name || chr(10) || chr(10) || repeat('x', 3100) || chr(10) || chr(10) || '## Annex & more' AS text FROM supplier UNION ALL SELECT 'f' || s_suppkey || '.docx', 2, chr(10) || 'the end' FROM supplier")
def src_06_pages(t: Tables):
    return office.docx_pages(_documents(t))


@query("src_06_docx_tables", "SELECT 'f' || s_suppkey || '.docx' AS path, 1 AS table_index, 'DOCX Table 1' AS caption, 'Mine;Col_2' AS headers, s_name || ';' || s_suppkey AS first_row FROM supplier")
def src_06_tables(t: Tables):
    rows = office.docx_tables(_documents(t))
    return rows.select("path", "table_index", "caption", F.array_join("headers", ";").alias("headers"), F.array_join(F.get("rows", F.lit(0)), ";").alias("first_row"))


@query("snk_06_rendered_report", "SELECT o_custkey, 'Orders of customer ' || o_custkey AS title, CAST(count(*) AS INTEGER) AS n_rows, arg_min(o_orderstatus, o_orderkey) AS first_status, true AS same_bytes FROM orders GROUP BY 1")
def snk_06(t: Tables):
    """Reports rendered twice and read back: equal bytes, the rows in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: F.array(x["o_orderkey"].cast("string"), x["o_orderstatus"]))
    fields = F.concat(F.array(F.array(F.lit("Order"), F.lit("Status"))), lines)
    made = t.orders.groupBy("o_custkey").agg(office.blocks_of(F.format_string("Orders of customer %d", F.first("o_custkey")), fields).alias("blocks"))
    made = spread(made)
    once = office.render_docx(made).select(F.col("o_custkey").cast("string").alias("path"), "content", "sha256")
    again = office.render_docx(made).select(F.col("o_custkey").cast("string").alias("path"), F.col("sha256").alias("again"))
    read = office.docx_tables(once).select("path", F.size("rows").alias("n_rows"), F.col("rows")[0][1].alias("first_status"))
    title = office.docx_pages(once).select("path", F.regexp_replace("text", r"^\n## |\n$", "").alias("title"))
    both = once.select("path", "sha256").join(again, "path").join(read, "path").join(title, "path")
    return both.select(F.col("path").cast("long").alias("o_custkey"), "title", "n_rows", "first_status", (F.col("sha256") == F.col("again")).alias("same_bytes"))


def _mixed(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 6
    end = F.when(k == 0, "csv").when(k == 1, "txt").when(k == 2, "pdf").when(k == 3, "xls").when(k == 4, "png").otherwise("zip")
    return t.supplier.select(F.concat(F.lit("f"), "s_suppkey", F.lit("."), end).alias("path"), F.encode(F.concat("s_name", F.lit(",1\n")), "UTF-8").alias("content"))


MIXED = "SELECT 'f' || s_suppkey || '.' || e AS path, p AS parser, CASE WHEN p IN ('csv', 'text'{given}) THEN 1 END AS page_number, CASE WHEN p = 'csv' THEN s_name || ' | 1' WHEN p IN ('text'{given}) THEN s_name || ',1' || chr(10) END AS text, CASE WHEN p IS NULL THEN 'no parser takes this file' WHEN p IN ('csv', 'text'{given}) THEN NULL WHEN p = 'pdf' THEN 'PDF cannot be read: not a PDF file' WHEN p = 'xls' THEN 'XLS cannot be read: not a compound file' ELSE 'parser is not available: ' || p END AS error FROM supplier JOIN (VALUES (0, 'csv', 'csv'), (1, 'txt', 'text'), (2, 'pdf', 'pdf'), (3, 'xls', 'xls'), (4, 'png', 'image'), (5, 'zip', NULL)) v(k, e, p) ON s_suppkey % 6 = k"


@query("src_04_07_08_unavailable", MIXED.format(given=""))
def src_absent(t: Tables):
    """Images, whose parser is not here, and files that are not what they are called come back with an error."""
    return readers.pages(_mixed(t))


@query("udf_03_parser", MIXED.format(given=", 'pdf', 'xls'"))
def udf_03(t: Tables):
    """The same files with parsers given for two of the formats."""
    return readers.pages(_mixed(t), {"pdf": readers.text_pages, "xls": readers.text_pages})


# plug-in points ---------------------------------------------------------------------------------------------------
def _no_model():
    raise ImportError("no model is installed")


def _letters(text):
    """A vector of three letters' counts, as a stand-in for a model."""
    return F.array(*(F.regexp_count(text, F.lit(c)).cast("float") for c in "aeo"))


@query("ret_09_embedding_fallback", "SELECT item_id AS chunk_id, 'deterministic-hash' AS model_name, 384 AS dimensions, 'FALLBACK: no model is installed' AS status FROM benchmark")
def ret_09(t: Tables):
    provider, model, status = embedding.loaded("neural", {"neural": _no_model})
    rows = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    none = t.spark.createDataFrame([], "chunk_id long, model_name string")
    return embedding.index(rows, none, model, provider=provider).select("chunk_id", "model_name", "dimensions", F.lit(status).alias("status"))


@query("udf_01_embedding_provider", "SELECT doc_id AS chunk_id, 'letters' AS model_name, len(text) - len(replace(text, 'a', '')) AS n_a, 3 AS dimensions, 'READY' AS status FROM documents WHERE doc_id % 2 = 1")
def udf_01(t: Tables):
    provider, model, status = embedding.loaded("letters", {"letters": lambda: _letters})
    done = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"), F.lit(model).alias("model_name"))
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    made = embedding.index(rows, done, model, provider=provider)
    return made.select("chunk_id", "model_name", F.col("vector")[0].cast("long").alias("n_a"), "dimensions", F.lit(status).alias("status"))


@query("udf_02_reranker", "SELECT item_id, len(text)::DOUBLE AS rerank_score, 'RERANKED' AS rerank_status, row_number() OVER (ORDER BY len(text) DESC, item_id)::INTEGER AS rank FROM benchmark ORDER BY rank LIMIT 25")
def udf_02(t: Tables):
    """The best results of a given pairwise model (here the length of the text)."""
    scored = retrieval.rerank(t.benchmark.select("item_id", "text"), lambda text: F.length(text).cast("double"))
    return retrieval.ranked(scored.orderBy(F.desc("rerank_score"), "item_id").limit(25), [F.desc("rerank_score"), F.col("item_id")]).select("item_id", "rerank_score", "rerank_status", "rank")


@query("udf_04_extraction_provider", "SELECT p_partkey AS id, 'production_quantity' AS field_name, 'rules' AS provider FROM part UNION ALL SELECT p_partkey, 'brand', 'brands' FROM part WHERE p_partkey % 2 = 0")
def udf_04(t: Tables):
    """Candidates of the built-in rules and of a provider that was added; one that cannot be loaded adds nothing."""

    def brands(chunks: DataFrame) -> DataFrame:
        return chunks.select("id", F.lit("brand").alias("field_name"), F.nullif(F.regexp_extract("content", r"Brand (\w+)", 1), F.lit("")).alias("raw_value")).where("raw_value IS NOT NULL")

    loaders = {"rules": lambda: extraction.from_texts, "brands": lambda: brands, "none": lambda: lambda c: brands(c).limit(0), "language model": _no_model}
    chunks = t.part.select(F.col("p_partkey").alias("id"), F.format_string("Coal Production: %.2f MT.%s", "p_retailprice", F.when(F.col("p_partkey") % 2 == 0, " Brand X").otherwise("")).alias("content"))
    out = None
    for name in ("rules", "brands", "language model"):
        provider, used, _ = providers.load(name, loaders, "none")
        rows = provider(chunks).select("id", "field_name", F.lit(used).alias("provider"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("vis_03_classifier_selection", "SELECT p_partkey AS id, kind AS visual_type, 'heuristic' AS classifier, 'FALLBACK: no model is installed' AS status FROM part JOIN (VALUES (0, 'MAP'), (1, 'BOREHOLE_LOG'), (2, 'UNKNOWN'), (3, 'TABLE_IMAGE'), (4, 'CHART'), (5, 'UNKNOWN'), (6, 'CROSS_SECTION'), (7, 'PHOTOGRAPH'), (8, 'STRATIGRAPHIC_DIAGRAM')) v(k, kind) ON p_partkey % 9 = k")
def vis_03(t: Tables):
    """The classifier of a setting; where its model is absent the heuristic one stands in and says so."""
    classify, name, status = providers.load("vision", {"heuristic": lambda: visuals.classified, "vision": _no_model}, "heuristic")
    return classify(_visuals(t), F.col("caption")).select("id", "visual_type", F.lit(name).alias("classifier"), F.lit(status).alias("status"))


@query("udf_05_visual_classifier", "SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 2 THEN 'PHOTOGRAPH' ELSE 'UNKNOWN' END AS visual_type FROM part")
def udf_05(t: Tables):
    """A classifier that was given in place of the heuristic one."""
    given = lambda rows, text: rows.withColumns({"visual_type": visuals.taxonomy(F.when(text == "A picture", "photograph")), "confidence": F.lit(0.9), "review_status": F.lit("ACCEPTED")})
    classify, _, _ = providers.load("given", {"given": lambda: given, "heuristic": lambda: visuals.classified}, "heuristic")
    return classify(_visuals(t), F.col("caption")).select("id", F.coalesce("visual_type", F.lit("UNKNOWN")).alias("visual_type"))


def _stated(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.lit("coal_production").alias("field_name"), F.lit(None).cast("string").alias("entity_name"), F.lit("FY2023-24").alias("reporting_period"), F.col("s_acctbal").alias("numeric_value"), F.lit("MT").alias("unit"), F.lit(1).alias("seq"))


@query("qa_16_answer_provider", "SELECT s_suppkey, 'Coal Production of the project in FY2023-24 was ' || printf('%,.1f', s_acctbal) || ' MT [1].' AS answer, 'template' AS provider, 'FALLBACK: no model is installed' AS status FROM supplier")
def qa_16(t: Tables):
    """Answers of the provider that is set; without its model the template answers."""
    answer, name, status = providers.load("local model", {"template": lambda: grounding.synthesis, "local model": _no_model}, "template")
    return answer(_stated(t), key="s_suppkey", order="seq").withColumns({"provider": F.lit(name), "status": F.lit(status)})


@query("udf_06_answer_model", "SELECT s_suppkey, 'one fact' AS answer, 'counting' AS provider, 'READY' AS status FROM supplier")
def udf_06(t: Tables):
    counting = lambda facts, *, key, order: facts.groupBy(key).agg(F.when(F.count(order) == 1, "one fact").otherwise("facts").alias("answer"))
    answer, name, status = providers.load("counting", {"template": lambda: grounding.synthesis, "counting": lambda: counting}, "template")
    return answer(_stated(t), key="s_suppkey", order="seq").withColumns({"provider": F.lit(name), "status": F.lit(status)})


@query("udf_07_external_system", """
SELECT CASE event_id % 3 WHEN 0 THEN 'sap' WHEN 1 THEN 'coalnet' ELSE 'dms' END AS system, CASE event_id % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'dispatch' ELSE 'document' END AS record_type, count(*) AS n, max(event_id) AS last_record FROM events GROUP BY 1, 2""")
def udf_07(t: Tables):
    """Exports of all systems, made from the events, through one interface; one that is not configured fails closed (see the tests)."""
    at = _folder(t, "systems")
    t.spark.dataSource.register(readers.ExternalRecords)
    out = None
    for i, name in enumerate(("sap", "coalnet", "dms")):
        t.events.where(F.col("event_id") % 3 == i).select(F.col("event_id").alias("record_id"), F.lit(i).alias("changed_day")).write.json(f"{at}/{name}")
        rows = t.spark.read.format("external_records").option("system", name).option("exports", f"{at}/{name}").load()
        out = rows if out is None else out.union(rows)
    return out.groupBy("system", "record_type").agg(F.count("*").alias("n"), F.max(F.col("record_id").cast("long")).alias("last_record"))


@query("udf_08_identity", "SELECT o_orderkey AS attempt_id, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_custkey % 7 > 0 THEN o_custkey END END AS user_id, CASE WHEN o_orderkey % 4 <> 0 THEN 'INVALID_CREDENTIALS' WHEN o_custkey % 7 = 0 THEN 'INACTIVE' ELSE 'OK' END AS status, CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 7 > 0 THEN 'MINE_OFFICER' END AS role FROM orders")
def udf_08(t: Tables):
    """Every order's customer tries to sign in: one in four with the right password, one in four under an unknown name."""
    word = lambda k: F.concat(F.lit("pass-"), k.cast("string"))
    salt = F.sha2(F.col("c_custkey").cast("string"), 256)
    users = t.customer.select(F.concat(F.lit("User"), "c_custkey").alias("username"), F.col("c_custkey").alias("user_id"), salt.alias("salt"), operations.secret(salt, word(F.col("c_custkey"))).alias("secret"), (F.col("c_custkey") % 7 > 0).alias("active"), F.array(F.lit("MINE_OFFICER")).alias("roles"))
    k = F.col("o_orderkey") % 4
    attempts = t.orders.select(F.col("o_orderkey").alias("attempt_id"), F.concat(F.when(k == 1, "nobody").otherwise("user"), "o_custkey").alias("username"), F.when(k == 0, word(F.col("o_custkey"))).when(k == 2, "").otherwise("pass").alias("password"))
    return operations.authenticated(attempts, users).select("attempt_id", "user_id", "status", F.get("roles", F.lit(0)).alias("role"))


@query("udf_08_directory_absent", "SELECT o_orderkey AS attempt_id, NULL::BIGINT AS user_id, 'PROVIDER_UNAVAILABLE' AS status FROM orders")
def udf_08_ldap(t: Tables):
    attempts = t.orders.select(F.col("o_orderkey").alias("attempt_id"), F.lit("user").alias("username"), F.lit("").alias("password"))
    users = t.spark.createDataFrame([], "username string, user_id long, salt string, secret string, active boolean, roles array<string>")
    return operations.authenticated(attempts, users, "ldap").select("attempt_id", "user_id", "status")


# backups, health, sweeps ------------------------------------------------------------------------------------------
@query("snk_07_archive", "SELECT 'f' || s_suppkey || '.csv' AS path, 'OK' AS status, sha256('Mine;Output' || chr(10) || s_name || ';1,5' || chr(10) || chr(10) || s_name || ';2' || chr(10)) AS sha256 FROM supplier")
def snk_07(t: Tables):
    at = _folder(t, "backup")
    listed = operations.back_up(_csv_files(t), at)
    return operations.verified(t.spark, at).join(listed, "path").select("path", "status", "sha256")


@query("snk_07_retention", "SELECT event_id AS name FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) > 30")
def snk_07_retention(t: Tables):
    return operations.expired(t.events.select(F.col("event_id").alias("name"), F.col("ts").alias("created_at")), 30).select("name")


@query("gov_08_restore", "SELECT 'f' || s_suppkey || '.csv' AS path, 'OK' AS status, true AS refused_again, true AS forced FROM supplier")
def gov_08(t: Tables):
    """A backup restored: refused where the target holds files, unless forced; every file as read back."""
    at, target = _folder(t, "backup"), _folder(t, "restored")
    operations.back_up(_csv_files(t), at)
    operations.restore(t.spark, at, target).write.format("noop").mode("overwrite").save()
    try:
        operations.restore(t.spark, at, target)
        refused = False
    except operations.Refused:
        refused = True
    return operations.restore(t.spark, at, target, force=True).withColumns({"refused_again": F.lit(refused), "forced": F.lit(True)})


def _probed(t: Tables) -> DataFrame:
    named = {"documents": f"{t._folder}/documents.parquet", "absent": f"{t._folder}/no-such-table.parquet"}
    checks = operations.built_in(t.spark, named, _folder(t, "health"))
    return operations.probes(t.spark, {**checks, "queue": None, "model": lambda: "no model is installed"}, optional=("table absent", "model", "queue"))


@query("gov_07_probes", "SELECT * FROM (VALUES ('executors', 'HEALTHY', true), ('storage', 'HEALTHY', true), ('table documents', 'HEALTHY', true), ('table absent', 'UNAVAILABLE', false), ('streams', 'HEALTHY', true), ('queue', 'NOT_CONFIGURED', false), ('model', 'DEGRADED', false)) v(component, status, required)")
def gov_07(t: Tables):
    return _probed(t).select("component", "status", "required")


@query("gov_07_health", "SELECT 'DEGRADED' AS status")
def gov_07_health(t: Tables):
    return operations.health(_probed(t))


@query("str_08_sweep", "SELECT event_id AS id, 'FAILED' AS status FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 MINUTE")
def str_08(t: Tables):
    """The sweep run twice to its end: a job is marked once."""
    at = _folder(t, "sweep")
    read = lambda: t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "PROCESSING").otherwise("COMPLETED").alias("status"), F.col("ts").cast("timestamp").alias("started_at"), F.col("ts").cast("timestamp").alias("created_at"))
    for i in range(2):
        jobs.sweep(t.spark, read, f"{at}/marks", f"{at}/state-{i}", every=None, now=F.lit("2024-01-15").cast("timestamp")).awaitTermination()
    return t.spark.read.parquet(f"{at}/marks").select("id", "status")


@query("obs_01_spans", "SELECT 1 AS span, 'count orders' AS operation, 'OK' AS status, CAST(count(*) AS VARCHAR) AS rows FROM orders UNION ALL SELECT 2, 'restore', 'ERROR', NULL UNION ALL SELECT 3, 'count labels', 'OK', CAST(count(*) AS VARCHAR) FROM labels")
def obs_01_spans(t: Tables):
    """Three timed operations, one of which fails; its span says so and the error goes on to the caller."""
    spans = operations.Spans()
    with spans.timed("count orders") as seen:
        seen["rows"] = t.orders.count()
    try:
        with spans.timed("restore"):
            raise operations.Refused("target holds files")
    except operations.Refused:
        pass
    with spans.timed("count labels") as seen:
        seen["rows"] = t.labels.count()
    return spans.frame(t.spark).where("latency_ms >= 0").select("span", "operation", "status", F.col("attributes")["rows"].alias("rows"))


@query("str_02_rate_limit_rest", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def str_02_rest(t: Tables):
    """Every request comes out of the rate limit, allowed or not."""
    rows = governance.rate_limited(t.events.select("event_id", "user_id", "ts"), client="user_id", at="ts", limit=3, window=36_000.0)
    return rows.groupBy("user_id").agg(F.count("allowed").alias("n"))
