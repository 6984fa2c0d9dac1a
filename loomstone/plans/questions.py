"""Queries of questions, answers and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.operators import questions as qs
from loomstone.operators import reports, tables
from loomstone.plans.catalog import ORACLES, QUERIES, Tables, query
from loomstone.plans.facts import YEARLY, _yearly
from loomstone.session import shared_folder
from loomstone.sources import readers, sinks

QUERIES["srt_02_nearest"], ORACLES["srt_02_nearest"] = QUERIES["ret_03_dense"], ORACLES["ret_03_dense"]


def _questions(t: Tables) -> DataFrame:
    text = F.format_string("What is the coal production of Mine %d and Gevra under SECL in FY 2023-24 compared to 2022-2023, drilling too?", F.col("p_partkey"))
    return t.part.select("p_partkey", text.alias("question"))


@query("qa_01_normalised", "SELECT p_partkey, 'the coal production of Mine ' || p_partkey || ' and Gevra under SECL in FY 2023-24 compared to 2022-2023 drilling too' AS clean_query, 'FY2022-23' AS period_start, 'FY2023-24' AS period_end FROM part")
def qa_01(t: Tables):
    return qs.normalised(_questions(t)).select("p_partkey", "clean_query", "period_start", "period_end")


@query("sca_02_entities", "SELECT p_partkey, 'SECL;Mine ' || p_partkey || ';Gevra' AS entities FROM part")
def sca_02(t: Tables):
    return qs.normalised(_questions(t)).select("p_partkey", F.array_join("entities", ";").alias("entities"))


@query("sca_03_tags", "SELECT p_partkey, 'production' AS metrics, 'drilling' AS topics FROM part")
def sca_03(t: Tables):
    return qs.normalised(_questions(t)).select("p_partkey", F.array_join("metrics", ";").alias("metrics"), F.array_join("topics", ";").alias("topics"))


def _records(t: Tables) -> DataFrame:
    return _yearly(t).select(F.col("l_suppkey").cast("string").alias("entity_name"), F.lit("coal_production").alias("field_name"), F.col("period").alias("reporting_period"), F.lit("d").alias("document_id"), F.col("value").alias("numeric_value"))


@query("qa_10_comparison", f"WITH s AS ({YEARLY}), p AS (SELECT CAST(l_suppkey AS VARCHAR) AS entity, value, lag(value) OVER (PARTITION BY l_suppkey ORDER BY period) AS first FROM s) SELECT entity, 'coal production' AS metric, 'YOY' AS operation, first, value AS last, round(value - first, 2) AS result FROM p WHERE first IS NOT NULL")
def qa_10(t: Tables):
    return qs.calculations("growth of coal production", _records(t)).select("entity", "metric", "operation", "first", "last", F.round("result", 2).alias("result"))


@query("qa_10_sums", f"WITH s AS ({YEARLY}) SELECT CAST(l_suppkey AS VARCHAR) AS entity, 'SUM' AS operation, round(sum(value), 1) AS result FROM s GROUP BY 1 HAVING count(*) >= 2")
def qa_10_sums(t: Tables):
    return qs.calculations("total coal production", _records(t)).select("entity", "operation", F.round("result", 1).alias("result"))


@query("qa_13_answers", "SELECT s_suppkey, 'Coal Production of the project in FY2023-24 was ' || printf('%,.1f', s_acctbal) || ' MT [1].' AS answer, 'SUPPORTED' AS status, 0.9::DOUBLE AS confidence FROM supplier")
def qa_13(t: Tables):
    rows = t.supplier.select("s_suppkey", F.lit("coal_production").alias("field_name"), F.lit(None).cast("string").alias("entity_name"), F.lit("FY2023-24").alias("reporting_period"), F.col("s_acctbal").alias("numeric_value"), F.lit("MT").alias("unit"), F.lit(1).alias("seq"))
    return qs.answered(rows, key="s_suppkey", order="seq")


query("rpt_11_narrative", ORACLES["qa_13_answers"])(qa_13)


@query("rpt_09_assembly", "SELECT s_suppkey AS report, count(*) AS n_fields FROM supplier, range(0, 21) r(i) GROUP BY 1")
def rpt_09(t: Tables):
    facts = t.supplier.select(F.col("s_suppkey").alias("report"), F.lit("block_name").alias("name"), F.col("s_name").alias("v"))
    frozen = reports.snapshot(reports.mapped_fields(facts, report="report", name="name", value="v"), key="report", order="internal_id")
    return frozen.select("report", F.json_array_length("snapshot").cast("long").alias("n_fields"))


@query("sca_15_merged_headers", "SELECT * FROM (VALUES (0, 'Coal | Plan'), (1, 'Coal | Actual'), (2, 'OB | Actual'), (3, 'Col_4')) v(i, name)")
def sca_15(t: Tables):
    names = [*tables.merged_headers([["Coal", None, "OB"], ["Plan", "Actual", "Actual"]], [(1, 1, 1, 2)]), *tables.merged_headers([[None] * 4])[3:]]
    return t.spark.createDataFrame(list(enumerate(names)), "i int, name string")


@query("sca_16_header_depth", "SELECT 2 AS depth, true AS numeric_row, false AS text_row")
def sca_16(t: Tables):
    rows = [["Coal", None], ["Plan", "Actual"], ["1", "2"]]
    return t.spark.createDataFrame([(tables.header_depth(rows, [(1, 1, 1, 2)]), tables.is_data_row(rows[2]), tables.is_data_row(rows[1]))], "depth int, numeric_row boolean, text_row boolean")


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/sink-{uuid.uuid4().hex[:12]}"


@query("snk_01_staged_write", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def snk_01(t: Tables):
    at = _folder(t)
    t.documents.select("doc_id", "lang").write.parquet(at)
    return t.spark.read.parquet(at).groupBy("lang").agg(F.count("*").alias("n"))


@query("snk_02_repeated_overwrite", "SELECT lang, count(*) AS n FROM documents WHERE lang <> 'fr' OR doc_id % 2 = 0 GROUP BY 1")
def snk_02(t: Tables):
    at = _folder(t)
    rows = t.documents.select("doc_id", "lang")
    sinks.overwrite_partitions(rows, at, "lang")
    for _ in range(2):
        sinks.overwrite_partitions(rows.where("lang = 'fr' AND doc_id % 2 = 0"), at, "lang")
    return t.spark.read.parquet(at).groupBy("lang").agg(F.count("*").alias("n"))


@query("snk_05_audit", "SELECT 2 * count(*) AS n, count(DISTINCT event_id) AS n_hashes FROM events")
def snk_05(t: Tables):
    at = _folder(t)
    for _ in range(2):
        sinks.audit(t.events.select("event_id", "event_type"), at)
    return t.spark.read.parquet(at).agg(F.count("*").alias("n"), F.countDistinct("sha256").alias("n_hashes"))


@query("str_07_parts", "SELECT CAST(i AS INTEGER) AS part, CASE WHEN i < 3 THEN 2000 ELSE 1000 END AS n_rows FROM range(1, 4) r(i)")
def str_07(t: Tables):
    body = F.concat(F.lit("id\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda x: x.cast("string")), "\n"))
    files = t.region.where("r_regionkey = 0").select(F.lit("a.csv").alias("path"), F.encode(body, "UTF-8").alias("content"))
    return readers.csv_tables(files).select("part", F.size("rows").alias("n_rows"))


@query("obs_01_observed", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def obs_01(t: Tables):
    rows, seen = qs.observed(t.orders.where("o_orderstatus = 'F'"), f"orders-{uuid.uuid4().hex[:8]}")
    rows.write.format("noop").mode("overwrite").save()
    return t.spark.createDataFrame([(seen.get["rows"],)], "n long")
