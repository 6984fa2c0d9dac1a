"""Queries of extraction, tables, strata, visuals, grounding, reports, governance, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.operators import extraction, geology, grounding, reports, tables, visuals
from loomstone.operators import governance as gv
from loomstone.plans.catalog import Tables, query, spread
from loomstone.session import shared_folder
from loomstone.sources import readers, sinks
from loomstone.streaming import jobs


# extraction -------------------------------------------------------------------------------------------------------
def _notes(t: Tables) -> DataFrame:
    """A note per part that states production, ash and a fiscal year."""
    text = F.format_string("Mine Name: Pit %d, Coal Production: %.2f MT. Ash Content %d%%. FY 2023-24. Borehole No: BH-%d", F.col("p_partkey"), F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey"))
    return spread(t.part).select(F.col("p_partkey").alias("id"), text.alias("content"))


@query("ext_01_text_rules", """
SELECT p_partkey AS id, 'production_quantity' AS field_name, printf('%.2f', p_retailprice) AS raw_value, round(p_retailprice, 2)::DOUBLE AS numeric_value, 'MT' AS unit FROM part
UNION ALL SELECT p_partkey, 'ash_content', p_size || '', p_size::DOUBLE, '%' FROM part
UNION ALL SELECT p_partkey, 'fiscal_year', '2023-24', NULL, NULL FROM part
UNION ALL SELECT p_partkey, 'borehole_id', 'BH-' || p_partkey, NULL, NULL FROM part
UNION ALL SELECT p_partkey, 'mine_name', 'Pit ' || p_partkey, NULL, NULL FROM part""")
def ext_01(t: Tables):
    return extraction.from_texts(_notes(t)).select("id", "field_name", "raw_value", "numeric_value", "unit")


def _tables(t: Tables) -> DataFrame:
    """One table per supplier: mine, production and ash of its lines."""
    row = lambda x: F.array(F.concat(F.lit("mine"), x["l_partkey"].cast("string")), x["l_quantity"].cast("string"), F.when(x["l_linenumber"] == 1, "nil").otherwise(x["l_linenumber"].cast("string")))
    rows = t.lineitem.groupBy("l_suppkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))), row).alias("rows"))
    return rows.select(F.col("l_suppkey").alias("table_id"), F.lit(1).alias("page_number"), F.array(F.lit("Mine"), F.lit("Raw Coal (LT)"), F.lit("Ash %")).alias("headers"), "rows")


@query("ext_02_table_rules", """
SELECT l_suppkey AS table_id, 'production_quantity' AS field_name, 'LT' AS unit, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1
UNION ALL SELECT l_suppkey, 'ash_content', '%', count(*), sum(l_linenumber)::DOUBLE FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1""")
def ext_02(t: Tables):
    found = extraction.from_tables(_tables(t))
    return found.groupBy("table_id", "field_name", "unit").agg(F.count("*").alias("n"), F.round(F.sum("numeric_value"), 2).alias("total"))


@query("ext_04_pipeline", """
SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 2 THEN 3 ELSE 4 END AS n_fields, CASE WHEN p_size * 3 > 100 THEN 'ERROR' WHEN p_size * 3 > 65 OR p_partkey % 3 = 1 THEN 'WARNING' ELSE 'PASS' END AS status,
  CASE WHEN p_size * 3 > 100 THEN 1 ELSE 0 END AS n_tasks FROM part""")
def ext_04(t: Tables):
    """Extraction, deduplication, validation and review tasks, over notes that repeat a fact, state a bad year or no mine."""
    from loomstone.operators import governance as gv
    from loomstone.operators.quality import overall, validate

    k = F.col("p_partkey") % 3
    text = F.format_string("%sCoal Production: %.2f MT. Coal Production: %.2f MT. Ash Content %d%%. FY 2023-24.", F.when(k == 2, "").otherwise(F.format_string("Mine Name: Pit %d, ", "p_partkey")), "p_retailprice", "p_retailprice", F.col("p_size") * 3)
    facts = extraction.from_texts(spread(t.part).select(F.col("p_partkey").alias("id"), text.alias("content"), k.alias("k"))).withColumns({"page_number": F.lit(1), "unit": F.when((F.col("field_name") == "production_quantity") & (F.col("id") % 3 == 1), "").otherwise(F.col("unit"))})
    checked = validate(extraction.deduplicated(facts, document="id", page="page_number", order="field_name"))
    tasks = gv.review_tasks(facts=checked).groupBy(F.col("object_id").cast("long").alias("id")).agg(F.count("*").alias("n"))
    found = checked.groupBy("id").agg(F.count("*").cast("int").alias("n_fields"), overall(F.flatten(F.collect_list("validation"))).alias("status"))
    return found.join(tasks, "id", "left").select("id", "n_fields", "status", F.coalesce("n", F.lit(0)).cast("int").alias("n_tasks"))


# strata -----------------------------------------------------------------------------------------------------------
STRATA = """strata AS (SELECT l_orderkey AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS o, l_quantity AS q, l_partkey % 4 AS k, l_discount AS x FROM lineitem),
depth AS (SELECT *, round(sum(q) OVER (PARTITION BY b ORDER BY o) - q + CASE WHEN x > 0.08 THEN 0.5 WHEN x < 0.01 THEN -0.5 ELSE 0 END, 2) AS f, round(sum(q) OVER (PARTITION BY b ORDER BY o), 2) AS e FROM strata)"""


def _strata(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = t.lineitem.withColumns({"o": F.row_number().over(w), "e": F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    shift = F.when(F.col("l_discount") > 0.08, 0.5).when(F.col("l_discount") < 0.01, -0.5).otherwise(0.0)
    k = F.col("l_partkey") % 4
    kind = F.when(k == 0, "Coal").when(k == 1, "Sandstone").when(k == 2, "Shale").otherwise("Clay")
    return rows.select(F.col("l_orderkey").alias("b"), F.col("o").alias("stratum_order"), F.round(F.col("e") - F.col("l_quantity") + shift, 2).alias("depth_from_m"), F.round("e", 2).alias("depth_to_m"), F.col("l_quantity").alias("stated_thickness_m"), kind.alias("lithology_type"), F.when(k == 0, F.concat(F.lit("Seam "), (F.col("l_partkey") % 3).cast("string"))).alias("seam_name"))


@query("geo_03_interval_metrics", f"WITH {STRATA} SELECT b, CAST(o AS INTEGER) AS stratum_order, round(e - f, 3) AS thickness_m, round(abs(q - round(e - f, 3)), 3) > 0.01 AS has_thickness_discrepancy FROM depth WHERE f >= 0 AND e >= f")
def geo_03(t: Tables):
    return geology.metrics(_strata(t)).select("b", "stratum_order", "thickness_m", "has_thickness_discrepancy")


@query("geo_04_anomalies", f"""WITH {STRATA} SELECT b, CAST(o AS INTEGER) AS stratum_order, CASE WHEN e < f THEN 'INVERTED_DEPTH' WHEN f < p - 0.01 THEN 'OVERLAPPING_INTERVAL' WHEN f > p + 0.05 THEN 'DEPTH_GAP' END AS anomaly FROM (SELECT *, lag(e) OVER (PARTITION BY b ORDER BY o) AS p FROM depth)""")
def geo_04(t: Tables):
    return geology.anomalies(_strata(t), keys=["b"]).select("b", "stratum_order", "anomaly")


query("win_09_adjacency", f"WITH {STRATA} SELECT b, count(*) FILTER (f > p + 0.05 OR f < p - 0.01 OR e < f) AS n FROM (SELECT *, lag(e) OVER (PARTITION BY b ORDER BY o) AS p FROM depth) GROUP BY 1")(lambda t: geology.anomalies(_strata(t), keys=["b"]).groupBy("b").agg(F.count("anomaly").alias("n")))
query("jon_13_interval_overlap", f"WITH {STRATA} SELECT b, CAST(o AS INTEGER) AS stratum_order FROM (SELECT *, lag(e) OVER (PARTITION BY b ORDER BY o) AS p FROM depth) WHERE f < p - 0.01 AND e >= f")(lambda t: geology.anomalies(_strata(t), keys=["b"]).where("anomaly = 'OVERLAPPING_INTERVAL'").select("b", "stratum_order"))

SUMMARY = f"""WITH {STRATA}, m AS (SELECT b, k, e, round(e - f, 3) AS t, round(abs(q - round(e - f, 3)), 3) > 0.01 AS x FROM depth WHERE f >= 0 AND e >= f)
SELECT b, max(e) AS max_depth_m, round(coalesce(sum(t) FILTER (k = 0), 0), 3) AS coal_thickness_m, count(*) FILTER (x) AS n_discrepancies, count(*) AS n_strata FROM m GROUP BY 1"""


@query("agg_14_strata_summary", SUMMARY)
def agg_14(t: Tables):
    return geology.summary(geology.metrics(_strata(t)), keys=["b"]).select("b", "max_depth_m", "coal_thickness_m", "n_discrepancies", "n_strata")


query("geo_05_borehole_read", f"SELECT b, n_strata FROM ({SUMMARY}) WHERE coal_thickness_m > 0")(lambda t: agg_14(t).where("coal_thickness_m > 0").select("b", "n_strata"))
query("qa_05_borehole_coal", f"SELECT b, coal_thickness_m FROM ({SUMMARY}) WHERE b = 64")(lambda t: agg_14(t).where("b = 64").select("b", "coal_thickness_m"))


@query("geo_01_strata_lines", "SELECT p_partkey AS document_id, 'BH-' || p_partkey AS borehole_id, i AS stratum_order, CASE i WHEN 1 THEN 0.0 ELSE p_size END::DOUBLE AS depth_from_m, (p_size + CASE i WHEN 1 THEN 0 ELSE 3.5 END)::DOUBLE AS depth_to_m, CASE i WHEN 1 THEN 'Sandstone' ELSE 'Coal' END AS lithology_type, CASE i WHEN 2 THEN 'Seam III' END AS seam_name FROM part, (VALUES (1), (2)) v(i)")
def geo_01(t: Tables):
    text = F.format_string("Borehole No: BH-%d\n1. 0.00 - %d.00 m Coarse grained sandstone\nremarks of the day\n%d.00 to %.2f m Coal Seam III", F.col("p_partkey"), F.col("p_size"), F.col("p_size"), F.col("p_size") + F.lit(3.5))
    pages = t.part.select(F.col("p_partkey").alias("document_id"), F.lit(1).alias("page_number"), text.alias("text"))
    return geology.from_texts(pages).select("document_id", "borehole_id", "stratum_order", "depth_from_m", "depth_to_m", "lithology_type", "seam_name")


@query("geo_02_strata_tables", "SELECT s_suppkey AS document_id, 'BH-TABLE' AS borehole_id, 1 AS stratum_order, 12.0::DOUBLE AS depth_from_m, 18.5::DOUBLE AS depth_to_m, 6.5::DOUBLE AS thickness_m, 'Sandstone' AS lithology_type, NULL::VARCHAR AS seam_name FROM supplier UNION ALL SELECT s_suppkey, 'BH-TABLE', 2, 18.5, 23.5, 5.0, 'Coal', 'Seam III' FROM supplier")
def geo_02(t: Tables):
    row = lambda *c: F.array(*map(F.lit, c))
    tabs = t.supplier.select(F.col("s_suppkey").alias("table_id"), F.col("s_suppkey").alias("document_id"), F.lit(1).alias("page_number"), F.lit("Strata").alias("caption"), row("Strata No", "Depth From (m)", "Depth To (m)", "Thickness (m)", "Lithology", "Seam Name").alias("headers"), F.array(row("1", "12.0", "18.5", "6.5", "Sandstone", "-"), row("2", "18.5", "23.5", "5.0", "Coal", "Seam III")).alias("rows"))
    return geology.from_tables(tabs).select("document_id", "borehole_id", "stratum_order", "depth_from_m", "depth_to_m", "thickness_m", "lithology_type", "seam_name")


@query("geo_06_merged_strata", "SELECT p_partkey AS document_id, 2 AS n FROM part")
def geo_06(t: Tables):
    texts = geology.from_texts(t.part.select(F.col("p_partkey").alias("document_id"), F.lit(1).alias("page_number"), F.lit("BH-1\n1. 0.0 - 2.0 m Soil\n2. 2.0 - 4.0 m Coal").alias("text")))
    return geology.merged(texts.where("stratum_order = 1"), texts).groupBy("document_id").agg(F.count("*").cast("int").alias("n"))


@query("sca_12_borehole_id", "SELECT p_partkey, 'BH-' || p_size AS borehole FROM part")
def sca_12(t: Tables):
    return t.part.select("p_partkey", geology.borehole_id(F.format_string("Log of BH %d, depth 20", F.col("p_size"))).alias("borehole"))


@query("sca_13_lithology", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Shale' WHEN 1 THEN 'Coal' WHEN 2 THEN 'Top Soil' ELSE 'Basalt' END AS lithology, CASE p_partkey % 4 WHEN 1 THEN 'सीम II' END AS seam FROM part")
def sca_13(t: Tables):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, "Grey carbonaceous shale").when(k == 1, "कोयला (सीम II)").when(k == 2, "मिट्टी").otherwise("Basalt")
    return t.part.select("p_partkey", geology.lithology(raw).alias("lithology"), geology.seam(raw).alias("seam"))


# tables and visuals -----------------------------------------------------------------------------------------------
#: What follows the first table of a document, by supplier: page, caption, header, whether its rows repeat the header, and
#: what comes out (worked out by hand from the weights): score, status.
FOLLOWERS = {
    0: (2, "Table 1 (contd.)", ("Mine", "Output"), True, 1.0, "AUTO_MERGED"),  # .15 base + .35 repeated + .35 cue + .10 top + .10 aligned, at most 1
    1: (2, "", ("Mine", "Output"), False, 0.55, "REVIEW_REQUIRED"),  # .15 + .20 identical + .10 + .10
    2: (2, "", (), False, 0.60, "REVIEW_REQUIRED"),  # .15 + .25 headless + .10 + .10
    3: (2, "", ("Year", "Grade"), False, 0.0, "STANDALONE"),  # .15 - .40 contradiction + .10 + .10 < 0
    4: (3, "Table 1 (contd.)", ("Mine", "Output"), True, 0.0, "STANDALONE"),  # a page is missing: gate
    5: (2, "Table 1", (), False, 0.85, "AUTO_MERGED"),  # .15 + .25 + .25 same caption + .10 + .10
}


def _physical(t: Tables) -> DataFrame:
    """Three tables per supplier: the second is one of ``FOLLOWERS``, the third stands far away."""
    row = lambda *c: F.array(*map(F.lit, c)) if c else F.array().cast("array<string>")
    page = lambda p, cap, h, *rows: F.struct(F.lit(p).alias("page_number"), F.lit(0).alias("table_index"), F.lit(cap).alias("caption"), row(*h).alias("headers"), F.array(*(row(*r) for r in rows)).alias("rows"))
    second = None
    for k, (at, cap, head, repeated, _, _) in FOLLOWERS.items():
        one = page(at, cap, head, *[("Mine", "Output")] * repeated, ("c", "3"))
        second = F.when(F.col("s_suppkey") % 6 == k, one) if second is None else second.when(F.col("s_suppkey") % 6 == k, one)
    three = F.array(page(1, "Table 1", ("Mine", "Output"), ("a", "1"), ("b", "2")), second, page(9, "Table 2", ("Mine", "Output"), ("d", "4")))
    return t.supplier.select(F.col("s_suppkey").cast("string").alias("document_id"), F.explode(three).alias("x")).select("document_id", "x.*")


def _stitched(t: Tables) -> DataFrame:
    return tables.stitched(_physical(t))


CASES = ", ".join(f"({k}, {at}, {score}::DOUBLE, '{status}')" for k, (at, _, _, _, score, status) in FOLLOWERS.items())
PARTS = f"""SELECT CAST(s_suppkey AS VARCHAR) AS document_id, CASE i WHEN 1 THEN 1 WHEN 2 THEN pg ELSE 9 END AS page_number,
  CASE WHEN i = 2 AND status = 'AUTO_MERGED' THEN 2 ELSE 1 END AS part_number, CASE WHEN i < 3 AND status = 'AUTO_MERGED' THEN 2 ELSE 1 END AS total_parts,
  CASE WHEN i = 2 THEN status ELSE 'STANDALONE' END AS continuation_status, CASE WHEN i = 2 AND score > 0 THEN score ELSE 1.0 END AS continuation_confidence
FROM supplier JOIN (VALUES {CASES}) c(k, pg, score, status) ON s_suppkey % 6 = k, (VALUES (1), (2), (3)) v(i)"""


@query("tab_02_stitching", f"SELECT document_id, page_number, part_number, total_parts, continuation_status FROM ({PARTS})")
def tab_02(t: Tables):
    return _stitched(t).select("document_id", "page_number", "part_number", "total_parts", "continuation_status")


query("tab_01_continuation_score", f"SELECT document_id, page_number, continuation_confidence FROM ({PARTS})")(lambda t: _stitched(t).select("document_id", "page_number", "continuation_confidence"))
query("win_08_part_numbers", f"SELECT document_id, max(part_number) AS parts FROM ({PARTS}) GROUP BY 1")(lambda t: _stitched(t).groupBy("document_id").agg(F.max("part_number").alias("parts")))
LOGICAL = f"""SELECT document_id, CASE WHEN page_number = 1 THEN 'MERGED' ELSE 'STANDALONE' END AS status, CASE page_number WHEN 1 THEN 3 ELSE 1 END AS n_rows, CASE page_number WHEN 1 THEN 2 ELSE 1 END AS n_pages, s % 6 = 0 AND page_number = 1 AS has_repeated_headers
  FROM (SELECT *, CAST(document_id AS BIGINT) AS s FROM ({PARTS})) WHERE s % 6 IN (0, 5) AND page_number <> 2
UNION ALL SELECT document_id, CASE WHEN continuation_status = 'REVIEW_REQUIRED' THEN 'REVIEW_REQUIRED' ELSE 'STANDALONE' END, CASE WHEN page_number = 1 THEN 2 WHEN page_number = 3 THEN 2 ELSE 1 END, 1, false FROM ({PARTS}) WHERE CAST(document_id AS BIGINT) % 6 NOT IN (0, 5)"""


@query("tab_03_logical_view", f"SELECT document_id, n_rows, n_pages, status FROM ({LOGICAL})")
def tab_03(t: Tables):
    return tables.logical(_stitched(t)).select("document_id", F.size("rows").alias("n_rows"), F.size("pages").alias("n_pages"), "status")


query("agg_18_logical_rollup", f"SELECT document_id, CAST(sum(n_rows) AS INTEGER) AS n_rows, bool_or(has_repeated_headers) AS has_repeated_headers FROM ({LOGICAL}) GROUP BY 1")(lambda t: tables.logical(_stitched(t)).groupBy("document_id").agg(F.sum(F.size("rows")).cast("int").alias("n_rows"), F.bool_or("has_repeated_headers").alias("has_repeated_headers")))


def _visuals(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 9
    cap = F.when(k == 0, "Figure 2.1: Geological map of the block. Scale 1:4000").when(k == 1, "Plate IV - Borehole log of BH-7, bore hole section").when(k == 2, "A picture").when(k == 3, "Table image of the table").when(k == 4, "Bar chart and histogram chart").when(k == 5, "Section A-BCD of the report").when(k == 6, F.format_string("Cross-section %d, section A-B'", "p_size")).when(k == 7, "Photograph of a blueprint").otherwise("Stratigraphic columnar section, plate")
    return t.part.select(F.col("p_partkey").alias("id"), cap.alias("caption"))


@query("vis_01_classes", "SELECT p_partkey AS id, kind AS visual_type, confidence, CASE WHEN confidence >= 0.7 THEN 'ACCEPTED' ELSE 'REVIEW_REQUIRED' END AS review_status FROM part JOIN (VALUES (0, 'MAP', 0.81::DOUBLE), (1, 'BOREHOLE_LOG', 0.81), (2, 'UNKNOWN', 0.0), (3, 'TABLE_IMAGE', 0.63), (4, 'CHART', 1.0), (5, 'UNKNOWN', 0.0), (6, 'CROSS_SECTION', 0.87), (7, 'PHOTOGRAPH', 0.45), (8, 'STRATIGRAPHIC_DIAGRAM', 0.84)) v(k, kind, confidence) ON p_partkey % 9 = k")
def vis_01(t: Tables):
    return visuals.classified(_visuals(t), F.col("caption")).select("id", "visual_type", "confidence", "review_status")


query("vis_02_taxonomy", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'MAP' ELSE 'UNKNOWN' END AS kind FROM part")(lambda t: t.part.select(F.col("p_partkey").alias("id"), visuals.taxonomy(F.when(F.col("p_partkey") % 2 == 0, " map ").otherwise("doodle")).alias("kind")))


@query("sca_14_figures", "SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'Figure 2.1' WHEN 1 THEN 'Plate IV' END AS number, CASE p_partkey % 9 WHEN 0 THEN 'Geological map of the block.' WHEN 1 THEN 'Borehole log of BH-7, bore hole section' END AS caption FROM part")
def sca_14(t: Tables):
    return _visuals(t).select("id", visuals.figure(F.col("caption")).alias("f")).select("id", "f.number", "f.caption")


@query("src_09_visual_regions")
def src_09(t: Tables):
    x, y = F.col("l_quantity") * 10, F.col("l_linenumber") * 40.0
    rects = t.lineitem.select(F.col("l_orderkey").alias("page"), x.alias("x0"), y.alias("y0"), (x + 12).alias("x1"), (y + 12).alias("y1"))
    return visuals.clusters(rects, page="page")


# grounding --------------------------------------------------------------------------------------------------------
def _answers(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    answer = F.when(k == 0, F.format_string("Output of the pit was %d MT [1]. Output stayed at %d MT [2].", F.col("p_size"), F.col("p_size"))).when(k == 1, F.format_string("Output of the pit was %d MT. Output rose to 99999 MT.", F.col("p_size"))).when(k == 2, "Insufficient verified evidence found in the selected knowledge base.").otherwise("Nothing like that ever happened anywhere around.")
    return t.part.select(F.col("p_partkey").alias("id"), answer.alias("answer"), F.format_string("output of the pit stayed: %d MT", F.col("p_size")).alias("evidence"))


@query("qa_11_grounding", """
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 1 END AS total_claims, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS supported_claims,
  CASE p_partkey % 4 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'PARTIALLY_SUPPORTED' WHEN 2 THEN 'REFUSED' ELSE 'UNSUPPORTED' END AS status, CASE p_partkey % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.35 WHEN 2 THEN 0.0 ELSE 0.1 END::DOUBLE AS confidence FROM part""")
def qa_11(t: Tables):
    out = grounding.report(_answers(t), key="id", answer="answer", evidence="evidence")
    return out.select("id", F.col("total_claims").cast("int").alias("total_claims"), F.col("supported_claims").cast("int").alias("supported_claims"), "status", "confidence")


@query("qa_12_refusal", "SELECT user_id, count(*) FILTER (event_type = 'view') = 0 OR (count(*) FILTER (event_type = 'purchase') = 0 AND max(value) / 10000 < 0.015) AS refused FROM events GROUP BY 1")
def qa_12(t: Tables):
    g = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("e"), F.count_if(F.col("event_type") == "purchase").alias("f"), (F.max("value") / 10000).alias("top"))
    return g.select("user_id", grounding.refused(F.col("e"), F.lit(True), F.lit(False), F.col("f"), F.col("top")).alias("refused"))


@query("qa_14_synthesis", "SELECT s_suppkey, 'Coal Production of the project in FY2023-24 was ' || printf('%,.1f', s_acctbal) || ' MT [1].' AS answer FROM supplier")
def qa_14(t: Tables):
    rows = t.supplier.select("s_suppkey", F.lit("coal_production").alias("field_name"), F.lit(None).cast("string").alias("entity_name"), F.lit("FY2023-24").alias("reporting_period"), F.col("s_acctbal").alias("numeric_value"), F.lit("MT").alias("unit"), F.lit(1).alias("seq"))
    return grounding.synthesis(rows, key="s_suppkey", order="seq")


@query("qa_15_history", "SELECT q.conv_id, q.turn, a.turn AS answer_turn FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant' ORDER BY 1 DESC, 2 DESC LIMIT 50")
def qa_15(t: Tables):
    q = t.conversations.where("role = 'user'").select("conv_id", "turn")
    a = t.conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("answer_turn"))
    return q.join(a, ["conv_id", "turn"]).orderBy(F.desc("conv_id"), F.desc("turn")).limit(50)


# reports ----------------------------------------------------------------------------------------------------------
@query("rpt_01_reserve_lineage", """
WITH a AS (SELECT p_partkey, round(p_retailprice + p_size + 10, 3) AS gross, p_size FROM part), b AS (SELECT *, round(gross * 0.1, 3) AS deduction FROM a), c AS (SELECT *, round(greatest(0, gross - deduction), 3) AS net FROM b),
d AS (SELECT *, round(greatest(0, net - p_size), 3) AS minable FROM c), e AS (SELECT *, round(minable * 0.12345::DOUBLE, 3) AS mining_loss FROM d), f AS (SELECT *, round(greatest(0, minable - mining_loss), 3) AS extractable FROM e)
SELECT p_partkey, gross, net, minable, extractable, round(greatest(0, extractable - 50), 3) AS balance FROM f""")
def rpt_01(t: Tables):
    rows = reports.reserve_lineage(t.part, proved=F.col("p_retailprice"), indicated=F.col("p_size"), inferred=F.lit(10.0), deduction_pct=F.lit(10.0), blocked=F.col("p_size"), loss_pct=F.lit(12.345), depleted=F.lit(50.0))
    return rows.select("p_partkey", "gross", "net", "minable", "extractable", "balance")


query("rpt_02_stripping_ratio", "SELECT p_partkey, CASE WHEN p_size > 0 THEN round(p_retailprice * 1.00037::DOUBLE / p_size, 2) ELSE 0.0 END AS ratio FROM part")(lambda t: t.part.select("p_partkey", reports.stripping_ratio(F.col("p_retailprice") * 1.00037, F.col("p_size")).alias("ratio")))
query("rpt_03_life_of_mine", "SELECT p_partkey, CASE WHEN p_size > 0 THEN round(p_retailprice * 1.00037::DOUBLE / p_size, 1) ELSE 0.0 END AS years FROM part")(lambda t: t.part.select("p_partkey", reports.life_of_mine(F.col("p_retailprice") * 1.00037, F.col("p_size")).alias("years")))


@query("rpt_04_closure_escrow", """
WITH a AS (SELECT p_partkey, p_size, round(CASE WHEN p_partkey % 2 = 0 THEN 14.0 ELSE 2.0 END::DOUBLE * 1.018::DOUBLE, 4) AS escalated_rate FROM part), b AS (SELECT *, round(p_size * escalated_rate, 2) AS closure_cost FROM a), c AS (SELECT *, round(closure_cost / 25, 2) AS annual_deposit FROM b)
SELECT p_partkey, escalated_rate, closure_cost, annual_deposit FROM c""")
def rpt_04(t: Tables):
    rows = reports.closure_escrow(t.part, area=F.col("p_size").cast("double"), opencast=F.col("p_partkey") % 2 == 0, life=F.lit(25))
    return rows.select("p_partkey", "escalated_rate", "closure_cost", "annual_deposit")


@query("rpt_05_community_escrow", """
WITH a AS (SELECT o_orderkey, o_custkey, round(200000.0::DOUBLE * 0.25, 2) AS earmarked, round(o_totalprice, 2) AS claimed FROM orders), b AS (SELECT *, round(earmarked / 3, 2) AS cap FROM a)
SELECT o_custkey, o_orderkey, cap, claimed, CASE WHEN claimed > cap + 0.01 THEN 'EXCEEDS_STATUTORY_CAP' ELSE 'COMPLIANT' END AS status FROM b""")
def rpt_05(t: Tables):
    rows = reports.community_escrow(t.orders.withColumn("deposit", F.lit(200000.0)), key="o_custkey", deposit="deposit", activity="o_orderkey", amount="o_totalprice")
    return rows.select("o_custkey", "o_orderkey", "cap", "claimed", "status")


query("rpt_06_transformation_corpus", "SELECT p_partkey, round(p_retailprice * 0.1::DOUBLE, 2) AS corpus, round(p_retailprice * 0.9::DOUBLE, 2) AS reimbursable FROM part")(lambda t: t.part.select("p_partkey", reports.transformation_corpus(F.col("p_retailprice")).alias("c")).select("p_partkey", "c.corpus", "c.reimbursable"))

MAPPED = "SELECT s_suppkey AS report, 'fld_1_1_1' AS internal_id, 'block_name' AS source_field, s_name AS value FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'fld_1_1_1', NULL, 'Not available in the verified knowledge base.' FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, 'fld_2_1_4', 'area_ha', s_nationkey || '' FROM supplier"


MAPPED_ALL = f"{MAPPED} UNION ALL SELECT s_suppkey, i, NULL, 'Not available in the verified knowledge base.' FROM supplier, (VALUES {', '.join(f"('{k}')" for k in reports.SYNONYMS if k not in ('fld_1_1_1', 'fld_2_1_4'))}) v(i)"


def _mapped(t: Tables) -> DataFrame:
    a = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("report"), F.explode(F.array(F.struct(F.lit("project_name").alias("name"), F.lit("later").alias("v")), F.struct(F.lit("block_name").alias("name"), F.col("s_name").alias("v")))).alias("x")).select("report", "x.*")
    b = t.supplier.select(F.col("s_suppkey").alias("report"), F.lit("AREA_HA").alias("name"), F.col("s_nationkey").cast("string").alias("v"))
    return reports.mapped_fields(a.unionByName(b), report="report", name="name", value="v")


@query("rpt_07_field_mapping", MAPPED_ALL)
def rpt_07(t: Tables):
    return _mapped(t)


@query("rpt_08_compliance", "SELECT s_suppkey AS report, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END AS critical, 19 AS warning, CASE WHEN s_suppkey % 2 = 0 THEN 'WARNINGS' ELSE 'NON_COMPLIANT' END AS status FROM supplier")
def rpt_08(t: Tables):
    issues = reports.missing_data(_mapped(t), report="report")
    out = reports.readiness(issues, t.supplier.select(F.col("s_suppkey").alias("report")), report="report")
    return out.select("report", F.col("critical").cast("int").alias("critical"), F.col("warning").cast("int").alias("warning"), "status")


query("agg_19_severity_counts", "SELECT 'CRITICAL' AS severity, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 1) AS n UNION ALL SELECT 'WARNING', 19 * (SELECT count(*) FROM supplier)")(lambda t: reports.missing_data(_mapped(t), report="report").groupBy("severity").agg(F.count("*").alias("n")))


@query("rpt_08_monotone_reserves", "SELECT p_partkey AS report, 'minable' AS internal_id FROM part WHERE p_size <> 0 AND p_retailprice > p_size * 40")
def rpt_08_monotone(t: Tables):
    rows = t.part.select(F.col("p_partkey").alias("report"), (F.col("p_size") * 40.0).alias("net"), F.col("p_retailprice").alias("minable"))
    return reports.monotone(rows, report="report", steps=["net", "minable"]).select("report", "internal_id")


query("sca_18_chapter", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'ch_general' ELSE 'ch_' || p_size END AS chapter FROM part")(lambda t: t.part.select("p_partkey", reports.chapter(F.when(F.col("p_partkey") % 3 != 0, F.format_string("sec_%d_1", F.col("p_size")))).alias("chapter")))


@query("agg_20_schema_audit", "SELECT 'kind:' || r_name AS finding, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT 'duplicates', 0 UNION ALL SELECT 'orphans', (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0)")
def agg_20(t: Tables):
    nodes = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("node"), F.when(F.col("n_nationkey") % 5 == 0, 999).otherwise(0).alias("parent"), F.col("r_name").alias("kind"))
    return reports.schema_audit(nodes, node="node", parent="parent", kind="kind")


query("agg_21_inventory", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")(lambda t: t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")))


@query("rpt_10_snapshot", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def rpt_10(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    frozen = reports.snapshot(rows, key="o_custkey", order="o_orderkey")
    return frozen.select("o_custkey", F.json_array_length("snapshot").cast("long").alias("n"))


# governance -------------------------------------------------------------------------------------------------------
EDITS = "edits AS (SELECT event_id AS edit_id, user_id AS maker, user_id % 4 AS org FROM events WHERE event_type = 'purchase'), decisions AS (SELECT event_id AS decision_id, event_id - event_id % 7 AS edit_id, user_id AS checker, user_id % 4 AS corg, CASE WHEN event_type = 'error' THEN 'REJECT' ELSE 'APPROVE' END AS decision, ts FROM events WHERE event_type IN ('view', 'error'))"


@query("gov_03_maker_checker", f"""WITH {EDITS}, valid AS (SELECT e.edit_id, decision FROM edits e JOIN decisions d ON e.edit_id = d.edit_id AND checker <> maker AND corg = org QUALIFY row_number() OVER (PARTITION BY e.edit_id ORDER BY ts, decision_id) = 1)
SELECT e.edit_id, CASE decision WHEN 'APPROVE' THEN 'VERIFIED' WHEN 'REJECT' THEN 'REJECTED' ELSE 'PENDING_VERIFICATION' END AS status FROM edits e LEFT JOIN valid v ON e.edit_id = v.edit_id""")
def gov_03(t: Tables):
    org = F.col("user_id") % 4
    edits = t.events.where("event_type = 'purchase'").select(F.col("event_id").alias("edit_id"), F.col("user_id").alias("maker"), org.alias("organization"))
    decisions = t.events.where("event_type IN ('view', 'error')").select(F.col("event_id").alias("decision_id"), (F.col("event_id") - F.col("event_id") % 7).alias("edit_id"), F.col("user_id").alias("checker"), org.alias("checker_organization"), F.when(F.col("event_type") == "error", "REJECT").otherwise("APPROVE").alias("decision"), F.col("ts").alias("at"))
    return gv.resolved_edits(edits, decisions).select("edit_id", "status")


query("snk_04_first_writer", f"WITH {EDITS} SELECT edit_id, arg_min(decision_id, (ts, decision_id)) AS winner FROM decisions GROUP BY 1")(lambda t: t.events.where("event_type IN ('view', 'error')").groupBy((F.col("event_id") - F.col("event_id") % 7).alias("edit_id")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("winner")))


@query("gov_01_task_actions", "SELECT doc_id AS task_id, CASE doc_id % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'REJECTED' ELSE 'PENDING' END AS task_status, CASE doc_id % 3 WHEN 0 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS conflict_status FROM documents")
def gov_01(t: Tables):
    tasks = t.documents.select(F.col("doc_id").alias("task_id"))
    acts = tasks.where("task_id % 3 <> 2").select("task_id", F.explode(F.array(F.struct(F.lit(1).alias("at"), F.lit("DEFER").alias("action")), F.struct(F.lit(2).alias("at"), F.when(F.col("task_id") % 3 == 0, "APPROVE").otherwise("REJECT").alias("action")))).alias("a")).select("task_id", "a.*", F.col("a.at").alias("action_id"))
    return gv.task_states(tasks, acts).select("task_id", "task_status", "conflict_status")


@query("gov_02_review_tasks", "SELECT 'PAGE' AS object_type, count(*) AS n FROM documents WHERE n_chars % 100 < 60 UNION ALL SELECT 'FIELD', count(*) FROM lineitem WHERE l_discount < 0.06 OR l_returnflag = 'R'")
def gov_02(t: Tables):
    pages = t.documents.select(F.col("doc_id").alias("id"), (F.col("n_chars") % 100 / 100).alias("confidence"))
    facts = t.lineitem.select(F.col("l_orderkey").alias("id"), (F.col("l_discount") * 10).alias("confidence_score"), F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("PASS").alias("validation_status"))
    return gv.review_tasks(pages=pages, facts=facts).groupBy("object_type").agg(F.count("*").alias("n"))


REGISTER = "SELECT 'field' AS modality, count(*) AS n FROM labels UNION ALL SELECT 'table', count(*) FROM benchmark UNION ALL SELECT 'visual', count(*) FROM pages"


def _register(t: Tables) -> DataFrame:
    return gv.register(field=t.labels.select("doc_id", "quality"), visual=t.pages.select(F.col("page_id").alias("doc_id"), "url"), table=t.benchmark.select(F.col("item_id").alias("doc_id"), "text"))


query("set_01_cross_modal_union", REGISTER)(lambda t: _register(t).groupBy("modality").agg(F.count("*").alias("n")))
query("gov_04_evidence_register", "SELECT 'visual' AS modality, page_id AS doc_id FROM pages")(lambda t: _register(t).where("modality = 'visual'").select("modality", "doc_id"))


@query("gov_05_audit_list", "SELECT event_id FROM events WHERE user_id % 9 IN (1, 4) ORDER BY ts DESC, event_id LIMIT 100")
def gov_05(t: Tables):
    from loomstone.operators.scope import scoped_or_global

    rows = t.events.withColumn("org", F.when(F.col("user_id") % 9 != 1, (F.col("user_id") % 9).cast("string")))
    return scoped_or_global(rows, "org", ["4"]).orderBy(F.desc("ts"), "event_id").limit(100).select("event_id")


CHECKED = "SELECT coalesce(a.id, b.id) AS path, CASE WHEN a.id IS NULL THEN 'MISSING' WHEN b.id IS NULL THEN 'UNEXPECTED' WHEN a.h <> b.h THEN 'CORRUPT' ELSE 'OK' END AS status FROM (SELECT doc_id AS id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3) a FULL JOIN (SELECT doc_id AS id, CASE WHEN doc_id % 50 = 1 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 7) b ON a.id = b.id"


def _checked(t: Tables) -> DataFrame:
    files = t.documents.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    want = t.documents.where("doc_id % 10 <> 7").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 50 == 1, "x").otherwise(F.sha2("text", 256)).alias("sha256"))
    return gv.manifest_check(files, want)


query("gov_06_manifest_check", CHECKED)(_checked)
query("gov_06_backup_state", f"SELECT 'CORRUPT' AS status, count(*) AS n_files FROM ({CHECKED})")(lambda t: gv.overall(_checked(t)))


# streams, sources and sinks ---------------------------------------------------------------------------------------
@query("str_01_stale_jobs", "SELECT event_id AS id, 'FAILED' AS status FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 MINUTE")
def str_01(t: Tables):
    rows = t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "PROCESSING").otherwise("COMPLETED").alias("status"), F.col("ts").alias("started_at"), F.col("ts").alias("created_at"))
    return gv.stale_jobs(rows, F.lit("2024-01-15").cast("timestamp")).select("id", "status")


#: Requests of a client in order, each with the allowed ones of the last ten hours before it.
LIMITED = """
WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r(user_id, i, event_id, allowed, kept) AS (
  SELECT user_id, i, event_id, true, [ts] FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, o.event_id, len(list_filter(kept, lambda k: o.ts - k < INTERVAL 10 HOUR)) < 3,
    CASE WHEN len(list_filter(kept, lambda k: o.ts - k < INTERVAL 10 HOUR)) < 3 THEN list_append(list_filter(kept, lambda k: o.ts - k < INTERVAL 10 HOUR), o.ts) ELSE list_filter(kept, lambda k: o.ts - k < INTERVAL 10 HOUR) END
  FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT event_id, allowed FROM r"""


@query("str_02_rate_limit", LIMITED)
def str_02(t: Tables):
    return gv.rate_limited(t.events.select("event_id", "user_id", "ts"), client="user_id", at="ts", limit=3, window=36_000.0).select("event_id", "allowed")


@query("str_03_job_states", "SELECT user_id AS job, count(*) FILTER (event_type = 'error') AS retries, CASE WHEN arg_max(event_type, event_id) = 'error' AND count(*) FILTER (event_type = 'error') > 3 THEN 'FAILED' WHEN arg_max(event_type, event_id) = 'error' THEN 'RETRYING' ELSE 'COMPLETED' END AS status FROM events GROUP BY 1")
def str_03(t: Tables):
    rows = t.events.select(F.col("user_id").alias("job"), F.when(F.col("event_type") == "error", "RETRYING").otherwise("COMPLETED").alias("state"), "event_id")
    return gv.job_states(rows, key="job", at=F.col("event_id")).select("job", "retries", "status")


query("str_06_progress", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1")(lambda t: t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state")))


def _streamed(t: Tables, shape) -> DataFrame:
    """Run a stream over the events to its end and read what it wrote."""
    at = f"{shared_folder(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{at}/in")
    out = shape(jobs.events(t.spark, f"{at}/in", rows, files_per_batch=100))
    q = jobs.run(out, f"{at}/out", f"{at}/state")
    q.awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{at}/out")


@query("str_04_duplicate_delivery", "SELECT event_id FROM events")
def str_04(t: Tables):
    twice = lambda s: jobs.deduplicated(s.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery")), "event_id").select("event_id")
    return _streamed(t, twice)


@query("str_ext_tumbling")
def str_ext(t: Tables):
    return _streamed(t, lambda s: jobs.tumbling(s, "event_type", width="1 day"))


@query("str_05_incremental_pull", "SELECT CAST(event_id AS VARCHAR) AS record_id FROM events WHERE event_id % 30 > 20")
def str_05(t: Tables):
    """Only what an export says changed after a day."""
    at = f"{shared_folder(t.spark).rstrip('/')}/exports-{uuid.uuid4().hex[:12]}"
    t.events.select(F.col("event_id").alias("record_id"), (F.col("event_id") % 30).alias("changed_day")).write.json(at)
    t.spark.dataSource.register(readers.ExternalRecords)
    return t.spark.read.format("external_records").option("system", "sap").option("exports", at).option("since", "20").load().select("record_id")


@query("src_11_external_records", "SELECT 'coalnet' AS system, CAST(event_id AS VARCHAR) AS record_id, 'dispatch' AS record_type, CAST(event_id % 30 AS INTEGER) AS changed_day, event_type AS quantity_type, user_id FROM events WHERE event_id % 30 > 9")
def src_11(t: Tables):
    """Events exported as the system would, read back from a given day on."""
    at = f"{shared_folder(t.spark).rstrip('/')}/exports-{uuid.uuid4().hex[:12]}"
    t.events.select(F.col("event_id").alias("record_id"), (F.col("event_id") % 30).alias("changed_day"), F.col("event_type").alias("quantity_type"), "user_id").write.json(at)
    t.spark.dataSource.register(readers.ExternalRecords)
    rows = t.spark.read.format("external_records").option("system", "coalnet").option("exports", at).option("since", "9").load()
    return rows.select("system", "record_id", "record_type", "changed_day", F.col("data")["quantity_type"].alias("quantity_type"), F.col("data")["user_id"].cast("long").alias("user_id"))


@query("src_01_parser_dispatch", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'text' WHEN 2 THEN 'pdf' END AS parser FROM part")
def src_01(t: Tables):
    k = F.col("p_partkey") % 4
    return t.part.select("p_partkey", readers.parser(F.when(k == 0, "a/b.CSV").when(k == 1, "note.txt").when(k == 2, "x.pdf").otherwise("y.bin")).alias("parser"))


def _csv_files(t: Tables) -> DataFrame:
    body = F.concat(F.lit("Mine;Output\n"), F.col("s_name"), F.lit(";1,5\n\n"), F.col("s_name"), F.lit(";2\n"))
    return t.supplier.select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string"), F.lit(".csv")).alias("path"), F.encode(body, "UTF-8").alias("content")).withColumn("length", F.length("content").cast("long"))


@query("src_02_csv", "SELECT 'f' || s_suppkey || '.csv' AS path, 1 AS part, 2 AS n_rows, 'Mine' AS first_header, s_name AS first_cell FROM supplier")
def src_02(t: Tables):
    return readers.csv_tables(_csv_files(t)).select("path", "part", F.size("rows").alias("n_rows"), F.col("headers")[0].alias("first_header"), F.col("rows")[0][0].alias("first_cell"))


query("src_12_admission", "SELECT 'f' || s_suppkey || '.csv' AS path, NULL::VARCHAR AS reason FROM supplier UNION ALL SELECT s_suppkey || '.pdf', 'content does not match extension' FROM supplier")(lambda t: readers.admitted(_csv_files(t).unionByName(_csv_files(t).withColumn("path", F.regexp_replace("path", r"^f(\d+)\.csv$", "$1.pdf")))).select("path", "reason"))
query("sca_33_magic_bytes", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'content does not match extension' END AS reason FROM supplier")(lambda t: readers.admitted(t.supplier.select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".png")).alias("path"), F.when(F.col("s_suppkey") % 2 == 0, F.unhex(F.lit("89504E470D0A1A0A00"))).otherwise(F.unhex(F.lit("FFD8FF00"))).alias("content"), F.lit(9).cast("long").alias("length"))).select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("s_suppkey"), "reason"))
query("src_10_table_scan", "SELECT r_regionkey, r_name FROM region")(lambda t: t.region)
query("snk_07_manifest", "SELECT 'f' || s_suppkey || '.csv' AS path, sha256('Mine;Output' || chr(10) || s_name || ';1,5' || chr(10) || chr(10) || s_name || ';2' || chr(10)) AS sha256 FROM supplier")(lambda t: sinks.manifest(_csv_files(t)).select("path", "sha256"))
