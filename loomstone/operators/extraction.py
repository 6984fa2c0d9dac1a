"""Rule-based extraction of facts from texts and tables. Rules are data: a list for texts, a small table for headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import numbers as nx

_T = r"(MT|Million\s+Tonnes?|Tonnes?|tonnes?)"
_N = r"\s*[:\-]?\s*([0-9.,]+)\s*"
#: Field, category, type, pattern (value in group 1), unit group or None, default unit, confidence.
TEXT_RULES = (
    ("mine_name", "IDENTIFICATION", "STRING", r"(?:Mine(?:\s+Name)?|Colliery|OCP|Mine\s+Block)\s*[:\-]?\s*([A-Za-z0-9\s\-]+?)(?=\n|,|\.|;|\(|\)|$)", None, None, 0.90),
    ("project_name", "IDENTIFICATION", "STRING", r"(?:Project(?:\s+Name)?|Block(?:\s+Name)?)\s*[:\-]?\s*([A-Za-z0-9\s\-]+?Project|[A-Za-z0-9\s\-]+?Block|[A-Za-z0-9\s\-]+?Expansion)(?=\n|,|\.|;|\(|\)|$)", None, None, 0.88),
    ("fiscal_year", "IDENTIFICATION", "STRING", r"(?:FY|Financial\s+Year)\s*[:\-]?\s*([0-9]{4}[-/][0-9]{2,4})", None, None, 0.95),
    ("reporting_period", "IDENTIFICATION", "STRING", r"(?:Reporting\s+Period|For\s+the\s+period(?:\s+ending)?|Period)\s*[:\-]?\s*([A-Za-z0-9\s\-/.]+?)(?=\n|\.|;|\(|$)", None, None, 0.85),
    ("formation", "GEOLOGY", "STRING", r"\b(Barakar|Raniganj|Karharbari|Talchir|Damuda)(?:\s+Formation)?\b", None, None, 0.92),
    ("seam", "GEOLOGY", "STRING", r"(?:Coal\s+Seam|Seam(?:\s+Name)?)\s*[:\-]?\s*([A-Za-z0-9\-\s]+?)(?=\n|,|\.|;|\(|$)", None, None, 0.90),
    ("borehole_id", "GEOLOGY", "STRING", r"(?:Borehole(?:\s+No\.?|\s+ID)?)\s*[:\-]?\s*([A-Z0-9\-/]+)", None, None, 0.95),
    ("drilling_metreage", "GEOLOGY", "NUMBER", r"(?:Drilling\s+Metreage|Drilling\s+Meterage|Drilling\s+Depth|Borehole\s+Depth|Total\s+Metreage)" + _N + r"(m|metres|meters)", 2, None, 0.92),
    ("reserves_proved", "GEOLOGY", "NUMBER", r"(?:Proved\s+(?:Coal\s+)?Reserves?|Proved\s+Resource)" + _N + _T, 2, None, 0.92),
    ("reserves_indicated", "GEOLOGY", "NUMBER", r"(?:Indicated\s+(?:Coal\s+)?Reserves?|Indicated\s+Resource)" + _N + _T, 2, None, 0.92),
    ("reserves_inferred", "GEOLOGY", "NUMBER", r"(?:Inferred\s+(?:Coal\s+)?Reserves?|Inferred\s+Resource)" + _N + _T, 2, None, 0.92),
    ("reserves_total", "GEOLOGY", "NUMBER", r"(?:Total\s+(?:Geological\s+)?Reserves?|Total\s+Coal\s+Resource)" + _N + _T, 2, None, 0.90),
    ("coal_grade", "GEOLOGY", "STRING", r"(?:Coal\s+Grade|Grade)\s*[:\-]?\s*([A-G][0-9]{1,2}|W-[I-IV]+|Steel-[I-II]+|Non-coking\s+Grade\s+[A-G][0-9]{1,2})", None, None, 0.92),
    ("gcv", "GEOLOGY", "NUMBER", r"(?:GCV|Gross\s+Calorific\s+Value)" + _N + r"(kcal/kg)", 2, None, 0.92),
    ("ash_content", "GEOLOGY", "NUMBER", r"(?:Ash\s+Content|Ash\s*%|Ash)" + _N + r"(%|percent)", 2, None, 0.92),
    ("production_quantity", "MINING", "NUMBER", r"(?:Coal\s+Production|Actual\s+Production|Production\s+Achieved|Production)" + _N + r"(MT|Million\s+Tonnes?|Tonnes?|tonnes?|LT|Lakh\s+Tonnes?)", 2, None, 0.92),
    ("target_quantity", "MINING", "NUMBER", r"(?:Production\s+Target|Target\s+Production|Annual\s+Target|Target)" + _N + _T, 2, None, 0.90),
    ("dispatch_quantity", "MINING", "NUMBER", r"(?:Coal\s+Dispatch|Dispatch|Offtake)" + _N + _T, 2, None, 0.90),
    ("stripping_ratio", "MINING", "NUMBER", r"(?:Stripping\s+Ratio(?:\s*\(OB:Coal\))?|Composite\s+Stripping\s+Ratio)" + _N + r"(cum/tonne|cum/t|m3/tonne|m3/t|:1)?", 2, "m3/tonne", 0.90),
    ("overburden_removal", "MINING", "NUMBER", r"(?:Overburden\s+Removal|OB\s+Removal|Overburden)" + _N + r"(Mm3|Million\s+m3|m3|lakh\s+m3|cum)", 2, None, 0.90),
)
#: Field, category, type, unit, keywords; the first rule whose keyword a header holds applies.
HEADER_RULES = (
    ("washed_coal_production", "MINING", "NUMBER", "MT", ("washed coal", "clean coal", "beneficiated coal", "धुला हुआ कोयला")),
    ("production_quantity", "MINING", "NUMBER", "MT", ("production", "actual prod", "coal prod", "raw coal", "उत्पादन", "कच्चा कोयला")),
    ("target_quantity", "MINING", "NUMBER", "MT", ("target", "prod target", "planned prod")),
    ("dispatch_quantity", "MINING", "NUMBER", "MT", ("dispatch", "offtake")),
    ("stripping_ratio", "MINING", "NUMBER", "m3/tonne", ("stripping ratio", "sr (ob:coal)", "s.r.")),
    ("overburden_removal", "MINING", "NUMBER", "Mm3", ("overburden", "ob removal", "ob (mm3)")),
    ("reserves_proved", "GEOLOGY", "NUMBER", "MT", ("proved reserve", "proved (mt)", "proved coal")),
    ("reserves_indicated", "GEOLOGY", "NUMBER", "MT", ("indicated reserve", "indicated (mt)")),
    ("reserves_inferred", "GEOLOGY", "NUMBER", "MT", ("inferred reserve", "inferred (mt)")),
    ("reserves_total", "GEOLOGY", "NUMBER", "MT", ("total reserve", "total (mt)", "gross reserve")),
    ("drilling_metreage", "GEOLOGY", "NUMBER", "m", ("drilling depth", "metreage", "meterage", "depth (m)")),
    ("coal_grade", "GEOLOGY", "STRING", None, ("grade", "coal grade")),
    ("gcv", "GEOLOGY", "NUMBER", "kcal/kg", ("gcv", "gross calorific value")),
    ("ash_content", "GEOLOGY", "NUMBER", "%", ("ash %", "ash content", "ash percent", "ash", "राख")),
    ("moisture_content", "GEOLOGY", "NUMBER", "%", ("moisture", "moisture %", "नमी")),
    ("seam", "GEOLOGY", "STRING", None, ("seam", "seam name", "सीम")),
    ("borehole_id", "GEOLOGY", "STRING", None, ("borehole", "bh no", "bh id", "borehole no")),
)
ENTITY_WORDS = ("mine", "project", "seam", "borehole", "block", "unit", "खदान")
EMPTY_CELLS = ("", "nil", "na", "n/a", "-", "--", "none")


def from_texts(chunks: DataFrame, *, key: str = "id", text: str = "content", rules=TEXT_RULES) -> DataFrame:
    """Candidates of every rule: (key, field_name, field_category, data_type, raw_value, numeric_value, unit, confidence_score).

    All rules run in one pass: each gives an array of matches, the arrays are concatenated and exploded.
    """

    def found(field, category, kind, pattern, unit_group, default, confidence):
        p = F.lit("(?i)" + pattern)
        values = F.regexp_extract_all(F.col(text), p, F.lit(1))
        units = F.regexp_extract_all(F.col(text), p, F.lit(unit_group)) if unit_group else F.transform(values, lambda _: F.lit(""))
        row = lambda v, u: F.struct(F.lit(field).alias("field_name"), F.lit(category).alias("field_category"), F.lit(kind).alias("data_type"), F.trim(v).alias("raw_value"), F.coalesce(F.nullif(F.trim(u), F.lit("")), F.lit(default).cast("string")).alias("unit"), F.lit(confidence).alias("confidence_score"))
        return F.zip_with(values, units, row)

    rows = chunks.select(key, F.explode(F.concat(*[found(*r) for r in rules])).alias("c")).select(key, "c.*")
    return rows.withColumns({"numeric_value": F.when(F.col("data_type") == "NUMBER", nx.parse(F.col("raw_value"))), "confidence_level": nx.confidence_level(F.col("confidence_score"))})


def header_rule(header: Column) -> Column:
    """struct<field_name, field_category, data_type, rule_unit> of the first rule with a keyword in the header, else null."""
    low = F.lower(F.trim(header))
    rule = lambda *v: F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("field_name", "field_category", "data_type", "rule_unit"), v, strict=True)])
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), rule(*r)) for *r, words in HEADER_RULES])


def from_tables(tables: DataFrame, *, table: str = "table_id", headers: str = "headers", rows: str = "rows", page: str = "page_number") -> DataFrame:
    """Candidates of table cells: the first rule that a header matches names its column; a row must be as wide as the header.

    A table's headers are matched within its row, so that tables, rows and cells are unfolded where they are. Columns unfold as
    outer ones: a filter that asks for any would be tried below, where headers that are constant meet every row of a group.
    """
    is_entity = lambda h: reduce(lambda a, b: a | b, [F.contains(F.lower(F.trim(h)), F.lit(w)) for w in ENTITY_WORDS])
    entity = F.array_position(F.transform(headers, lambda h: F.coalesce(is_entity(h), F.lit(False))), True) - 1
    ruled = F.filter(F.transform(headers, lambda h, i: F.struct(i.alias("col"), h.alias("header"), header_rule(h).alias("r"))), lambda x: x["r"].isNotNull())
    heads = tables.select(table, page, F.size(headers).alias("width"), entity.cast("int").alias("entity"), ruled.alias("ruled"), F.col(rows).alias("all"))
    cells = heads.select(table, page, "width", "entity", "ruled", F.posexplode("all").alias("row", "cells")).where(F.size("cells") == F.col("width"))
    named = cells.select(table, page, "row", "cells", F.when(F.col("entity") >= 0, F.trim(F.get("cells", F.col("entity")))).alias("entity_name"), F.explode_outer("ruled").alias("x")).where("x is not null")
    facts = named.select(table, page, "row", "entity_name", "x.col", "x.header", "x.r.*", F.trim(F.get("cells", F.col("x.col"))).alias("raw_value")).where(~F.lower("raw_value").isin(*EMPTY_CELLS))
    value = F.when(F.col("data_type") == "NUMBER", nx.parse(F.col("raw_value")))
    unit = F.coalesce(F.nullif(F.trim(F.regexp_extract("header", r"\((.*?)\)", 1)), F.lit("")), "rule_unit")
    out = facts.withColumns({"numeric_value": value, "unit": unit}).where((F.col("data_type") != "NUMBER") | F.col("numeric_value").isNotNull())
    return out.withColumn("confidence_score", F.lit(0.95)).select(table, page, "row", "col", "header", "entity_name", "field_name", "field_category", "data_type", "raw_value", "numeric_value", "unit", "confidence_score")


def deduplicated(facts: DataFrame, *, document: str, page: str, order: str) -> DataFrame:
    """The first candidate per document, field, value and page."""
    from loomstone.operators.filters import first_by

    return first_by(facts, [F.col(document), F.col("field_name"), F.lower(F.trim("raw_value")), F.col(page)], [F.col(order)])
