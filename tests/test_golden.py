"""Hand-computed values of single operators, and the folds that SQL cannot say."""

import pytest
from pyspark.sql import functions as F

from loomstone.functions import numbers, periods, text
from loomstone.operators import embedding, extraction, facts, geology, governance, grounding, operations, quality, reports, scope, tables, topics, trends, visuals
from loomstone.sources import office, readers, sinks
from loomstone.streaming import jobs


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_c_tf_idf(spark):
    rows = spark.createDataFrame([(0, "coal coal mining reserve"), (1, "mining seam seam seam")], "topic int, text string")
    got = {(r.topic, r.term): r.weight for r in topics.c_tf_idf(topics.term_counts(rows, topic="topic", text="text"), topic="topic").collect()}
    assert got == {(0, "coal"): 0.549306, (0, "reserve"): 0.402359, (0, "mining"): 0.274653, (1, "seam"): 0.635473, (1, "mining"): 0.274653}


@pytest.mark.parametrize(
    ("counts", "corpus", "want"),
    [
        ([20, 30], [100, 100], "GROWING"),
        ([3, 0], [12, 10], "DISAPPEARING"),
        ([2, 0, 2], [10, 10, 10], "RECURRING"),
        ([1, 2], [4, 4], "INSUFFICIENT_HISTORY"),
        ([0, 2], [10, 10], "EMERGING"),
        ([5, 5], [10, 10], "STABLE"),
        ([6, 4], [10, 10], "DECLINING"),
    ],
)
def test_trend_classes(spark, counts, corpus, want):
    rows = [("t", f"FY202{i}-2{i + 1}", f"{i}-{k}") for i, n in enumerate(counts) for k in range(n)] + [("other", f"FY202{i}-2{i + 1}", f"{i}-{k}") for i, n in enumerate(corpus) for k in range(n)]
    cells = trends.grid(spark.createDataFrame(rows, "topic string, period string, doc string"), topic="topic", period="period", document="doc")
    last = trends.series(cells, topic="topic", period="period").where("topic = 't'").orderBy(F.desc("period")).first()
    assert last.trend_status == want
    if want == "GROWING":
        assert (last.absolute_change, last.percentage_point_change, last.growth_rate_pct) == (10, 10.0, 50.0)


FACTS = "id int, organization_id string, document_id string, field_name string, numeric_value double, unit string, page_number int, entity_name string, reporting_period string, verification_status string"
ROWS = [(1, "SECL", "d1", "production_quantity", 52.5, "MT", 3, "Gevra", "2023-24", "VERIFIED"), (2, "SECL", "d2", "production_quantity", 43.0, "MT", 5, "Kusmunda", "2023-24", "VERIFIED"), (3, "SECL", "d3", "production_quantity", 35.5, "MT", 2, "Dipka", "2023-24", "UNVERIFIED")]
NO_CONFLICT = "field_id int, conflict_status string, resolution_status string"


@pytest.mark.parametrize(("word", "value"), [("total", 131.0), ("average", 43.6667), ("minimum", 35.5), ("maximum", 52.5)])
def test_aggregation(spark, word, value):
    want = facts.intent(f"What is the {word} coal production in FY2023-24?")
    got = one(facts.aggregate(spark.createDataFrame(ROWS, FACTS), spark.createDataFrame([], NO_CONFLICT), want))
    assert (got.calculated_value, got.record_count, got.unit, got.verified) == (value, 3, "MT", True)
    if word == "total":
        assert got.formula == "52.5 (Gevra, P.3) + 43.0 (Kusmunda, P.5) + 35.5 (Dipka, P.2)"


def test_aggregation_scope_conflicts_units(spark):
    rows, none = spark.createDataFrame(ROWS, FACTS), spark.createDataFrame([], NO_CONFLICT)
    want = facts.intent("total coal production of SECL")
    assert want.subsidiary == "SECL"
    assert one(facts.aggregate(rows, none, want, ["NCL"])).record_count == 0
    all_bad = spark.createDataFrame([(i, "CONFLICT", "UNRESOLVED") for i in (1, 2, 3)], NO_CONFLICT)
    got = one(facts.aggregate(rows, all_bad, want))
    assert (got.record_count, got.verified) == (0, False)
    mixed = rows.withColumns({"unit": F.when(F.col("id") == 3, "Tonnes").otherwise(F.col("unit")), "numeric_value": F.when(F.col("id") == 3, 35_500_000.0).otherwise(F.col("numeric_value"))})
    got = one(facts.aggregate(mixed, none, want))
    assert (got.calculated_value, got.unit_mismatch) == (131.0, False)
    other = mixed.withColumn("unit", F.when(F.col("id") == 3, "m3").otherwise(F.col("unit")))
    assert one(facts.aggregate(other, none, want)).unit_mismatch


def test_intents_of_a_column_are_those_of_single_questions(spark):
    asked = ["total coal production of Gevra in FY2023-24", "average ash content", "how many mines report dispatch", "growth from 2022 to 2023 in production", "borehole BH-01 total thickness", "highest gcv of SECL", "total target of NCL", "overall planned production in the North Karanpura area", "sum of output, Dudhichua Area 2019/2020", "mean SR in this area", "Total RESERVES of ib valley 1999", "minimum gcv 2021-2022 of all area", "", None]
    rows = facts.intents(spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string"), "q").collect()
    for r in rows:
        want = facts.intent(r.q or "")
        assert (r.operation, r.metric, r.subsidiary, r.entity, r.period) == (want.operation, want.metric, want.subsidiary, want.entity, want.period), r.q


@pytest.mark.parametrize(
    ("question", "operation", "metric"),
    [("growth from 2022 to 2023 in production", None, None), ("borehole BH-01 total thickness", None, None), ("how many records of ash content", "COUNT", "ash content"), ("total target production of Gevra in 2024", "SUM", "target production"), ("tell me a story", None, None)],
)
def test_intents(question, operation, metric):
    got = facts.intent(question)
    assert (got.operation, got.metric) == (operation, metric)


def test_scope(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "org string")
    assert [scope.scoped(rows, "org", m).count() for m in (None, ["a"], [])] == [3, 1, 0]
    assert [scope.scoped_or_global(rows, "org", m).count() for m in (None, ["a"], [])] == [3, 2, 1]
    assert scope.allowed(["SYSTEM_ADMIN"], "a") is None
    with pytest.raises(PermissionError):
        scope.allowed(["X"], "a", ["b"])


def test_year_over_year_and_variance(spark):
    s = spark.createDataFrame([("m", "2022-23", 46.7), ("m", "2023-24", 52.5)], "e string, p string, v double")
    got = one(facts.year_over_year(s, keys=["e"], period="p", value="v"))
    assert (got.absolute_change, got.percentage_change) == (5.8, 12.42)
    m = spark.createDataFrame([("g", 1, 82450.0), ("g", 2, 84250.0)], "g string, o int, v double")
    got = one(facts.conflict_variance(m, group="g", value="v", order="o"))
    assert (got.variance, got.variance_pct) == (1800.0, 2.18)


@pytest.mark.parametrize(("raw", "ok", "value"), [("FY2023-24", True, "FY2023-24"), ("Q1 FY 2023-2024", True, "FY2023-24"), ("2025-61", False, None), ("CY2023", True, "CY2023"), ("lifetime", True, "Lifetime"), ("2025-ba", False, None), ("1920-21", False, None), ("", False, None), (None, False, None)])
def test_periods(spark, raw, ok, value):
    got = one(spark.createDataFrame([(raw,)], "p string").select(periods.validate(F.col("p")).alias("v"))).v
    assert got.ok == ok and (not ok or got.value == value)


NOTE = "Mine Name: Gevra, Proved Reserves: 1,250.5 MT. Stripping Ratio: 3.5. Raniganj Formation. GCV: 4200 kcal/kg; Ash Content: 34.5 %."


def test_text_rules(spark):
    got = {r.field_name: (r.raw_value, r.numeric_value, r.unit) for r in extraction.from_texts(spark.createDataFrame([("c", NOTE)], "id string, content string")).collect()}
    assert got["reserves_proved"] == ("1,250.5", 1250.5, "MT") and got["gcv"] == ("4200", 4200.0, "kcal/kg")
    assert got["ash_content"][1:] == (34.5, "%") and got["formation"][0] == "Raniganj" and got["mine_name"][0] == "Gevra"
    assert got["stripping_ratio"][2] == "m3/tonne"


def test_table_rules(spark):
    t = spark.createDataFrame([("t", 4, ["खदान", "Production (LT)", "राख"], [["Gevra", "82,450", "nil"], ["short"], ["Dipka", "x", "31"]])], "table_id string, page_number int, headers array<string>, rows array<array<string>>")
    got = sorted((r.entity_name, r.field_name, r.numeric_value, r.unit) for r in extraction.from_tables(t).collect())
    assert got == [("Dipka", "ash_content", 31.0, "%"), ("Gevra", "production_quantity", 82450.0, "LT")]


def test_table_rules_match_headers_within_a_table_and_shuffle_nothing(spark):
    rows = [("t", 1, ["Mine", None, "Washed coal production", "x", "Grade (g)"], [["a", "1", " 2 ", "3", "G5"], ["b", "1", "-", "3", None]]), ("u", 2, ["x", "y"], [["1", "2"]]), ("v", 3, ["Ash"], [["7"]]), ("w", 4, None, None)]
    got = extraction.from_tables(spark.createDataFrame(rows, "table_id string, page_number int, headers array<string>, rows array<array<string>>"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    found = sorted((r.table_id, r.page_number, r.row, r.col, r.header, r.entity_name, r.field_name, r.raw_value, r.unit) for r in got.where("table_id = 't'").collect())
    assert found == [("t", 1, 0, 2, "Washed coal production", "a", "washed_coal_production", "2", "MT"), ("t", 1, 0, 4, "Grade (g)", "a", "coal_grade", "G5", "g")]
    assert [(r.table_id, r.entity_name, r.field_name, r.numeric_value) for r in got.where("table_id <> 't'").collect()] == [("v", None, "ash_content", 7.0)]


STRATA = "Borehole No: BH-07\n1. 0.0 - 2.5 m Top Soil\n2. 2.5 to 8.0 m Carbonaceous shale\n3. 14.80 - 18.20m (3.40m) Coal Seam I\n0.0 - 2.5 मी. मिट्टी"


def test_strata_lines(spark):
    pages = spark.createDataFrame([("d", 1, STRATA)], "document_id string, page_number int, text string")
    got = [(r.borehole_id, r.stratum_order, r.depth_from_m, r.thickness_m, r.lithology_type, r.seam_name, r.has_thickness_discrepancy) for r in geology.from_texts(pages).orderBy("stratum_order").collect()]
    assert got == [("BH-07", 1, 0.0, 2.5, "Top Soil", None, False), ("BH-07", 2, 2.5, 5.5, "Shale", None, False), ("BH-07", 3, 14.8, 3.4, "Coal", "Seam I", False), ("BH-07", 4, 0.0, 2.5, "Top Soil", None, False)]


def test_strata_anomalies(spark):
    rows = spark.createDataFrame([("b", 1, 0.0, 5.0), ("b", 2, 4.0, 6.0), ("b", 3, 7.0, 6.5), ("b", 4, 8.0, 9.0)], "b string, stratum_order int, depth_from_m double, depth_to_m double")
    got = [r.anomaly for r in geology.anomalies(rows, keys=["b"]).orderBy("stratum_order").collect()]
    assert got == [None, "OVERLAPPING_INTERVAL", "INVERTED_DEPTH", "DEPTH_GAP"]


def test_validation(spark):
    rows = spark.createDataFrame([("ash_content", "NUMBER", 70.0, "%"), ("gcv", "NUMBER", 9500.0, "kcal/kg"), ("production_quantity", "NUMBER", -1.0, "m"), ("drilling_metreage", "NUMBER", None, "m"), ("reserves_total", "NUMBER", 5.0, None)], "field_name string, data_type string, numeric_value double, unit string")
    got = {r.field_name: (r.validation_status, [x.rule_name for x in r.validation if x.status != "PASS"]) for r in quality.validate(rows).collect()}
    assert got["ash_content"] == ("WARNING", ["ASH_CONTENT_HIGH_WARNING"]) and got["gcv"] == ("ERROR", ["GCV_PHYSICAL_BOUNDS"])
    assert got["production_quantity"] == ("ERROR", ["MASS_UNIT_COMPATIBILITY", "NON_NEGATIVE_CONSTRAINT"])
    assert got["drilling_metreage"] == ("ERROR", ["NUMERIC_TYPE_CHECK"]) and got["reserves_total"] == ("WARNING", ["UNIT_PRESENCE_CHECK"])


def test_reserves_and_escrow(spark):
    row = spark.createDataFrame([(100.0, 50.0, 30.0)], "a double, b double, c double")
    got = one(reports.reserve_lineage(row, proved=F.col("a"), indicated=F.col("b"), inferred=F.col("c"), deduction_pct=F.lit(10.0), blocked=F.lit(20.0), loss_pct=F.lit(15.0), depleted=F.lit(5.0)))
    assert (got.gross, got.deduction, got.net, got.minable, got.mining_loss, got.extractable, got.recovery_pct, got.balance) == (180.0, 18.0, 162.0, 142.0, 21.3, 120.7, 85.0, 115.7)
    got = one(reports.closure_escrow(row, area=F.lit(100.0), opencast=F.lit(True), life=F.lit(25)))
    assert (got.escalated_rate, got.closure_cost, got.annual_deposit, got.compounded_deposit) == (14.252, 1425.2, 57.01, 59.86)
    assert one(row.select(reports.transformation_corpus(F.lit(1000.0)).alias("x"))).x.corpus == 100.0


def test_zero_rules(spark):
    z = F.lit(0.0)
    got = one(spark.range(1).select(numbers.success_rate(z, z).alias("a"), reports.stripping_ratio(F.lit(5.0), z).alias("b"), numbers.percentage_change(z, F.lit(1.0)).alias("c"), numbers.stripping_ratio(F.lit(1.0), z).alias("d")))
    assert (got.a, got.b, got.c, got.d) == (100.0, 0.0, None, None)


TABLE = "document_id string, page_number int, table_index int, caption string, headers array<string>, rows array<array<string>>"


@pytest.mark.parametrize(
    ("second", "status", "rows"),
    [
        ((2, 0, "Table 1 (contd.)", ["Mine", "Output"], [["Mine", "Output"], ["c", "3"]]), "AUTO_MERGED", 1),
        ((2, 0, None, [], [["c", "3"]]), "REVIEW_REQUIRED", 1),
        ((2, 0, "Table 2", ["Mine", "Output"], [["c", "3"]]), "STANDALONE", 1),
        ((3, 0, "Table 1 (contd.)", ["Mine", "Output"], [["c", "3"]]), "STANDALONE", 1),
        ((2, 0, "Table 1 (contd.)", ["Mine"], [["c"]]), "STANDALONE", 1),
    ],
)
def test_table_continuation(spark, second, status, rows):
    first = ("d", 1, 0, "Table 1", ["Mine", "Output"], [["a", "1"], ["b", "2"]])
    got = tables.stitched(spark.createDataFrame([first, ("d", *second)], TABLE)).orderBy("page_number").collect()[1]
    assert (got.continuation_status, len(got.rows)) == (status, rows)


def test_summary_row_closes_a_table():
    prev = {"page_number": 1, "table_index": 0, "caption": None, "headers": ["a"], "rows": [["Grand Total"]]}
    assert tables.score(prev, prev | {"page_number": 2}) == (0.0, False)


@pytest.mark.parametrize(
    ("levels", "merges", "want"),
    [
        ([[None, "Production", None, "Quality", None], ["Mine", "Raw Coal", "Washed Coal", "Ash %", "Moisture %"]], [(1, 2, 1, 3), (1, 4, 1, 5)], ["Mine", "Production | Raw Coal", "Production | Washed Coal", "Quality | Ash %", "Quality | Moisture %"]),
        ([[None, "FY 2025-26", None, None], [None, "Production", None, "Quality"], ["Mine", "Raw Coal", "Washed Coal", "Ash"]], [(1, 2, 1, 4), (2, 2, 2, 3)], ["Mine", "FY 2025-26 | Production | Raw Coal", "FY 2025-26 | Production | Washed Coal", "FY 2025-26 | Quality | Ash"]),
        ([["Mine", "Production", None], [None, "Raw Coal", None]], [(1, 2, 1, 3)], ["Mine", "Production | Raw Coal", "Production"]),
        ([["Production", "Production"], ["Raw Coal", "Raw Coal"]], [], ["Production | Raw Coal", "Production | Raw Coal [col=2]"]),
        ([[None, "उत्पादन", None], ["खदान", "कच्चा कोयला", "Washed Coal"]], [(1, 2, 1, 3)], ["खदान", "उत्पादन | कच्चा कोयला", "उत्पादन | Washed Coal"]),
        ([[None, None]], [], ["Col_1", "Col_2"]),
    ],
)
def test_headers(levels, merges, want):
    assert tables.merged_headers(levels, merges) == want


def test_header_depth():
    merged = [[None, "Production", None], ["Mine", "Raw", "Washed"], ["a", "1,200", "₹ 850"], ["b", "18%", "x"]]
    assert tables.header_depth(merged, [(1, 2, 1, 3)]) == 2 and tables.header_depth(merged) == 1
    assert tables.header_depth([["a", "b"]] * 9, [(1, 1, 3, 1)]) == 3
    assert tables.is_data_row(["a", "1e3", "-2.5%"]) and not tables.is_data_row(["a", "b", "3"]) and not tables.is_data_row([None, " "])


def test_workbooks(spark):
    body = [[None, "Production", None], ["Mine", "Raw", "Washed"], *([f"m{i}", 1000 + i, 0.5] for i in range(4500))]
    data = office.xlsx_bytes([("Big", body, ["B1:C1"]), ("Flags", [["a", "b"], [True, None], [None, None], [" x ", "<&>"]], []), ("Empty", [], [])])
    files = spark.createDataFrame([("a.xlsx", data)], "path string, content binary")
    rows = office.xlsx_tables(files).orderBy("page_number", "part").collect()
    assert [(r.page_number, r.part, len(r.rows), r.row_from, r.caption) for r in rows] == [(1, 1, 2000, 1, "Sheet: Big"), (1, 2, 2000, 2001, "Sheet: Big (Part 2)"), (1, 3, 500, 4001, "Sheet: Big (Part 3)"), (2, 1, 2, 1, "Sheet: Flags"), (3, 0, 0, 0, "Sheet: Empty (Empty)")]
    assert rows[0].headers == ["Mine", "Production | Raw", "Production | Washed"] and rows[0].raw_headers == ["Mine", "Raw", "Washed"] and rows[2].rows[-1] == ["m4499", "5499", "0.5"]
    assert rows[3].rows == [["True", ""], ["x", "<&>"]]
    text = office.xlsx_pages(office.xlsx_tables(files)).orderBy("page_number").collect()
    assert text[0].text.endswith("\n... (4400 more rows)") and text[0].text.startswith("# Sheet: Big\nHeaders: Mine | Production | Raw | Production | Washed\nData:\nm0 | 1000 | 0.5\n") and text[2].text == "Sheet: Empty (Empty)"


def test_shared_strings_dates_and_other_cells():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId9"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="rId9" Type="t/worksheet" Target="/xl/worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>',
        "xl/worksheets/s.xml": f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3" s="1"><v>45000</v></c><c r="B3" s="2"><v>45000.5</v></c><c r="C3" s="3"><v>2.0</v></c><c r="D3" t="str"><v>f</v></c><c r="AA3" t="e"><v>#N/A</v></c></row></sheetData></worksheet>',
    }
    book = office.Workbook(office.archive(parts))
    assert list(book.rows("xl/worksheets/s.xml")) == [["plain", None, "rich"], ["2023-03-15 00:00:00", "2023-03-15 12:00:00", "2.0", "f", *[None] * 22, "#N/A"]]


def test_documents(spark):
    blocks = [("heading", "One & two", None), ("text", "body", None), ("table", None, [["a", ""], ["1", "2"]])]
    assert office.docx_bytes(blocks) == office.docx_bytes(blocks)
    d = office.Document(office.docx_bytes(blocks))
    assert d.pages() == ["\n## One & two\n\nbody"] and d.tables() == [[["a", ""], ["1", "2"]]] and d.images() == []
    w = office._W[1:-1]
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    body = f"<w:tbl><w:tr>{cell('wide', '<w:gridSpan w:val=%s2%s/>' % (chr(34), chr(34)))}</w:tr><w:tr>{cell('v', '<w:vMerge w:val=%srestart%s/>' % (chr(34), chr(34)))}{cell('x')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('y')}</w:tr></w:tbl><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p>"
    d = office.Document(office.archive({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'}))
    assert d.tables() == [[["wide", "wide"], ["v", "x"], ["v", "y"]]] and d.pages() == ["a\tb"]
    assert office.image_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")) == (7, 9) and office.image_size(b"GIF89a") is None
    assert office.image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x06") == (6, 5)


def test_pages_of_many_formats(spark):
    files = spark.createDataFrame([("a.docx", office.docx_bytes([("text", "hello", None)])), ("b.xlsx", office.xlsx_bytes([("S", [["h"], ["v"]], [])])), ("c.pdf", b"x"), ("c.png", b"x"), ("d.bin", b"x"), ("e.txt", "é".encode())], "path string, content binary")
    got = {r.path: (r.parser, r.text, r.error) for r in readers.pages(files).collect()}
    assert got == {"a.docx": ("docx", "hello", None), "b.xlsx": ("xlsx", "# Sheet: S\nHeaders: h\nData:\nv", None), "c.pdf": ("pdf", None, "PDF cannot be read: not a PDF file"), "c.png": ("image", None, "parser is not available: image"), "d.bin": (None, None, "no parser takes this file"), "e.txt": ("text", "é", None)}


def test_structured_sum_over_documents(spark):
    rows = [(1, "org", "d1", "production_quantity", 52.5, "MT", 3, "Gevra", "2023-24", "VERIFIED"), (2, "org", "d2", "production_quantity", 43.0, "MT", 5, "Kusmunda", "2023-24", "VERIFIED"), (3, "org", "d3", "production_quantity", 35.5, "MT", 2, "Dipka", "2023-24", "UNVERIFIED")]
    found = spark.createDataFrame(rows, "id long, organization_id string, document_id string, field_name string, numeric_value double, unit string, page_number int, entity_name string, reporting_period string, verification_status string")
    none = spark.createDataFrame([], "field_id long, conflict_status string, resolution_status string")
    got = one(facts.aggregate(found, none, facts.intent("total coal production in FY 2023-24")))
    assert (got.calculated_value, got.unit, got.record_count, got.unit_mismatch, got.verified) == (131.0, "MT", 3, False, True)
    assert got.formula == "52.5 (Gevra, P.3) + 43.0 (Kusmunda, P.5) + 35.5 (Dipka, P.2)"


def test_backups(spark, tmp_path):
    files = spark.createDataFrame([("a/b.txt", b"one"), ("c.txt", b"two")], "path string, content binary")
    at, target = f"file://{tmp_path}/backup", f"file://{tmp_path}/target"
    assert operations.back_up(files, at).count() == 2
    with pytest.raises(operations.Refused, match="holds files"):
        operations.back_up(files, at)
    assert {(r.path, r.status) for r in operations.restore(spark, at, target).collect()} == {("a/b.txt", "OK"), ("c.txt", "OK")}
    assert (tmp_path / "target" / "a" / "b.txt").read_bytes() == b"one"
    with pytest.raises(operations.Refused, match="holds files"):
        operations.restore(spark, at, target)
    spark.createDataFrame([("c.txt", b"TWO"), ("../d.txt", b"x")], "path string, content binary").write.mode("overwrite").parquet(f"{at}/files")
    with pytest.raises(operations.Refused, match="does not match"):
        operations.restore(spark, at, target, force=True)
    loose = spark.createDataFrame([("../d.txt", b"x")], "path string, content binary")
    operations.back_up(loose, f"file://{tmp_path}/loose")
    with pytest.raises(operations.Refused, match="lead out"):
        operations.restore(spark, f"file://{tmp_path}/loose", f"file://{tmp_path}/other")


def test_health(spark):
    def broken():
        raise OSError("gone")

    rows = operations.probes(spark, {"a": lambda: None, "b": broken, "c": lambda: "slow", "d": None}, optional=("b",))
    assert {r.component: (r.status, r.detail) for r in rows.collect()} == {"a": ("HEALTHY", None), "b": ("UNAVAILABLE", "OSError: gone"), "c": ("DEGRADED", "slow"), "d": ("NOT_CONFIGURED", None)}
    states = [one(operations.health(operations.probes(spark, checks))).status for checks in ({"a": lambda: None, "d": None}, {"c": lambda: "slow"}, {"b": broken})]
    assert states == ["UP", "DEGRADED", "DOWN"]


def test_spans(spark):
    spans = operations.Spans()
    with pytest.raises(ValueError), spans.timed("x", doc=1):
        raise ValueError("no")
    row = one(spans.frame(spark))
    assert (row.operation, row.status, row.error, row.attributes) == ("x", "ERROR", "ValueError: no", {"doc": "1"})


def test_order_of_one_hot_client(spark):
    """Rows of one key stream through its task in order; batches are smaller than the key."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(100).selectExpr("CASE WHEN id < 80 THEN 'hot' WHEN id < 90 THEN 'cold' END AS client", "timestamp_seconds(1000 - id) AS at", "id")
        got = governance.rate_limited(rows, client="client", at="at", limit=2, window=10.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name in ("hot", "cold", None):
        kept, want = [], {}
        for r in sorted((r for r in got if r.client == name), key=lambda r: r["at"]):
            kept = [k for k in kept if (r["at"] - k).total_seconds() < 10]
            want[r.id] = len(kept) < 2
            kept += [r["at"]] * want[r.id]
        assert {r.id: r.allowed for r in got if r.client == name} == want and want


def test_shared_values(spark):
    rows = spark.createDataFrame([(d, "o", "v") for d in range(40)] + [(1, "o", "w"), (2, "o", "w"), (3, "p", "v"), (4, "o", None)], "d long, s string, v string")
    pairs = quality.relate(rows, document="d", scope="s", value="v", kind="K", confidence=1.0, most=7).collect()
    assert {(r.source_document_id, r.target_document_id): r.n_shared for r in pairs} == {(a, b): 1 + ((a, b) == (1, 2)) for a in range(40) for b in range(a + 1, 40)}
    groups = quality.shared_groups(rows, document="d", scope="s", value="v", kind="K", confidence=1.0).collect()
    assert sorted((r.s, r.v, r.representative, r.d, r.n_documents) for r in groups) == sorted([("o", "v", 0, d, 40) for d in range(40)] + [("o", "w", 1, d, 2) for d in (1, 2)])


def test_texts_are_read_once_for_c_tf_idf(spark, tmp_path):
    spark.createDataFrame([(i % 2, "coal seam the ash") for i in range(20)], "topic int, text string").write.parquet(f"{tmp_path}/t")
    found = topics.c_tf_idf(topics.term_counts(spark.read.parquet(f"{tmp_path}/t"), topic="topic", text="text"), topic="topic", stopwords=["the"])
    assert len(found.collect()) == 6
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 or "ReusedExchange" in final


def test_topic_clusters(spark):
    rng = __import__("random").Random(4)
    rows = [(i, [float((i % 3 == j) * 5 + rng.random()) for j in range(12)]) for i in range(60)]
    got = topics.cluster(spark.createDataFrame(rows, "id long, embedding array<float>"), 3, starts=3).collect()
    assert len({(r.id % 3, r.topic) for r in got}) == 3
    assert topics.cluster(spark.createDataFrame(rows[:4], "id long, embedding array<float>"), 2, starts=1).count() == 4


def test_fallbacks(spark):
    def broken():
        raise RuntimeError("no weights")

    assert embedding.loaded("m", {"m": broken})[1:] == (embedding.MODEL, "FALLBACK: no weights") and embedding.loaded("m", {})[1:] == (embedding.MODEL, "NOT_CONFIGURED")
    assert embedding.loaded("m", {"m": lambda: abs})[1:] == ("m", "READY") and embedding.loaded(embedding.MODEL, {})[2] == "READY"


def test_hash_embedding_of_a_batch_is_that_of_single_texts():
    texts = ["Coal seam III", None, "", "ash ash content!", "é"]
    assert [x.tolist() for x in embedding.embed_all(texts)] == [embedding.embed(t) for t in texts]


def test_hash_embedding_adds_tables_of_words_in_the_order_of_features(monkeypatch):
    texts = ["Coal seam III", None, "", "a", "ab a ab a ab", "é ß 日本語 x_y", "!!", "seam coal seam coal"]
    want = []
    for t in texts:
        v = [0.0] * 384
        for f, w in embedding.features(t):
            axis, sign = embedding.place(f)
            v[axis] += w * sign
        size = sum(x * x for x in v) ** 0.5
        want.append([x / size for x in v] if size else [1.0] + [0.0] * 383)
    monkeypatch.setattr(embedding, "features", None)  # no list of every occurrence's features
    got = embedding.embed_all(texts)
    assert max(abs(a - b) for g, w in zip(got.tolist(), want, strict=True) for a, b in zip(g, w, strict=True)) < 1e-12
    assert embedding.embed_all([]).shape == (0, 384)


def test_visual_classes_and_boxes(spark):
    rows = spark.createDataFrame([("Geological map",), ("Borehole log, drill log",), ("nothing",)], "c string")
    got = [(r.visual_type, r.confidence, r.review_status) for r in visuals.classified(rows, F.col("c")).collect()]
    assert got == [("MAP", 0.81, "ACCEPTED"), ("BOREHOLE_LOG", 1.0, "ACCEPTED"), ("UNKNOWN", 0.0, "REVIEW_REQUIRED")]
    rects = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 20.0, 0.0, 30.0, 10.0), (1, 100.0, 100.0, 110.0, 110.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.members for r in visuals.clusters(rects, page="page").collect()) == [1, 2]


def test_grounding(spark):
    rows = spark.createDataFrame([(1, "Output was 52.5 MT in the year. [1] This indicates that demand growth will follow.", "output was 52.5 mt in the year"), (2, "", "x")], "id int, a string, e string")
    got = {r.id: (r.status, r.confidence) for r in grounding.report(rows, key="id", answer="a", evidence="e").collect()}
    assert got == {1: ("PARTIALLY_SUPPORTED", 0.35), 2: ("UNSUPPORTED", 0.1)}


def test_maker_checker(spark):
    edits = spark.createDataFrame([(1, "m", "o"), (2, "m", "o"), (3, "m", "o")], "edit_id int, maker string, organization string")
    done = spark.createDataFrame([(1, 1, "m", "o", "APPROVE", 1), (2, 1, "c", "o", "REJECT", 2), (3, 1, "c", "o", "APPROVE", 3), (4, 2, "c", "p", "APPROVE", 1)], "decision_id int, edit_id int, checker string, checker_organization string, decision string, at int")
    assert {r.edit_id: r.status for r in governance.resolved_edits(edits, done).collect()} == {1: "REJECTED", 2: "PENDING_VERIFICATION", 3: "PENDING_VERIFICATION"}


def test_rate_limit_ignores_rejected_calls(spark):
    rows = spark.sql("SELECT 'c' AS client, i AS i, timestamp_seconds(i * 20) AS ts FROM (SELECT explode(sequence(0, 5)) AS i)")
    got = [r.allowed for r in governance.rate_limited(rows, client="client", at="ts", limit=2, window=60.0).orderBy("i").collect()]
    assert got == [True, True, False, True, True, False]


def test_embedding():
    a = embedding.embed("coal seam")
    assert len(a) == 384 and abs(sum(x * x for x in a) - 1) < 1e-9 and embedding.embed("coal seam") == a
    assert embedding.embed("")[0] == 1.0 and embedding.embed(None)[0] == 1.0


def test_csv_and_admission(spark):
    body = 'Mine_Name,Output\n"Moonidih, North","82,450"\n\n,\n'.encode()
    files = spark.createDataFrame([("a.csv", bytearray(body), len(body)), ("b.exe", bytearray(b"MZ"), 2), ("c.pdf", bytearray(b"%PDF-1.7"), 8), ("d.pdf", bytearray(b"zzzz"), 4)], "path string, content binary, length long")
    t = one(readers.csv_tables(files.where("path = 'a.csv'")))
    assert (t.headers, t.rows) == (["Mine_Name", "Output"], [["Moonidih, North", "82,450"]])
    assert {r.path: r.reason for r in readers.admitted(files).collect()} == {"a.csv": None, "b.exe": "denied extension", "c.pdf": None, "d.pdf": "content does not match extension"}
    assert [readers.sniff(x) for x in ("a;b\nc;d", "a\tb\nc\td", "a|b\nc|d", "a,b\nc,d")] == [";", "\t", "|", ","]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, p string")
    for _ in range(2):
        sinks.append_missing(rows, str(tmp_path / "m"), "id")
        sinks.overwrite_partitions(rows, str(tmp_path / "o"), "p")
    assert spark.read.parquet(str(tmp_path / "m")).count() == spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT i AS id, timestamp_seconds(i * 600) AS ts, CAST(i AS double) AS value, IF(i % 2 = 0, 'a', 'b') AS kind FROM (SELECT explode(sequence(0, 199)) AS i)")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    out = jobs.tumbling(jobs.events(spark, str(tmp_path / "in"), rows, files_per_batch=100), "kind")
    jobs.run(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.start, r.kind): (r.n, r.total) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.kind): (r.n, r.total) for r in rows.groupBy(F.window("ts", "1 hour"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "kind", "n", "total").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 6


def test_external_source_fails_closed(spark):
    spark.dataSource.register(readers.ExternalRecords)
    with pytest.raises(Exception, match="not configured"):
        spark.read.format("external_records").load().count()


def test_text_functions(spark):
    row = spark.createDataFrame([("What is the output, of Mine-7?", "password=abc Bearer x.y")], "q string, s string")
    got = one(row.select(text.clean_query(F.col("q")).alias("q"), text.redact(F.col("s")).alias("s"), text.tokens(F.lit("Coal-seam _x_ 12 É ok")).alias("t")))
    assert (got.q, got.s, got.t) == ("the output of Mine-7", "password=[REDACTED] Bearer [REDACTED]", ["coal-seam", "ok"])
