"""PDF and legacy workbook readers, damaged files, and the inverted index, against brute force and files made here."""

import random
import struct
import time
import zlib
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstone.operators import inverted, retrieval
from loomstone.operators.inverted import Index
from loomstone.sources import admission, office, pdf, readers, xls
from loomstone.sources.frames import frames

SHEETS = [(["Héllo wörld", "second (line) \\ 日本 \U0001f600", "x" * 300], [["a", ""], ["1", "2 x"]]), ([], [])]


def text_of(data):
    return [r[4] for r in pdf._drawn("p", data) if r[2] == "span"]


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_objects_are_found_with_and_without_tables(packed):
    data = pdf.pdf_bytes(SHEETS, packed)
    want = [*SHEETS[0][0], "a", "1", "2 x"]
    assert text_of(data) == want
    assert text_of(data.replace(b"startxref", b"startxxxx")) == want and text_of(data[:-60]) == want and text_of(b"junk\n" + data) == want


def simple_pdf(content, font=b"<</Type/Font/Subtype/Type1/BaseFont/F>>", filters=b""):
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 300 400]/Resources<</Font<</F 4 0 R>>>>>>", b"<</Type/Page/Parent 2 0 R/Contents 5 0 R>>", font, b"<<%s/Length %d>>stream\n" % (filters, len(content)) + content + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer<</Root 1 0 R>>"


def test_pdf_text_operators():
    content = rb"BT /F 10 Tf 12 TL 20 300 Td (one\) \(two\51) Tj T* [(thr) -20 (ee) -400 (four)] TJ (next) ' 1 0 0 1 20 200 Tm <6669766520> Tj q 2 0 0 2 0 0 cm Q ET"
    assert text_of(simple_pdf(content)) == ["one) (two)", "three four", "next", "five "]
    differences = b"<</Type/Font/Subtype/Type1/Encoding<</Differences[65/uni00E9/fi/space/B]>>>>"
    assert text_of(simple_pdf(b"BT /F 10 Tf (ABCD) Tj ET", differences)) == ["éfi B"]
    ranges = b"<</Type/Font/Subtype/Type1>>"
    assert text_of(simple_pdf(zlib.compress(b"BT /F 9 Tf (packed) Tj ET"), ranges, b"/Filter/FlateDecode")) == ["packed"]
    assert text_of(simple_pdf(b"BT /F 9 Tf (hex) Tj ET".hex().encode() + b">", ranges, b"/Filter/ASCIIHexDecode")) == ["hex"]


def test_pdf_predictors():
    rows = [bytes([1, 2, 3, 250]), bytes([2, 4, 6, 8]), bytes([9, 9, 9, 9])]
    sub = lambda r, _: bytes((b - (r[i - 1] if i else 0)) & 255 for i, b in enumerate(r))
    up = lambda r, a: bytes((b - c) & 255 for b, c in zip(r, a, strict=True))
    mean = lambda r, a: bytes((b - ((r[i - 1] if i else 0) + a[i]) // 2) & 255 for i, b in enumerate(r))
    for kind, f in ((1, sub), (2, up), (3, mean)):
        data = b"".join(bytes([kind]) + f(r, rows[i - 1] if i else bytes(4)) for i, r in enumerate(rows))
        assert pdf._predicted(data, {"Predictor": 12, "Columns": 4}) == b"".join(rows)


def test_damaged_pdfs_end_in_an_error_and_in_time():
    data, rng = pdf.pdf_bytes(SHEETS, True), random.Random(3)
    for _ in range(150):
        bad = bytearray(data)
        for _ in range(rng.randint(1, 30)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        rows = pdf._drawn("p", bytes(bad[: rng.randint(0, len(bad))]))
        assert rows and all(len(r) == 10 for r in rows)
    assert pdf._drawn("p", b"")[0][-1].startswith("PDF cannot be read") and "encrypted" in pdf._drawn("p", simple_pdf(b"").replace(b"/Root", b"/Encrypt 9 0 R/Root"))[0][-1]
    for unit in (b"[", b"<<", b"(", b"1 0 obj ", b"BT ", b"trailer<<"):
        began = time.perf_counter()
        pdf._drawn("p", b"%PDF-1.4 " + unit * 20_000)
        pdf._drawn("p", simple_pdf(unit * 20_000))
        assert time.perf_counter() - began < 10, unit


def test_pdf_lines_and_tables(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(pdf.pdf_bytes([(["first", "second"], [["h", "", "k"], ["1", "2", "3"], ["4", "", "6"]])]))), ("b.pdf", bytearray(b"no"))], "path string, content binary")
    rows = {(r.path, r.page_number): r for r in pdf.pages(files).collect()}
    assert rows["a.pdf", 1].text.split("\n")[:2] == ["first", "second"] and rows["a.pdf", 1].needs_review == (len(rows["a.pdf", 1].text) < 30)
    assert rows["b.pdf", None].text is None and rows["b.pdf", None].error == "PDF cannot be read: not a PDF file"
    (table,) = pdf.tables(pdf.drawn(files)).collect()
    assert table.headers == ["h", "Column_2", "k"] and table.rows == [["1", "2", "3"], ["4", "", "6"]]


def test_xls_cells_and_strings_over_continue_records():
    rows = [["Mine", None, "Dätе"], ["x" * 9000 + "日\U0001f600", 1, datetime(2020, 2, 29)], [True, 2.5, -7], [None, None, None], ["y" * 8221, 10**12, 0.1]]
    book = xls.Book(xls.xls_bytes([("Rëport", rows), ("Empty", [])]))
    assert [n for n, _ in book.sheets] == ["Rëport", "Empty"]
    assert list(book.rows(book.sheets[0][1])) == [["Mine", "", "Dätе"], [rows[1][0], "1", "2020-02-29"], ["TRUE", "2.5", "-7"], ["y" * 8221, "1000000000000", "0.1"]]
    assert list(book.rows(book.sheets[1][1])) == []
    assert [xls._rk(v) for v in (0x3FF00000, 4 << 2 | 2, 1234 << 2 | 3, (-5 << 2 | 2) & 0xFFFFFFFF)] == [1.0, 4.0, 12.34, -5.0]


def test_xls_formulas_and_narrow_strings():
    head = struct.pack("<HHH", 0, 0, 0)
    text = xls._record(xls.FORMULA, head + bytes([0, 0, 0, 0, 0, 0, 255, 255])) + xls._record(xls.STRING, struct.pack("<HB", 3, 0) + b"abc")
    more = [xls._record(xls.FORMULA, struct.pack("<HHH", 0, 1, 0) + struct.pack("<d", 7.0)), xls._record(xls.FORMULA, struct.pack("<HHH", 0, 2, 0) + bytes([2, 0, 7, 0, 0, 0, 255, 255])), xls._record(xls.MULRK, struct.pack("<HHHIHIH", 0, 3, 0, 8 << 2 | 2, 0, 9 << 2 | 2, 4))]
    book = xls.Book(xls.xls_bytes([("A", [["q"]])]))
    book.data = text + b"".join(more) + xls._record(xls.EOF, b"")
    assert list(book.rows(0)) == [["abc", "7", "#DIV/0!", "8", "9"]]


def test_damaged_workbooks_end_in_an_error():
    data, rng = xls.xls_bytes([("A", [["s", i] for i in range(200)])]), random.Random(4)
    for _ in range(150):
        bad = bytearray(data)
        for _ in range(rng.randint(1, 30)):
            bad[rng.randrange(600)] = rng.randrange(256)
        assert list(xls._parts("p", bytes(bad[: rng.randint(0, len(bad))]), 50))


def test_one_bad_file_costs_no_other(spark):
    good = office.xlsx_bytes([("S", [["Name"], ["x"]], [])])
    big = office.xlsx_bytes([("S", [["Name"], ["x"]], [])])
    files = [("a.xlsx", good), ("b.xlsx", good[: len(good) // 2]), ("c.xlsx", xls.MAGIC + bytes(600)), ("d.docx", b"PK\x03\x04 no"), ("e.csv", b"n\n1\n"), ("f.xls", good), ("g.pdf", None), ("h.xlsx", b"")]
    got = readers.pages(spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in files], "path string, content binary")).collect()
    assert {r.path for r in got if r.error is None} == {"a.xlsx", "e.csv"} and {r.path for r in got} == {p for p, _ in files}
    assert "encrypted" in next(r.error for r in got if r.path == "c.xlsx")
    office.MOST_UNPACKED, kept = 100, office.MOST_UNPACKED
    try:
        with pytest.raises(ValueError, match="too many"):
            office.Workbook(big)
    finally:
        office.MOST_UNPACKED = kept


# inverted index ---------------------------------------------------------------------------------------------------
def corpus(n=60, seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Thing", "things", "on", "of", "the", "proof", "them", "x-y", "é", "日本", "a.b", "O'f"])
    return [(i, None if i % 13 == 0 else "".join(word() + rng.choice([" ", " ", " ", "  ", "\n", "\t", " \n "]) for _ in range(rng.randint(0, 25)))) for i in range(n)]


def test_index_gives_the_rows_of_the_scans(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").withColumn("title", F.when(F.col("doc_id") % 4 == 0, "the Thing"))
    index = Index(spark, f"file://{tmp_path}/i", buckets=5)
    index.append(docs.where("doc_id < 40"), key="doc_id", columns=["text", "title"])
    index.append(docs.where("doc_id >= 40"), key="doc_id", columns=["text", "title"])
    for query in ("thing of", "o", "on on", "é", "zzz", "hin 本"):
        for columns in ({"text": 1}, {"text": 1, "title": 3}):
            assert index.lexical(query, key="doc_id", columns=columns).collect() == retrieval.lexical(docs, query, key="doc_id", columns=columns).collect(), query
    for query in ('"of the"', '"f th"', "thing", 'the "on of" -them', "thing OR é", '"of" on -é OR', '"the thing on"', "x-y -the"):
        want = {r.doc_id for r in retrieval.matches(docs, query, "text").collect()}
        assert {r.doc_id for r in index.matches(query, key="doc_id", column="text").collect()} == want, query


def test_index_after_changes_and_compaction(spark, tmp_path):
    rows = dict(corpus())
    make = lambda r: spark.createDataFrame(sorted(r.items()), "doc_id long, text string")
    index = Index(spark, f"file://{tmp_path}/i", buckets=3)
    index.append(make(rows), key="doc_id", columns=["text"])
    changed = {k: "the new thing" for k in range(0, 60, 7)}
    index.append(make(changed | {99: "thing thing"}), key="doc_id", columns=["text"])
    index.delete(make({k: "" for k in range(0, 60, 5)}), key="doc_id")
    index.append(make({5: "thing again"}), key="doc_id", columns=["text"])
    now = {k: v for k, v in (rows | changed | {99: "thing thing"}).items() if k % 5 or k >= 60} | {5: "thing again"}
    want = retrieval.lexical(make(now), "thing", key="doc_id", columns={"text": 1}).collect()
    assert index.lexical("thing", key="doc_id", columns={"text": 1}).collect() == want
    before = index.status().first()
    assert before.dead_postings > 0 and before.live_keys == len(now)
    assert index.compact() == 1
    after = index.status().first()
    assert (after.dead_postings, after.live_postings, after.live_keys, after.batches) == (0, before.live_postings, len(now), 1)
    assert index.lexical("thing", key="doc_id", columns={"text": 1}).collect() == want


def test_a_query_reads_only_its_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} other{i % 50}") for i in range(2000)], "doc_id long, text string")
    index = Index(spark, f"file://{tmp_path}/i", buckets=16)
    index.append(docs, key="doc_id", columns=["text"])
    found = index._of(index._tokens("word77", lambda c: c == "word77"), ["n"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert len(found.collect()) == 1 and len({f.split("bucket=")[1].split("/")[0] for f in index._read("postings").where("bucket = 3").inputFiles()}) == 16


def test_postings_are_made_where_the_texts_are_and_packed_by_token(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the thing of the day") for i in range(500)], "doc_id long, text string").coalesce(1)
    index = Index(spark, f"file://{tmp_path}/i", buckets=2)
    assert "Exchange" not in index._postings(docs, "doc_id", ["text"])._jdf.queryExecution().executedPlan().toString()
    index.append(docs, key="doc_id", columns=["text"])
    assert index._read("postings").count() == 4 and index.status().first().live_postings == 2000
    met = index.matches('"of the day" thing', key="doc_id", column="text")
    assert met.count() == 500 and met._jdf.queryExecution().executedPlan().toString().count("Expand") == 0


@pytest.mark.parametrize("most", [1, 300, 1 << 24])
def test_blocks_hold_every_occurrence_of_the_keys_that_stay(monkeypatch, most):
    monkeypatch.setattr(inverted, "BLOCK_BYTES", most)
    texts = {f"k{i}": " ".join(["a", f"w{i % 3}", "", "\n", "a", "é"][: i % 7]) if i % 11 else None for i in range(60)}
    batches = pa.table({"key": list(texts), "text0": pa.array(texts.values(), pa.string()), "text1": pa.array(["x a"] * 60)}).to_batches(max_chunksize=25)
    made = list(inverted._blocks(iter(batches), ["one", "two"]))
    assert (len({b for m in made for b in m["block"].to_pylist()}) > 1) == (most < 1 << 24)

    def occurrences(tables):
        for r in (r for t in tables for r in t.to_pylist()):
            assert len(r["keys"]) == len(r["ns"]) > 0 and sum(r["ns"]) == len(r["positions"])
            owners = [k for k, n in zip(r["keys"], r["ns"], strict=True) for _ in range(n)]
            yield from ((r["token"], r["field"], k, p) for k, p in zip(owners, r["positions"], strict=True))

    want = sorted((w, f, k, i) for k, t in texts.items() for f, x in (("one", t), ("two", "x a")) if x is not None for i, w in enumerate(x.split(" ")) if w not in ("", "\n"))
    assert sorted(occurrences(made)) == want
    gone = pa.table({"key": [k for k in texts if int(k[1:]) % 4 == 0]})
    left = [inverted._without(pa.Table.from_batches([m]), gone) for m in made]
    assert sorted(occurrences(left)) == [x for x in want if int(x[2][1:]) % 4]
    assert all(len(inverted._without(pa.Table.from_batches([m]), pa.table({"key": list(texts)}))) == 0 for m in made)


def test_an_unfinished_batch_does_not_exist(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one thing")], "doc_id long, text string")
    index = Index(spark, f"file://{tmp_path}/i", buckets=2)
    with pytest.raises(ValueError, match="no index"):
        index.status()
    index.append(docs, key="doc_id", columns=["text"])
    index._postings(docs, "doc_id", ["text"]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"file://{tmp_path}/i/g=0/postings/batch=2")
    assert index.batches() == [1] and index.lexical("thing", key="doc_id", columns={"text": 1}).count() == 1
    assert index.append(docs.withColumn("doc_id", F.lit(2)), key="doc_id", columns=["text"]) == 2 and index.lexical("thing", key="doc_id", columns={"text": 1}).count() == 2


# quarantine -------------------------------------------------------------------------------------------------------
def test_a_promotion_that_stopped_admits_nothing_until_it_is_finished(spark, tmp_path, monkeypatch):
    store = admission.Store(spark, f"file://{tmp_path}/s")
    files = [("a.csv", b"x,1"), ("b.pdf", b"no"), ("c.exe", b"MZ"), ("d.txt", b""), ("sub/e.csv", b"y")]
    store.take_in(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary"), "one")
    assert {r.state for r in store.state().collect()} == {"QUARANTINED"} and store.accepted().count() == 0
    whole = admission.operations.write_files

    def stops(found, target):
        whole(found.limit(1), target).collect()
        raise RuntimeError("stopped")

    monkeypatch.setattr(admission.operations, "write_files", stops)
    with pytest.raises(RuntimeError):
        store.promote("one")
    assert store.accepted().count() == 0 and {r.state for r in store.state().collect()} == {"QUARANTINED"}
    monkeypatch.setattr(admission.operations, "write_files", whole)
    assert store.finish() == ["one"] and store.finish() == []
    got = {r.path: (r.state, r.reason) for r in store.state().collect()}
    assert got == {"a.csv": ("ADMITTED", None), "sub/e.csv": ("ADMITTED", None), "b.pdf": ("REFUSED", "content does not match extension"), "c.exe": ("REFUSED", "denied extension"), "d.txt": ("REFUSED", "empty")}
    assert (tmp_path / "s/accepted/one/a.csv").read_bytes() == b"x,1" and (tmp_path / "s/accepted/one/sub/e.csv").read_bytes() == b"y"


def test_a_file_that_changes_while_it_is_promoted_is_refused(spark, tmp_path, monkeypatch):
    store = admission.Store(spark, f"file://{tmp_path}/s")
    store.take_in(spark.createDataFrame([("a.csv", bytearray(b"x"))], "path string, content binary"), "one")
    whole = admission.operations.write_files
    monkeypatch.setattr(admission.operations, "write_files", lambda found, target: whole(found.withColumn("content", F.encode(F.lit("other"), "UTF-8")), target))
    store.promote("one")
    assert [(r.state, r.reason) for r in store.state().collect()] == [("REFUSED", "changed while it was promoted")]


def test_rows_of_many_files_come_in_few_frames_and_those_of_a_large_one_in_several():
    schema = "path string, part int, rows array<array<string>>, row_from long"
    small = list(frames(((f"f{i}", 1, [["a"]], None) for i in range(500)), schema))
    assert [len(f) for f in small] == [500] and str(small[0]["row_from"].dtype) == "Int64" and small[0]["row_from"].isna().all()
    large = list(frames((("f", i, [["a", "b"]] * 50, i) for i in range(100)), schema, most=1000))
    assert len(large) == 10 and sum(map(len, large)) == 100 and not list(frames([], schema))


def test_many_small_files_are_dealt_over_tasks(spark):
    from loomstone.plans import files
    from loomstone.plans.catalog import Tables

    for made in (files._xls_files, files._damaged, files._order_pdfs, files._pdf_files):
        rows = made(Tables(spark, "/root/testdata/sf0.001"))
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_pages_are_drawn_once(spark):
    files = spark.createDataFrame([("a.pdf", pdf.pdf_bytes([(["one two", "three"], []), ([], [])])), ("b.pdf", b"junk")], "path string, content binary")
    got = pdf.pages(files)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert sorted((r.path, r.page_number, r.text, r.width, r.error) for r in got.collect() if r.path == "a.pdf") == [("a.pdf", 1, "one two\nthree", 612, None), ("a.pdf", 2, "", 612, None)]
    (bad,) = [r for r in got.collect() if r.path == "b.pdf"]
    assert bad.page_number is None and bad.text is None and "not a PDF" in bad.error
