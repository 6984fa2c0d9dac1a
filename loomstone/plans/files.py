"""Queries of PDF files, legacy workbooks and damaged files, all made from the given tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.plans.catalog import Tables, query, spread
from loomstone.session import shared_folder, written
from loomstone.sources import admission, office, pdf, readers, xls

PAGE_LINES = 40


def _pdf_files(t: Tables) -> DataFrame:
    """A PDF per document: its lines that are not blank, 40 a page; those of odd keys in the packed form."""

    def made(keys: pd.Series, texts: pd.Series) -> pd.Series:
        def one(key, text):
            lines = [x for x in (text or "").split("\n") if x.strip()]
            return pdf.pdf_bytes([(lines[i : i + PAGE_LINES], []) for i in range(0, max(1, len(lines)), PAGE_LINES)], packed=key % 2 == 1)

        return pd.Series([one(k, x) for k, x in zip(keys, texts, strict=True)])

    content = F.pandas_udf(made, "binary")("doc_id", "text")
    return spread(t.documents.select("doc_id", "text")).select(F.concat(F.lit("d"), "doc_id", F.lit(".pdf")).alias("path"), content.alias("content"))


LINES = r"""lines AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM documents),
sheets AS (SELECT doc_id, l, unnest(range(0, greatest(1, (len(l) + 39) // 40))) AS p FROM lines),
paged AS (SELECT doc_id, CAST(p + 1 AS INTEGER) AS page_number, regexp_replace(array_to_string(l[40 * p + 1 : 40 * p + 40], chr(10)), '^\s+|\s+$', '', 'g') AS text FROM sheets)"""


@query("src_07_pdf_pages", f"WITH {LINES} SELECT 'd' || doc_id || '.pdf' AS path, page_number, text, 612 AS width, 792 AS height, length(text) < 30 AS needs_review, NULL AS error FROM paged")
def src_07_pages(t: Tables):
    """Text of PDFs of all documents, with cross-reference tables and with streams; pages without text to speak of are marked."""
    return pdf.pages(_pdf_files(t))


def _order_pdfs(t: Tables) -> DataFrame:
    """A PDF per customer with orders: a page of text, then a page with a title and a ruled table of the orders, 30 rows at most a page."""

    def made(names: pd.Series, keys: pd.Series, states: pd.Series) -> pd.Series:
        def one(name, orders, status):
            rows = [[str(o), s] for o, s in zip(orders, status, strict=True)]
            sheets = [([f"Report for {name}", "Nothing is ruled on this page."], [])]
            sheets += [([f"Orders from {i}"], [["Order", ""], *rows[i : i + 30]]) for i in range(0, len(rows), 30)]
            return pdf.pdf_bytes(sheets, packed=len(rows) % 2 == 0)

        return pd.Series([one(*x) for x in zip(names, keys, states, strict=True)])

    orders = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o"))
    orders = spread(orders)
    content = F.pandas_udf(made, "binary")(F.col("o_custkey").cast("string"), F.col("o.o_orderkey"), F.col("o.o_orderstatus"))
    return orders.select(F.concat(F.lit("c"), "o_custkey", F.lit(".pdf")).alias("path"), content.alias("content"))


@query("src_07_pdf_tables", """
WITH o AS (SELECT o_custkey, list(o_orderkey || ':' || o_orderstatus ORDER BY o_orderkey) AS l FROM orders GROUP BY 1), sheets AS (SELECT o_custkey, l, unnest(range(0, (len(l) + 29) // 30)) AS p FROM o)
SELECT 'c' || o_custkey || '.pdf' AS path, CAST(p + 2 AS INTEGER) AS page_number, 1 AS table_index, 'Table 1 (Page ' || (p + 2) || ')' AS caption, 'Order;Column_2' AS headers, array_to_string(l[30 * p + 1 : 30 * p + 30], ';') AS rows FROM sheets""")
def src_07_tables(t: Tables):
    """Ruled tables put together from lines and places."""
    found = pdf.tables(written(pdf.drawn(_order_pdfs(t)), "drawn"))
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, ":")), ";")
    return found.select("path", "page_number", "table_index", "caption", F.array_join("headers", ";").alias("headers"), rows.alias("rows"))


def _xls_files(t: Tables) -> DataFrame:
    """A legacy workbook per supplier: a sheet of one row a nation of its parity with all kinds of cells, one of rows by key, an empty one."""

    def made(names: pd.Series, amounts: pd.Series, counts: pd.Series) -> pd.Series:
        def one(name, amount, count):
            day = pd.Timestamp(2000, 2, 28).to_pydatetime() + pd.Timedelta(days=count).to_pytimedelta()
            report = [["Mine", None, "Day", "Open", "Share"], [name, float(amount), day, count % 2 == 0, count], [None] * 5, [name + " é日", -count, None, None, 0.5]]
            return xls.xls_bytes([("Report", report), ("Rows & more", [["No", "Name"], *([i, f"{name} {i % 7}"] for i in range(count))]), ("Nothing", [])])

        return pd.Series([one(n, float(a), int(c)) for n, a, c in zip(names, amounts, counts, strict=True)])

    count = (F.col("s_suppkey") % 250 + 1).cast("int")
    return spread(t.supplier).select(F.concat(F.lit("f"), "s_suppkey", F.lit(".xls")).alias("path"), F.pandas_udf(made, "binary")("s_name", F.col("s_acctbal").cast("double"), count).alias("content"))


_COUNT = "s_suppkey % 250 + 1"
_AMOUNT = "CASE WHEN s_acctbal::DOUBLE = floor(s_acctbal::DOUBLE) THEN CAST(CAST(s_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(s_acctbal::DOUBLE AS VARCHAR) END"
_ROW = f"s_name || ';' || {_AMOUNT} || ';' || strftime(DATE '2000-02-28' + CAST({_COUNT} AS INTEGER), '%Y-%m-%d') || ';' || CASE WHEN ({_COUNT}) % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END || ';' || ({_COUNT})"


@query("src_04_xls_tables", f"""
SELECT 'f' || s_suppkey || '.xls' AS path, 1 AS page_number, 1 AS part, 'Sheet: Report' AS caption, 'Mine;Col_2;Day;Open;Share' AS headers, {_ROW} || '/' || s_name || ' é日;' || -({_COUNT}) || ';;;0.5' AS rows, 1::BIGINT AS row_from, NULL AS error FROM supplier
UNION ALL SELECT 'f' || s_suppkey || '.xls', 2, CAST(p + 1 AS INTEGER), 'Sheet: Rows & more' || CASE WHEN p > 0 THEN ' (Part ' || (p + 1) || ')' ELSE '' END, 'No;Name', array_to_string(list_transform(range(100 * p, least(100 * p + 100, {_COUNT})), lambda i: i || ';' || s_name || ' ' || (i % 7)), '/'), 100 * p + 1, NULL FROM supplier, range(0, 3) r(p) WHERE 100 * p < {_COUNT}
UNION ALL SELECT 'f' || s_suppkey || '.xls', 3, 0, 'Sheet: Nothing (Empty)', '', '', 0, NULL FROM supplier""")
def src_04_tables(t: Tables):
    """All kinds of cells, rows in parts, an empty sheet."""
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, ";")), "/")
    return xls.xls_tables(_xls_files(t), part_rows=100).select("path", "page_number", "part", "caption", F.array_join("headers", ";").alias("headers"), rows.alias("rows"), "row_from", "error")


@query("src_04_xls_pages", f"""
SELECT 'f' || s_suppkey || '.xls' AS path, 1 AS page_number, concat_ws(chr(10), '# Sheet: Report [Legacy XLS]', 'Headers: Mine | Col_2 | Day | Open | Share', 'Data:', replace({_ROW}, ';', ' | '), s_name || ' é日 | ' || -({_COUNT}) || ' |  |  | 0.5') AS text FROM supplier
UNION ALL SELECT 'f' || s_suppkey || '.xls', 2, concat_ws(chr(10), '# Sheet: Rows & more [Legacy XLS]', 'Headers: No | Name', 'Data:', array_to_string(list_transform(range(0, least(100, {_COUNT})), lambda i: i || ' | ' || s_name || ' ' || (i % 7)), chr(10)), CASE WHEN {_COUNT} > 100 THEN '... (' || ({_COUNT} - 100) || ' more rows)' END) FROM supplier
UNION ALL SELECT 'f' || s_suppkey || '.xls', 3, 'Sheet: Nothing (Empty)' FROM supplier""")
def src_04_pages(t: Tables):
    return xls.xls_pages(xls.xls_tables(_xls_files(t))).drop("error")


def _damaged(t: Tables) -> DataFrame:
    """By key: a good and a cut-off PDF, XLSX, DOCX and XLS, and a good CSV, each as a file of its own."""

    def made(kinds: pd.Series, names: pd.Series) -> pd.Series:
        def one(kind, name):
            if kind.endswith("pdf"):
                data = pdf.pdf_bytes([([f"Supplier {name} stands in a file of its own"], [])], packed=True)
            elif kind.endswith("xlsx"):
                data = office.xlsx_bytes([("S", [["Name"], [name]], [])])
            elif kind.endswith("xls"):
                data = xls.xls_bytes([("S", [["Name"], [name]])])
            else:
                return f"Name,\n{name},1\n".encode()
            return data[: len(data) // 3] if kind.startswith("cut") else data

        return pd.Series([one(*x) for x in zip(kinds, names, strict=True)])

    kind = F.element_at(F.array(*map(F.lit, ("a.pdf", "cut.pdf", "a.xlsx", "cut.xlsx", "a.xls", "cut.xls", "a.csv"))), (F.col("s_suppkey") % 7 + 1).cast("int"))
    return spread(t.supplier).select(F.concat(F.col("s_suppkey").cast("string"), kind).alias("path"), F.pandas_udf(made, "binary")(kind, "s_name").alias("content"))


@query("src_03_damaged_files", """
SELECT s_suppkey || k AS path, p AS parser, CASE WHEN k NOT LIKE 'cut%' THEN 1 END AS page_number,
  CASE WHEN k = 'a.pdf' THEN 'Supplier ' || s_name || ' stands in a file of its own' WHEN k = 'a.xlsx' THEN concat_ws(chr(10), '# Sheet: S', 'Headers: Name', 'Data:', s_name) WHEN k = 'a.xls' THEN concat_ws(chr(10), '# Sheet: S [Legacy XLS]', 'Headers: Name', 'Data:', s_name) WHEN k = 'a.csv' THEN 'Name | Col_2' || chr(10) || s_name || ' | 1' END AS text, k LIKE 'cut%' AS failed
FROM supplier JOIN (VALUES (0, 'a.pdf', 'pdf'), (1, 'cut.pdf', 'pdf'), (2, 'a.xlsx', 'xlsx'), (3, 'cut.xlsx', 'xlsx'), (4, 'a.xls', 'xls'), (5, 'cut.xls', 'xls'), (6, 'a.csv', 'csv')) v(m, k, p) ON s_suppkey % 7 = m""")
def src_03_damaged(t: Tables):
    """Cut-off files come back with their errors, the good files beside them with their pages."""
    return readers.pages(_damaged(t)).select("path", "parser", "page_number", "text", F.col("error").isNotNull().alias("failed"))


@query("src_12_promotion", """
WITH f AS (SELECT s_suppkey, s_suppkey || (['a.csv', 'b.pdf', 'c.exe', 'd.csv'])[s_suppkey % 4 + 1] AS path, s_suppkey % 4 AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS batch FROM supplier)
SELECT batch, path, CASE WHEN batch = 'odd' THEN 'QUARANTINED' WHEN k = 0 THEN 'ADMITTED' ELSE 'REFUSED' END AS state, CASE k WHEN 1 THEN 'content does not match extension' WHEN 2 THEN 'denied extension' END AS reason, batch = 'even' AND k = 0 AS stored FROM f""")
def src_12_promotion(t: Tables):
    """Two batches taken in, one promoted: admitted files can be read back as they came, the other batch has none yet."""
    store = admission.Store(t.spark, f"{shared_folder(t.spark).rstrip('/')}/store-{uuid.uuid4().hex[:12]}")
    name = F.element_at(F.array(*map(F.lit, ("a.csv", "b.pdf", "c.exe", "d.csv"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    files = t.supplier.select("s_suppkey", F.concat(F.col("s_suppkey").cast("string"), name).alias("path"), F.encode("s_name", "UTF-8").alias("content"))
    for batch, rest in (("even", 0), ("odd", 1)):
        store.take_in(files.where(F.col("s_suppkey") % 2 == rest), batch)
    store.promote("even")
    stored = readers.binary_files(t.spark, f"{store.root}/accepted/*").select(F.element_at(F.split("path", "/"), -1).alias("path"), F.sha2("content", 256).alias("sha256"), F.lit(True).alias("here"))
    return store.state().join(stored, ["path", "sha256"], "left").select("batch", "path", "state", "reason", F.coalesce("here", F.lit(False)).alias("stored"))
