"""Workbooks (XLSX) and documents (DOCX) as rows, and documents rendered from rows; zip and XML of the standard library.

A file is read in one task: sheets as streams in parts of ``PART_ROWS`` rows, so that memory follows the part.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import chain, islice
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators import tables
from loomstone.sources.frames import frames

PART_ROWS, PEEK_ROWS, SUMMARY_ROWS = 2000, 12, 100
#: A text of more characters is cut into virtual pages, each closed by a heading after so many characters.
LONG_TEXT, PAGE_TEXT = 3000, 2500
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Built-in number formats that show a date or a time.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _targets(book: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relationship ids of a part: (type, path in the archive)."""
    folder, name = posixpath.split(part)
    try:
        root = ET.fromstring(book.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return {}
    where = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
    return {r.get("Id"): (r.get("Type", "").rsplit("/", 1)[-1], where(r.get("Target", ""))) for r in root}


#: Bytes that an archive may unpack to.
MOST_UNPACKED = 1 << 30


def _opened(data: bytes) -> zipfile.ZipFile:
    """The archive of an office file, unless it is encrypted or would unpack to too much."""
    if data[:4] == b"\xd0\xcf\x11\xe0":
        raise ValueError("encrypted, or of an older format")
    book = zipfile.ZipFile(io.BytesIO(data))
    parts = book.infolist()
    if any(i.flag_bits & 1 for i in parts):
        raise ValueError("encrypted")
    if sum(i.file_size for i in parts) > MOST_UNPACKED:
        raise ValueError("unpacks to too many bytes")
    return book


def _reason(kind: str, e: Exception) -> str:
    return f"{kind} cannot be read: {e or type(e).__name__}"


class Workbook:
    """Sheets of one XLSX file: names, merged ranges, and rows as lists of cell texts (None where empty)."""

    def __init__(self, data: bytes):
        self.zip = _opened(data)
        rels = _targets(self.zip, "xl/workbook.xml")
        root = ET.fromstring(self.zip.read("xl/workbook.xml"))
        self.sheets = [(s.get("name"), rels[s.get(f"{_REL}id")][1]) for s in root.iter() if _local(s.tag) == "sheet"]
        self.epoch = datetime(1904, 1, 1) if any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root.iter()) else datetime(1899, 12, 30)
        self.strings = self._strings()
        self.dates = self._date_styles()

    def _strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        root = ET.fromstring(self.zip.read("xl/sharedStrings.xml"))
        return ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in root if _local(si.tag) == "si"]

    def _date_styles(self) -> set[int]:
        if "xl/styles.xml" not in self.zip.namelist():
            return set()
        root = ET.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")) for f in root.iter() if _local(f.tag) == "numFmt" and re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))}
        cells = next((x for x in root if _local(x.tag) == "cellXfs"), ())
        return {i for i, x in enumerate(cells) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}

    def layout(self, part: str) -> tuple[list[tuple[int, int, int, int]], int]:
        """(first row, first column, last row, last column) of merged ranges, from one, and the stated width (0 if none)."""
        out, width = [], 0
        with self.zip.open(part) as f:
            for _, e in ET.iterparse(f):
                kind = _local(e.tag)
                if kind in ("mergeCell", "dimension"):
                    a, _, b = e.get("ref").partition(":")
                    box = (*_place(a), *_place(b or a))
                    if kind == "dimension":
                        width = box[3]
                    else:
                        out.append(box)
                elif kind == "row":
                    e.clear()
        return out, width

    def _value(self, cell: ET.Element) -> str | None:
        kind, text = cell.get("t", "n"), next((c.text for c in cell if _local(c.tag) == "v"), None)
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
        if text is None:
            return None
        if kind == "s":
            return self.strings[int(text)]
        if kind == "b":
            return str(text == "1")
        if kind != "n":
            return text
        if int(cell.get("s", 0)) in self.dates:
            return str(self.epoch + timedelta(days=float(text)))
        number = float(text)
        return str(int(number)) if number.is_integer() and re.fullmatch(r"[+-]?\d+", text) else repr(number)

    def rows(self, part: str) -> Iterator[list[str | None]]:
        """Rows with a cell in them."""
        with self.zip.open(part) as f:
            for _, e in ET.iterparse(f):
                if _local(e.tag) != "row":
                    continue
                row: list[str | None] = []
                for cell in e:
                    column = _place(cell.get("r"))[1] - 1 if cell.get("r") else len(row)
                    row += [None] * (column - len(row))
                    row.append(self._value(cell))
                e.clear()
                if any(c is not None for c in row):
                    yield row


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits), column


XLSX = "path string, page_number int, sheet_name string, part int, caption string, header_depth int, headers array<string>, raw_headers array<string>, rows array<array<string>>, row_from long"


def _sheet_parts(data: bytes, part_rows: int) -> Iterator[tuple]:
    book = Workbook(data)
    for page, (name, part) in enumerate(book.sheets, 1):
        merges, width = book.layout(part)
        rows = (r + [None] * (width - len(r)) for r in book.rows(part))
        peek = list(islice(rows, PEEK_ROWS))
        if not peek:
            yield page, name, 0, f"Sheet: {name} (Empty)", 0, [], [], [], 0
            continue
        depth = tables.header_depth(peek, merges)
        headers = tables.merged_headers(peek[:depth], merges)
        raw = [(str(c).strip() if c is not None else "") or h for c, h in zip([*peek[depth - 1], *[None] * len(headers)], headers, strict=False)]
        rows = chain(peek[depth:], rows)
        number = 0
        while True:
            held = [[*(("" if c is None else c.strip()) for c in r[: len(headers)]), *[""] * (len(headers) - len(r))] for r in islice(rows, part_rows)]
            if number and not held:
                break
            number += 1
            yield page, name, number, f"Sheet: {name}" + f" (Part {number})" * (number > 1), depth, headers, raw, held, (number - 1) * part_rows + 1
            if len(held) < part_rows:
                break


def xlsx_parts(files: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Sheets of workbooks (path, content) as tables in parts; an empty sheet has part 0 without headers.

    Header rows are those before the first row of numbers where ranges are merged, else one. Rows are as wide as the header.
    A file that is damaged, encrypted or too large has a row with its ``error``, after the parts read before it.
    """

    def parts(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    for row in _sheet_parts(bytes(content or b""), part_rows):
                        yield path, *row, None
                except Exception as e:  # whatever is wrong with a file is told as that file's error
                    yield path, *[None] * 9, _reason("XLSX", e)

    schema = XLSX + ", error string"
    return files.select("path", "content").mapInPandas(lambda batches: frames(parts(batches), schema), schema)


def xlsx_tables(files: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The parts of ``xlsx_parts`` that could be read."""
    return xlsx_parts(files, part_rows).where("error IS NULL").drop("error")


def xlsx_pages(sheets: DataFrame) -> DataFrame:
    """(path, page_number, text) of each sheet: its name, its headers and its first hundred rows; errors, where given, stay."""
    told = [F.first("error").alias("error")] if "error" in sheets.columns else []
    parts = sheets.groupBy("path", "page_number").agg(F.first("sheet_name").alias("sheet_name"), F.min_by(F.struct("headers", "rows"), "part").alias("one"), F.max("part").alias("parts"), F.sum(F.size("rows")).alias("n"), *told)
    line = lambda cells: F.array_join(cells, " | ")
    shown = F.transform(F.slice("one.rows", 1, SUMMARY_ROWS), line)
    more = F.when(F.col("n") > SUMMARY_ROWS, F.array(F.format_string("... (%d more rows)", F.col("n") - SUMMARY_ROWS))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.array(F.concat(F.lit("# Sheet: "), "sheet_name"), F.concat(F.lit("Headers: "), line(F.col("one.headers"))), F.lit("Data:")), shown, more), "\n")
    return parts.select("path", "page_number", F.when(F.col("parts") == 0, F.concat(F.lit("Sheet: "), "sheet_name", F.lit(" (Empty)"))).otherwise(text).alias("text"), *parts.columns[6:])


class Document:
    """Paragraphs, tables and images of one DOCX file."""

    def __init__(self, data: bytes):
        self.zip = _opened(data)
        self.body = ET.fromstring(self.zip.read("word/document.xml")).find(f"{_W}body")
        self.headings = set()
        if "word/styles.xml" in self.zip.namelist():
            for s in ET.fromstring(self.zip.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                if name is not None and name.get(f"{_W}val", "").lower().startswith("heading"):
                    self.headings.add(s.get(f"{_W}styleId"))

    @staticmethod
    def _text(p: ET.Element) -> str:
        pieces = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n", f"{_W}cr": lambda e: "\n"}
        return "".join(pieces[e.tag](e) for r in p.iter(f"{_W}r") for e in r if e.tag in pieces)

    def pages(self) -> list[str]:
        lines = []
        for p in self.body.findall(f"{_W}p"):
            if text := self._text(p).strip():
                style = p.find(f"{_W}pPr/{_W}pStyle")
                lines.append(f"\n## {text}\n" if style is not None and style.get(f"{_W}val") in self.headings else text)
        whole = "\n".join(lines)
        if len(whole) <= LONG_TEXT:
            return [whole]
        out, held, size = [], [], 0
        for line in whole.split("\n"):
            held.append(line)
            size += len(line)
            if size > PAGE_TEXT and line.startswith("##"):
                out.append("\n".join(held))
                held, size = [], 0
        return [*out, "\n".join(held)] if held else out

    def tables(self) -> list[list[list[str]]]:
        out = []
        for t in self.body.findall(f"{_W}tbl"):
            rows: list[list[str]] = []
            for r in t.findall(f"{_W}tr"):
                cells: list[str] = []
                for c in r.findall(f"{_W}tc"):
                    text = "\n".join(self._text(p) for p in c.findall(f"{_W}p")).strip()
                    span, down = c.find(f"{_W}tcPr/{_W}gridSpan"), c.find(f"{_W}tcPr/{_W}vMerge")
                    if down is not None and down.get(f"{_W}val") != "restart" and rows and len(cells) < len(rows[-1]):
                        text = rows[-1][len(cells)]
                    cells += [text] * (int(span.get(f"{_W}val")) if span is not None else 1)
                rows.append(cells)
            if rows:
                out.append(rows)
        return out

    def images(self) -> list[tuple[str, int, int, bytes]]:
        """(relationship, width, height, bytes) of embedded images whose size can be read."""
        found = []
        for name, (kind, at) in sorted(_targets(self.zip, "word/document.xml").items()):
            if kind == "image" and at in self.zip.namelist() and (size := image_size(data := self.zip.read(at))):
                found.append((name, *size, data))
        return found


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG or JPEG, None for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def _documents(files: DataFrame, rows_of, schema: str, errors: bool = False) -> DataFrame:
    """Rows of each document; with ``errors`` a file that cannot be read has one row with its error."""
    schema += ", error string"

    def read(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    found = list(rows_of(Document(bytes(content or b""))))
                except Exception as e:  # whatever is wrong with a file is told as that file's error
                    yield path, *[None] * (schema.count(", ") - 1), _reason("DOCX", e)
                else:
                    yield from ((path, *row, None) for row in found)

    rows = files.select("path", "content").mapInPandas(lambda batches: frames(read(batches), schema), schema)
    return rows if errors else rows.where("error IS NULL").drop("error")


def docx_pages(files: DataFrame, errors: bool = False) -> DataFrame:
    """(path, page_number, text): headings as "## " lines, long texts cut into virtual pages at headings.

    With ``errors`` also (path, error) of the files that cannot be read.
    """
    return _documents(files, lambda d: enumerate(d.pages(), 1), "path string, page_number int, text string", errors)


def docx_tables(files: DataFrame) -> DataFrame:
    """(path, table_index, caption, headers, rows): the first row is the header."""
    rows_of = lambda d: [(i, f"DOCX Table {i}", [c.strip() or f"Col_{j + 1}" for j, c in enumerate(t[0])], t[1:]) for i, t in enumerate(d.tables(), 1)]
    return _documents(files, rows_of, "path string, table_index int, caption string, headers array<string>, rows array<array<string>>")


def docx_images(files: DataFrame) -> DataFrame:
    """(path, figure_number, rel_id, width, height, content) of embedded images."""
    rows_of = lambda d: [(f"DOCX Figure {i}", *image) for i, image in enumerate(d.images(), 1)]
    return _documents(files, rows_of, "path string, figure_number string, rel_id string, width int, height int, content binary")


# writing ----------------------------------------------------------------------------------------------------------
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006"


def archive(parts: dict[str, str]) -> bytes:
    """A zip of XML parts; equal parts give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _HEAD + body)
    return out.getvalue()


def _package(main: str, kind: str, rels: list[tuple[str, str]], overrides: dict[str, str]) -> dict[str, str]:
    """The parts every office file has: content types, and relationships of the package and of its main part."""
    kinds = "".join(f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for p, t in {main: kind, **overrides}.items())
    folder, name = posixpath.split(main)
    own = "".join(f'<Relationship Id="rId{i}" Type="{_DOC}/relationships/{t}" Target="{at}"/>' for i, (t, at) in enumerate(rels, 1))
    return {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_DOC}/relationships/officeDocument" Target="{main}"/></Relationships>',
        f"{folder}/_rels/{name}.rels": f'<Relationships xmlns="{_RELS}">{own}</Relationships>',
    }


def xlsx_bytes(sheets: list[tuple[str, list[list], list[str]]]) -> bytes:
    """A workbook of (name, rows, merged ranges); texts inline, numbers and booleans typed, None empty."""

    def cell(v, at: str) -> str:
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    letters = lambda i: (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)
    names = [f"worksheets/sheet{i}.xml" for i in range(1, len(sheets) + 1)]
    parts = _package("xl/workbook.xml", "spreadsheetml.sheet.main", [("worksheet", n) for n in names], {f"xl/{n}": "spreadsheetml.worksheet" for n in names})
    main = f'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{_DOC}/relationships"'
    parts["xl/workbook.xml"] = f"<workbook {main}><sheets>" + "".join(f'<sheet name="{escape(s[0], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets, 1)) + "</sheets></workbook>"
    for name, (_, rows, merges) in zip(names, sheets, strict=True):
        body = "".join(f'<row r="{i}">' + "".join(cell(v, f"{letters(j)}{i}") for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
        size = f'<dimension ref="A1:{letters(max(map(len, rows)) - 1)}{len(rows)}"/>' if rows else ""
        joined = f'<mergeCells count="{len(merges)}">' + "".join(f'<mergeCell ref="{m}"/>' for m in merges) + "</mergeCells>" if merges else ""
        parts[f"xl/{name}"] = f"<worksheet {main}>{size}<sheetData>{body}</sheetData>{joined}</worksheet>"
    return archive(parts)


def docx_bytes(blocks: list[tuple[str, str | None, list[list[str]] | None]]) -> bytes:
    """A document of blocks: ("heading", text, None), ("text", text, None) or ("table", None, rows with the header first)."""
    run = lambda text: f'<w:r><w:t xml:space="preserve">{escape(text or "")}</w:t></w:r>'
    out = []
    for kind, text, rows in blocks:
        if kind == "table":
            lines = "".join("<w:tr>" + "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in r) + "</w:tr>" for r in rows or [])
            out.append(f"<w:tbl><w:tblPr/><w:tblGrid>{'<w:gridCol/>' * len((rows or [[]])[0])}</w:tblGrid>{lines}</w:tbl>")
        else:
            style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' if kind == "heading" else ""
            out.append(f"<w:p>{style}{run(text)}</w:p>")
    space = f'xmlns:w="{_W[1:-1]}"'
    parts = _package("word/document.xml", "wordprocessingml.document.main", [("styles", "styles.xml")], {"word/styles.xml": "wordprocessingml.styles"})
    parts["word/document.xml"] = f"<w:document {space}><w:body>{''.join(out)}</w:body></w:document>"
    parts["word/styles.xml"] = f'<w:styles {space}><w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>'
    return archive(parts)


BLOCK = "array<struct<kind:string,text:string,rows:array<array<string>>>>"


def render_docx(reports: DataFrame, *, blocks: str = "blocks") -> DataFrame:
    """``reports`` with content (a DOCX file of its ``blocks``, of type ``BLOCK``), n_bytes and sha256; equal blocks, equal bytes."""

    @F.pandas_udf("binary")
    def rendered(column: pd.Series) -> pd.Series:
        return column.map(lambda rows: docx_bytes([(b["kind"], b["text"], None if b["rows"] is None else [list(r) for r in b["rows"]]) for b in rows]))

    made = reports.withColumn("content", rendered(F.col(blocks).cast(BLOCK)))
    return made.withColumns({"n_bytes": F.length("content").cast("long"), "sha256": F.sha2("content", 256)})



def blocks_of(title: Column, fields: Column) -> Column:
    """Blocks of a report: its title, then one table of its fields (an array of arrays of texts, header first)."""
    block = lambda kind, text, rows: F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"), rows.cast("array<array<string>>").alias("rows"))
    return F.array(block("heading", title, F.lit(None)), block("table", F.lit(None), fields))
