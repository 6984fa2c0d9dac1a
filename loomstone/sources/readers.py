"""Files of several formats as rows: CSV with sniffed separators, texts as pages, admission by content, external systems."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PART_ROWS = 2000
MOST_BYTES = 100 << 20
ALLOWED = ("pdf", "docx", "xlsx", "xls", "csv", "txt", "png", "jpg", "jpeg", "tif", "tiff")
DENIED = ("exe", "dll", "bat", "cmd", "sh", "js", "jar", "msi", "ps1", "php")
#: How files of each type begin, in hexadecimal.
MAGIC = {"pdf": ("25504446",), "docx": ("504B0304",), "xlsx": ("504B0304",), "xls": ("D0CF11E0A1B11AE1",), "png": ("89504E470D0A1A0A",), "jpg": ("FFD8FF",), "jpeg": ("FFD8FF",), "tif": ("49492A00", "4D4D002A"), "tiff": ("49492A00", "4D4D002A")}
PARSERS = (("pdf", ("pdf",)), ("docx", ("docx",)), ("xlsx", ("xlsx",)), ("xls", ("xls",)), ("csv", ("csv",)), ("text", ("txt", "md", "log")), ("image", ("png", "jpg", "jpeg", "tif", "tiff")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def parser(path: Column) -> Column:
    """The first parser that takes the file, null if none does."""
    ext = extension(path)
    return F.coalesce(*[F.when(ext.isin(*exts), F.lit(name)) for name, exts in PARSERS])


def admitted(files: DataFrame) -> DataFrame:
    """Files (path, length, content) with the reason against each, if any, and a content hash."""
    ext, head = extension(F.col("path")), F.hex(F.substring("content", 1, 8))
    known = [F.when(ext == e, F.exists(F.array(*map(F.lit, starts)), lambda s: F.startswith(head, s))) for e, starts in MAGIC.items()]
    real = F.coalesce(*known, F.lit(True))
    reason = F.when(ext.isin(*DENIED), "denied extension").when(~ext.isin(*ALLOWED), "unknown extension").when(F.col("length") > MOST_BYTES, "too large").when(F.col("length") == 0, "empty").when(~real, "content does not match extension")
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), reason.alias("reason"))


def sniff(sample: str) -> str:
    """The separator of a CSV sample: of comma, tab, semicolon and pipe the one that cuts lines most evenly."""
    try:
        return csv.Sniffer().sniff(sample, delimiters=",\t;|").delimiter
    except csv.Error:
        return max(",\t;|", key=lambda d: (sample.count(d), -",\t;|".index(d)))


def decoded(data: bytes) -> str:
    for encoding in ("utf-8", "utf-8-sig", "latin-1"):
        try:
            text = data.decode(encoding)
            return text.removeprefix("﻿")
        except UnicodeDecodeError:
            continue
    return data.decode("cp1252", "replace")


TABLE = "path string, part int, headers array<string>, rows array<array<string>>, row_from long"


def csv_tables(files: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """CSV files (path, content) as tables in parts: first row the header, blank rows skipped, cells trimmed."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                text = decoded(bytes(content))
                rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text), delimiter=sniff(text[:8192])) if any(c.strip() for c in r)]
                if not rows:
                    continue
                headers = [h or f"Col_{i + 1}" for i, h in enumerate(rows[0])]
                for at in range(0, max(1, len(rows) - 1), part_rows):
                    out.append((path, at // part_rows + 1, headers, rows[1 + at : 1 + at + part_rows], at + 1))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TABLE.split(", ")])

    return files.select("path", "content").mapInPandas(run, TABLE)


def csv_pages(files: DataFrame) -> DataFrame:
    """(path, page_number, text): a CSV file's parts as lines."""
    line = lambda cells: F.array_join(cells, " | ")
    return csv_tables(files).select("path", F.col("part").alias("page_number"), F.array_join(F.concat(F.array(line(F.col("headers"))), F.transform("rows", line)), "\n").alias("text"))


def text_pages(files: DataFrame) -> DataFrame:
    """(path, page_number, text): a text file as one page; virtual pages are cut by ``chunking.virtual_pages``."""

    def run(batches):
        for b in batches:
            yield b.assign(page_number=1, text=[decoded(bytes(c)) for c in b["content"]])[["path", "page_number", "text"]]

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, text string")


def pages(files: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """(path, parser, page_number, text, error) of files (path, content), each by the first parser that takes it.

    CSV, text, XLSX, DOCX, PDF and legacy XLS are built in. Images need a parser given by its name (files to path,
    page_number, text and, if it likes, error); without one their files come back with an error instead of pages. A file
    that its parser cannot read comes back with that error, and the others with their pages.
    """
    from loomstone.sources import office, pdf, xls

    known = {
        "csv": csv_pages, "text": text_pages, "xlsx": lambda f: office.xlsx_pages(office.xlsx_parts(f)), "docx": lambda f: office.docx_pages(f, errors=True),
        "pdf": lambda f: pdf.pages(f).select("path", "page_number", "text", "error"), "xls": lambda f: xls.xls_pages(xls.xls_tables(f)), **(parsers or {}),
    }
    named = files.select("path", "content", parser(F.col("path")).alias("parser"))
    refusal = F.when(F.col("parser").isNull(), "no parser takes this file").otherwise(F.concat(F.lit("parser is not available: "), "parser"))
    out = named.where(F.col("parser").isNull() | ~F.col("parser").isin(*known)).select("path", "parser", F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("text"), refusal.alias("error"))
    for name, parse in known.items():
        got = parse(named.where(F.col("parser") == name).select("path", "content"))
        error = F.col("error") if "error" in got.columns else F.lit(None).cast("string").alias("error")
        out = out.unionByName(got.select("path", F.lit(name).alias("parser"), "page_number", "text", error))
    return out


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


class ExternalRecords(DataSource):
    """Records of an external system: ``spark.read.format("external_records").option("system", ...)``.

    Options: system (sap, coalnet or dms), since (only records changed after this day number) and ``exports``, a shared
    folder of JSON-lines files that the system exported (record_id, changed_day and any other fields), one task a file.
    Without a system or a folder it fails closed. As a stream it reads exports day by day (``_ExternalStream``).
    """

    SYSTEMS = {"sap": "production", "coalnet": "dispatch", "dms": "document"}

    @classmethod
    def name(cls) -> str:
        return "external_records"

    def schema(self) -> str:
        return "system string, record_id string, record_type string, changed_day int, data map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        return _ExternalReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ExternalStream(self.options)


class _ExternalReader(DataSourceReader):
    def __init__(self, options):
        self.system, self.since, self.exports = options.get("system"), int(options.get("since", -1)), options.get("exports")
        if self.system not in ExternalRecords.SYSTEMS or not self.exports:
            raise ValueError(f"external system is not configured: {self.system}")

    def partitions(self):
        from pyarrow import fs

        disk, root = fs.FileSystem.from_uri(self.exports)
        found = disk.get_file_info(fs.FileSelector(root, recursive=True))
        return [InputPartition(f.path) for f in found if f.is_file and f.path.endswith((".json", ".jsonl"))]

    def _exported(self, path: str) -> Iterator[tuple]:
        import json

        from pyarrow import fs

        disk, _ = fs.FileSystem.from_uri(self.exports)
        with disk.open_input_stream(path) as f:
            for line in io.TextIOWrapper(f, "utf-8"):
                if line.strip():
                    row = json.loads(line)
                    day = int(row.pop("changed_day", 0))
                    if day > self.since:
                        yield self.system, str(row.pop("record_id")), ExternalRecords.SYSTEMS[self.system], day, {k: None if v is None else str(v) for k, v in row.items()}

    def read(self, partition) -> Iterator[tuple]:
        yield from self._exported(partition.value)


class _ExternalStream(DataSourceStreamReader):
    """Exports as a stream: files below ``exports`` in folders named by day (``day=N``), as they come.

    An offset is the last day with files and the files of that day that are there; an earlier day's files are complete when a
    later day has any, and files do not change. So an offset stays small, and between two of them lie exact files: a batch that
    is run again after a restart reads the same ones.
    """

    def __init__(self, options):
        self.files = _ExternalReader(options)

    def _days(self) -> dict[int, list[str]]:
        from pyarrow import fs

        disk, root = fs.FileSystem.from_uri(self.files.exports)
        days: dict[int, list[str]] = {}
        for f in disk.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            parts = f.path.removeprefix(root).strip("/").split("/")
            if f.is_file and len(parts) == 2 and parts[0].startswith("day=") and not parts[1].startswith((".", "_")) and parts[1].endswith((".json", ".jsonl")):
                days.setdefault(int(parts[0][4:]), []).append(parts[1])
        return {d: sorted(names) for d, names in sorted(days.items())}

    def initialOffset(self) -> dict:
        return {"day": -1, "files": []}

    def latestOffset(self) -> dict:
        days = self._days()
        return {"day": max(days), "files": days[max(days)]} if days else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        from pyarrow import fs

        _, root = fs.FileSystem.from_uri(self.files.exports)
        out = []
        for day, names in self._days().items():
            if start["day"] <= day <= end["day"]:
                before = start["files"] if day == start["day"] else []
                upto = end["files"] if day == end["day"] else names
                out += [InputPartition(f"{root}/day={day}/{n}") for n in names if n in upto and n not in before]
        return out

    def read(self, partition) -> Iterator[tuple]:
        yield from self.files._exported(partition.value)

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the system owns its exports."""
