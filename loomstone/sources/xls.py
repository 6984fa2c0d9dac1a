"""Legacy workbooks (XLS, BIFF8) as rows: sector chains of the compound file, then the workbook's record stream.

A file is read in one task; a sheet's rows are handed on as its records are read. A file that cannot be read, an encrypted
one and one of an older format come back with an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.sources.frames import frames
from loomstone.sources.office import DATE_FORMATS, PART_ROWS, SUMMARY_ROWS

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
#: Record kinds.
BOUNDSHEET, SST, CONTINUE, LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, FORMULA, STRING, DATEMODE, FORMAT, XF, FILEPASS, BOF, EOF = 0x85, 0xFC, 0x3C, 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207, 0x22, 0x41E, 0xE0, 0x2F, 0x809, 0x0A
#: Error codes of cells.
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
_END = 0xFFFFFFFA


class Compound:
    """Streams of a compound file by name."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a compound file")
        self.data, self.size, self.small = data, 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        directory, cutoff, first_small, _, next_table, _ = struct.unpack_from("<I4xIIIII", data, 48)
        tables = list(struct.unpack_from("<109I", data, 76))
        seen = set()
        while next_table < _END and next_table not in seen:
            seen.add(next_table)
            more = struct.unpack(f"<{self.size // 4}I", self._sector(next_table))
            tables += more[:-1]
            next_table = more[-1]
        self.next = [n for t in tables if t < _END for n in struct.unpack(f"<{self.size // 4}I", self._sector(t))]
        small_next = self._chain(first_small) if first_small < _END else b""
        self.small_next = struct.unpack(f"<{len(small_next) // 4}I", small_next)
        self.streams, root = {}, b""
        entries = self._chain(directory)
        for at in range(0, len(entries) - 127, 128):
            length, kind = struct.unpack_from("<HB", entries, at + 64)
            name, (start, size) = entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace"), struct.unpack_from("<II", entries, at + 116)
            if kind == 5:
                root = self._chain(start)[:size] if start < _END else b""
            elif kind == 2:
                self.streams[name.lower()] = (start, size, size < cutoff)
        self.root = root

    def _sector(self, n: int) -> bytes:
        found = self.data[(n + 1) * self.size : (n + 2) * self.size]
        if len(found) < self.size:
            found += bytes(self.size - len(found)) if found else b""
        if not found:
            raise ValueError("sector beyond the file")
        return found

    def _chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < _END:
            if n in seen or n >= len(self.next):
                raise ValueError("broken sector chain")
            seen.add(n)
            out.append(self._sector(n))
            n = self.next[n]
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        start, size, small = self.streams[name.lower()]
        if not small:
            return self._chain(start)[:size]
        out, seen = [], set()
        while start < _END:
            if start in seen or start >= len(self.small_next):
                raise ValueError("broken sector chain")
            seen.add(start)
            out.append(self.root[start * self.small : (start + 1) * self.small])
            start = self.small_next[start]
        return b"".join(out)[:size]


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes, int]]:
    """(kind, contents, place) from a place on."""
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        yield kind, data[at + 4 : at + 4 + size], at
        at += 4 + size


class _Strings:
    """Strings that may go on over CONTINUE records, each of which says anew how wide its characters are."""

    def __init__(self, parts: list[bytes], at: int = 0):
        self.parts, self.i, self.at = parts, 0, at

    def _take(self, n: int) -> bytes:
        out = b""
        while n > len(out):
            if self.i >= len(self.parts):
                raise ValueError("strings end early")
            piece = self.parts[self.i][self.at : self.at + n - len(out)]
            out, self.at = out + piece, self.at + len(piece)
            if self.at >= len(self.parts[self.i]) and len(out) < n:
                self.i, self.at = self.i + 1, 0
        return out

    def next(self) -> str:
        count, flags = struct.unpack("<HB", self._take(3))
        runs = struct.unpack("<H", self._take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self._take(4))[0] if flags & 4 else 0
        wide, out = flags & 1, []
        while count:
            if self.at >= len(self.parts[self.i]):
                self.i, self.at = self.i + 1, 1
                wide = self.parts[self.i][0] & 1
            width = 1 + wide
            n = min(count, (len(self.parts[self.i]) - self.at) // width)
            if not n:
                raise ValueError("strings end early")
            out.append(self._take(n * width).decode("utf-16-le" if wide else "latin-1", "replace") if not wide else self._take(n * width).decode("utf-16-le", "surrogatepass"))
            count -= n
        self._take(4 * runs + extra)
        return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _rk(value: int) -> float:
    """A number in 30 bits: whole or the upper half of a double, maybe a hundredth."""
    number = float(value >> 2 if value < 1 << 31 else (value - (1 << 32)) >> 2) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


class Book:
    """Sheets of a workbook and their rows of cell texts."""

    def __init__(self, data: bytes):
        files = Compound(data)
        if "encryptedpackage" in files.streams:
            raise ValueError("encrypted")
        if "workbook" not in files.streams:
            raise ValueError("no BIFF8 workbook")
        self.data, self.sheets, self.strings, formats, cells = files.stream("workbook"), [], [], {}, []
        self.epoch, shared, known = datetime(1899, 12, 30), None, 0
        for kind, body, _ in records(self.data):
            if kind == FILEPASS:
                raise ValueError("encrypted")
            if kind == SST:
                known, shared = struct.unpack_from("<I", body, 4)[0], [body]
            elif kind == CONTINUE and shared is not None:
                shared.append(body)
                continue
            elif kind == BOUNDSHEET:
                place, _, what = struct.unpack_from("<IBB", body)
                wide = body[7] & 1
                self.sheets.append((body[8 : 8 + body[6] * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace"), place, what))
            elif kind == DATEMODE and body[0]:
                self.epoch = datetime(1904, 1, 1)
            elif kind == FORMAT:
                number, count, wide = struct.unpack_from("<HHB", body)
                formats[number] = body[5 : 5 + count * (1 + (wide & 1))].decode("utf-16-le" if wide & 1 else "latin-1", "replace")
            elif kind == XF:
                cells.append(struct.unpack_from("<H", body, 2)[0])
            elif kind == EOF:
                break
            if kind not in (SST, CONTINUE) and shared is not None:
                self._read(shared, known)
                shared = None
        if shared is not None:
            self._read(shared, known)
        dated = {n for n, f in formats.items() if any(c in "ymdh" for c in _bare(f.lower()))}
        self.dates = {i for i, n in enumerate(cells) if n in DATE_FORMATS | dated}
        self.sheets = [(name, place) for name, place, what in self.sheets if what == 0]

    def _read(self, parts: list[bytes], count: int) -> None:
        reader = _Strings(parts, 8)
        self.strings = [reader.next() for _ in range(count)]

    def _number(self, value: float, style: int) -> str:
        if style in self.dates:
            return (self.epoch + timedelta(days=value)).strftime("%Y-%m-%d")
        return str(int(value)) if value.is_integer() else repr(value)

    def rows(self, place: int) -> Iterator[list[str]]:
        """Rows with a cell that is not empty, in order."""
        row, now, waiting = {}, -1, None
        for kind, body, _ in records(self.data, place):
            if kind == EOF:
                break
            if kind == STRING and waiting is not None:
                row[waiting] = _Strings([body]).next().strip()
                waiting = None
                continue
            if kind not in (LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, FORMULA):
                continue
            r, c, style = struct.unpack_from("<HHH", body)
            if r != now:
                if any(row.values()):
                    yield [row.get(i, "") for i in range(max(row) + 1)]
                row, now = {}, r
            if kind == LABELSST:
                row[c] = self.strings[struct.unpack_from("<I", body, 6)[0]].strip()
            elif kind == LABEL:
                row[c] = _Strings([body[6:]]).next().strip()
            elif kind == NUMBER:
                row[c] = self._number(struct.unpack_from("<d", body, 6)[0], style)
            elif kind == RK:
                row[c] = self._number(_rk(struct.unpack_from("<I", body, 6)[0]), style)
            elif kind == MULRK:
                for i in range((len(body) - 6) // 6):
                    style, value = struct.unpack_from("<HI", body, 4 + 6 * i)
                    row[c + i] = self._number(_rk(value), style)
            elif kind == BOOLERR:
                row[c] = ERRORS.get(body[6], "#ERR") if body[7] else ("TRUE" if body[6] else "FALSE")
            elif body[12:14] == b"\xff\xff":  # a formula whose result is no number
                waiting = c if body[6] == 0 else None
                row[c] = "" if body[6] in (0, 3) else ("TRUE" if body[8] else "FALSE") if body[6] == 1 else ERRORS.get(body[8], "#ERR")
            else:
                row[c] = self._number(struct.unpack_from("<d", body, 6)[0], style)
        if any(row.values()):
            yield [row.get(i, "") for i in range(max(row) + 1)]


def _bare(code: str) -> str:
    """A number format without its quoted, bracketed and escaped parts."""
    import re

    return re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)


XLS = "path string, page_number int, sheet_name string, part int, caption string, headers array<string>, rows array<array<string>>, row_from long, error string"


def _parts(path: str, data: bytes, part_rows: int) -> Iterator[tuple]:
    try:
        book = Book(data)
        for page, (name, place) in enumerate(book.sheets, 1):
            rows = book.rows(place)
            head = next(rows, None)
            if head is None:
                yield path, page, name, 0, f"Sheet: {name} (Empty)", [], [], 0, None
                continue
            headers, number = [h or f"Col_{i + 1}" for i, h in enumerate(head)], 0
            while (held := list(islice(rows, part_rows))) or not number:
                number += 1
                wide = [r[: len(headers)] + [""] * (len(headers) - len(r)) if len(r) < len(headers) else r for r in held]
                yield path, page, name, number, f"Sheet: {name}" + f" (Part {number})" * (number > 1), headers, wide, (number - 1) * part_rows + 1, None
    except Exception as e:  # whatever is wrong with a file is told as that file's error
        yield path, None, None, None, None, None, None, None, f"XLS cannot be read: {e or type(e).__name__}"


def xls_tables(files: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Sheets of legacy workbooks (path, content) as tables in parts: the first row is the header; see ``XLS``.

    An empty sheet has part 0. A file that cannot be read has one row with its error (after the sheets read before it).
    """

    def run(batches):
        yield from frames((row for b in batches for path, content in zip(b["path"], b["content"], strict=True) for row in _parts(path, bytes(content or b""), part_rows)), XLS)

    return files.select("path", "content").mapInPandas(run, XLS)


def xls_pages(sheets: DataFrame) -> DataFrame:
    """(path, page_number, text, error) of each sheet: its name, its headers and its first hundred rows."""
    parts = sheets.groupBy("path", "page_number").agg(F.first("sheet_name").alias("sheet_name"), F.min_by(F.struct("headers", "rows"), "part").alias("one"), F.max("part").alias("parts"), F.sum(F.size("rows")).alias("n"), F.first("error").alias("error"))
    line = lambda cells: F.array_join(cells, " | ")
    more = F.when(F.col("n") > SUMMARY_ROWS, F.array(F.format_string("... (%d more rows)", F.col("n") - SUMMARY_ROWS))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.array(F.format_string("# Sheet: %s [Legacy XLS]", "sheet_name"), F.concat(F.lit("Headers: "), line(F.col("one.headers"))), F.lit("Data:")), F.transform(F.slice("one.rows", 1, SUMMARY_ROWS), line), more), "\n")
    return parts.select("path", "page_number", F.when(F.col("parts") == 0, F.format_string("Sheet: %s (Empty)", "sheet_name")).otherwise(text).alias("text"), "error")


# writing ----------------------------------------------------------------------------------------------------------
def _record(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def _shared_strings(strings: list[str]) -> bytes:
    """The table of strings, cut into records of 8,224 bytes at most, within strings as well."""
    out, body = [], struct.pack("<II", len(strings), len(strings))
    most = 8224
    for s in strings:
        data = s.encode("utf-16-le", "surrogatepass")
        if len(body) + 3 > most:
            out.append(body)
            body = b""
        body += struct.pack("<HB", len(data) // 2, 1)
        while data:
            room = (most - len(body)) // 2 * 2
            body, data = body + data[:room], data[room:]
            if data:
                out.append(body)
                body = b"\x01"
    out.append(body)
    return b"".join(_record(SST if not i else CONTINUE, b) for i, b in enumerate(out))


def xls_bytes(sheets: list[tuple[str, list[list]]]) -> bytes:
    """A BIFF8 workbook of sheets (name, rows of None, text, number, boolean or datetime)."""
    strings: dict[str, int] = {}
    bodies = []
    for _, rows in sheets:
        out = [_record(BOF, struct.pack("<HHHHII", 0x600, 0x10, 0, 0, 0, 6))]
        for r, row in enumerate(rows):
            for c, v in enumerate(row):
                if isinstance(v, bool):
                    out.append(_record(BOOLERR, struct.pack("<HHHBB", r, c, 0, v, 0)))
                elif isinstance(v, datetime):
                    out.append(_record(NUMBER, struct.pack("<HHHd", r, c, 1, (v - datetime(1899, 12, 30)).total_seconds() / 86400)))
                elif isinstance(v, int) and -(1 << 29) <= v < 1 << 29:
                    out.append(_record(RK, struct.pack("<HHHI", r, c, 0, (v << 2 | 2) & 0xFFFFFFFF)))
                elif isinstance(v, int | float):
                    out.append(_record(NUMBER, struct.pack("<HHHd", r, c, 0, v)))
                elif v is not None:
                    out.append(_record(LABELSST, struct.pack("<HHHI", r, c, 0, strings.setdefault(v, len(strings)))))
        bodies.append(b"".join(out) + _record(EOF, b""))
    names = [n.encode("utf-16-le", "surrogatepass") for n, _ in sheets]
    head = _record(BOF, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 6)) + _record(XF, struct.pack("<HH16x", 0, 0)) + _record(XF, struct.pack("<HH16x", 0, 14))
    tail = _shared_strings(list(strings)) + _record(EOF, b"")
    place, bounds = len(head) + sum(12 + len(n) for n in names) + len(tail), b""
    for name, body in zip(names, bodies, strict=True):
        bounds += _record(BOUNDSHEET, struct.pack("<IBBBB", place, 0, 0, len(name) // 2, 1) + name)
        place += len(body)
    stream = head + bounds + tail + b"".join(bodies)
    stream += bytes(max(0, 4096 - len(stream)))
    sectors = -(-len(stream) // 512)
    tables = 1
    while tables * 128 < sectors + 1 + tables:
        tables += 1
    if tables > 109:
        raise ValueError("workbook too large to write")
    chain = [*range(1, sectors), 0xFFFFFFFE, 0xFFFFFFFE, *[0xFFFFFFFD] * tables]
    chain += [0xFFFFFFFF] * (tables * 128 - len(chain))
    entry = lambda name, kind, child, start, size: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBBIII16xIQQIQ", 2 * len(name) + 2, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, child, 0, 0, 0, start, size)
    directory = entry("Root Entry", 5, 1, 0xFFFFFFFE, 0) + entry("Workbook", 2, 0xFFFFFFFF, 0, len(stream)) + bytes(256)
    places = [sectors + 1 + i for i in range(tables)]
    header = MAGIC + bytes(16) + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, tables, sectors, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    header += struct.pack("<109I", *places, *[0xFFFFFFFF] * (109 - tables))
    return header + stream.ljust(sectors * 512, b"\0") + directory + struct.pack(f"<{tables * 128}I", *chain)
