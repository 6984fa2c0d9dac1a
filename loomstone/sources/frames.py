"""Rows that Python readers give, as DataFrames of a size that pays: one for many small files, several for a large one."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd

#: Rows of one DataFrame; cells of tables, and every thousand bytes of text, count as rows.
MOST_ROWS = 20_000
_TYPES = {"int": "Int32", "long": "Int64"}


def _size(value) -> int:
    if isinstance(value, str | bytes):
        return len(value) // 1000
    if isinstance(value, list):
        return sum(len(v) if isinstance(v, list) else 1 for v in value)
    return 0


def frames(rows: Iterable[tuple], schema: str, most: int = MOST_ROWS) -> Iterator[pd.DataFrame]:
    """``rows`` in the columns of ``schema``, gathered until they are ``most``; whole numbers may be missing."""
    columns = dict(c.split() for c in schema.split(", "))
    types = {c: _TYPES[t] for c, t in columns.items() if t in _TYPES}
    frame = lambda held: pd.DataFrame(held, columns=list(columns)).astype(types)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1 + sum(map(_size, row))
        if size >= most:
            yield frame(held)
            held, size = [], 0
    if held:
        yield frame(held)
