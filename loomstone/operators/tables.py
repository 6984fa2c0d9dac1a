"""Tables that run over pages: continuation scores, stitching, logical views, merged headers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.operators.folds import per_key

#: Weights of the continuation score, its thresholds, and the words it looks for.
BASE, REPEATED, IDENTICAL, HEADLESS, PARTIAL, CONTRADICT = 0.15, 0.35, 0.20, 0.25, 0.10, -0.40
CUE, SAME_CAPTION, TOP, ALIGNED, OTHER_CAPTION = 0.35, 0.25, 0.10, 0.10, -0.50
MERGE, REVIEW = 0.70, 0.35
SUMMARY_WORDS = ("total", "grand total", "summary", "sub-total", "sub total", "net total", "overall")
CUE_PATTERN = r"cont(?:inue)?d?\.?|continuation|part\s*\d+"
SCHEMA = "document_id string, page_number int, table_index int, caption string, headers array<string>, rows array<array<string>>, logical_table_id string, is_continuation boolean, part_number int, total_parts int, continuation_status string, continuation_confidence double, has_repeated_headers boolean"


def _norm(cells) -> list[str]:
    return [str(c).strip().lower() for c in cells]


def _jaccard(a: list[str], b: list[str]) -> float:
    return len(set(a) & set(b)) / max(len(set(a) | set(b)), 1)


def _numeric(cell) -> bool:
    return re.sub(r"[.,-]", "", str(cell)).isdigit()


def score(prev: dict, cur: dict) -> tuple[float, bool]:
    """(score, whether the first row repeats the header) of ``cur`` as the continuation of ``prev``; 0 behind a closed gate."""
    width = lambda t: len(t["headers"]) or (len(t["rows"][0]) if len(t["rows"]) else 0)
    caption = [(t["caption"] or "").strip().lower() for t in (prev, cur)]
    named = [re.search(r"table\s*(\d+)", c) for c in caption]
    last = " ".join(_norm(prev["rows"][-1])) if len(prev["rows"]) else ""
    gates = (
        cur["page_number"] == prev["page_number"] + 1,
        width(prev) == width(cur) != 0,
        not any(re.search(rf"\b{w}\b", last) for w in SUMMARY_WORDS),
        not (all(named) and named[0][1] != named[1][1]),
    )
    if not all(gates):
        return 0.0, False
    want, have = _norm(prev["headers"]), _norm(cur["headers"])
    first = _norm(cur["rows"][0]) if len(cur["rows"]) else []
    repeated = bool(first and want) and (first == want or _jaccard(want, first) >= 0.70)
    total = BASE
    if repeated:
        total += REPEATED
    elif not have:
        total += HEADLESS
    elif have == want:
        total += IDENTICAL
    else:
        near = _jaccard(want, have)
        total += PARTIAL if near >= 0.60 else CONTRADICT if near < 0.30 else 0.0
    cue = bool(caption[1]) and re.search(CUE_PATTERN, caption[1]) is not None
    total += CUE * cue
    total += SAME_CAPTION * (bool(caption[1]) and caption[0] == caption[1])
    total += TOP * (cur["table_index"] == 0)
    total += OTHER_CAPTION * (bool(caption[1]) and not cue and caption[0] != caption[1])
    if len(prev["rows"]) and len(cur["rows"]):
        sample = cur["rows"][1] if repeated and len(cur["rows"]) > 1 else cur["rows"][0]
        pairs = list(zip(prev["rows"][-1], sample, strict=False))
        total += ALIGNED * (sum(_numeric(a) == _numeric(b) for a, b in pairs) == width(prev))
    return min(max(round(total, 2), 0.0), 1.0), repeated


def stitched(tables: DataFrame) -> DataFrame:
    """Physical tables with the logical table they belong to, headers inherited and repeated header rows dropped.

    What one table inherits decides how the next one compares, so a document (a bounded group) is folded in one task.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for t in group.sort_values(["page_number", "table_index"]).to_dict("records"):
            t["headers"], t["rows"] = list(t["headers"] if t["headers"] is not None else []), [list(r) for r in (t["rows"] if t["rows"] is not None else [])]
            points, repeated = score(out[-1], t) if out else (0.0, False)
            t |= {"has_repeated_headers": False, "is_continuation": False, "continuation_status": "STANDALONE", "continuation_confidence": 1.0}
            t["logical_table_id"] = f"{t['document_id']}:{t['page_number']}:{t['table_index']}"
            if points >= MERGE:
                t |= {"is_continuation": True, "continuation_status": "AUTO_MERGED", "continuation_confidence": points, "logical_table_id": out[-1]["logical_table_id"], "has_repeated_headers": repeated}
                t["rows"] = t["rows"][1:] if repeated else t["rows"]
                t["headers"] = t["headers"] or list(out[-1]["headers"])
            elif points >= REVIEW:
                t |= {"continuation_status": "REVIEW_REQUIRED", "continuation_confidence": points}
            out.append(t)
        parts: dict[str, int] = {}
        for t in out:
            parts[t["logical_table_id"]] = t["part_number"] = parts.get(t["logical_table_id"], 0) + 1
        for t in out:
            t["total_parts"] = parts[t["logical_table_id"]]
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return per_key(tables, "document_id", fold, SCHEMA)


def logical(tables: DataFrame) -> DataFrame:
    """One row per logical table: rows in order, pages, least confidence, status of its parts."""
    part = F.struct("part_number", "rows", "page_number")
    return tables.groupBy("document_id", "logical_table_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["rows"])).alias("rows"), F.sort_array(F.collect_set("page_number")).alias("pages"),
        F.min("continuation_confidence").alias("confidence"), F.bool_or("has_repeated_headers").alias("has_repeated_headers"),
        F.when(F.bool_or(F.col("continuation_status") == "REVIEW_REQUIRED"), "REVIEW_REQUIRED").when(F.count("*") > 1, "MERGED").otherwise("STANDALONE").alias("status"),
    )


Merge = tuple[int, int, int, int]


def merged_headers(levels: list[list[str | None]], merges: list[Merge] = ()) -> list[str]:
    """Header names of several rows: merged cells (first row, first column, last row, last column, from one) carried over
    their ranges, levels joined, repeated names numbered by their column."""
    width = max(map(len, levels), default=0)
    grid = [["" if c is None else str(c).strip() for c in row] + [""] * (width - len(row)) for row in levels]
    for top, left, bottom, right in merges:
        if top <= len(grid) and left <= width and (value := grid[top - 1][left - 1]):
            for row in grid[top - 1 : bottom]:
                row[left - 1 : right] = [c or value for c in row[left - 1 : right]]
    names: list[str] = []
    for i, path in enumerate(zip(*grid, strict=True)):
        steps = [c for j, c in enumerate(path) if c and c != next((p for p in reversed(path[:j]) if p), None)]
        name = " | ".join(steps) or f"Col_{i + 1}"
        names.append(f"{name} [col={i + 1}]" if name in names else name)
    return names


def _is_number(cell) -> bool:
    return re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", re.sub(r"^[₹$€£\s]+", "", str(cell).strip()).replace(",", "").rstrip("%")) is not None


def is_data_row(cells: list[str | None], share: float = 0.40) -> bool:
    """At least ``share`` of the non-empty cells are numbers, with or without currency or percent sign."""
    full = [c for c in cells if c is not None and str(c).strip()]
    return bool(full) and sum(map(_is_number, full)) / len(full) >= share


def header_depth(rows: list[list[str | None]], merges: list[Merge] = (), most: int = 6) -> int:
    """Rows before the first data row where ranges are merged at the top (else as far as these reach); one without any."""
    top = [m for m in merges if m[0] <= most and (m[2] > m[0] or m[3] > m[1])]
    if not top:
        return 1
    first = next((i for i, r in enumerate(rows[: most + 2]) if is_data_row(r)), None)
    return min(most, max(1, max(m[2] for m in top) if first is None else first))
