"""Figures: classes from words of their captions, figure numbers, boxes and their overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.numbers import clamp
from loomstone.operators.folds import in_buckets

ACCEPT = 0.70
#: Pattern, class, base confidence; a class adds 0.6 of each base, at most 1.
RULES = (
    (r"\bmine\s*plan\b", "MINE_PLAN", 0.75), (r"\bmine\s*layout\b", "MINE_PLAN", 0.65), (r"\bquarry\s*layout\b", "MINE_PLAN", 0.70),
    (r"\bcross[- ]?section\b", "CROSS_SECTION", 0.75), (r"\bsection\s+[A-Z][-–—][A-Z]['’]?\b", "CROSS_SECTION", 0.70),
    (r"\bgeological\s+section\b", "GEOLOGICAL_SECTION", 0.75), (r"\blitho\s*log\b", "GEOLOGICAL_SECTION", 0.65),
    (r"\bborehole\s*log\b", "BOREHOLE_LOG", 0.80), (r"\bbore\s*hole\b", "BOREHOLE_LOG", 0.55), (r"\bdrill\s*(?:ing)?\s*log\b", "BOREHOLE_LOG", 0.65),
    (r"\bstratigraph", "STRATIGRAPHIC_DIAGRAM", 0.75), (r"\bcolumnar\s+section\b", "STRATIGRAPHIC_DIAGRAM", 0.65),
    (r"\bgeological\s+map\b", "MAP", 0.85), (r"\btopograph", "MAP", 0.65), (r"\bindex\s*map\b", "MAP", 0.75), (r"\bmap\b", "MAP", 0.50),
    (r"\bbar\s*(?:chart|graph)\b", "CHART", 0.70), (r"\bpie\s*chart\b", "CHART", 0.75), (r"\bhistogram\b", "CHART", 0.70), (r"\bchart\b", "CHART", 0.45),
    (r"\bscatter\s*plot\b", "PLOT", 0.75), (r"\bplot\b", "PLOT", 0.45), (r"\bgraph\b", "PLOT", 0.40), (r"\btable\s*image\b", "TABLE_IMAGE", 0.70), (r"\btable\b", "TABLE_IMAGE", 0.35),
    (r"\btechnical\s+drawing\b", "TECHNICAL_DRAWING", 0.75), (r"\bblueprint\b", "TECHNICAL_DRAWING", 0.65), (r"\bschematic\b", "TECHNICAL_DRAWING", 0.55),
    (r"\bphotograph\b", "PHOTOGRAPH", 0.75), (r"\bphoto\b", "PHOTOGRAPH", 0.55), (r"\bplate\b", "PLATE", 0.55),
)
TYPES = tuple(dict.fromkeys(t for _, t, _ in RULES)) + ("UNKNOWN",)


def classified(visuals: DataFrame, text: Column) -> DataFrame:
    """``visuals`` with visual_type, confidence and review_status; on ties the class named first wins."""
    scores = []
    for i, kind in enumerate(TYPES[:-1]):
        hits = [F.when(text.rlike("(?i)" + p), F.lit(0.6 * base)).otherwise(0.0) for p, t, base in RULES if t == kind]
        total = hits[0]
        for h in hits[1:]:
            total = total + h
        scores.append(F.struct(F.least(F.lit(1.0), total).alias("score"), F.lit(-i).alias("first"), F.lit(kind).alias("kind")))
    best = F.array_max(F.array(*scores))
    out = visuals.withColumn("__b", best)
    kind = F.when(F.col("__b.score") > 0, F.col("__b.kind")).otherwise("UNKNOWN")
    conf = F.round(clamp(F.col("__b.score")), 6)
    return out.withColumns({"visual_type": kind, "confidence": conf, "review_status": F.when((kind != "UNKNOWN") & (conf >= ACCEPT), "ACCEPTED").otherwise("REVIEW_REQUIRED")}).drop("__b")


def taxonomy(kind: Column) -> Column:
    up = F.upper(F.trim(kind))
    return F.when(up.isin(*TYPES), up).otherwise("UNKNOWN")


def figure(text: Column) -> Column:
    """struct<number, caption>: the figure's number and the first sentence of its caption (250 characters at most)."""
    number = F.regexp_extract(text, r"(?i)(?:(?:Figure|Fig\.?)\s*\d+(?:\.\d+)?[a-zA-Z]?|Plate\s+(?:[IVXLCDM]+|\d+)|(?:Map|Chart|Diagram|Drawing|Photo(?:graph)?)\s+\d+(?:\.\d+)?)", 0)
    caption = F.trim(F.regexp_extract(text, r"(?i)(?:Figure|Fig\.?|Plate|Map|Chart|Diagram|Drawing|Photo(?:graph)?)\s*(?:\d+(?:\.\d+)?[a-zA-Z]?|[IVXLCDM]+)\s*[:.\-–—]?\s*([^\n]+)", 1))
    first = F.when(F.instr(caption, ". ") > 0, F.substring(caption, F.lit(1), F.instr(caption, ". "))).otherwise(caption)
    return F.struct(F.nullif(F.trim(number), F.lit("")).alias("number"), F.nullif(F.substring(first, 1, 250), F.lit("")).alias("caption"))


def repaired(box: Column) -> Column:
    """Corners in order and not negative."""
    pos = lambda c: F.greatest(F.lit(0.0), F.when(F.isnan(c), 0.0).otherwise(F.coalesce(c, F.lit(0.0))))
    x0, y0, x1, y1 = (pos(box[c]) for c in ("x0", "y0", "x1", "y1"))
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda c: (c["x1"] - c["x0"]) * (c["y1"] - c["y0"])
    least = F.least(area(a), area(b))
    return F.when(least > 0, w * h / least).otherwise(0.0)


def clusters(rects: DataFrame, *, page: str, gap: float = 15.0) -> DataFrame:
    """Rectangles of a page joined while they lie within ``gap`` of a group's box: (page, x0, y0, x1, y1, members).

    Joining depends on the box grown so far, so a page (a bounded group) is folded in one task.
    """

    def near(a: list[float], b: list[float]) -> bool:
        return a[0] <= b[2] + gap and b[0] <= a[2] + gap and a[1] <= b[3] + gap and b[1] <= a[3] + gap

    def fold(group):
        import pandas as pd

        pages: dict = {}
        for name, x0, y0, x1, y1 in group.sort_values(["y0", "x0", "y1", "x1"])[[page, "x0", "y0", "x1", "y1"]].itertuples(index=False):
            boxes, new = pages.setdefault(name, []), [x0, y0, x1, y1, 1]
            while (other := next((b for b in boxes if near(new, b)), None)) is not None:
                boxes.remove(other)
                new = [min(new[0], other[0]), min(new[1], other[1]), max(new[2], other[2]), max(new[3], other[3]), new[4] + other[4]]
            boxes.append(new)
        return pd.DataFrame([(name, *b) for name, boxes in pages.items() for b in boxes], columns=[page, "x0", "y0", "x1", "y1", "members"])

    kind = dict(rects.dtypes)[page]
    return in_buckets(rects, page, fold, f"`{page}` {kind}, x0 double, y0 double, x1 double, y1 double, members long")


def kept(groups: DataFrame, page_area: float, *, least: int = 5) -> DataFrame:
    """Groups of 3 to 95 percent of the page with ``least`` members."""
    share = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / page_area
    return groups.where(share.between(0.03, 0.95) & (F.col("members") >= least))
