"""Borehole strata: intervals from texts and tables, lithology names, interval checks, sequence anomalies, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of lithologies and what they are called.
LITHOLOGY = {
    "carbonaceous shale": "Shale", "carb shale": "Shale", "carb. shale": "Shale", "coaly shale": "Shale", "shaly coal": "Coal",
    "shaley coal": "Coal", "coal": "Coal", "coarse grained sandstone": "Sandstone", "coarse sandstone": "Sandstone",
    "fine grained sandstone": "Sandstone", "fine-grained sandstone": "Sandstone", "fine sandstone": "Sandstone",
    "medium grained sandstone": "Sandstone", "medium sandstone": "Sandstone", "ferruginous sandstone": "Sandstone",
    "gritty sandstone": "Sandstone", "sandstone": "Sandstone", "sand stone": "Sandstone", "sandy shale": "Shale", "shale": "Shale",
    "siltstone": "Siltstone", "silt stone": "Siltstone", "clay": "Clay", "fireclay": "Fireclay", "mudstone": "Mudstone",
    "top soil": "Top Soil", "topsoil": "Top Soil", "soil": "Top Soil", "alluvium": "Alluvium", "overburden": "Overburden",
    "कोयला": "Coal", "शेल": "Shale", "बलुआ पत्थर": "Sandstone", "सैंडस्टोन": "Sandstone", "सिल्टस्टोन": "Siltstone",
    "गाद पत्थर": "Siltstone", "गाद": "Siltstone", "मिट्टी": "Top Soil", "टॉप सॉइल": "Top Soil", "ओवरबर्डन": "Overburden",
    "क्ले": "Clay", "जलोढ़": "Alluvium",
}
_SEAM_BEFORE = r"(?iU)((?:Seam|सीम)\s*[-_:]?\s*[A-Za-z0-9\x{0966}-\x{096F}]+)"
_SEAM_AFTER = r"(?iU)(\b[A-Za-z0-9\x{0966}-\x{096F}]+\s+(?:Seam|सीम))"
_LINE = (
    r"(?iU)^\s*(?:(?:Stratum|Layer|संस्तर)\s+)?(?:(\d+)[.:)]\s+)?(\d+(?:\.\d+)?)\s*(?:-|–|—|\bto\b|से)\s*(\d+(?:\.\d+)?)\s*"
    r"(?:m\b|metres|meters|मी\.?|मीटर)?\s*(?:\(\s*(\d+(?:\.\d+)?)\s*(?:m|metres|meters|मी\.?|मीटर)?\)\s*)?(?:[:\-—–|]\s*)?([\p{L}\p{M}0-9\s()/.,_-]+)$"
)
_BOREHOLE = (r"(?i)\b(BH-TEST-[0-9]+)\b", r"(?i)\b(BH[-_\s]*[0-9]+[A-Za-z0-9\-_/]*)", r"(?iU)(?:Borehole(?:\s+No\.?|\s+ID|\s+Log|\s+Number)?|बोरहोल(?:\s+संख्या|\s+आईडी|\s+लॉग)?)\s*[:\-#]?\s*([A-Za-z0-9\-_/]+)")
_NO_NAME = ("log", "no", "id", "number", "संख्या", "लॉग")


def borehole_id(text: Column) -> Column:
    """The first borehole name of a text, blanks as hyphens."""
    one = lambda p: F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit(""))
    real = lambda c: F.when(~F.lower(c).isin(*_NO_NAME), c)
    return F.regexp_replace(F.coalesce(*[real(one(p)) for p in _BOREHOLE]), r"\s+", "-")


def seam(raw: Column) -> Column:
    """The seam's name: the word after "Seam", else the one before it."""
    one = lambda p: F.nullif(F.trim(F.regexp_extract(raw, p, 1)), F.lit(""))
    return F.coalesce(one(_SEAM_BEFORE), one(_SEAM_AFTER))


def lithology(raw: Column) -> Column:
    """The canonical name: of the whole text, else of the longest known name in it as whole words, else the text itself."""
    no_seam = F.when(raw.rlike(_SEAM_BEFORE), F.regexp_replace(raw, _SEAM_BEFORE, "")).otherwise(F.regexp_replace(raw, _SEAM_AFTER, ""))
    clean = F.regexp_replace(F.trim(no_seam), r"^[\s\-_:,()]+|[\s\-_:,()]+$", "")
    low = F.regexp_replace(F.lower(clean), r"\s+", " ")
    names = sorted(LITHOLOGY, key=lambda k: (-len(k), k))
    found = F.coalesce(*[F.when(low == k, F.lit(LITHOLOGY[k])) for k in names], *[F.when(low.rlike(r"(?U)(?<![\w\p{M}])" + k.replace(".", r"\.") + r"(?![\w\p{M}])"), F.lit(LITHOLOGY[k])) for k in names])
    return F.coalesce(found, F.nullif(clean, F.lit("")), F.lit("Unknown"))


def metrics(rows: DataFrame) -> DataFrame:
    """Intervals that make sense, with thickness and whether a stated one differs by more than 0.01."""
    good = rows.where((F.col("depth_from_m") >= 0) & (F.col("depth_to_m") >= F.col("depth_from_m")) & (F.coalesce("stated_thickness_m", F.lit(0.0)) >= 0))
    out = good.withColumn("thickness_m", F.round(F.col("depth_to_m") - F.col("depth_from_m"), 3))
    return out.withColumn("has_thickness_discrepancy", F.coalesce(F.round(F.abs(F.col("stated_thickness_m") - F.col("thickness_m")), 3) > 0.01, F.lit(False)))


def from_texts(pages: DataFrame, *, document: str = "document_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """Strata lines of texts: a line naming a borehole opens it; orders count on from the last stated one."""
    lines = pages.select(document, page, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    part = lambda i: F.nullif(F.regexp_extract("line", _LINE, i), F.lit(""))
    read = lines.withColumns({"bh": borehole_id(F.col("line")), "order_": part(1), "from_": part(2), "to_": part(3), "stated": part(4), "raw": part(5)})
    w = Window.partitionBy(document).orderBy(page, "line_no")
    read = read.withColumns({"borehole_id": F.coalesce(F.last("bh", ignorenulls=True).over(w), F.lit("BH-UNKNOWN")), "opened": F.count("bh").over(w)})
    hits = read.where(F.col("bh").isNull() & F.col("from_").isNotNull() & F.col("raw").isNotNull())
    by = Window.partitionBy(document, "opened").orderBy(page, "line_no")
    stated = F.last(F.when(F.col("order_").isNotNull(), F.struct(F.col("order_").cast("int").alias("o"), F.col("n"))), ignorenulls=True).over(by)
    counted = hits.withColumn("n", F.row_number().over(by)).withColumn("s", stated)
    numbered = counted.withColumn("stratum_order", F.when(F.col("s").isNull(), F.col("n")).otherwise(F.col("s.o") + F.col("n") - F.col("s.n")))
    out = numbered.select(document, page, "borehole_id", "stratum_order", F.col("from_").cast("double").alias("depth_from_m"), F.col("to_").cast("double").alias("depth_to_m"), F.col("stated").cast("double").alias("stated_thickness_m"), lithology(F.col("raw")).alias("lithology_type"), F.col("raw").alias("raw_lithology"), seam(F.col("raw")).alias("seam_name"), F.col("line").alias("source_text"))
    return metrics(out).withColumn("confidence_score", F.lit(0.95))


def from_tables(tables: DataFrame, *, document: str = "document_id", page: str = "page_number") -> DataFrame:
    """Strata of tables by header words; the word "to" counts anywhere in a header that has no "from"."""
    h = F.lower(F.trim("header"))
    has = lambda *ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(h, w))
    role = F.when(has("from", "गहराई से"), "from").when(has("to", "गहराई तक"), "to").when(has("thick", "मोटाई"), "thick").when(has("lithology", "strata", "rock", "formation", "संस्तर", "शैल"), "litho").when(has("seam", "सीम"), "seam").when(has("order", "sl", "s.no", "no", "क्रम"), "order")
    cols = tables.select("table_id", F.posexplode("headers").alias("col", "header")).withColumn("role", role).where("role IS NOT NULL")
    spot = cols.groupBy("table_id").pivot("role", ["from", "to", "thick", "litho", "seam", "order"]).agg(F.max("col")).where("`from` IS NOT NULL AND `to` IS NOT NULL AND litho IS NOT NULL")
    rows = tables.select("table_id", document, page, "caption", F.posexplode("rows").alias("row", "cells")).join(spot, "table_id")
    cell = lambda c: F.trim(F.get("cells", F.col(f"`{c}`")))
    number = lambda c: F.nullif(F.regexp_replace(cell(c), r"[^\d.]", ""), F.lit("")).try_cast("double")
    named = F.when(~cell("seam").isin("", "-", "—", "N/A"), cell("seam"))
    out = rows.select("table_id", document, page, F.coalesce(borehole_id(F.col("caption")), F.lit("BH-TABLE")).alias("borehole_id"), F.coalesce(cell("order").try_cast("int"), F.col("row") + 1).alias("stratum_order"), number("from").alias("depth_from_m"), number("to").alias("depth_to_m"), number("thick").alias("stated_thickness_m"), lithology(cell("litho")).alias("lithology_type"), cell("litho").alias("raw_lithology"), F.coalesce(named, seam(cell("litho"))).alias("seam_name"))
    return metrics(out).withColumn("confidence_score", F.lit(0.98))


def anomalies(strata: DataFrame, *, keys: list[str], order: str = "stratum_order") -> DataFrame:
    """``strata`` with the first anomaly that holds against the stratum before: inverted, overlapping, or a gap."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag("depth_to_m").over(w)
    kind = F.when(F.col("depth_to_m") < F.col("depth_from_m"), "INVERTED_DEPTH").when(F.col("depth_from_m") < prev - 0.01, "OVERLAPPING_INTERVAL").when(F.col("depth_from_m") > prev + 0.05, "DEPTH_GAP")
    return strata.withColumn("anomaly", kind)


def summary(strata: DataFrame, *, keys: list[str]) -> DataFrame:
    """Depth, coal thickness, seams, thickness per lithology and discrepancies of each borehole."""
    per = strata.groupBy(*keys, "lithology_type").agg(F.sum("thickness_m").alias("t"), F.max("depth_to_m").alias("d"), F.collect_set("seam_name").alias("s"), F.count_if("has_thickness_discrepancy").alias("x"), F.count("*").alias("n"))
    coal = F.coalesce(F.sum(F.when(F.col("lithology_type") == "Coal", F.col("t"))), F.lit(0.0))
    return per.groupBy(*keys).agg(
        F.max("d").alias("max_depth_m"), F.round(coal, 3).alias("coal_thickness_m"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("s")))).alias("seams"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("lithology_type", F.round("t", 3))))).alias("thickness_by_lithology"), F.sum("x").alias("n_discrepancies"), F.sum("n").alias("n_strata"),
    )


def merged(from_table: DataFrame, from_text: DataFrame) -> DataFrame:
    """Strata of tables before those of texts, one per borehole, order and starting depth."""
    both = from_table.withColumn("__p", F.lit(0)).unionByName(from_text.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("document_id", "borehole_id", "stratum_order", F.round("depth_from_m", 2)).orderBy("__p", "page_number")
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__p")
