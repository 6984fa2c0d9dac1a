"""Pages, paragraphs and tables to retrieval chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folded(parts: Column, limit: int) -> Column:
    """array<array<string>>: runs of parts, each closed before it would pass ``limit`` characters."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))

    def step(s, p):
        full = (F.size(s["open"]) > 0) & (s["size"] + F.length(p) > limit)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"),
            F.when(full, F.array(p)).otherwise(F.concat(s["open"], F.array(p))).alias("open"),
            F.when(full, F.length(p)).otherwise(s["size"] + F.length(p)).cast("int").alias("size"),
        )

    return F.aggregate(parts, start, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def paragraphs(rows: DataFrame, *, key: str, text: str, limit: int = 1000, cut: str = r"\n\n") -> DataFrame:
    """(key, chunk_index, content, section_heading): paragraphs joined up to ``limit`` characters.

    A heading (a line with # or SECTION:, at most 200 characters) holds from its paragraph on, and for the chunk that it
    closes too: headings change before a chunk is flushed.
    """
    # trim by itself would take a second argument, the place, as the signs to trim
    parts = F.filter(F.transform(F.split(F.col(text), cut), lambda p: F.trim(p)), lambda p: p != "")
    chunks = rows.select(key, F.posexplode(folded(parts, limit)).alias("chunk_index", "parts"))
    content = F.array_join("parts", "\n\n")
    own = F.filter("parts", lambda p: p.rlike(r"^(#|SECTION:)") & (F.length(p) <= 200))
    heading = F.when(F.size(own) > 0, F.trim(F.regexp_replace(F.element_at(own, -1), r"^(#+|SECTION:)\s*", "")))
    order = Window.partitionBy(key).orderBy("chunk_index")
    opens = F.lead(F.when(F.get("parts", F.lit(0)).rlike(r"^(#|SECTION:)"), F.trim(F.regexp_replace(F.get("parts", F.lit(0)), r"^(#+|SECTION:)\s*", "")))).over(order)
    named = chunks.withColumns({"__h": heading, "__next": opens})
    return named.select(key, "chunk_index", content.alias("content"), F.coalesce("__next", F.last("__h", ignorenulls=True).over(order)).alias("section_heading"))


def table_parts(rows: DataFrame, *, table: str, order: str, cells: str, page: str | None = None, size: int = 25) -> DataFrame:
    """(table, part, total_parts, n_rows, content): rows of a table in parts of ``size``, page marks where it has several pages."""
    by = Window.partitionBy(table)
    numbered = rows.withColumn("__i", F.row_number().over(by.orderBy(order)) - 1)
    line = F.array_join(F.col(cells), " | ")
    if page:
        pages = F.size(F.collect_set(page).over(by))
        line = F.when(pages > 1, F.concat(F.format_string("[P.%d] ", F.col(page)), line)).otherwise(line)
    parts = numbered.withColumns({"__line": line, "part": (F.floor(F.col("__i") / size) + 1).cast("int")})
    grouped = parts.groupBy(table, "part").agg(F.count("*").alias("n_rows"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__line"))), lambda x: x["__line"]), "\n").alias("content"))
    return grouped.withColumn("total_parts", F.max("part").over(by))


def visual_chunks(visuals: DataFrame) -> DataFrame:
    """Visuals whose recognised text has at least ten characters, as chunks."""
    content = F.concat_ws("\n", F.concat(F.lit("[VISUAL] "), F.coalesce("caption", F.lit("Untitled"))), "ocr_text")
    return visuals.where(F.length(F.trim("ocr_text")) >= 10).select("id", "document_id", "page_number", F.lit("VISUAL").alias("chunk_type"), content.alias("content"))


def virtual_pages(rows: DataFrame, *, key: str, text: str, long: int = 3000, limit: int = 2500) -> DataFrame:
    """(key, page_number, text): texts over ``long`` characters split at blank lines once a page passes ``limit``."""
    whole = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    parts = F.split(whole, r"\n\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s, p):
        open_ = F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit("\n\n"), p))
        full = F.length(open_) > limit
        return F.struct(F.when(full, F.concat(s["done"], F.array(open_))).otherwise(s["done"]).alias("done"), F.when(full, F.lit("")).otherwise(open_).alias("open"))

    pages = F.aggregate(parts, start, step, lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    return rows.select(key, F.posexplode(F.when(F.length(whole) > long, pages).otherwise(F.array(whole))).alias("page_number", "text")).withColumn("page_number", F.col("page_number") + 1)
