"""Row filters, enrichment and small set operations shared by the other operators."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equal(rows: DataFrame, **wanted) -> DataFrame:
    """Equality filters; a value of None does not filter."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows


def names_period(rows: DataFrame, period: str, content: str, title: str) -> DataFrame:
    """Rows whose content or title holds the period, with or without its FY."""
    terms = {period, period.removeprefix("FY").strip()}
    return rows.where(reduce(or_, [F.col(c).ilike(f"%{x}%") for c in (content, title) for x in sorted(terms)]))


def any_token(rows: DataFrame, tokens: list[str], *columns: str, most: int = 5) -> DataFrame:
    """Rows where one of the first ``most`` tokens is a substring of one of the columns, whatever the case."""
    return rows.where(reduce(or_, [F.contains(F.lower(F.col(c)), F.lit(x.lower())) for x in tokens[:most] for c in columns]))


def text_or_known(rows: DataFrame, text: str, term: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose text holds the term, or whose key a fact table knows."""
    flagged = rows.join(known.select(key).distinct().withColumn("__known", F.lit(True)), key, "left")
    return flagged.where(F.col(text).ilike(f"%{term}%") | F.col("__known")).drop("__known")


def needs_review(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("validation_status").isin("WARNING", "ERROR") | (F.col("verification_status") == "UNVERIFIED"))


def started_before(rows: DataFrame, cutoff: Column) -> DataFrame:
    return rows.where(F.coalesce("started_at", "created_at") < cutoff)


def consistent(rows: DataFrame, text: Column, title: Column, target: str, others: list[str], needle: str | None = None) -> DataFrame:
    """Rows that name the target, or whose title names no other one; all rows if that leaves none."""
    keep = text.ilike(f"%{needle or target}%") | title.ilike(f"%{target}%") | ~title.isin(*others)
    some = rows.agg(F.coalesce(F.bool_or(keep), F.lit(False)).alias("__some"))
    return rows.crossJoin(F.broadcast(some)).where(keep | ~F.col("__some")).drop("__some")


def enriched(rows: DataFrame, lookup: DataFrame, key: str, lookup_key: str, value: str, name: str, default: str = "Unknown Unit") -> DataFrame:
    """``name`` from a lookup table, a default where it has none."""
    table = lookup.select(F.col(lookup_key).alias("__k"), F.col(value).alias("__v"))
    return rows.join(table, F.col(key) == F.col("__k"), "left").withColumn(name, F.coalesce("__v", F.lit(default))).drop("__k", "__v")


def first_by(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): values only in a, only in b, or in both."""
    left, right = a.select(key).distinct().withColumn("__a", F.lit(1)), b.select(key).distinct().withColumn("__b", F.lit(1))
    side = F.when(F.col("__b").isNull(), "only_a").when(F.col("__a").isNull(), "only_b").otherwise("common")
    return left.join(right, key, "full").select(key, side.alias("side"))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
