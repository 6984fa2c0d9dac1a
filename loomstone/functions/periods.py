"""Fiscal and calendar periods as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PREFIX = r"(?i)^(?:(?:Q[1-4]|H[1-2])\s+)?(?:FY\s*)?"
#: Periods that are words.
CATEGORICAL = ("lifetime", "cumulative", "current", "historical")
#: Sort key of periods without a year.
UNKNOWN_YEAR = 9999


def label(year: Column) -> Column:
    """FYyyyy-yy of a starting year."""
    y = year.cast("int")
    return F.concat(F.lit("FY"), y.cast("string"), F.lit("-"), F.lpad(F.pmod(y + 1, F.lit(100)).cast("string"), 2, "0"))


def fiscal_start(ts: Column) -> Column:
    """Starting year of the fiscal year (April to March) of a time."""
    return F.year(ts) - F.when(F.month(ts) >= 4, 0).otherwise(1)


def fiscal_year(ts: Column) -> Column:
    return label(fiscal_start(ts))


def validate(period: Column) -> Column:
    """struct<ok, value>: the normalised period, or why it is none. The end year must follow the start year."""
    p = F.trim(period)
    short, long, year = _PREFIX + r"(\d{4})[-/](\d{2})$", _PREFIX + r"(\d{4})[-/](\d{4})$", r"(?i)^(?:CY\s*)?(\d{4})$"
    at = lambda pattern, i: F.try_to_number(F.nullif(F.regexp_extract(p, pattern, i), F.lit("")), F.lit("9999")).cast("int")
    start = F.coalesce(at(short, 1), at(long, 1))
    rolls = F.when(p.rlike(short), at(short, 2) == F.pmod(start + 1, F.lit(100))).otherwise(at(long, 2) == start + 1)
    in_range = lambda y: y.between(1950, 2100)
    pair = lambda ok, value: F.struct(ok.alias("ok"), value.alias("value"))
    bad = lambda text: pair(F.lit(False), F.concat(F.lit(text), p))
    return (
        F.when(period.isNull() | (p == ""), pair(F.lit(False), F.lit("Period is empty")))
        .when(p.rlike(short) | p.rlike(long), F.when(~rolls, bad("Invalid financial year rollover: ")).when(~in_range(start), bad("Year out of operational range: ")).otherwise(pair(F.lit(True), label(start))))
        .when(p.rlike(year), F.when(in_range(at(year, 1)), pair(F.lit(True), F.concat(F.lit("CY"), at(year, 1).cast("string")))).otherwise(bad("Calendar year out of operational range: ")))
        .when(F.lower(p).isin(*CATEGORICAL), pair(F.lit(True), F.initcap(p)))
        .otherwise(bad("Malformed reporting period format: "))
    )


def sort_key(period: Column) -> Column:
    """struct<year, part> that orders periods; a period without a year comes last."""
    year = F.regexp_extract(period, r"((?:19|20)\d{2})", 1)
    part = F.regexp_extract(period, r"(?i)[QH]([1-4])", 1)
    return F.struct(F.coalesce(F.nullif(year, F.lit("")).cast("int"), F.lit(UNKNOWN_YEAR)).alias("year"), F.coalesce(F.nullif(part, F.lit("")).cast("int"), F.lit(0)).alias("part"))


def mentioned(text: Column) -> Column:
    """Canonical fiscal years (FYyyyy-yy) that a text names, distinct and in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:FY\s*[-_]?)?((?:19|20)\d{2}[-/]\d{2,4})\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda m: F.concat(F.lit("FY"), F.substring(m, 1, 4), F.lit("-"), F.right(m, F.lit(2)))))


def document_period(title: Column, created: Column) -> Column:
    """The fiscal year a title names, else that of the creation time."""
    named = F.regexp_extract(title, r"(?i)FY\s*(\d{4})[-/](\d{2})", 1)
    return F.when(named != "", label(named.cast("int"))).otherwise(fiscal_year(created))


def content_period(text: Column) -> Column:
    """The first 20yy-yy of a text, null if none."""
    return F.nullif(F.regexp_extract(text, r"(20\d{2}-\d{2})", 1), F.lit(""))
