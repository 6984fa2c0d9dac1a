"""Number parsing, units and the arithmetic rules (each keeps its own answer to a zero divisor)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASS = ("MT", "TONNES", "TONNE", "TE")
RESERVE_UNITS = ("mt", "million tonnes", "tonnes", "tonne", "t", "te")


def parse(raw: Column) -> Column:
    """Digits, dot and minus of a text as a double, null if they form no number."""
    return F.nullif(F.regexp_replace(raw, r"[^\d.\-]", ""), F.lit("")).try_cast("double")


def parse_reserve(raw: Column) -> Column:
    """struct<value, unit, ok>: first number (thousands separators allowed), not negative, with a unit of mass."""
    value = F.replace(F.regexp_extract(raw, r"(-?\d[\d,]*(?:\.\d+)?)", 1), F.lit(",")).try_cast("double")
    unit = F.lower(F.trim(F.regexp_extract(raw, r"-?\d[\d,]*(?:\.\d+)?\s*([A-Za-z ]*)$", 1)))
    return F.struct(value.alias("value"), unit.alias("unit"), (value.isNotNull() & (value >= 0) & (unit.isin(*RESERVE_UNITS) | (unit == ""))).alias("ok"))


def absolute_change(a: Column, b: Column) -> Column:
    return F.round(b - a, 4)


def percentage_change(a: Column, b: Column) -> Column:
    """Change in percent of the size of ``a``; null where that is nearly zero."""
    return F.when(F.abs(a) >= 1e-9, F.round((b - a) / F.abs(a) * 100, 2))


def stripping_ratio(volume: Column, mass: Column) -> Column:
    """Null without mass."""
    return F.when(F.abs(mass) >= 1e-9, F.round(volume / mass, 4))


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percent; 0 of nothing."""
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(0.0)


def success_rate(done: Column, total: Column) -> Column:
    """Percent with one digit; 100 of nothing."""
    return F.when(total > 0, F.round(done / total * 100, 1)).otherwise(100.0)


def growth(previous: Column, now: Column) -> Column:
    """Growth of a share in percent: from nothing to something is 100, from nothing to nothing 0."""
    return F.when(previous > 0, F.round((now - previous) / previous * 100, 2)).when(now > 0, 100.0).otherwise(0.0)


def clamp(x: Column) -> Column:
    """Into [0, 1]; what is no number, or infinite, is 0."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def to_canonical_mass(value: Column, unit: Column, canonical: Column) -> Column:
    """Tonnes to millions of them where the canonical unit is MT."""
    return F.when((canonical == "MT") & F.upper(unit).isin(*MASS[1:]), F.round(value / 1_000_000, 4)).otherwise(value)


def column_letters(index: Column) -> Column:
    """Spreadsheet letters of a 0-based column number, to ZZ."""
    letter = lambda n: F.char(n + 65)
    return F.when(index < 26, letter(index)).otherwise(F.concat(letter(F.floor(index / 26) - 1), letter(F.pmod(index, F.lit(26)))))


def column_index(letters: Column) -> Column:
    """0-based column number of one or two spreadsheet letters."""
    up = F.upper(letters)
    return F.when(F.length(up) == 1, F.ascii(up) - 65).otherwise((F.ascii(up) - 64) * 26 + F.ascii(F.substring(up, 2, 1)) - 65)


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.85, "HIGH").when(score >= 0.60, "MEDIUM").otherwise("LOW")
