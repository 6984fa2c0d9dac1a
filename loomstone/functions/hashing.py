"""Content hashes and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprint(ids: Column, *params: Column) -> Column:
    """SHA-256 of the sorted distinct ids and the parameters: the same corpus and settings give the same value."""
    return F.sha2(F.concat_ws("|", F.array_join(F.array_sort(F.array_distinct(ids)), ","), *params), 256)


def canonical_json(*cols: Column) -> Column:
    """SHA-256 of a struct's JSON with its fields in the order given."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)
