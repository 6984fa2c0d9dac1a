"""Tenant scope: None sees everything, a list its members, an empty list nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Roles that see every organization.
CENTRAL_ROLES = ("MINISTRY_OFFICER", "CMPDI_HQ_OFFICER", "SYSTEM_ADMIN")


def allowed(role_codes: list[str], organization: str | None, requested: list[str] | None = None) -> list[str] | None:
    """The list of organizations of a caller; PermissionError where another one is asked for."""
    if any(r in CENTRAL_ROLES for r in role_codes):
        return requested
    own = [organization] if organization else []
    if requested and set(requested) - set(own):
        raise PermissionError("organization outside the caller's scope")
    return own


def scoped(rows: DataFrame, column: str, members: list[str] | None) -> DataFrame:
    if members is None:
        return rows
    return rows.where(F.col(column).isin(*members)) if members else rows.where(F.lit(False))


def scoped_or_global(rows: DataFrame, column: str, members: list[str] | None) -> DataFrame:
    """Also rows that belong to no organization."""
    if members is None:
        return rows
    none = F.col(column).isNull()
    return rows.where(none | F.col(column).isin(*members) if members else none)


def summary(rows: DataFrame, column: str, scopes: dict[str, list[str] | None]) -> DataFrame:
    """(kind, n): rows visible under each named scope."""
    parts = [scoped(rows, column, m).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, m in scopes.items()]
    return reduce(DataFrame.unionByName, parts)
