"""Aggregation of extracted facts: intent, filters, conflicts, priority, units, and the result with its provenance."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import numbers as nx
from loomstone.operators.scope import scoped

#: Organizations and mines that questions name.
SUBSIDIARIES = ("ECL", "BCCL", "CCL", "WCL", "SECL", "MCL", "NCL", "CMPDI", "CIL")
MINES = (
    "Moonidih", "Rajmahal", "Dipka", "Gevra", "Kusmunda", "Jharia", "Raniganj", "Singrauli", "Korba", "Talcher", "Ib Valley",
    "Wardha", "Pench", "Piprawar", "Ashok", "Kalyani", "Bhilai", "North Karanpura", "South Karanpura",
)
#: Operations in the order in which a question is tested for them.
OPERATIONS = (
    ("AVG", r"average|avg|mean"),
    ("MIN", r"minimum|min|lowest"),
    ("MAX", r"maximum|max|highest"),
    ("COUNT", r"how many|count of|number of mines|number of blocks|number of records|number of sources"),
    ("SUM", r"total|sum|combined|aggregate|overall"),
)
#: Metrics in test order: label, pattern, field names.
METRICS = (
    ("stripping ratio", r"stripping ratio|strip ratio|sr", ("stripping_ratio",)),
    ("coal dispatch", r"dispatch|offtake", ("dispatch_quantity", "coal_dispatch")),
    ("overburden removal", r"overburden|ob removal|ob excavation", ("overburden_removal",)),
    ("target production", r"target|planned", ("target_quantity",)),
    ("proved reserves", r"proved reserve|proved reserves", ("reserves_proved",)),
    ("coal reserves", r"reserve|reserves", ("reserves_proved", "reserves_total")),
    ("drilling metreage", r"drilling|metreage|drilled", ("drilling_metreage",)),
    ("ash content", r"ash|ash content", ("ash_content",)),
    ("gross calorific value", r"gcv|calorific value", ("gcv",)),
    ("seam thickness", r"thickness|seam thickness", ("seam_thickness",)),
    ("raw coal production", r"production|output|tonnage|extracted|raw coal|coal production", ("production_quantity", "coal_production")),
)
_YOY, _TOTAL = r"yoy|year-over-year|growth from|increase from|decrease from|change from|variance between", r"total|sum|combined|aggregate|overall|average|avg|mean"


@dataclass
class Intent:
    operation: str | None = None
    metric: str | None = None
    fields: tuple[str, ...] = ()
    subsidiary: str | None = None
    entity: str | None = None
    period: str | None = None
    scope: str = field(default="Enterprise Scope")

    def __bool__(self) -> bool:
        return self.operation is not None


def _has(pattern: str, text: str) -> bool:
    return re.search(rf"\b(?:{pattern})\b", text) is not None


def intent(question: str) -> Intent:
    """What a question wants aggregated; false where it asks for a comparison of years, a borehole, or nothing known."""
    low = question.lower()
    if _has(_YOY, low) and not _has(_TOTAL, low) or _has(r"borehole|bore\s*hole|bh[-_\s]*[a-z0-9]+", low):
        return Intent()
    operation = next((name for name, p in OPERATIONS if _has(p, low)), None)
    metric = next(((label, names) for label, p, names in METRICS if _has(p, low) and (label != "target production" or "production" in low)), None)
    if not operation or not metric:
        return Intent()
    subsidiary = next((s for s in SUBSIDIARIES if _has(s.lower(), low)), None)
    entity = next((m for m in MINES if _has(re.escape(m.lower()), low)), None)
    if not entity and (m := re.search(r"\b([A-Za-z0-9_-]+)\s+area\b", question, re.I)) and m[1].lower() not in ("the", "this", "that", "each", "every", "all"):
        entity = m[1]
    period = None
    if m := re.search(r"\b(?:FY\s*[-_]?)?((?:19|20)\d{2})[-/](\d{2,4})\b", question, re.I):
        period = f"FY{m[1]}-{m[2][-2:]}"
    elif m := re.search(r"\b(?:19|20)\d{2}\b", question):
        period = m[0]
    parts = [f"{k}: {v}" for k, v in (("Subsidiary", subsidiary), ("Entity/Area", entity), ("Period", period)) if v]
    return Intent(operation, metric[0], metric[1], subsidiary, entity, period, ", ".join(parts) or "Enterprise Scope")


def intents(rows: DataFrame, question: str) -> DataFrame:
    """``rows`` with operation, metric, subsidiary, entity and period of each question, as ``intent`` has them for one.

    The rules are one expression each, the first that matches counts; a question that wants no aggregate, and a null one, has
    nulls only.
    """
    q = F.coalesce(F.col(question), F.lit(""))
    low = F.lower(q)
    has = lambda pattern: low.rlike(rf"\b(?:{pattern})\b")
    first = lambda rules: F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules])
    operation = first([(name, has(p)) for name, p in OPERATIONS])
    metric = first([(label, has(p) & F.contains(low, F.lit("production")) if label == "target production" else has(p)) for label, p, _ in METRICS])
    other = has(_YOY) & ~has(_TOTAL) | has(r"borehole|bore\s*hole|bh[-_\s]*[a-z0-9]+")
    area = F.regexp_extract(q, r"(?i)\b([A-Za-z0-9_-]+)\s+area\b", 1)
    named = first([(m, has(re.escape(m.lower()))) for m in MINES])
    entity = F.coalesce(named, F.when((area != "") & ~F.lower(area).isin("the", "this", "that", "each", "every", "all"), area))
    years = r"(?i)\b(?:FY\s*[-_]?)?((?:19|20)\d{2})[-/](\d{2,4})\b"
    fiscal, year = F.regexp_extract(q, years, 1), F.regexp_extract(q, r"\b(?:19|20)\d{2}\b", 0)
    period = F.when(fiscal != "", F.concat(F.lit("FY"), fiscal, F.lit("-"), F.right(F.regexp_extract(q, years, 2), F.lit(2)))).when(year != "", year)
    wanted = ~other & operation.isNotNull() & metric.isNotNull()
    found = {"operation": operation, "metric": metric, "subsidiary": first([(s, has(s.lower())) for s in SUBSIDIARIES]), "entity": entity, "period": period}
    return rows.withColumns({name: F.when(wanted, value) for name, value in found.items()})


def candidates(facts: DataFrame, want: Intent, allowed: list[str] | None) -> DataFrame:
    """Facts of the wanted fields within the caller's scope that have a number and were not rejected."""
    org = None
    if want.subsidiary:
        org = [want.subsidiary] if allowed is None or want.subsidiary in allowed else []
    rows = scoped(scoped(facts, "organization_id", allowed), "organization_id", org)
    rows = rows.where(F.col("field_name").isin(*want.fields) & F.col("numeric_value").isNotNull() & (F.col("verification_status") != "REJECTED"))
    if want.period:
        rows = rows.where(F.contains(F.coalesce("reporting_period", F.lit("")), F.lit(want.period.removeprefix("FY"))))
    if want.entity:
        rows = rows.where(F.lower("entity_name") == want.entity.lower())
    return rows


def without_conflicts(rows: DataFrame, conflicts: DataFrame, *, key: str = "id") -> DataFrame:
    """Facts that are in no unresolved conflict (``conflicts``: field_id, conflict_status, resolution_status)."""
    bad = conflicts.where("conflict_status = 'CONFLICT' AND resolution_status <> 'RESOLVED'").select(F.col("field_id").alias(key))
    return rows.join(bad, key, "left_anti")


def preferred(rows: DataFrame, *, seq: str = "id") -> DataFrame:
    """One fact per entity, field and period (per document, field and page without an entity): verified before the rest, then the first."""
    named = F.coalesce("entity_name", F.lit("")) != ""
    key = F.when(named, F.concat_ws("_", "entity_name", "field_name", F.coalesce("reporting_period", F.lit("")))).otherwise(F.concat_ws("_", F.col("document_id"), F.col("field_name"), F.col("page_number").cast("string")))
    priority = F.when(F.col("verification_status").isin("VERIFIED", "CORRECTED"), 2).otherwise(1)
    order = Window.partitionBy(key).orderBy(priority.desc(), seq)
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def harmonised(rows: DataFrame) -> DataFrame:
    """Adds value, canonical unit and whether units mix in a way that cannot be converted."""
    units = rows.groupBy(F.upper("unit").alias("u")).count().agg(F.array_sort(F.collect_set("u")).alias("__units"))
    return _in_units(rows.crossJoin(F.broadcast(units))).drop("__units")


def _in_units(rows: DataFrame) -> DataFrame:
    """Value, canonical unit and mismatch of rows that carry ``__units``, the sorted units of all of them."""
    mass, several = F.forall("__units", lambda u: u.isin(*nx.MASS)), F.size("__units") > 1
    canonical = F.when(several & mass, F.lit("MT")).otherwise(F.get("__units", F.lit(0)))
    value = F.when(several & mass, _as_mass(F.col("numeric_value"))).otherwise(F.col("numeric_value"))
    return rows.withColumns({"canonical_unit": canonical, "unit_mismatch": several & ~mass, "value": value})


def _as_mass(value: Column) -> Column:
    return nx.to_canonical_mass(value, F.col("unit"), F.lit("MT"))


def aggregate(facts: DataFrame, conflicts: DataFrame, want: Intent, allowed: list[str] | None = None, *, terms: int = 8) -> DataFrame:
    """One row: value, unit, record_count, unit_mismatch, verified and a formula of the first ``terms`` records.

    Without candidates the count is 0; where conflicts remove all of them the result is not verified. Facts are summed by
    unit, as they are and as mass, and the few units decide which holds; the formula's records come from a bounded top-k.
    """
    found = candidates(facts, want, allowed)
    rows = preferred(without_conflicts(found, conflicts))
    parts = {"SUM": F.sum, "AVG": F.sum, "MIN": F.min, "MAX": F.max, "COUNT": F.count}
    part = parts[want.operation]
    per_unit = rows.groupBy(F.upper("unit").alias("u")).agg(F.count("*").alias("n"), part("numeric_value").alias("plain"), part(_as_mass(F.col("numeric_value"))).alias("mass"))
    total = per_unit.agg(F.array_sort(F.collect_set("u")).alias("__units"), F.coalesce(F.sum("n"), F.lit(0)).alias("record_count"), *(_over_units(want.operation, c) for c in ("plain", "mass")))
    term = F.struct("id", "numeric_value", "unit", F.coalesce("entity_name", "document_id").alias("who"), "page_number")
    first = rows.orderBy("id").limit(terms).agg(F.array_sort(F.collect_list(term)).alias("__first"))
    seen = found.agg(F.count("*").alias("__found"))
    mass, several = F.forall("__units", lambda u: u.isin(*nx.MASS)), F.size("__units") > 1
    value = lambda x: F.when(several & mass, nx.to_canonical_mass(x["numeric_value"], x["unit"], F.lit("MT"))).otherwise(x["numeric_value"])
    label = lambda x: F.format_string("%s (%s, P.%d)", F.format_number(value(x), 1), x["who"], x["page_number"])
    return total.crossJoin(first).crossJoin(seen).select(
        F.when(several & mass, F.col("mass")).otherwise(F.col("plain")).alias("calculated_value"), F.when(several & mass, F.lit("MT")).otherwise(F.get("__units", F.lit(0))).alias("unit"),
        "record_count", (several & ~mass).alias("unit_mismatch"), F.array_join(F.transform("__first", label), " + ").alias("formula"),
        (~((F.col("record_count") == 0) & (F.col("__found") > 0))).alias("verified"),
    )


def _over_units(name: str, column: str) -> Column:
    """One operation over all units from the parts of each."""
    c = F.col(column)
    made = {"SUM": F.round(F.sum(c), 4), "AVG": F.round(F.sum(c) / F.sum("n"), 4), "MIN": F.min(c), "MAX": F.max(c), "COUNT": F.sum(c).cast("double")}
    return made[name].alias(column)


def lookup(facts: DataFrame, fields: list[str], entity: str | None, *, most: int = 20) -> DataFrame:
    """Facts by metric and entity; if none, by metric; if none, by entity (``most`` of them). One plan, no second query."""
    metric, who = F.col("field_name").isin(*fields), F.col("entity_name").ilike(f"%{entity}%") if entity else F.lit(False)
    level = F.when(metric & who, 1).when(metric, 2).when(who, 3)
    rows = facts.withColumn("__level", level).where("__level IS NOT NULL")
    best = rows.agg(F.min("__level").alias("__best"))
    kept = rows.crossJoin(F.broadcast(best)).where("__level = __best").drop("__best", "__level")
    return kept.orderBy("id").limit(most) if not fields else kept


def year_over_year(series: DataFrame, *, keys: list[str], period: str, value: str) -> DataFrame:
    """Every consecutive pair of periods: previous value, change and percent."""
    w = Window.partitionBy(*keys).orderBy(period)
    rows = series.withColumns({"previous_period": F.lag(period).over(w), "previous_value": F.lag(value).over(w)}).where("previous_period IS NOT NULL")
    return rows.withColumns({"absolute_change": nx.absolute_change(F.col("previous_value"), F.col(value)), "percentage_change": nx.percentage_change(F.col("previous_value"), F.col(value))})


def conflict_variance(members: DataFrame, *, group: str, value: str, order: str) -> DataFrame:
    """The first two candidates of each group and how far they are apart."""
    w = Window.partitionBy(group).orderBy(order)
    two = members.withColumns({"second": F.lead(value).over(w), "__n": F.row_number().over(w)}).where("__n = 1 AND second IS NOT NULL")
    a, b = F.col(value), F.col("second")
    return two.select(group, a.alias("first"), b.alias("second"), nx.absolute_change(a, b).alias("variance"), nx.percentage_change(a, b).alias("variance_pct"))
