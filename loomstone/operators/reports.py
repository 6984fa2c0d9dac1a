"""Statutory arithmetic with its rounding at every step, field mapping, compliance and schema audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNAVAILABLE = "Not available in the verified knowledge base."
#: Fields whose absence is critical.
CRITICAL_FIELDS = ("fm_block_name", "fm_allottee_name", "fld_1_1_1", "fld_1_3_6", "fld_2_2_17", "fld_2_2_21")
#: Names of facts that fill a report field, first match wins.
SYNONYMS = {
    "fld_1_1_1": ("mine_name", "block_name", "project_name", "coal_block"), "fld_1_1_2": ("coalfield", "coalfield_name", "basin"),
    "fld_1_1_4": ("linked_plant", "end_use_plant", "power_plant"), "fld_1_1_5": ("distance_plant", "distance_km"),
    "fld_1_1_6": ("transport_mode", "despatch_mode", "coal_transport"), "fld_1_2_1": ("location", "district", "state", "district_state"),
    "fld_1_3_1": ("allottee", "allottee_name", "company_name"), "fld_1_3_2": ("allotment_order", "vesting_order", "allotment_date"),
    "fld_1_3_5": ("rated_capacity", "capacity_mtpa", "peak_capacity"), "fld_2_1_2": ("gr_title", "geological_report", "gr_date"),
    "fld_2_1_3": ("gr_agency", "exploration_agency", "cmpdi_ri"), "fld_2_1_4": ("block_area", "block_area_ha", "lease_area_ha", "area_ha"),
    "fld_2_2_1": ("boreholes", "borehole_density", "total_meterage"), "fld_2_2_7": ("coal_grade", "gcv", "ash_pct", "moisture_pct"),
    "fld_2_3_2": ("gross_reserves", "proved_reserves", "total_reserves"), "fld_2_3_4": ("blocked_reserves", "sterilized_reserves"),
    "fld_2_3_9": ("depleted_coal", "prior_extraction", "depleted_reserves"), "fld_3_1_1": ("mining_method", "proposed_method", "oc_ug_method"),
    "fld_3_1_2": ("target_capacity", "annual_production", "peak_prod_capacity"), "fld_6_1_1": ("total_land", "total_land_ha", "project_land"),
    "fld_6_1_2": ("forest_land", "tenancy_land", "govt_land"),
}


def reserve_lineage(rows: DataFrame, *, proved: Column, indicated: Column, inferred: Column, deduction_pct: Column, blocked: Column, loss_pct: Column, depleted: Column) -> DataFrame:
    """Gross to balance reserves; each step rounds to three digits and feeds the next, none falls under zero."""
    floor = lambda c: F.round(F.greatest(F.lit(0.0), c), 3)
    return (
        rows.withColumn("gross", F.round(proved + indicated + inferred, 3))
        .withColumn("deduction", F.round(F.col("gross") * (deduction_pct / 100), 3))
        .withColumn("net", floor(F.col("gross") - F.col("deduction")))
        .withColumn("minable", floor(F.col("net") - blocked))
        .withColumn("mining_loss", F.round(F.col("minable") * (loss_pct / 100), 3))
        .withColumn("extractable", floor(F.col("minable") - F.col("mining_loss")))
        .withColumn("recovery_pct", F.when(F.col("minable") > 0, F.round(F.col("extractable") / F.col("minable") * 100, 2)).otherwise(0.0))
        .withColumn("balance", floor(F.col("extractable") - depleted))
    )


def stripping_ratio(volume: Column, mass: Column) -> Column:
    """Two digits; 0 without mass."""
    return F.when(mass > 0, F.round(volume / mass, 2)).otherwise(0.0)


def life_of_mine(extractable: Column, capacity: Column) -> Column:
    return F.when(capacity > 0, F.round(extractable / capacity, 1)).otherwise(0.0)


def closure_escrow(rows: DataFrame, *, area: Column, opencast: Column, life: Column, wpi: float = 1.018, base: Column | None = None) -> DataFrame:
    """Escalated rate, cost, yearly deposit and the deposit compounded at 5 percent."""
    rate = F.when(opencast, 14.0).otherwise(2.0) if base is None else base
    return (
        rows.withColumn("escalated_rate", F.round(rate * wpi, 4))
        .withColumn("closure_cost", F.round(area * F.col("escalated_rate"), 2))
        .withColumn("annual_deposit", F.when(life > 0, F.round(F.col("closure_cost") / life, 2)).otherwise(0.0))
        .withColumn("compounded_deposit", F.round(F.col("annual_deposit") * 1.05, 2))
    )


def community_escrow(claims: DataFrame, *, key: str, deposit: str, activity: str, amount: str) -> DataFrame:
    """Each activity's claim against a third of the earmarked quarter of the five-yearly deposit."""
    earmarked = F.round(F.col(deposit) * 0.25, 2)
    rows = claims.withColumns({"earmarked": earmarked, "claimed": F.round(amount, 2)}).withColumn("cap", F.round(F.col("earmarked") / 3, 2))
    over = F.col("claimed") > F.col("cap") + 0.01
    return rows.select(key, activity, "earmarked", "cap", "claimed", F.when(over, "EXCEEDS_STATUTORY_CAP").otherwise("COMPLIANT").alias("status"), F.when(over, F.round(F.col("claimed") - F.col("cap"), 2)).otherwise(0.0).alias("excess"))


def transformation_corpus(balance: Column) -> Column:
    """struct<corpus, reimbursable>: a tenth and nine tenths."""
    return F.struct(F.round(balance * 0.10, 2).alias("corpus"), F.round(balance * 0.90, 2).alias("reimbursable"))


def mapped_fields(facts: DataFrame, *, report: str, name: str, value: str) -> DataFrame:
    """(report, internal_id, source_field, value) of every field of the synonym table; without a fact the notice."""
    spark = facts.sparkSession
    table = spark.createDataFrame([(k, i, s) for k, names in SYNONYMS.items() for i, s in enumerate(names)], "internal_id string, pos int, source_field string")
    found = facts.join(F.broadcast(table), F.lower(F.col(name)) == F.col("source_field")).groupBy(report, "internal_id").agg(F.min_by(F.struct("source_field", F.col(value).cast("string").alias("v")), F.struct("pos", F.col(value).cast("string"))).alias("b"))
    grid = facts.select(report).distinct().crossJoin(F.broadcast(table.select("internal_id").distinct()))
    return grid.join(found, [report, "internal_id"], "left").select(report, "internal_id", F.col("b.source_field").alias("source_field"), F.coalesce("b.v", F.lit(UNAVAILABLE)).alias("value"))


def chapter(parent: Column) -> Column:
    number = F.regexp_extract(parent, r"^(?:sec_|root_ch|ch_)(\d+)", 1)
    return F.when(parent.isNull() | (number == ""), "ch_general").otherwise(F.concat(F.lit("ch_"), number))


def missing_data(fields: DataFrame, *, report: str) -> DataFrame:
    """Issues of report fields without a value."""
    empty = F.col("value").isNull() | (F.trim("value") == "") | (F.trim("value") == UNAVAILABLE)
    severity = F.when(F.col("internal_id").isin(*CRITICAL_FIELDS), "CRITICAL").otherwise("WARNING")
    return fields.where(empty).select(report, "internal_id", F.lit("MISSING_DATA").alias("issue_type"), severity.alias("severity"))


def monotone(rows: DataFrame, *, report: str, steps: list[str]) -> DataFrame:
    """Issues where a later reserve exceeds the one before (zeros and nulls are not compared)."""
    pair = lambda a, b: F.when((F.col(a) != 0) & (F.col(b) != 0) & (F.col(b) > F.col(a)), F.lit(b))
    found = F.filter(F.array(*[pair(a, b) for a, b in zip(steps, steps[1:], strict=False)]), lambda x: x.isNotNull())
    return rows.select(report, F.explode(found).alias("internal_id")).withColumns({"issue_type": F.lit("ARITHMETIC_INCONSISTENCY"), "severity": F.lit("CRITICAL")})


def readiness(issues: DataFrame, reports: DataFrame, *, report: str) -> DataFrame:
    """Counts by severity and the state of every report."""
    n = issues.groupBy(report).agg(F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "WARNING").alias("warning"))
    rows = reports.select(report).distinct().join(n, report, "left").na.fill(0, ["critical", "warning"])
    return rows.withColumn("status", F.when(F.col("critical") > 0, "NON_COMPLIANT").when(F.col("warning") > 0, "WARNINGS").otherwise("COMPLIANT"))


def schema_audit(nodes: DataFrame, *, node: str, parent: str, kind: str) -> DataFrame:
    """(finding, n): nodes by kind, duplicate ids, and nodes whose parent does not exist."""
    kinds = nodes.groupBy(F.concat(F.lit("kind:"), F.col(kind)).alias("finding")).agg(F.count("*").alias("n"))
    twice = nodes.groupBy(node).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicates").alias("finding"), "n")
    ids = nodes.select(F.col(node).alias("__id")).distinct()
    orphans = nodes.where(F.col(parent).isNotNull()).join(ids, F.col(parent) == F.col("__id"), "left_anti").agg(F.count("*").alias("n")).select(F.lit("orphans").alias("finding"), "n")
    return kinds.unionByName(twice).unionByName(orphans)


def snapshot(rows: DataFrame, *, key: str, order: str) -> DataFrame:
    """A frozen report: its rows as JSON in order, with a content hash."""
    body = F.to_json(F.sort_array(F.collect_list(F.struct(order, *[c for c in rows.columns if c not in (key, order)]))))
    return rows.groupBy(key).agg(body.alias("snapshot")).withColumn("sha256", F.sha2("snapshot", 256))


def versions(rows: DataFrame, *, key: str, order: str) -> DataFrame:
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(order)))
