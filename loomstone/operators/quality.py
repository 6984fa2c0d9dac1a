"""Validation rules, reconciliation across documents, and relationships between documents."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.session import written

#: Units allowed per kind of measure, and metrics that need one.
MASS_UNITS = ("mt", "million tonnes", "million tonne", "tonnes", "tonne", "lt", "lakh tonnes", "t")
LENGTH_UNITS = ("m", "metre", "metres", "meter", "meters")
ENERGY_UNITS = ("kcal/kg", "kcal / kg")
NEED_UNIT = ("production", "target", "dispatch", "reserves", "drilling", "gcv", "stripping", "ash")
MASS_METRICS = ("production", "target", "dispatch", "reserves")
NON_NEGATIVE = ("production", "target", "dispatch", "reserves", "drilling", "overburden", "gcv")
#: Fixed value: relative divergence from which values of one group conflict.
DIVERGENCE = 0.01
GENERIC = ("annual", "monthly", "report", "mining", "plan", "coal", "the", "document", "file", "final", "draft")
#: Pairs that one task writes out.
PAIRS_OF_A_TASK = 4_000_000


def _any(name: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(name, F.lit(w)) for w in words])


def _result(when: Column, rule: str, category: str, status: str) -> Column:
    severity = {"ERROR": "CRITICAL", "WARNING": "WARNING", "PASS": "INFO"}[status]
    return F.when(when, F.struct(F.lit(rule).alias("rule_name"), F.lit(category).alias("rule_category"), F.lit(status).alias("status"), F.lit(severity).alias("severity")))


def _first(*results: Column) -> Column:
    return F.coalesce(*results)


def results(name: Column, kind: Column, value: Column, unit: Column, raw: Column) -> Column:
    """Array of rule results for one fact: type, unit, ranges, fiscal year."""
    n, u = F.lower(name), F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    number, has = kind == "NUMBER", value.isNotNull()
    units = F.when(number & has, _first(
        _result((u == "") & _any(n, NEED_UNIT), "UNIT_PRESENCE_CHECK", "UNIT", "WARNING"),
        _result((u != "") & _any(n, MASS_METRICS) & ~u.isin(*MASS_UNITS) & _any(u, ("m", "metre", "kcal", "%")), "MASS_UNIT_COMPATIBILITY", "UNIT", "ERROR"),
        _result((u != "") & ~_any(n, MASS_METRICS) & F.contains(n, F.lit("drilling")) & ~u.isin(*LENGTH_UNITS), "LENGTH_UNIT_COMPATIBILITY", "UNIT", "ERROR"),
        _result((u != "") & (n == "gcv") & ~u.isin(*ENERGY_UNITS), "ENERGY_UNIT_COMPATIBILITY", "UNIT", "ERROR"),
    ))
    ratio, ash, gcv = n == "stripping_ratio", n == "ash_content", n == "gcv"
    year_like = r"(?i)^(?:FY\s*)?([0-9]{4})[-/]([0-9]{2,4})$"
    found = F.array(
        F.when(number, _first(_result(~has, "NUMERIC_TYPE_CHECK", "TYPE", "ERROR"), _result(has, "NUMERIC_TYPE_CHECK", "TYPE", "PASS"))),
        units,
        _result(_any(n, NON_NEGATIVE) & (value < 0), "NON_NEGATIVE_CONSTRAINT", "RANGE", "ERROR"),
        F.when(ratio, _first(_result(value < 0, "STRIPPING_RATIO_NON_NEGATIVE", "RANGE", "ERROR"), _result(value > 50, "STRIPPING_RATIO_UPPER_BOUND", "RANGE", "WARNING"), _result(has, "STRIPPING_RATIO_PLAUSIBLE_RANGE", "RANGE", "PASS"))),
        F.when(ash, _first(_result((value < 0) | (value > 100), "ASH_PERCENT_PHYSICAL_BOUNDS", "RANGE", "ERROR"), _result(value > 65, "ASH_CONTENT_HIGH_WARNING", "RANGE", "WARNING"), _result(has, "ASH_PERCENT_PLAUSIBLE_RANGE", "RANGE", "PASS"))),
        F.when(gcv, _first(_result((value < 0) | (value > 9000), "GCV_PHYSICAL_BOUNDS", "RANGE", "ERROR"), _result(value < 1500, "GCV_LOW_WARNING", "RANGE", "WARNING"))),
        F.when(n == "fiscal_year", _first(_result(F.trim(raw).rlike(year_like), "FISCAL_YEAR_FORMAT", "CONSISTENCY", "PASS"), _result(F.lit(True), "FISCAL_YEAR_FORMAT", "CONSISTENCY", "WARNING"))),
    )
    return F.filter(found, lambda x: x.isNotNull())


def overall(found: Column) -> Column:
    """ERROR before WARNING before PASS."""
    has = lambda s: F.exists(found, lambda x: x["status"] == s)
    return F.when(has("ERROR"), "ERROR").when(has("WARNING"), "WARNING").otherwise("PASS")


def validate(facts: DataFrame) -> DataFrame:
    """``facts`` with ``validation`` (rule results) and ``validation_status``."""
    raw = F.col("raw_value") if "raw_value" in facts.columns else F.lit("")
    out = facts.withColumn("validation", results(F.col("field_name"), F.col("data_type"), F.col("numeric_value"), F.col("unit"), raw))
    return out.withColumn("validation_status", overall(F.col("validation")))


def context(facts: DataFrame, *, document: str = "document_id", seq: str = "id") -> DataFrame:
    """Per document the last entity (mine or project) and period named, with defaults."""
    last = lambda *names: F.max_by("normalized_value", F.when(F.col("field_name").isin(*names), F.col(seq)))
    return facts.groupBy(document).agg(F.coalesce(last("mine_name", "project_name"), F.lit("General Mine")).alias("entity_name"), F.coalesce(last("fiscal_year", "reporting_period"), F.lit("Current")).alias("reporting_period"))


def reconcile(facts: DataFrame, *, entity: str, metric: str, period: str, document: str, value: str, threshold: float = DIVERGENCE) -> DataFrame:
    """Groups that two documents or more report on: least and greatest value, divergence, MATCHED or CONFLICT."""
    key = lambda c, name: F.lower(F.trim(F.col(c).cast("string"))).alias(name)
    groups = facts.where(F.col(value).isNotNull()).groupBy(key(entity, "entity"), key(metric, "metric"), key(period, "period")).agg(F.countDistinct(document).alias("n_documents"), F.min(value).alias("least"), F.max(value).alias("greatest")).where("n_documents >= 2")
    spread = F.abs(F.col("greatest") - F.col("least")) / F.when(F.col("least") > 0, F.col("least")).otherwise(1.0)
    return groups.withColumn("divergence", spread).withColumn("conflict_status", F.when(F.col("divergence") > threshold, "CONFLICT").otherwise("MATCHED"))


def candidates(facts: DataFrame, groups: DataFrame, *, entity: str, metric: str, period: str, columns: list[str]) -> DataFrame:
    """The facts behind each group, sorted, one row per group; a group has one member per document and row reported."""
    key = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    members = facts.withColumns({"entity": key(entity), "metric": key(metric), "period": key(period)}).join(groups.select("entity", "metric", "period"), ["entity", "metric", "period"])
    return members.select("entity", "metric", "period", *columns)


def relate(mentions: DataFrame, *, document: str, scope: str, value: str, kind: str, confidence: float, most: int = 1000) -> DataFrame:
    """Edges between documents of one scope that share a value: (source, target, relationship_type, confidence, n_shared).

    Values are the join key, so documents are compared only where they share one. The documents of a value are gathered in
    parts of about ``most`` (a row each), and parts meet parts, so a value of many documents is dealt over several tasks and
    its mentions are shuffled once. The edges of a value are as many as its pairs: ``shared_groups`` says the same in rows
    that grow with the mentions.
    """
    distinct = mentions.where(F.col(value).isNotNull() & F.col(document).isNotNull()).select(document, scope, value).distinct()
    # parts by hash: as many as the value of most documents needs, fewer by powers of two for the others
    widest = distinct.groupBy(scope, value).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0
    parts = 1 << max(0, (-(-widest // most) - 1).bit_length())
    gathered = distinct.groupBy(scope, value, F.pmod(F.xxhash64(document), F.lit(parts)).alias("__part")).agg(F.collect_list(document).alias("__d"))
    if parts == 1:
        both = gathered.select(F.col("__d").alias("__a"), F.col("__d").alias("__b"))
    else:
        other = gathered.select(scope, value, F.col("__part").alias("__other"), F.col("__d").alias("__b"))
        both = gathered.join(other, [scope, value]).where("__part <= __other").select(F.col("__d").alias("__a"), "__b", (F.col("__part") < F.col("__other")).alias("__apart"))
    source, target = F.least("s", "t").alias("source_document_id"), F.greatest("s", "t").alias("target_document_id")
    pairs = both.select("*", F.explode("__a").alias("s")).select("*", F.explode("__b").alias("t")).where((F.col("s") != F.col("t")) & (F.col("__apart") | (F.col("s") < F.col("t"))) if parts > 1 else F.col("s") < F.col("t"))
    return pairs.groupBy(source, target).agg(F.count("*").alias("n_shared")).withColumns({"relationship_type": F.lit(kind), "confidence": F.lit(confidence)})


def relate_classes(mentions: DataFrame, *, document: str, scope: str, value: str, kind: str, confidence: float) -> DataFrame:
    """The edges of ``relate`` without writing out those of documents alike; every document is of one scope.

    Documents of a scope with the same set of values are a class, and the least represents it. Rows of type MEMBER give every
    document (target) its representative (source) and the number of its values, which any two of a class share; rows of
    type ``kind`` are edges between representatives, and hold for all documents of their classes.
    """
    distinct = mentions.where(F.col(value).isNotNull() & F.col(document).isNotNull()).select(document, scope, value).distinct()
    sets = distinct.groupBy(document, scope).agg(F.array_sort(F.collect_list(value)).alias("__v"))
    classes = sets.groupBy(scope, "__v").agg(F.min(document).alias("__r"))
    member = sets.join(classes, [scope, "__v"]).select(F.col("__r").alias("source_document_id"), F.col(document).alias("target_document_id"), F.size("__v").cast("long").alias("n_shared"), F.lit("MEMBER").alias("relationship_type"), F.lit(confidence).alias("confidence"))
    leaders = classes.select(F.col("__r").alias(document), scope, F.explode("__v").alias(value))
    return member.unionByName(relate(leaders, document=document, scope=scope, value=value, kind=kind, confidence=confidence))


def relate_alike(mentions: DataFrame, *, document: str, scope: str, value: str, kind: str, confidence: float, most: int = 1000) -> DataFrame:
    """The edges of ``relate``, a row for every pair, where documents have few different sets of values.

    Values are compared once for two classes of ``relate_classes``. Members of a class are gathered in parts of about
    ``most``; parts meet parts, are dealt over tasks by the number of their pairs, and there become pairs, which are not
    shuffled. Scope and value are compared as one, so a document may be of several scopes.
    """
    known = mentions.where(F.col(scope).isNotNull() & F.col(value).isNotNull())
    whole = written(known.select(document, F.lit(0).alias("__all"), F.struct(scope, value).alias("__key")).distinct(), "mentions")
    rows = written(relate_classes(whole, document=document, scope="__all", value="__key", kind="CLASSES", confidence=confidence), "classes")
    members = rows.where("relationship_type = 'MEMBER'").select(F.col("source_document_id").alias("__c"), F.col("target_document_id").alias("__m"))
    # a class meets itself by the row of its representative
    edges = rows.where("relationship_type = 'CLASSES' OR source_document_id = target_document_id").select(F.col("source_document_id").alias("__a"), F.col("target_document_id").alias("__b"), "n_shared")
    parts = members.groupBy("__c").agg(F.ceil(F.count("*") / most).alias("__parts"))
    # sorted, as rows dealt by their number must be the same if they are made again
    gathered = members.join(parts, "__c").groupBy("__c", F.pmod(F.xxhash64("__m"), "__parts").alias("__part")).agg(F.array_sort(F.collect_list("__m")).alias("__d"))
    left, right = (gathered.select(F.col("__c").alias(c), F.col("__part").alias(f"{c}_part"), F.col("__d").alias(f"{c}_d")) for c in ("__a", "__b"))
    met = edges.join(left, "__a").join(right, "__b").where("__a <> __b OR __a_part <= __b_part")
    pairs = met.agg(F.sum(F.size("__a_d").cast("long") * F.size("__b_d"))).first()[0] or 0
    dealt = met.repartition(max(4 * mentions.sparkSession.sparkContext.defaultParallelism, pairs // PAIRS_OF_A_TASK + 1))
    both = dealt.select("*", F.explode("__a_d").alias("s")).select("*", F.explode("__b_d").alias("t")).where("s < t OR __a <> __b OR __a_part <> __b_part")
    return both.select(F.least("s", "t").alias("source_document_id"), F.greatest("s", "t").alias("target_document_id"), "n_shared", F.lit(kind).alias("relationship_type"), F.lit(confidence).alias("confidence"))


def shared_groups(mentions: DataFrame, *, document: str, scope: str, value: str, kind: str, confidence: float) -> DataFrame:
    """Groups of documents of one scope that share a value: (scope, value, representative, document, n_documents, ...).

    One row per member; two documents are related if they are members of one group. The least document represents it.
    """
    distinct = mentions.where(F.col(value).isNotNull()).select(document, scope, value).distinct()
    groups = distinct.groupBy(scope, value).agg(F.min(document).alias("representative"), F.count("*").alias("n_documents")).where("n_documents > 1")
    return distinct.join(groups, [scope, value]).select(scope, value, "representative", document, "n_documents").withColumns({"relationship_type": F.lit(kind), "confidence": F.lit(confidence)})


def family_key(tokens: Column) -> Column:
    """Documents with one key are a family: the first token if it is long and not generic, else the first two unless both are."""
    first, second = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
    return F.when((F.length(first) >= 4) & ~first.isin(*GENERIC), first).when(second.isNotNull() & ~(first.isin(*GENERIC) & second.isin(*GENERIC)), F.concat_ws(" ", first, second))


def last_events(events: DataFrame, *, key: list[str], order: list[Column]) -> DataFrame:
    """The latest row of each key."""
    return events.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
