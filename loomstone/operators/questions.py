"""Questions as rows: what they name, which calculation they ask for, and an answer from facts that is checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import periods
from loomstone.functions import text as tx
from loomstone.operators import facts as fx
from loomstone.operators import grounding

#: Names, and the words that stand for metrics and topics.
SUBSIDIARIES = ("CIL", "CMPDI", "BCCL", "CCL", "ECL", "WCL", "SECL", "MCL", "NCL", "NEC")
METRICS = {
    "production": ("production", "output", "tonnage", "extracted", "yield"), "stripping ratio": ("stripping ratio", "strip ratio", "sr", "ob to coal"),
    "overburden": ("overburden", "ob removal", "ob excavation"), "reserve": ("reserve", "geological reserve", "proved reserve", "indicated reserve"),
    "ash content": ("ash content", "ash percentage", "ash %"), "calorific value": ("calorific value", "gcv", "heat value"),
    "thickness": ("thickness", "seam thickness"), "safety": ("safety", "accident", "incident", "dgms"),
}
TOPICS = {
    "drilling": ("drill", "drilling", "borehole", "coring", "strata"), "exploration": ("exploration", "survey", "geological survey", "reconnaissance"),
    "environment": ("environment", "forestry", "clearance", "air quality", "water"), "dispatch": ("dispatch", "offtake", "rake", "loading"),
}
NAMED = (r"Mine\s+[A-Za-z0-9_-]+", r"Block\s+[A-Za-z0-9_-]+", r"Area\s+[A-Za-z0-9_-]+", r"Colliery\s+[A-Za-z0-9_-]+", r"Seam\s+[A-Za-z0-9_-]+", r"BH[-_\s]*\d+[A-Za-z]?", r"Borehole[-_\s]*\d+[A-Za-z]?")
COMPARING = ("growth", "increase", "decrease", "change", "difference", "variance", "yoy", "year-over-year", "compared to", "versus", "vs", "trend", "compare")
SUMMING = ("total", "sum", "combined", "aggregate", "average", "mean", "overall")


def _quoted(word: str) -> str:
    return word.replace("%", "\\%").replace(" ", r"\s")


def entities(text: Column) -> Column:
    """Subsidiaries, then named mines, blocks, areas, seams and boreholes, then known mines; each once."""
    known = lambda names: F.filter(F.array(*map(F.lit, names)), lambda n: F.regexp_like(text, F.concat(F.lit(r"(?i)\b"), n, F.lit(r"\b"))))
    named = F.concat(*[F.regexp_extract_all(text, F.lit(rf"(?i)\b({p})\b"), F.lit(1)) for p in NAMED])
    return F.array_distinct(F.concat(known(SUBSIDIARIES), F.transform(named, tx.squeeze), known(fx.MINES)))


def tags(text: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Groups with a word of theirs in the text, whole words only."""
    low = F.lower(text)
    hit = lambda words: low.rlike("|".join(rf"\b{_quoted(w)}" + (r"\b" if w[-1].isalnum() else "") for w in words))
    return F.filter(F.array(*[F.when(hit(words), F.lit(name)) for name, words in groups.items()]), lambda x: x.isNotNull())


def normalised(questions: DataFrame, *, text: str = "question") -> DataFrame:
    """``questions`` with clean_query, entities, metrics, topics, fiscal_years and the period range they span."""
    q = F.col(text)
    out = questions.withColumns({"clean_query": tx.clean_query(q), "entities": entities(q), "metrics": tags(q, METRICS), "topics": tags(q, TOPICS), "fiscal_years": periods.mentioned(q)})
    several = F.size("fiscal_years") >= 2
    return out.withColumns({"period_start": F.when(several, F.array_min("fiscal_years")), "period_end": F.when(several, F.array_max("fiscal_years"))})


def calculations(question: str, records: DataFrame, *, entity: str = "entity_name", metric: str = "field_name", period: str = "reporting_period", document: str = "document_id", value: str = "numeric_value") -> DataFrame:
    """The calculation that a question implies, per entity and metric: consecutive periods, or a sum or average; else no rows."""
    low = question.lower()
    key = [F.lower(F.trim(F.coalesce(entity, F.lit("Entity")))).alias("entity"), F.replace(F.lower(F.trim(F.col(metric))), F.lit("_"), F.lit(" ")).alias("metric")]
    rows = records.where(F.col(value).isNotNull()).select(*key, F.coalesce(period, F.lit("")).alias("period"), F.col(document).alias("document"), F.col(value).alias("value")).distinct()
    if any(w in low for w in COMPARING):
        pairs = fx.year_over_year(rows.withColumn("at", F.struct("period", "document", "value")), keys=["entity", "metric"], period="at", value="value")
        real = pairs.where((F.abs(F.col("value") - F.col("previous_value")) >= 1e-9) | (F.col("period") != F.col("previous_period.period")))
        return real.select("entity", "metric", F.lit("YOY").alias("operation"), F.col("previous_value").alias("first"), F.col("value").alias("last"), F.col("absolute_change").alias("result"), "percentage_change")
    if any(w in low for w in SUMMING):
        mean = any(w in low for w in ("average", "mean"))
        found = rows.groupBy("entity", "metric").agg(F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last"), F.round(F.avg("value") if mean else F.sum("value"), 4).alias("result")).where("n >= 2")
        return found.select("entity", "metric", F.lit("AVERAGE" if mean else "SUM").alias("operation"), "first", "last", "result", F.lit(None).cast("double").alias("percentage_change"))
    return rows.limit(0).select("entity", "metric", F.lit("").alias("operation"), F.col("value").alias("first"), F.col("value").alias("last"), F.col("value").alias("result"), F.lit(None).cast("double").alias("percentage_change"))


def answered(facts: DataFrame, *, key: str, order: str) -> DataFrame:
    """A deterministic answer per key, grounded against the facts it was made of: (key, answer, status, confidence)."""
    answers = grounding.synthesis(facts, key=key, order=order)
    line = F.concat_ws(" ", F.replace("field_name", F.lit("_"), F.lit(" ")), F.coalesce("entity_name", F.lit("the project")), F.coalesce("reporting_period", F.lit("the period")), F.format_number("numeric_value", 1), F.coalesce("unit", F.lit("")))
    evidence = facts.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(line)), " ").alias("evidence"))
    both = answers.join(evidence, key)
    return both.select(key, "answer").join(grounding.report(both, key=key, answer="answer", evidence="evidence").select(key, "status", "confidence"), key)


def observed(rows: DataFrame, name: str):
    """``rows`` whose count is observed as the plan runs, and the observation to ask for it."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen
