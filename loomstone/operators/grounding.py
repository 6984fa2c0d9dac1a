"""Whether answers say only what their evidence says, sentence by sentence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import text as tx

REFUSAL = "insufficient verified evidence"
#: Phrases that extrapolate, and the topics they extrapolate about.
SPECULATION = (
    r"\b(?:indicates|suggests|implies|proves)\s+that\b", r"\bsufficient\s+(?:coal\s+)?resources\s+to\s+meet\b", r"\bmeet\s+(?:its\s+|the\s+)?(?:current\s+|future\s+)?demand\b",
    r"\bwithout\s+(?:any\s+)?(?:significant\s+)?depletion\b", r"\bdepletion\s+over\s+time\b", r"\boperational\s+(?:failure|breakdown|inefficiency|bottleneck)\b",
    r"\bdue\s+to\s+(?:bad\s+weather|mismanagement|negligence|strike|flooding)\b", r"\bcauses?\s+of\s+(?:the\s+)?(?:decline|increase|fluctuation)\b", r"\blong-term\s+sustainability\b",
    r"\bwill\s+(?:likely|continue\s+to)\s+(?:increase|decrease|exhaust)\b", r"\bdemand\s+growth\b",
)
TOPICS = ("demand", "depletion", "depleted", "sufficiency", "sustainability", "failure")
COMMON = ("based", "given", "evidence", "report", "reported", "include", "includes", "approximately")
MIN_OVERLAP, CONFIDENT = 0.4, 0.015


def claims(answers: DataFrame, *, key: str, answer: str, evidence: str) -> DataFrame:
    """One row per sentence: numbers, whether they are in the evidence, speculation, word overlap, and the verdict."""
    rows = answers.select(key, F.lower(F.col(evidence)).alias("evidence"), F.posexplode(tx.sentences(F.col(answer))).alias("i", "sentence"))
    low = F.lower("sentence")
    numbers = tx.numbers(F.col("sentence"))
    missing = F.filter("numbers", lambda n: ~F.contains(F.col("evidence"), F.regexp_replace(n, "%$", "")))
    speaks = reduce(lambda a, b: a | b, [low.rlike(p) for p in SPECULATION])
    unbacked = F.exists(F.array(*map(F.lit, TOPICS)), lambda t: F.contains(low, t) & ~F.contains(F.col("evidence"), t))
    words = F.filter(F.regexp_extract_all(low, F.lit(r"\b[a-z]{4,}\b"), F.lit(0)), lambda w: ~w.isin(*COMMON))
    shared = F.filter("words", lambda w: F.contains(F.col("evidence"), w))
    out = rows.withColumns({"numbers": numbers, "words": words, "speculative": speaks & (unbacked | F.contains(low, F.lit("indicates that")) | F.contains(low, F.lit("sufficient")))})
    out = out.withColumns({"missing": missing, "overlap": F.when(F.size("words") > 0, F.size(shared) / F.size("words"))})
    supported = ~F.col("speculative") & (F.size("missing") == 0) & ((F.size("numbers") > 0) | F.col("overlap").isNull() | (F.col("overlap") >= MIN_OVERLAP))
    return out.withColumns({"supported": supported, "citations": F.transform(F.regexp_extract_all("sentence", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))})


def report(answers: DataFrame, *, key: str, answer: str, evidence: str) -> DataFrame:
    """Per answer: claims, supported ones, status and confidence (.95 with two citations, .90, 0.7 of the ratio, or .10)."""
    each = claims(answers, key=key, answer=answer, evidence=evidence).groupBy(key).agg(F.count("*").alias("n"), F.count_if("supported").alias("ok"))
    rows = answers.select(key, F.lower(F.col(answer)).alias("low"), F.size(F.regexp_extract_all(F.col(answer), F.lit(r"(?i)\[(?:Doc|P\.|\d+|Citation)[^\]]*\]"), F.lit(0))).alias("cites"))
    both = rows.join(each, key, "left").withColumns({"total_claims": F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)), "supported_claims": F.coalesce("ok", F.lit(0))})
    refused = F.contains("low", F.lit(REFUSAL))
    full = F.col("supported_claims") == F.col("total_claims")
    status = F.when(refused, "REFUSED").when(full, "SUPPORTED").when(F.col("supported_claims") > 0, "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED")
    confidence = F.when(refused, 0.0).when(full, F.when(F.col("cites") >= 2, 0.95).otherwise(0.90)).when(F.col("supported_claims") > 0, F.round(F.col("supported_claims") / F.col("total_claims") * 0.70, 2)).otherwise(0.10)
    return both.select(key, "total_claims", "supported_claims", status.alias("status"), confidence.alias("confidence"))


def citation_mismatches(each: DataFrame, chunks: DataFrame, *, key: str) -> DataFrame:
    """Sentences whose citation is out of range or holds none of the sentence's numbers (chunks: key, cite, source_text)."""
    cited = each.select(key, "i", "numbers", F.explode("citations").alias("cite")).join(chunks, [key, "cite"], "left")
    holds = F.exists("numbers", lambda n: F.contains(F.lower("source_text"), F.regexp_replace(n, "%$", "")))
    return cited.where(F.col("source_text").isNull() | ((F.size("numbers") > 0) & ~holds)).select(key, "i", "cite")


def refused(evidence: Column, overlap: Column, year_missing: Column, facts: Column, top: Column) -> Column:
    """No evidence, nothing on the topic, a stated year missing, or no facts and weak retrieval."""
    return (evidence == 0) | ~overlap | year_missing | ((facts == 0) & (top < CONFIDENT))


def synthesis(facts: DataFrame, *, key: str, order: str) -> DataFrame:
    """A deterministic answer of the facts: one sentence each, in order."""
    line = F.format_string("%s of %s in %s was %s %s [%d].", F.initcap(F.replace("field_name", F.lit("_"), F.lit(" "))), F.coalesce("entity_name", F.lit("the project")), F.coalesce("reporting_period", F.lit("the period")), F.format_number("numeric_value", 1), F.coalesce("unit", F.lit("")), F.col(order).cast("int"))
    return facts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("t")))), lambda x: x["t"]), " ").alias("answer"))
