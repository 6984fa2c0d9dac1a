"""One query per training-data operator, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import backoff, decontaminate, jaccard, language, maintext, media, phrases, pieces, pii, quality, records, shared, toxicity, whitening


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings: 0 for low quality, 1 for good but toxic, 2 for good and clean."""
    labels = shared.table(spark, sf_dir, "labels").select("doc_id", (2 * F.col("quality") - F.col("quality") * F.coalesce("toxic", F.lit(0))).alias("rating"))
    return quality.grade(shared.table(spark, sf_dir, "documents"), labels)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(shared.table(spark, sf_dir, "documents"))


def op3_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff.score(shared.table(spark, sf_dir, "documents"))
    return scored.withColumns({"log_score": F.round("log_score", 3), "mean_log_score": F.round("mean_log_score", 5)})


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))


def op5_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(shared.table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(shared.table(spark, sf_dir, "documents"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.read(records.write(shared.table(spark, sf_dir, "documents"), records.byte_level_encoder()))


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"), short_inside=True)


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(shared.table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(shared.table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(shared.table(spark, sf_dir, "documents"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(shared.table(spark, sf_dir, "pages"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(shared.table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_backoff_scores": op3_backoff_scores,
    "op4_toxicity": op4_toxicity,
    "op5_jaccard_groups": op5_jaccard_groups,
    "op6_personal_data": op6_personal_data,
    "op7_token_records": op7_token_records,
    "op8_benchmark_leaks": op8_benchmark_leaks,
    "op9_media_chunks": op9_media_chunks,
    "op10_pieces": op10_pieces,
    "op11_phrases": op11_phrases,
    "op12_main_text": op12_main_text,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op3_backoff_scores": backoff.ORACLE,
    "op5_jaccard_groups": jaccard.ORACLE,
    "op8_benchmark_leaks": decontaminate.ORACLE,
    "op11_phrases": phrases.ORACLE,
}
