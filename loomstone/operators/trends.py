"""Topics over periods: a zero-filled grid, shares, deltas, trend and persistence classes, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import numbers as nx

#: Gates of the trend classes.
MIN_PERIOD_DOCUMENTS, MIN_EMERGING, MIN_DISAPPEARING, PP = 5, 2, 2, 2.0
UNSPECIFIED = "UNSPECIFIED"


def grid(rows: DataFrame, *, topic: str, period: str, document: str) -> DataFrame:
    """(topic, period, document_count, chunk_count, corpus_document_count, document_share_pct) for every topic and period.

    Rows of an unspecified period count nowhere. Topics and periods are both small sets; their product is the grid.
    """
    known = rows.where(F.col(period).isNotNull() & (F.col(period) != UNSPECIFIED))
    corpus = known.groupBy(period).agg(F.countDistinct(document).alias("corpus_document_count"), F.count("*").alias("corpus_chunk_count"))
    own = known.groupBy(topic, period).agg(F.countDistinct(document).alias("document_count"), F.count("*").alias("chunk_count"))
    cells = known.select(topic).distinct().crossJoin(F.broadcast(corpus))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    full = cells.join(own, [topic, period], "left").select(topic, period, zero("document_count"), zero("chunk_count"), "corpus_document_count", "corpus_chunk_count")
    return full.withColumn("document_share_pct", nx.share(F.col("document_count"), F.col("corpus_document_count")))


def series(cells: DataFrame, *, topic: str, period: str) -> DataFrame:
    """Deltas to the period before and the trend class. Growth is that of the already rounded shares."""
    w = Window.partitionBy(topic).orderBy(period)
    earlier = w.rowsBetween(Window.unboundedPreceding, -2)
    prev = lambda c: F.lag(c).over(w)
    out = cells.withColumns({
        "previous_count": prev("document_count"), "previous_share": prev("document_share_pct"), "previous_corpus": prev("corpus_document_count"),
        "present_earlier": F.coalesce(F.max((F.col("document_count") > 0).cast("int")).over(earlier), F.lit(0)) == 1,
    })
    out = out.withColumns({
        "absolute_change": F.col("document_count") - F.col("previous_count"),
        "percentage_point_change": F.round(F.col("document_share_pct") - F.col("previous_share"), 2),
        "growth_rate_pct": F.when(F.col("previous_share").isNotNull(), nx.growth(F.col("previous_share"), F.col("document_share_pct"))),
    })
    return out.withColumn("trend_status", status(F.col("document_count"), F.col("previous_count"), F.col("corpus_document_count"), F.col("previous_corpus"), F.col("percentage_point_change"), F.col("present_earlier")))


def status(now: Column, before: Column, corpus: Column, corpus_before: Column, pp: Column, earlier: Column) -> Column:
    """The trend class; the first rule that applies decides."""
    few = "INSUFFICIENT_HISTORY"
    return (
        F.when(before.isNull(), few)
        .when((corpus < MIN_PERIOD_DOCUMENTS) | (corpus_before < MIN_PERIOD_DOCUMENTS), few)
        .when((now > 0) & (before == 0) & earlier, "RECURRING")
        .when((before == 0) & (now >= MIN_EMERGING), "EMERGING")
        .when((before >= MIN_DISAPPEARING) & (now == 0), "DISAPPEARING")
        .when((now < MIN_EMERGING) | (before < MIN_EMERGING), few)
        .when(pp > PP, "GROWING")
        .when(pp < -PP, "DECLINING")
        .otherwise("STABLE")
    )


def persistence(cells: DataFrame, *, topic: str, period: str) -> DataFrame:
    """First and last period seen, periods observed, ratio and class of every topic."""
    seen = F.col("document_count") > 0
    g = cells.groupBy(topic).agg(
        F.count("*").alias("n_periods"), F.count_if(seen).alias("n_observed"), F.min(F.when(seen, F.col(period))).alias("first_seen"),
        F.max(F.when(seen, F.col(period))).alias("last_seen"), F.max_by("document_count", period).alias("latest"),
    )
    ratio = F.round(F.col("n_observed") / F.col("n_periods"), 4)
    kind = (
        F.when(F.col("n_periods") <= 1, "INSUFFICIENT_HISTORY").when(F.col("n_observed") == 0, "DISAPPEARED")
        .when((F.col("n_observed") == 1) & (F.col("latest") > 0), "NEW").when(F.col("latest") == 0, "DISAPPEARED")
        .when(ratio >= 0.75, "PERSISTENT").otherwise("INTERMITTENT")
    )
    return g.withColumns({"persistence_ratio": ratio, "persistence_class": kind}).drop("latest")


def compare(cells: DataFrame, a: str, b: str, *, topic: str, period: str) -> DataFrame:
    """Period ``a`` against ``b`` per topic."""
    side = lambda p, s: cells.where(F.col(period) == p).select(topic, F.col("document_count").alias(f"count_{s}"), F.col("document_share_pct").alias(f"share_{s}"))
    both = side(a, "a").join(side(b, "b"), topic, "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0 if c.startswith("share") else 0))
    filled = both.select(topic, *[zero(c).alias(c) for c in ("count_a", "share_a", "count_b", "share_b")])
    return filled.withColumns({"count_change": F.col("count_b") - F.col("count_a"), "pp_change": F.round(F.col("share_b") - F.col("share_a"), 2)})


def distribution(rows: DataFrame, *, dimension: str, topic: str, document: str) -> DataFrame:
    """Per dimension value and topic: chunks, distinct documents and the share of the value's chunks."""
    g = rows.groupBy(dimension, topic).agg(F.count("*").alias("chunk_count"), F.countDistinct(document).alias("document_count"))
    return g.withColumn("chunk_share_pct", nx.share(F.col("chunk_count"), F.sum("chunk_count").over(Window.partitionBy(dimension))))


def term_evolution(rows: DataFrame, terms: DataFrame, *, topic: str, period: str, text: str, top: int = 15) -> DataFrame:
    """Occurrences of each topic's ``top`` terms by period, as whole tokens."""
    from loomstone.functions.text import tokens

    counted = rows.select(topic, period, F.explode(tokens(F.col(text))).alias("term")).groupBy(topic, period, "term").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(terms.where(F.col("rank") <= top).select(topic, "term")), [topic, "term"])


def summary(row_topic: Column, label: Column, state: Column, share: Column) -> Column:
    return F.format_string("Topic %s (%s) is %s at %.2f%% of documents.", row_topic.cast("string"), label, F.lower(F.replace(state, F.lit("_"), F.lit(" "))), share)
