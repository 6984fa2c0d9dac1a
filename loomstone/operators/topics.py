"""Topic analytics over chunks that carry a topic: class-based TF-IDF, prevalence, contribution and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import numbers as nx
from loomstone.functions import text as tx
from loomstone.functions import vectors as vx

MIN_CHUNKS, MIN_DOCUMENTS = 3, 2
#: When a chunk is an outlier of its topic.
MAX_DISTANCE, Z, MIN_SIZE = 0.65, 1.5, 2


def refused(chunks: Column, documents: Column) -> Column:
    """A corpus too small for topics."""
    return (chunks < MIN_CHUNKS) | (documents < MIN_DOCUMENTS)


def state(chunks: Column) -> Column:
    """struct<status, progress> of an analysis: a corpus too small stops at the first step."""
    small = chunks < MIN_CHUNKS
    return F.struct(F.when(small, "INSUFFICIENT_CORPUS").otherwise("COMPLETED").alias("status"), F.when(small, 10).otherwise(100).alias("progress"))


def method(chunks: Column) -> Column:
    """The label of an analysis by its size."""
    return F.when(chunks < 10, "TFIDF_KEYWORD").when(chunks < 50, "NMF_TFIDF").otherwise("EMBEDDING_CLUSTER_CTFIDF")


def topic_count(n: Column, wanted: int | None = None) -> Column:
    """How many topics ``n`` chunks get; ``wanted`` is held between 2 and n - 1."""
    if wanted is not None:
        return F.greatest(F.lit(2), F.least(F.lit(wanted), (n - 1).cast("int")))
    return F.when(n <= 5, 2).when(n <= 15, 3).when(n <= 50, 4).otherwise(F.least(F.lit(6), F.floor(F.sqrt(n / 2)).cast("int")))


def term_counts(chunks: DataFrame, *, topic: str, text: str) -> DataFrame:
    """(topic, term, f): tokens counted by topic; the only pass over texts."""
    return chunks.select(topic, F.explode(tx.tokens(F.col(text))).alias("term")).groupBy(topic, "term").agg(F.count("*").alias("f"))


def c_tf_idf(counts: DataFrame, *, topic: str, stopwords: list[str] | None = None, min_count: int = 1, top: int = 10) -> DataFrame:
    """The ``top`` terms of each topic: (topic, term, f, weight, rank), weight = f / mass(topic) * ln(1 + mean mass / f(term)).

    Masses count every token, stop words too; the vocabulary leaves them out. The counts are used twice, for the masses and
    for the terms, by equal plans, so that one shuffle serves both and texts are read once.
    """
    mass = counts.groupBy(topic).agg(F.sum("f").alias("mass")).withColumn("mean_mass", F.avg("mass").over(Window.partitionBy()))
    rows = counts.withColumn("total", F.sum("f").over(Window.partitionBy("term"))).join(F.broadcast(mass), topic)
    weight = F.col("f") / F.col("mass") * F.log(1 + F.col("mean_mass") / F.col("total"))
    kept = F.col("total") >= min_count
    if stopwords:
        kept = kept & ~F.col("term").isin(*stopwords)
    # the filter reads a computed column, so it stays above the counts and their plan stays shared
    rows = rows.withColumn("weight", F.when(kept, weight)).where("weight IS NOT NULL")
    order = Window.partitionBy(topic).orderBy(F.desc(F.round("weight", 9)), "term")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(topic, "term", "f", F.round("weight", 6).alias("weight"), "rank")


def labels(terms: DataFrame, *, topic: str) -> DataFrame:
    """(topic, label) of the first four terms by rank."""
    first = F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])
    return terms.groupBy(topic).agg(tx.topic_label(first).alias("label"))


def prevalence(chunks: DataFrame, *, topic: str, document: str) -> DataFrame:
    """(topic, n_chunks, n_documents, prevalence_pct) with the share of all chunks."""
    g = chunks.groupBy(topic).agg(F.count("*").alias("n_chunks"), F.countDistinct(document).alias("n_documents"))
    return g.withColumn("prevalence_pct", nx.share(F.col("n_chunks"), F.sum("n_chunks").over(Window.partitionBy())))


def contribution(chunks: DataFrame, *, topic: str, document: str, similarity: str) -> DataFrame:
    """(topic, document, n_chunks, mean_similarity, contribution_pct) with the share of the document's chunks."""
    g = chunks.groupBy(topic, document).agg(F.count("*").alias("n_chunks"), F.round(F.avg(similarity), 4).alias("mean_similarity"))
    return g.withColumn("contribution_pct", nx.share(F.col("n_chunks"), F.sum("n_chunks").over(Window.partitionBy(document))))


def centroids(vectors: DataFrame, *, topic: str, vector: str) -> DataFrame:
    """(topic, centroid): the mean vector, aggregated per dimension."""
    long = vectors.select(topic, F.posexplode(vector).alias("i", "x"))
    mean = long.groupBy(topic, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy(topic).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def distances(vectors: DataFrame, *, topic: str, vector: str) -> DataFrame:
    """``vectors`` with the cosine distance to the centroid of their topic."""
    return vectors.join(F.broadcast(centroids(vectors, topic=topic, vector=vector)), topic).withColumn("distance", 1 - vx.cosine(F.col(vector), F.col("centroid"))).drop("centroid")


def outliers(rows: DataFrame, *, topic: str, new: str = "topic_id") -> DataFrame:
    """``rows`` with ``new``: -1 for outliers (too few, too far, or far beyond the mean), surviving topics renumbered from 0."""
    # a topic's figures are one row; its documents are not brought together
    figures = rows.groupBy(F.col(topic).alias("__topic")).agg(F.count("*").alias("__n"), (F.avg("distance") + Z * F.stddev_pop("distance")).alias("__far"))
    out = (F.col("__n") < MIN_SIZE) | (F.col("distance") > MAX_DISTANCE) | (F.col("distance") > F.col("__far"))
    flagged = rows.join(F.broadcast(figures), F.col(topic).eqNullSafe(F.col("__topic"))).withColumn("outlier", out).drop("__topic", "__n", "__far")
    live = flagged.where("NOT outlier").select(topic).distinct().withColumn("__new", F.dense_rank().over(Window.orderBy(topic)) - 1)
    return flagged.join(F.broadcast(live), topic, "left").withColumn(new, F.when(F.col("outlier"), -1).otherwise(F.col("__new"))).drop("__new")


def sizes(chunks: DataFrame, *, topic: str) -> DataFrame:
    """Distribution of topic sizes, population standard deviation."""
    n = chunks.groupBy(topic).agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("greatest"), F.round(F.avg("n"), 4).alias("mean"), F.expr("percentile(n, 0.5)").alias("median"), F.round(F.stddev_pop("n"), 4).alias("std"))


def coherence(vectors: DataFrame, *, topic: str, vector: str) -> DataFrame:
    """(topic, coherence): mean cosine over all pairs of a topic, from sums of unit vectors (no pairs are formed).

    The mean over pairs is (|sum of unit vectors|^2 - n) / (n (n - 1)).
    """
    unit = vectors.withColumn("__norm", vx.norm(F.col(vector))).where("__norm > 0").select(topic, F.posexplode(F.transform(F.col(vector), lambda x: x.cast("double"))).alias("i", "x"), "__norm")
    per = unit.groupBy(topic, "i").agg(F.sum(F.col("x") / F.col("__norm")).alias("s"), F.count("*").alias("n"))
    both = per.groupBy(topic).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    return both.select(topic, F.when(F.col("n") > 1, F.round((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6)).alias("coherence"))


def diversity(terms: DataFrame) -> Column:
    """Distinct terms over terms, for ``agg``."""
    return F.round(F.countDistinct("term") / F.count("*"), 4)


def cluster(vectors: DataFrame, k: int, *, vector: str = "embedding", seed: int = 42, starts: int = 10) -> DataFrame:
    """Unit vectors, their projection on the leading singular vectors when there are enough rows, k-means; adds ``topic``.

    The singular vectors are those of the uncentred rows, from their Gram matrix (as wide as a vector); of ``starts``
    k-means runs the one of least cost counts.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.linalg import Vectors

    rows = Normalizer(inputCol="__v", outputCol="__u", p=2.0).transform(vectors.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double")))))
    n = vectors.count()
    use = "__u"
    if n > 5:
        basis = RowMatrix(rows.select(vector_to_array("__u").alias("x")).rdd.map(lambda r: Vectors.dense(r.x))).computeSVD(min(10, n - 1)).V.toArray().T
        axes = [F.array(*map(F.lit, map(float, axis))) for axis in basis]
        rows, use = rows.withColumn("__p", array_to_vector(F.array(*(vx.dot(vector_to_array("__u"), a) for a in axes)))), "__p"
    points = rows.select(use).persist()  # read by every pass of every run; a lost part is made again
    try:
        models = [KMeans(k=k, seed=seed + i, featuresCol=use, predictionCol="topic").fit(points) for i in range(starts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
    finally:
        points.unpersist()
    return best.transform(rows).drop("__v", "__u", "__p")
