"""Connected components of a link table by Spark joins: hook to the least neighbour, shorten the paths, contract, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import shared


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node with a link; ``comp`` is the least node reachable.

    Each turn every component with a smaller neighbour joins its least one, so the number of components that still have
    links at least halves. Nothing is collected; every turn is written to the shared folder, and nodes of many links are salted.
    """
    edges = shared.written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to"))
        up = shorten(shared.written(up.select(F.col("a").alias("node"), F.col("to").alias("comp")), "hooks"))
        if labels is None:
            labels = up
        else:
            new = shared.salted(labels, up.select(F.col("node").alias("comp"), F.col("comp").alias("next")), ["comp"], shared.hot(labels, "comp"), "left")
            labels = shared.written(new.select("node", F.coalesce("next", "comp").alias("comp")), "labels")
        at = up.select(F.col("node"), F.col("comp"))
        heavy = shared.hot(edges, "a"), shared.hot(edges, "b")
        edges = shared.salted(edges, at.select(F.col("node").alias("a"), F.col("comp").alias("ca")), ["a"], heavy[0])
        edges = shared.salted(edges, at.select(F.col("node").alias("b"), F.col("comp").alias("cb")), ["b"], heavy[1])
        edges = shared.written(edges.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")
    if labels is None:
        return links.select(F.col(a).alias("node"), F.col(b).alias("comp")).limit(0)
    return labels


def shorten(up: DataFrame) -> DataFrame:
    """Follow ``comp`` of ``comp``, two steps a turn, until every node points at its root."""
    while True:
        over = up.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        again = up.select(F.col("node").alias("next"), F.col("comp").alias("last"))
        root = F.coalesce("last", "next", "comp")
        once = shared.salted(up, over, ["comp"], shared.hot(up, "comp"), "left")
        longer = shared.written(once.join(again, "next", "left").select("node", root.alias("comp"), (root != F.col("comp")).alias("moved")), "hooks")
        up = longer.select("node", "comp")
        if longer.where("moved").isEmpty():
            return up
