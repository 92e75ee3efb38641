"""Connected components of links, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``links`` (a, b): root is the smallest node reachable.

    Large-star and small-star in turn: a node's larger neighbours, then its smaller
    ones, are handed to the least of it and its neighbours, until each component is
    one star. Rounds grow with the logarithm of a chain's length, whatever its labels.
    """
    nodes = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = saved(nodes.distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = saved(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        handed = large.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        new = saved(handed.unionByName(least.select("a", F.col("least").alias("b"))).distinct(), "links")
        # settled: every node has one smaller neighbour, and that one has none
        if new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and new.join(new.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return new.toDF("node", "root").unionByName(new.select("b", "b").distinct().toDF("node", "root"))
        edges = new
