"""Connected components of a graph given as pairs of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.session import written


def components(pairs: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``pairs`` (columns a, b) that is not the root of its component itself.

    The root is the smallest id of the component. Each round moves edges towards smaller
    neighbours, first of the larger ends, then of the smaller ones, until the edges are
    stars around the roots. Minima are aggregates and joins, so that a node with many
    neighbours is never one group in memory. Every round is a table in the shared folder.
    """
    edges = written(pairs.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min(F.least("node", "root")).alias("least"))
        large = both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("least").alias("root")).distinct()
        large = written(large, "edges")
        lower = large.groupBy("node").agg(F.min("root").alias("least"))
        moved = large.join(lower, "node").where("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        edges = written(moved.unionByName(lower.select("node", F.col("least").alias("root"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == state:
            return edges
        state = now
