"""Connected components of a large graph: large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passlane.llm.common import cut


def connected(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of longs to (node, component): the smallest node reachable.

    Every node that has a link to another gets a row. The least neighbour is an aggregate
    (combined before the shuffle) that is joined back, so a hub's links are never collected;
    each round is checkpointed, and the edges come to a star for each component.
    """
    edges = cut(links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every greater neighbour, and the node itself, to the least
        down = (both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        # small star: every smaller neighbour, and the node itself, to the least of them
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut(down.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                    .unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        # done when no node that others point to points on, and none points twice
        ups = edges.agg(F.count("*"), F.count_distinct("u")).first()
        on = edges.join(edges.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi")
        if ups[0] == ups[1] and on.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
