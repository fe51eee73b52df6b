"""Connected components of a graph given by its edges, by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeprep.llm.stage import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component: its smallest node.

    Large star and small star in turn: every node's larger, then smaller neighbours are
    hung on the smallest one near it, until only stars are left. That takes few rounds (the
    logarithm of the graph's size), each with map-side sums; every round is a written
    table. Neighbourhoods are never gathered: hubs are joined back, and adaptive execution
    splits a hub with many edges. ``edges`` is read several times; stage it if it is costly.
    """
    edges = edges.filter("u <> v").select("u", "v").distinct()
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.filter("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        down = stage(large, "large-star").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
        roots = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(roots, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .union(roots.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = stage(small, "small-star")
        if only_stars(edges):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v"), F.col("v")).distinct()
    )


def only_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, and nothing hangs on a node that does."""
    twice = edges.groupBy("u").count().filter("count > 1").select("u")
    chained = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u")
    return twice.union(chained).isEmpty()
