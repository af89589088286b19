"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(e: DataFrame) -> bool:
    """Whether every node a of the edges a > b has one edge and is no other node's b."""
    if e.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1):
        return False
    return not e.select("b").distinct().join(e.select(F.col("a").alias("b")), "b", "left_semi").head(1)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b) of longs; component is its smallest node.

    A step links all neighbours of a node to the smallest of them: first those larger than the node,
    then those smaller. It ends when the edges are stars, each around its smallest node. Minima are
    pre-aggregated, and both sides of the joins are written first, so that Spark can split a hub's
    rows between tasks. Nulls and loops are left out; no edges give no rows.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    while not _stars(e):
        both = e.union(e.select("b", "a"))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut(e.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
