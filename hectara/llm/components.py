"""Connected components of a distributed edge list by alternating star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hectara.session import cut_lineage


def large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it sees. Rows may repeat."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).repartition("u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b")


def small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them. Edges come as a < b."""
    dealt = edges.repartition("b")
    least = dealt.groupBy("b").agg(F.min("a").alias("m"))
    moved = dealt.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a < b")
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def unfinished(edges: DataFrame) -> DataFrame:
    """Nodes that are both a larger and a smaller end, or have two smaller ones."""
    ends = edges.select(F.col("b").alias("node"), F.col("a").alias("least")).unionByName(edges.select(F.col("a").alias("node"), F.lit(None).cast("long").alias("least")))
    return ends.groupBy("node").agg(F.count("least").alias("larger"), F.count("*").alias("every")).filter("larger > 0 and every > 1")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Ends when all edges are stars. An iteration deals the edges out four times: by either end, by the larger end, as distinct rows, and by node for the test.
    """
    edges = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    while not unfinished(edges).isEmpty():
        edges = cut_lineage(small_star(large_star(edges)))
    return cut_lineage(
        edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
        .unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    )
