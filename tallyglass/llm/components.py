"""Connected components of a distributed edge list by alternating large and small stars.

Every round replaces edges by edges to smaller nodes; the result is one star per component. Rounds
grow with the logarithm of the size. Only two numbers per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def connected(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, root): the smallest node that each node of an edge can reach.

    Null ends and loops are ignored; repeated edges are harmless; no edges give no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(
        "u != v and a is not null and b is not null").distinct().checkpoint()
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = now
        edges = _small_star(_large_star(edges)).checkpoint()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to its smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.join(least, both.u == least.w).where("v > u").select(
        F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    moved = edges.join(least, edges.u == least.w).where("v != m").select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).distinct()
