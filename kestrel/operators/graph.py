"""Module graph: hubs, mutual imports and orphans over an edge list (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def hubs(edges: DataFrame, n: int) -> DataFrame:
    """The n targets with the most distinct importers, ties by name."""
    return edges.groupBy("dst").agg(F.countDistinct("src").alias("importers")).orderBy(F.desc("importers"), "dst").limit(n)


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs a < b that import each other."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"]).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def orphans(nodes: DataFrame, edges: DataFrame, entry_points: DataFrame) -> DataFrame:
    """Nodes that nothing imports and that are no entry point."""
    return nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").join(entry_points, "node", "left_anti")


def merged(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) edges; top where any of them is."""
    return edges.groupBy("src", "dst").agg(F.bool_or("top").alias("top"))
