"""Connected components of an edge list too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kestrel.llm.common import shared_dir, stash


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, component) for edges (a, b): the smallest node of each component, by neighbours' minima and pointer jumping.

    Each round ends in written files.  Nodes without an edge don't appear; null ends and loops are left aside.
    """
    folder = folder or shared_dir(edges.sparkSession, "components")
    edges = edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = stash(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), folder, "edges")
    labels = stash(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), folder, "labels-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(near, "u").select("u", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        hooked = stash(hooked, folder, f"hooked-{step}")
        # A label is a node: its own label is at least as small.
        onward = hooked.select(F.col("u").alias("label"), F.col("label").alias("onward"))
        after = stash(hooked.join(onward, "label").select("u", F.col("onward").alias("label"), "old"), folder, f"labels-{step}")
        if after.where("label <> old").limit(1).count() == 0:
            return after.select(F.col("u").alias("node"), F.col("label").alias("component"))
        labels = after.select("u", "label")
