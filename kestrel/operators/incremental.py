"""Incremental evaluation: what changed, what is kept, what is read again.  A delta gives the rows of a full run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

Extract = Callable[[DataFrame], DataFrame]


def digests(files: DataFrame) -> DataFrame:
    """(project, path, digest); null texts have the empty text's digest."""
    return files.select("project", "path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))


def plan(before: DataFrame, files: DataFrame) -> DataFrame:
    """(project, path, change): added, modified or deleted, by digests (I3); a rename is a deletion and an addition (Q29)."""
    now = digests(files).withColumnRenamed("digest", "now")
    both = before.join(now, ["project", "path"], "full_outer")
    change = F.when(F.col("digest").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("digest") != F.col("now"), "modified")
    return both.select("project", "path", change.alias("change")).where("change IS NOT NULL")


def carry_over(state: DataFrame, changes: DataFrame, files: DataFrame, extract: Extract) -> DataFrame:
    """State rows of unchanged files with those that `extract` reads from changed ones.

    `extract` must look at one file at a time; what spans files is computed on the result.
    """
    kept = state.join(changes.select("project", "path"), ["project", "path"], "left_anti")
    changed = files.join(changes.where("change != 'deleted'").select("project", "path"), ["project", "path"], "left_semi")
    return kept.unionByName(extract(changed).select(state.columns))


def nearest_cached(cached: DataFrame, ancestors: DataFrame, most: int = 50) -> DataFrame:
    """(project, hash, depth) of the nearest first-parent ancestor (project, hash, depth) that is cached."""
    hits = ancestors.where(F.col("depth") <= most).join(cached.select("project", "hash").distinct(), ["project", "hash"])
    return hits.groupBy("project").agg(F.min_by("hash", F.struct("depth", "hash")).alias("hash"), F.min("depth").alias("depth"))


def exact_hits(cached: DataFrame, heads: DataFrame, version: int, own_folder: str) -> DataFrame:
    """Cached reports of clean (project, hash, dirty paths) heads under a schema version (I1); changes in the own folder don't count."""
    clean = heads.where(F.size(F.filter("dirty", lambda p: ~p.startswith(own_folder))) == 0)
    return cached.where(F.col("version") == version).join(clean.select("project", "hash"), ["project", "hash"], "left_semi")
