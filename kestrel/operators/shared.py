"""Written intermediate tables, and joins that a hot key does not stop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, a path of the cluster's default file system unless it says otherwise.

    Where that is unset and all runs on one machine (tests), under a local temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="kestrel-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/kestrel/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it back: lineage ends at files that outlive executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup(rows: DataFrame, table: DataFrame, on: str, count: str, total: int) -> DataFrame:
    """rows with the columns of table, which has a key of `on` once and says in `count` how many of the `total` rows have it; rows without a match go.

    Keys of more than a fixed share of all rows are few (the share bounds their number): they are sent to
    the tasks, so their rows stay where they are.  The others are joined by key.
    """
    share = max(1, total // (4 * partitions(rows.sparkSession)))
    hot, rest = table.where(F.col(count) > share).drop(count), table.where(F.col(count) <= share).drop(count)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(rest, on))
