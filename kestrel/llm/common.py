"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
MASK = (1 << 64) - 1


def ready(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it (clusters ship it with --py-files)."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset and all runs on one machine (tests), under a local temporary folder."""
    ready(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="kestrel-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:
        base = "file://" + base.removeprefix("file:") if base.startswith(("/", "file:")) else base
    return f"{base.rstrip('/')}/kestrel/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, folder: str, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet and reads it back: lineage ends at files that outlive executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(folder: str, name: str = "") -> None:
    """Deletes a stash that nothing reads any more, or a whole folder of them."""
    fs, path = open_fs(f"{folder}/{name}".rstrip("/"))
    fs.delete_dir(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that are done with, instead of at its next chance collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def open_fs(uri: str):
    """(file system, path) for a folder that executors and the driver share."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


_kept: dict = {}


def only(key, make=None):
    """What a worker keeps from task to task, under one key at a time: asking for another key drops it, so that an operator does not hold the memory of the one before."""
    if key not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # where the C library can, it gives freed memory back
            ctypes.CDLL(None).malloc_trim(0)
        if make is not None:
            _kept[key] = make()
    return _kept.get(key)


def free_name(df: DataFrame, *names: str):
    """Names for helping columns that df has no column of, in any case: one, or a list where several are asked for."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out if len(out) > 1 else out[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col):
    from pyspark.sql import functions as F

    return F.coalesce(col.cast("string"), F.lit(""))


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash; forgets all it knows when it holds too many words."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (two multiply and shift rounds)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, in order; of the whole sequence where there are fewer words; none without words."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for j in range(k):
        out = out * factor + mix(words[j : n - k + 1 + j] + np.uint64(j + 1))
    return mix(out + np.uint64(k))
