"""Keyed state in versions: buckets of rows behind a manifest that is put in place as the last step.

A version is a manifest: for each bucket of keys the folder of its rows, and how many there are.  A new
version writes the buckets that changed to a folder of its own, then its manifest under a passing name,
and renames that.  A writer that is lost before the rename leaves the version before as it is; one that
finds its number taken by another gives up.  Buckets are of a fixed number, so a manifest is small.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Version:
    number: int
    buckets: dict[int, tuple[str, int]]  # folder and rows


class Store:
    """Rows of a schema under a path that all machines share, one to a key."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _names(self) -> list[str]:
        folder = self._at(f"{self.path}/manifests")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        return sorted((n for f in found if (n := f.getPath().getName()).startswith("v")), reverse=True)

    def _load(self, name: str) -> Version | None:
        """The manifest of that name, null if it can't be read or its rows are not all there."""
        try:
            text = "".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{name}").collect())  # one small file
            found = {int(b): (folder, rows) for b, (folder, rows) in json.loads(text).items()}
        except (ValueError, TypeError, AttributeError):
            return None
        version = Version(int(name[1:].removesuffix(".json")), found)
        if not all(self._fs.exists(self._at(f"{self.path}/{folder}")) for folder, _ in found.values()):
            return None
        try:
            whole = self.read(version).count() == sum(rows for _, rows in found.values())
        except Exception:  # a file that is cut short or gone
            return None
        return version if whole else None

    def current(self) -> Version | None:
        """The newest version; null if there is none, or it is damaged: then a full run is due."""
        names = self._names()
        return self._load(names[0]) if names else None

    def read(self, version: Version) -> DataFrame:
        folders = sorted({f"{self.path}/{folder}" for folder, rows in version.buckets.values() if rows})
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _commit(self, rows: DataFrame, base: dict[int, tuple[str, int]], touched: set[int], number: int) -> Version:
        """Rows of the touched buckets become the content of those; the others stay as in base."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        written = self.spark.read.parquet(f"{self.path}/{folder}") if touched and not rows.isEmpty() else None
        counts = {r["_bucket"]: r["count"] for r in written.groupBy("_bucket").count().collect()} if written is not None else {}
        buckets = {b: x for b, x in base.items() if b not in touched} | {b: (f"{folder}/_bucket={b}", n) for b, n in counts.items()}
        passing, final = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._at(f"{self.path}/manifests/v{number:012d}.json")
        out = self._fs.create(passing)
        out.write(bytearray(json.dumps(buckets).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(passing, final):
            self._fs.delete(passing, False)
            raise RuntimeError(f"version {number} was written by another")
        return Version(number, buckets)

    def replace(self, rows: DataFrame) -> Version:
        """A full run: a new version of these rows alone.  It goes on from the newest number, damaged or not."""
        names = self._names()
        number = int(names[0][1:].removesuffix(".json")) + 1 if names else 1
        return self._commit(rows.select(*self._columns()), {}, set(range(self.buckets)), number)

    def _columns(self) -> list[str]:
        return [f.name for f in self.spark.createDataFrame([], self.schema).schema]

    def apply(self, base: Version, upserts: DataFrame, deletes: DataFrame) -> Version:
        """A version after base, with these rows in place of those of their keys and without the keys of deletes.

        A key is in either once at most.  Only buckets with such keys are read and written.
        """
        changed = upserts.select(self.keys).unionByName(deletes.select(self.keys))
        touched = {r[0] for r in changed.select(self._bucket()).distinct().collect()}  # as many as there are buckets at most
        held = {b: x for b, x in base.buckets.items() if b in touched}
        rows = self.read(Version(base.number, held)).join(changed, self.keys, "left_anti").unionByName(upserts.select(*self._columns()))
        return self._commit(rows, base.buckets, touched, base.number + 1)

    def drop_old(self, keep: int = 2) -> None:
        """Deletes all but the newest versions, and folders that none of those names; no writer may be at work."""
        names = self._names()
        kept = [v for v in map(self._load, names[:keep]) if v]
        for name in names[keep:]:
            self._fs.delete(self._at(f"{self.path}/manifests/{name}"), False)
        used = {folder.split("/")[1] for v in kept for folder, _ in v.buckets.values()}
        data = self._at(f"{self.path}/data")
        for f in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f.getPath().getName() not in used:
                self._fs.delete(f.getPath(), True)


def evaluate(store: Store, files: DataFrame, digest: Column, facts: Callable[[DataFrame], DataFrame]) -> tuple[Version, str]:
    """Brings the state of files to date (I3-I6): (version, how), how is full, delta or same.

    `store` has the keys, digest and what `facts` gives besides; facts(files) gives a row per key.  Files
    whose digest is unchanged keep their rows, changed ones are extracted anew, deleted ones go.  Without
    a version, or with a damaged one, all files are extracted.
    """
    keyed = files.withColumn("digest", digest)
    base = store.current()
    extracted = lambda some: facts(some).join(some.select(*store.keys, "digest"), store.keys)
    if base is None:
        return store.replace(extracted(keyed)), "full"
    old = store.read(base).select(*store.keys, F.col("digest").alias("_old"))
    changed = keyed.join(old, store.keys, "left").where(~F.col("digest").eqNullSafe(F.col("_old"))).drop("_old")
    gone = old.join(keyed, store.keys, "left_anti").select(store.keys)
    if changed.isEmpty() and gone.isEmpty():
        return base, "same"
    return store.apply(base, extracted(changed), gone), "delta"
