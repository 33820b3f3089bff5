"""Exact deduplication behind an index of live digests: cuckoo filters over stored keys.

Texts are equal when they are identical after A-Z are put in lower case; their digest is the SHA-256
of what that gives.  Digests are dealt to shards by their leading bytes.  A shard has a cuckoo filter
(16 bits of the digest, four slots to a bucket, two buckets to a digest) and the stored keys behind
it, kept by pair of buckets.  A digest that the filter does not know is new; one that it knows is held
against the stored keys of its buckets, since it may only look like one of them.  A filter that finds
no place doubles its buckets and is filled anew from the stored keys.

A row in memory stands for one distinct text of a shard, of which there are KEYS in the mean, so a
table needs more shards, not larger ones, as it grows.  Copies are summed before they are dealt, in
each task, so a text with any number of copies sends a row or two from each.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kestrel.llm.common import discard, partitions, ready, shared_dir, stash, text_or_empty

#: Stored keys to a shard in the mean; distinct digests that a task sums copies of before it sends them on.
KEYS, HELD = 1 << 16, 50_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MEMBERS = "row_key long, doc_id long, digest binary, shard int"
STORED = "shard int, digest binary, live_id long, live_key long, copies long, slots binary"


class CuckooFilter:
    """Digests as 16-bit fingerprints in one of two buckets each; may take a digest for another, never misses one that was added."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 64, slots: bytes | None = None):
        self.slots = array("H", slots if slots is not None else bytes(2 * self.SLOTS * buckets))
        self.mask = len(self.slots) // self.SLOTS - 1
        if self.mask & (self.mask + 1):
            raise ValueError("the number of buckets must be a power of two")

    @staticmethod
    def fingerprint(digest: bytes) -> int:
        return 1 + int.from_bytes(digest[16:20], "little") % 65535

    def places(self, digest: bytes) -> tuple[int, int, int]:
        """(fingerprint, bucket, other bucket); either bucket and the fingerprint give the other."""
        mark, first = self.fingerprint(digest), int.from_bytes(digest[8:16], "little") & self.mask
        return mark, first, self.other(first, mark)

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 >> 3 & self.mask)

    def _bucket(self, b: int) -> array:
        return self.slots[b * self.SLOTS : (b + 1) * self.SLOTS]

    def has(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        return mark in self._bucket(a) or mark in self._bucket(b)

    def _put(self, bucket: int, mark: int) -> bool:
        for at in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
            if not self.slots[at]:
                self.slots[at] = mark
                return True
        return False

    def add(self, digest: bytes) -> bool:
        """False if it found no place: the filter is as it was, and too small."""
        mark, a, b = self.places(digest)
        if self._put(a, mark) or self._put(b, mark):
            return True
        moved, bucket = [], b
        for kick in range(self.KICKS):
            at = bucket * self.SLOTS + (mark + kick) % self.SLOTS
            moved.append((at, self.slots[at]))
            mark, self.slots[at] = self.slots[at], mark
            bucket = self.other(bucket, mark)
            if self._put(bucket, mark):
                return True
        for at, before in reversed(moved):
            self.slots[at] = before
        return False

    def remove(self, digest: bytes) -> bool:
        """Takes out a digest that was added; of one that never was it may take out another's."""
        mark, a, b = self.places(digest)
        for bucket in (a, b):
            for at in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if self.slots[at] == mark:
                    self.slots[at] = 0
                    return True
        return False

    def filled(self, digests: list[bytes]) -> CuckooFilter:
        """A filter of at least this size with these digests in it, doubled until all have a place."""
        buckets = self.mask + 1
        while True:
            new = CuckooFilter(buckets)
            if all(map(new.add, digests)):
                return new
            buckets *= 2


class Shard:
    """A filter and the stored keys behind it: digest, live row (id, row key) and copies."""

    def __init__(self):
        self.filter = CuckooFilter()
        self.stored: dict[int, list[list]] = {}

    def _content(self, digest: bytes) -> list[list]:
        _, a, b = self.filter.places(digest)
        return self.stored.setdefault(min(a, b), [])

    def add(self, digest: bytes, live: tuple, copies: int) -> None:
        if self.filter.has(digest):
            for key in self._content(digest):  # the filter may err: only an equal digest is a copy
                if key[0] == digest:
                    key[1], key[2] = max(key[1], live), key[2] + copies
                    return
        if not self.filter.add(digest):
            keys = list(self.keys())
            self.filter = CuckooFilter(2 * (self.filter.mask + 1)).filled([k[0] for k in keys] + [digest])
            self.stored = {}
            for key in keys:
                self._content(key[0]).append(key)
        self._content(digest).append([digest, live, copies])

    def keys(self) -> Iterator[list]:
        for content in self.stored.values():
            yield from content


@dataclass(frozen=True)
class Index:
    """A version of the index, in files: members (a row per document), keys (a row per live digest), filters (a row per shard)."""

    folder: str
    shards: int
    members: DataFrame
    keys: DataFrame
    filters: DataFrame


def _order(doc_id: int | None, row_key: int) -> tuple:
    """The larger is the one that stays: the larger id, nulls last of all; of rows that share an id the first."""
    return (doc_id is not None, doc_id or 0, -row_key)


def _live(live: tuple) -> tuple[int | None, int]:
    return (live[1] if live[0] else None), -live[2]


def _better(doc_id: str, row_key: str) -> Column:
    """The order of `_order` for max()."""
    return F.struct(F.col(doc_id).isNotNull().alias("there"), F.col(doc_id).alias("id"), (-F.col(row_key)).alias("key"))


def digests(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_key, doc_id, digest and shard of every row, over its whole text; null text counts as empty."""
    ready(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))

    def run(batches):
        for batch in batches:
            found = [hashlib.sha256(x.as_py().translate(_LOWER)).digest() for x in batch.column(2).cast(pa.large_binary() if pa.types.is_large_string(batch.column(2).type) else pa.binary())]
            shard = [int.from_bytes(x[:8], "big") % shards for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary()), pa.array(shard, pa.int32())], ["row_key", "doc_id", "digest", "shard"])

    return rows.mapInArrow(run, MEMBERS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in STORED.split(", ")])


def _summed(batches):
    """Rows of members as stored keys, a few for each digest of a task."""
    held: dict[bytes, list] = {}

    def flush():
        out = [(shard, digest, *_live(live), copies, None) for digest, (shard, live, copies) in held.items()]
        held.clear()
        return _batch(out)

    for batch in batches:
        for row_key, doc_id, digest, shard in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            live, at = _order(doc_id, row_key), held.get(digest)
            if at is None:
                held[digest] = [shard, live, 1]
            else:
                at[1], at[2] = max(at[1], live), at[2] + 1
        if len(held) > HELD:
            yield flush()
    if held:
        yield flush()


def _sharded(batches):
    """Stored keys in the order of their shards: each shard's through its filter, then the filter itself."""

    def done(number, shard):
        rows = [(number, digest, *_live(live), copies, None) for digest, live, copies in shard.keys()]
        return _batch([*rows, (number, None, None, None, None, shard.filter.slots.tobytes())])

    now, shard = None, Shard()
    for batch in batches:
        for number, digest, live_id, live_key, copies in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if number != now:
                if now is not None:
                    yield done(now, shard)
                now, shard = number, Shard()
            shard.add(digest, _order(live_id, live_key), copies)
    if now is not None:
        yield done(now, shard)


def _by_shard(df: DataFrame, *order: str) -> DataFrame:
    n = partitions(df.sparkSession)
    return df.repartitionById(n, F.pmod("shard", F.lit(n))).sortWithinPartitions("shard", *order)


def build(docs: DataFrame, shards: int | None = None, folder: str | None = None, **columns: str) -> Index:
    """An index of all rows of a table; shards is for one that is to be put into another index."""
    folder = folder or shared_dir(docs.sparkSession, "exact")
    n = shards or max(partitions(docs.sparkSession), -(-docs.count() // KEYS))
    members = stash(digests(docs, n, **columns), folder, "members")
    made = stash(_by_shard(members.mapInArrow(_summed, STORED)).mapInArrow(_sharded, STORED), folder, "stored")
    return Index(folder, n, members, made.where("digest is not null").drop("slots"), made.where("slots is not null").select("shard", "slots"))


def _ask(index: Index, keys: DataFrame) -> DataFrame:
    """The keys that the filters know or seem to know."""
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("digest", "binary"), ("live_id", "long"), ("live_key", "long"), ("copies", "long"))]
    both = index.filters.select("shard", *blank, "slots").unionByName(keys.withColumn("slots", F.lit(None).cast("binary")))
    ordered = _by_shard(both.select(*(x.split()[0] for x in STORED.split(", "))), "digest")  # nulls first: the filter

    def run(batches):
        now, known = None, None
        for batch in batches:
            shard, digest, slots = (batch.column(i).to_pylist() for i in (0, 1, 5))
            hit = []
            for s, d, x in zip(shard, digest, slots, strict=True):
                if d is None:
                    now, known = s, CuckooFilter(slots=x)
                hit.append(d is not None and s == now and known.has(d))
            yield batch.filter(pa.array(hit, pa.bool_()))

    return ordered.mapInArrow(run, STORED).drop("slots")


def _refiltered(index: Index, added: DataFrame, removed: DataFrame, keys: DataFrame, folder: str) -> DataFrame:
    """The filters after digests came and went; one that overflows is filled anew from all stored keys of its shard."""
    change = lambda df, kind: df.select("shard", F.lit(kind).alias("kind"), "digest", F.lit(None).cast("binary").alias("slots"))
    rows = index.filters.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("digest"), "slots").unionByName(change(removed, 1)).unionByName(change(added, 2))
    schema = "shard int, slots binary, buckets int"

    def run(batches):
        out = lambda s, f, full: pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "slots": pa.array([None if full else f.slots.tobytes()], pa.binary()), "buckets": pa.array([f.mask + 1], pa.int32())})
        now, filter_, full = None, None, False
        for batch in batches:
            for s, kind, digest, slots in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if s != now:
                    if now is not None:
                        yield out(now, filter_, full)
                    now, filter_, full = s, CuckooFilter(slots=slots), False
                if kind == 1:
                    filter_.remove(digest)
                elif kind == 2:
                    full = full or not filter_.add(digest)
        if now is not None:
            yield out(now, filter_, full)

    def fill(batches):
        now, held, buckets = None, [], 0
        made = lambda: pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "slots": pa.array([CuckooFilter(2 * buckets).filled(held).slots.tobytes()], pa.binary())})
        for batch in batches:
            for s, digest, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if s != now:
                    if now is not None:
                        yield made()
                    now, held, buckets = s, [], size
                held.append(digest)
        if now is not None:
            yield made()

    changed = stash(_by_shard(rows, "kind").mapInArrow(run, schema), folder, "changed")
    full = changed.where("slots is null").select("shard", "buckets")
    refilled = _by_shard(keys.join(full, "shard").select("shard", "digest", "buckets")).mapInArrow(fill, "shard int, slots binary")
    return stash(changed.where("slots is not null").select("shard", "slots").unionByName(refilled), folder, "filters")


def _with_empty_filters(index: Index, shards: DataFrame) -> Index:
    blank = CuckooFilter().slots.tobytes()
    fresh = shards.select("shard").distinct().join(index.filters, "shard", "left_anti").select("shard", F.lit(blank).alias("slots"))
    return Index(index.folder, index.shards, index.members, index.keys, index.filters.unionByName(fresh))


def insert(index: Index, docs: DataFrame, **columns: str) -> Index:
    """A new version of the index with the rows of docs added; the old one stays as it is.

    Only the digests that the filters seem to know are held against stored keys.  Rows that repeat
    ones of the index are copies of their own.  No rows give an index of the same content.
    """
    folder = shared_dir(docs.sparkSession, "exact")
    fresh = build(docs, index.shards, f"{folder}/fresh", **columns)
    # Row keys of a later table come after those of earlier ones.
    top = index.members.agg(F.max("row_key")).first()[0]
    shift = 0 if top is None else top + 1
    members = stash(index.members.unionByName(fresh.members.withColumn("row_key", F.col("row_key") + shift)), folder, "members")
    keys = fresh.keys.withColumn("live_key", F.col("live_key") + shift)
    index = _with_empty_filters(index, keys)
    asked = _ask(index, keys).select("shard", "digest", F.col("live_id").alias("new_id"), F.col("live_key").alias("new_key"), F.col("copies").alias("more"))
    hits = stash(asked.join(index.keys, ["shard", "digest"]), folder, "hits")
    last = F.greatest(_better("live_id", "live_key"), _better("new_id", "new_key"))
    merged = hits.select("shard", "digest", last.alias("last"), (F.col("copies") + F.col("more")).alias("copies"))
    merged = merged.select("shard", "digest", F.col("last.id").alias("live_id"), (-F.col("last.key")).alias("live_key"), "copies")
    known = hits.select("shard", "digest")
    added = keys.join(known, ["shard", "digest"], "left_anti")
    stored = stash(index.keys.join(known, ["shard", "digest"], "left_anti").unionByName(merged).unionByName(added), folder, "keys")
    return Index(folder, index.shards, members, stored, _refiltered(index, added.select("shard", "digest"), known.limit(0), stored, folder))


def delete(index: Index, docs: DataFrame, **columns: str) -> Index:
    """A new version without the members that equal rows of docs in id and text, however often either holds them.

    A digest none of whose members is left goes from its filter and the stored keys; of one that lost
    the row that stayed, the next in order takes its place.  Rows that the index does not have do nothing.
    """
    folder = shared_dir(docs.sparkSession, "exact")
    gone = stash(digests(docs, index.shards, **columns).select("shard", "digest", "doc_id").distinct(), folder, "gone")
    keys = gone.select("shard", "digest").distinct().select("shard", "digest", *(F.lit(None).cast("long").alias(c) for c in ("live_id", "live_key", "copies")))
    hits = stash(_ask(index, keys).select("shard", "digest").join(index.keys.select("shard", "digest"), ["shard", "digest"]), folder, "hits")
    out = gone.withColumnRenamed("doc_id", "_id").withColumnsRenamed({"shard": "_shard", "digest": "_digest"})
    same = (F.col("shard") == F.col("_shard")) & (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    members = stash(index.members.join(out, same, "left_anti"), folder, "members")
    left = members.join(hits, ["shard", "digest"], "left_semi").groupBy("shard", "digest").agg(F.max(_better("doc_id", "row_key")).alias("last"), F.count("*").alias("copies"))
    left = stash(left.select("shard", "digest", F.col("last.id").alias("live_id"), (-F.col("last.key")).alias("live_key"), "copies"), folder, "left")
    stored = stash(index.keys.join(hits, ["shard", "digest"], "left_anti").unionByName(left), folder, "keys")
    removed = hits.join(left, ["shard", "digest"], "left_anti")
    return Index(folder, index.shards, members, stored, _refiltered(index, hits.limit(0), removed, stored, folder))


def groups(index: Index) -> DataFrame:
    """A row per member: doc_id, keep_id, group_size, kept, text_sha256.

    Texts without a copy need no join.  Those with more than a fixed share of all rows are few (the
    share bounds their number) and are sent to the tasks; the others are joined by digest.
    """
    spark = index.members.sparkSession
    share = max(1, index.members.count() // (4 * partitions(spark)))
    several = index.keys.where("copies > 1").select("digest", "live_id", "live_key", "copies")
    hot = several.where(F.col("copies") > share)
    members = index.members.select("row_key", "doc_id", "digest")
    first = members.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left")
    rest = first.where("hot is null").select(members.columns).join(several.where(F.col("copies") <= share), "digest", "left")
    alone = F.col("copies").isNull()
    return first.where("hot").drop("hot").unionByName(rest).select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("live_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("live_key") == F.col("row_key"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, **columns: str) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row of the largest id stays; null ids come last, and of rows that repeat an id
    and a text one stays.  Null text counts as empty, and empty texts are equal.  Texts are read whole,
    whatever their length.  An empty table gives no rows; other columns don't matter.
    """
    return groups(build(docs, **columns))


def drop(index: Index) -> None:
    """Deletes the files of a version that nothing reads any more."""
    discard(index.folder)
