"""Importance resampling towards a target corpus, over inverted postings that are partitioned by bucket.

A text's features are its runs of 1 to `orders` words, each hashed to a bucket.  Tasks write what they
read as postings: for a range of buckets and a block of documents, which bucket stands in which
document how often.  The postings of a range meet the totals that both corpora have in its buckets;
there each bucket's gain is computed, and what it adds to each document goes out, to be summed by
document.  A range is salted by blocks, so no task holds a bucket whole, however frequent it is:
postings stream past the totals of their range.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kestrel.llm.common import partitions, ready, shared_dir, stash, text_or_empty

#: Production parameters.
ORDERS, BUCKETS, SHARE, LEAST_WORDS, SEED = 2, 10_000, 25, 20, 7
#: Ranges of buckets; blocks that share a salt; postings and documents to a block; bytes of a text that are looked at together.
RANGES, BLOCKS, POSTINGS, DOCUMENTS, PIECE = 64, 4096, 200_000, 4096, 1 << 20
#: Longest word whose length has a table.
TABLED = 64
#: Bytes of a word are themselves, in lower case; all others end it.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
READ = "row_key long, doc_id long, n_words long, n_features long, part int, block long, totals array<long>, postings binary"


def _shifts() -> np.ndarray:
    """[n, i, v]: what byte v at place i of a CRC-32 becomes when n bytes follow; parts are joined by exclusive or."""
    base = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        base = np.where(base & 1, (base >> 1) ^ np.uint32(0xEDB88320), base >> 1)
    out = [np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)]
    for _ in range(TABLED + 1):
        out.append(base[out[-1] & 255] ^ (out[-1] >> 8))
    return np.stack(out)


class _WordSums(dict):
    """Word to the CRC-32 of itself and of a blank and itself (upper half); forgets all when it holds too many."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word) | zlib.crc32(b" " + word) << 32
        if len(word) <= TABLED:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


class Features:
    """Counts of a text's features by bucket."""

    def __init__(self, orders: int = ORDERS, buckets: int = BUCKETS):
        self.orders, self.buckets, self.sums, self.shifts = orders, buckets, _WordSums(), _shifts()

    def counts(self, text: bytes) -> tuple[int, np.ndarray]:
        """(words, features in each bucket) of UTF-8 bytes, a piece at a time."""
        data, total, seen, carry = text.translate(_WORD), np.zeros(self.buckets, np.int64), 0, []
        for words in self._pieces(data):
            if words:
                carry = self._add(words, seen, carry, total)
                seen += len(words)
        return seen, total

    @staticmethod
    def _pieces(data: bytes):
        p, n = 0, len(data)
        while p < n:
            q = n
            if n - p > PIECE:
                q = data.rfind(b" ", p, p + PIECE)
                if q <= p:
                    q = data.find(b" ", p + PIECE)
                    q = n if q < 0 else q
            yield data[p:q].split()
            p = q

    def _add(self, words: list[bytes], seen: int, carry: list[int], total: np.ndarray) -> list[int]:
        """Adds the runs that end in these words; carry: sums of the runs that end in the last word before them, by length."""
        both = np.fromiter(map(self.sums.__getitem__, words), np.uint64, len(words))
        runs, after = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        long = np.flatnonzero(sizes > TABLED).tolist()
        shift, ends = np.minimum(sizes + 1, TABLED + 1), []
        for k in range(1, self.orders + 1):
            if k > 1:
                before = np.empty(len(words), np.uint32)
                before[1:], before[0] = runs[:-1], carry[k - 2] if len(carry) > k - 2 else 0
                runs = after.copy()
                for i in range(4):
                    runs ^= self.shifts[shift, i, (before >> np.uint32(8 * i)) & np.uint32(255)]
                for i in long:
                    runs[i] = zlib.crc32(b" " + words[i], int(before[i]))
            whole = runs[max(0, k - 1 - seen) :]
            if not len(whole):
                break
            total += np.bincount(whole % np.uint32(self.buckets), minlength=self.buckets)
            ends.append(int(whole[-1]))
        return ends


def _width(buckets: int) -> int:
    return -(-buckets // RANGES)


def _packed(bucket: np.ndarray, doc: np.ndarray, count: np.ndarray, width: int) -> bytes:
    """Postings of one range in order of their buckets: postings per bucket, documents (2 bytes each), counts (a byte, large ones at the end)."""
    large = count >= 255
    parts = (np.bincount(bucket, minlength=width).astype("<u4"), doc.astype("<u2"), np.where(large, 255, count).astype("u1"), count[large].astype("<i8"))
    return b"".join(x.tobytes() for x in parts)


def _unpacked(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.frombuffer(data, "<u4", width).astype(np.int64)
    n = int(sizes.sum())
    doc = np.frombuffer(data, "<u2", n, 4 * width)
    count = np.frombuffer(data, "u1", n, 4 * width + 2 * n).astype(np.int64)
    large = count == 255
    count[large] = np.frombuffer(data, "<i8", int(large.sum()), 4 * width + 3 * n)
    return np.repeat(np.arange(width), sizes), doc, count


def _rows(**columns) -> pa.RecordBatch:
    fields = {"row_key": pa.int64(), "doc_id": pa.int64(), "n_words": pa.int64(), "n_features": pa.int64(), "part": pa.int32(), "block": pa.int64(), "totals": pa.list_(pa.int64()), "postings": pa.binary()}
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), t) for c, t in fields.items()], list(fields))


def _read(docs: DataFrame, id_col: str | None, text_col: str, orders: int, buckets: int, postings: bool) -> DataFrame:
    """Rows of three kinds: a document's counts, a range's postings in a block, a range's totals in a task."""
    ready(docs.sparkSession)
    own = F.col(f"`{id_col}`").cast("long") if id_col else F.lit(None).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), own.alias("doc_id"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    width = _width(buckets)

    def run(batches):
        made = Features(orders, buckets)
        totals, block = np.zeros(width * RANGES, np.int64), []  # (row_key, buckets, counts)

        def flush():
            bucket, doc = (np.concatenate(x) for x in ([b for _, b, _ in block], [np.full(len(b), k - block[0][0]) for k, b, _ in block]))
            count = np.concatenate([c for _, _, c in block])
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            bucket, doc, count = bucket[order], doc[order], count[order]
            cuts = np.searchsorted(bucket, np.arange(RANGES + 1) * width).tolist()
            parts = [p for p in range(RANGES) if cuts[p] < cuts[p + 1]]
            data = [_packed(bucket[cuts[p] : cuts[p + 1]] - p * width, doc[cuts[p] : cuts[p + 1]], count[cuts[p] : cuts[p + 1]], width) for p in parts]
            out = _rows(part=parts, block=[block[0][0]] * len(parts), postings=data) if parts else None
            block.clear()
            return out

        held = 0
        for batch in batches:
            words, features, keys = [], [], batch.column(0).to_pylist()
            kind = pa.large_binary() if pa.types.is_large_string(batch.column(2).type) else pa.binary()
            for key, text in zip(keys, batch.column(2).cast(kind), strict=True):
                n, found = made.counts(text.as_py())
                words.append(n)
                features.append(int(found.sum()))
                totals[:buckets] += found
                if postings:
                    at = np.flatnonzero(found)
                    block.append((key, at, found[at]))
                    held += len(at)
                    if held >= POSTINGS or len(block) >= DOCUMENTS:
                        held, out = 0, flush()
                        if out is not None:
                            yield out
            yield _rows(row_key=keys, doc_id=batch.column(1).to_pylist(), n_words=words, n_features=features)
        if block and (out := flush()) is not None:
            yield out
        if totals.any():
            yield _rows(part=list(range(RANGES)), totals=totals.reshape(RANGES, width).tolist())

    return rows.mapInArrow(run, READ)


def gains(s: list[int], t: list[int], all_s: int, all_t: int, buckets: int) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each bucket."""
    return np.array([math.floor(1000 * math.log((y + 1.0) * (all_s + buckets) / ((x + 1.0) * (all_t + buckets)))) for x, y in zip(s, t, strict=True)], np.int64)


def _contributions(read: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(row_key, gain): what a range of buckets adds to a document, a few rows per document and task."""
    spark, width = read.sparkSession, _width(buckets)
    sums = read.where("totals is not null").select("part", F.posexplode("totals").alias("pos", "s"), F.lit(0).cast("long").alias("t"))
    sums = sums.unionByName(target.where("totals is not null").select("part", F.posexplode("totals").alias("pos", "t"), F.lit(0).cast("long").alias("s")))
    sums = sums.groupBy("part", "pos").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    sums = sums.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("pos", "s", "t"))).alias("x"))  # as many entries as a range has buckets
    all_s, all_t = (df.agg(F.coalesce(F.sum("n_features"), F.lit(0))).first()[0] for df in (read, target))
    posted = read.where("postings is not null").select("part", "block", "postings")
    salts = max(1, posted.count() // (RANGES * BLOCKS))
    none = F.lit(None).cast("array<long>")
    posted = posted.select("part", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "block", "postings", none.alias("s"), none.alias("t"))
    sums = sums.select("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("postings"), F.col("x.s").alias("s"), F.col("x.t").alias("t"))
    cells = posted.unionByName(sums).repartition(max(partitions(spark), RANGES * salts), "part", "salt").sortWithinPartitions("part", "salt", F.col("block").asc_nulls_first())

    def run(batches):
        gain = None
        for batch in batches:
            keys, added = [], []
            for block, data, s, t in zip(*(batch.column(i) for i in range(2, 6)), strict=True):
                if not block.is_valid:
                    gain = gains(s.as_py(), t.as_py(), all_s, all_t, buckets)
                    continue
                bucket, doc, count = _unpacked(data.as_py(), width)
                present = np.bincount(doc)
                total = np.zeros(len(present), np.int64)
                np.add.at(total, doc, gain[bucket] * count)
                at = np.flatnonzero(present)
                keys.append(block.as_py() + at)
                added.append(total[at])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (keys, added)], ["row_key", "gain"])

    return cells.mapInArrow(run, "row_key long, gain long")


def ranked(df: DataFrame, folder: str, *order) -> DataFrame:
    """Adds rank, 1 for the first row in an order that leaves no ties: numbered in ranges, so no task holds all rows."""
    spark = df.sparkSession
    rows = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = stash(rows, folder, "ordered").withColumn("_range", F.shiftright("_at", 33))
    # A row for each range, of which there are as many as shuffle partitions at most.
    sizes = rows.groupBy("_range").agg(F.count("*").alias("n"))
    before = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(before), "_range").withColumn("rank", place).drop("_range", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; rank is null for those that are not drawn.

    `share` percent of the documents of `least_words` words or more are drawn, those of the highest
    scores (weight and Gumbel noise that the id decides), ties by id, null ids last.  Null texts have
    no words; without features the weight is 0.  A null id gives noise as an empty one does.  Rows that
    repeat an id have a row each, with a rank each if they are drawn; an empty table gives no rows, an
    empty target counts of 0.  Long texts are counted a piece at a time, to their end.
    """
    folder = shared_dir(docs.sparkSession, "resampling")
    read = stash(_read(docs, id_col, text_col, orders, buckets, True), folder, "read")
    wanted = stash(_read(target, None, target_text, orders, buckets, False), folder, "target")
    added = _contributions(read, wanted, buckets).groupBy("row_key").agg(F.sum("gain").alias("gain"))
    own = read.where("row_key is not null").select("row_key", "doc_id", "n_words", "n_features")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(0).cast("long")
    scored = own.join(added, "row_key", "left").withColumn("weight", weight)
    scored = stash(scored.select("row_key", "doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score")), folder, "scored")
    shape = ["doc_id", "n_features", "weight", "score"]
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * share // 100
    placed = ranked(able, folder, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row_key")
    placed = placed.select(*shape, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    return placed.unionByName(scored.where(F.col("n_words") < least_words).select(*shape, F.lit(None).cast("long").alias("rank")))
