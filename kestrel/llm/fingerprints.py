"""One-permutation MinHash fingerprints with optimal densification, kept as packed low-order bits.

Each shingle is hashed once: its leading bits choose a bin, the bin keeps its smallest hash.  An
empty bin copies the first non-empty bin on a probe sequence of its own (a function of the bin
alone, the same for all texts), which keeps collisions unbiased.  Of each bin `bits` low-order bits
are stored; two fingerprints agree in a bin by chance with probability 2^-bits, which the estimate
takes out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kestrel.llm.common import WordHashes, mix, partitions, ready, shingle_hashes, text_or_empty

WORDS = 5
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class OnePermutation:
    """Words are runs without ASCII white space, ASCII letters in lower case; a text without words has the empty fingerprint."""

    def __init__(self, bins: int = 256, bits: int = 4, words: int = WORDS):
        if bins & (bins - 1) or bins < 8 or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two from 8 on, bits one of 1, 2, 4, 8")
        self.bins, self.bits, self.words, self.hashes = bins, bits, words, WordHashes()
        self.shift = np.uint64(64 - (bins.bit_length() - 1))
        self.probes = np.stack([self._probe(np.arange(bins), a) for a in range(64)])

    def _probe(self, bins: np.ndarray, attempt: int) -> np.ndarray:
        """The bin that an empty bin looks at in this attempt."""
        return (mix(bins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt * 2 + 1)) >> self.shift).astype(np.int64)

    def of(self, text: str) -> bytes:
        shingles = shingle_hashes(self.hashes.of(text.encode().lower().split()), self.words)
        if not len(shingles):
            return b""
        least = np.full(self.bins, np.iinfo(np.uint64).max, np.uint64)
        at = (shingles >> self.shift).astype(np.int64)
        np.minimum.at(least, at, shingles)
        full = np.zeros(self.bins, bool)
        full[at] = True
        out, empty, attempt = least.copy(), np.flatnonzero(~full), len(self.probes)
        if len(empty):
            tried = full[self.probes[:, empty]]
            hit = tried.any(axis=0)
            out[empty[hit]] = least[self.probes[tried[:, hit].argmax(axis=0), empty[hit]]]
            empty = empty[~hit]
        while len(empty):
            probe = self._probe(empty, attempt)
            hit = full[probe]
            out[empty[hit]] = least[probe[hit]]
            empty, attempt = empty[~hit], attempt + 1
        low = (mix(out) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        per_byte = 8 // self.bits
        low = low.reshape(-1, per_byte) << (np.arange(per_byte, dtype=np.uint8) * self.bits)
        return np.bitwise_or.reduce(low, axis=1).astype(np.uint8).tobytes()

    def likeness(self, a: bytes, b: bytes) -> float:
        """Estimated Jaccard similarity, bias taken out, from 0 to 1.  Two empty fingerprints are alike, an empty one and another are not."""
        if not a or not b:
            return float(a == b)
        per_byte, mask = 8 // self.bits, (1 << self.bits) - 1
        differ = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
        same = sum(int(((differ >> (i * self.bits)) & mask == 0).sum()) for i in range(per_byte)) / self.bins
        chance = 2.0**-self.bits
        return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def edited(text: str, following: str) -> str:
    """The last quarter of the text (code points, rounded down) replaced by the first as many of the text that follows."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def id_bounds(docs: DataFrame, n: int) -> list[int]:
    """Bounds between ranges of doc_id with about as many rows each, from the id column alone.  They are estimates and may differ from call to call."""
    return sorted({int(x) for x in docs.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)})


def with_range(docs: DataFrame, bounds: list[int]) -> DataFrame:
    """Adds _range, the number of bounds up to the id; null ids are in range 0."""
    limits = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64), "right").astype(np.int32))

    return docs.withColumn("_range", range_of("doc_id"))


def compare_with_next(docs: DataFrame, bins: int = 256, bits: int = 4, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edit against the next document in ascending id.

    Null text counts as empty.  Null ids come first; rows of one id are in the order of their texts;
    after the last row follows the first, which for a table of one row is that row.
    """
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    bounds = id_bounds(docs, 2 * partitions(spark))
    ranged, of_ids = with_range(docs, bounds), with_range(docs.select("doc_id"), bounds)
    # The first id of each range, a row per range: its rows are also sent to the range before, as what follows the last row there.
    first = of_ids.groupBy("_range").agg(F.min("doc_id").alias("first"), (F.count("*") > F.count("doc_id")).alias("has_null")).orderBy("_range").collect()
    before = {r["_range"]: first[i - 1]["_range"] for i, r in enumerate(first)}
    keys = [F.struct(F.lit(r["_range"]).alias("r"), F.lit(None if r["has_null"] else r["first"]).cast("long").alias("f"), F.lit(before[r["_range"]]).alias("b")) for r in first]
    if not keys:
        return spark.createDataFrame([], RESULT)
    marks = F.map_from_arrays(F.array(*(k["r"] for k in keys)), F.array(*keys))
    ranged = ranged.withColumn("_m", F.element_at(marks, F.col("_range")))
    own = F.struct(F.col("_range").alias("r"), F.lit(0).alias("after"))
    copy = F.struct(F.col("_m.b").alias("r"), F.lit(1).alias("after"))
    sent = ranged.withColumn("_to", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("_m.f")), F.array(own, copy)).otherwise(F.array(own))))
    sent = sent.select(F.col("_to.r").alias("r"), F.col("_to.after").alias("after"), "doc_id", "text")
    ordered = sent.repartitionById(len(bounds) + 1, "r").sortWithinPartitions("r", "after", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        made = OnePermutation(bins, bits, words)
        last, rows = None, []  # (range, doc_id, text, fingerprint) that waits for the row that follows
        for batch in batches:
            for r, after, doc_id, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                r, after = r.as_py(), after.as_py()
                if after and (last is None or last[0] != r):
                    continue  # the row that follows has been seen
                text = text.as_py()
                own = made.of(text)
                if last is not None and last[0] == r:
                    changed = edited(last[2], text)
                    mark = made.of(changed)
                    rows.append((last[1], len(last[2]), hashlib.sha256(changed.encode()).hexdigest(), last[3].hex(), mark.hex(), made.likeness(last[3], mark), made.likeness(last[3], own)))
                last = None if after else (r, doc_id.as_py(), text, own)
            if rows:
                yield _batch(rows)
                rows = []

    return ordered.mapInArrow(run, RESULT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in RESULT.split(", ")])
