"""Packing: length buckets that minimise padding, and batches within a token budget in each bucket.

Rows longer than the budget are batches of their own and need no padding, so the histogram of the
lengths up to the budget decides all: one bin per length, as many as the budget at most, whatever
the data.  A dynamic program over the filled bins picks the bucket boundaries with the least padding
in all.  Its step is a minimum of lines (a boundary's cost is linear in the length above it), which
a convex hull answers, so it is exact and takes time in proportion to bins and buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from kestrel.llm.common import discard, free_name, ready, shared_dir, stash, text_or_empty

#: Production parameters: buckets, and tokens to a batch, padding counted in.
BUCKETS, BUDGET = 16, 16384
#: Parts that each bucket is numbered in.
CHUNKS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def boundaries(bins: list[tuple[int, int]], buckets: int) -> tuple[list[int], int]:
    """(bucket boundaries, padding) for bins (length, rows) in ascending order: at most `buckets` of them, the last the longest."""
    n = len(bins)
    if not n:
        return [], 0
    top = [length for length, _ in bins]
    rows, sums = [0], [0]  # of the first bins
    for length, count in bins:
        rows.append(rows[-1] + count)
        sums.append(sums[-1] + length * count)
    # best[j]: least padding of the first j bins; a bucket over bins i to j-1 pads each row to top[j-1].
    best: list[int | None] = [0] + [None] * n
    back = []
    for _ in range(min(buckets, n)):
        following, chosen = [0] + [0] * n, [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # slope, height, bin: ever steeper downwards
        at = 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                line = (-rows[j - 1], best[j - 1] + sums[j - 1], j - 1)
                while len(hull) > 1 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            x, at = top[j - 1], min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            following[j], chosen[j] = hull[at][0] * x + hull[at][1] + x * rows[j] - sums[j], hull[at][2]
        best = following
        back.append(chosen)
    out, j = [], n
    for chosen in reversed(back):
        if j:
            out.append(top[j - 1])
            j = chosen[j]
    return out[::-1], best[n]


@dataclass
class Plan:
    """Where rows of a table go, by their id and length alone."""

    edges: list[int]
    budget: int
    offsets: DataFrame  # rows of a bucket before each of its chunks: CHUNKS rows a bucket at most

    def place(self, rows: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
        """The rows with bucket, padded_tokens, batch (within the bucket) and slot; columns of these names are replaced."""
        chunk, offset, number, size = free_name(rows, "chunk", "offset", "number", "size")
        length, row_id = F.col(f"`{length_col}`"), F.col(f"`{id_col}`")
        rows = rows.drop("bucket", "padded_tokens", "batch", "slot").withColumns(_where(self.edges, length, row_id, "bucket", chunk))
        # A bucket may hold most rows: it is numbered chunk by chunk, each chunk from the rows of those before it.
        offsets = F.broadcast(self.offsets.select("bucket", F.col("chunk").alias(chunk), F.col("offset").alias(offset)))
        nth = F.row_number().over(Window.partitionBy("bucket", chunk).orderBy(row_id, length))
        numbered = rows.withColumn(number, nth).join(offsets, ["bucket", chunk]).withColumn(number, F.col(number) + F.col(offset) - 1)
        over = F.col("bucket") >= len(self.edges)
        padded = F.when(over, length).otherwise(F.element_at(_tops(self.edges), F.col("bucket") + 1)) if self.edges else length
        numbered = numbered.withColumn("padded_tokens", padded)
        numbered = numbered.withColumn(size, F.greatest(F.floor(F.lit(self.budget) / F.greatest("padded_tokens", F.lit(1))).cast("long"), F.lit(1)))
        numbered = numbered.withColumns({"batch": F.floor(F.col(number) / F.col(size)).cast("long"), "slot": (F.col(number) % F.col(size)).cast("int")})
        names = [c for c in rows.columns if c not in ("bucket", chunk)]
        return numbered.select(*(F.col(f"`{c}`") for c in names), "bucket", "padded_tokens", "batch", "slot")


def _tops(edges: list[int]):
    return F.array(*(F.lit(e).cast("long") for e in edges))


def _where(edges: list[int], length, row_id, bucket: str, chunk: str) -> dict:
    found = F.size(F.filter(_tops(edges), lambda x: x < length)) if edges else F.lit(0)
    return {bucket: found, chunk: F.pmod(F.xxhash64(row_id, length), F.lit(CHUNKS)).cast("int")}


def fit(lengths: DataFrame, folder: str, id_col: str = "doc_id", length_col: str = "n_tokens", buckets: int = BUCKETS, budget: int = BUDGET) -> Plan:
    """The best boundaries for all lengths up to the budget, and the numbering of the rows; lengths are not null."""
    length, row_id = F.col(f"`{length_col}`"), F.col(f"`{id_col}`")
    bins = lengths.where(length <= budget).groupBy(length.alias("length")).agg(F.count("*").alias("rows")).collect()  # budget + 1 bins at most
    edges, _ = boundaries(sorted((r["length"], r["rows"]) for r in bins), buckets)
    per_chunk = lengths.select(*(x.alias(name) for name, x in _where(edges, length, row_id, "bucket", "chunk").items())).groupBy("bucket", "chunk").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    return Plan(edges, budget, stash(per_chunk.select("bucket", "chunk", F.coalesce(before, F.lit(0)).alias("offset")), folder, "offsets"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, padded_tokens, batch (within the bucket), slot.

    Lengths are those of length_col, else counts of words; null texts and lengths and negative ones
    count as 0.  A document longer than the budget is a batch of its own, in a last bucket and
    without padding.  Places depend on ids and lengths only, however the rows are dealt out.  Repeated rows
    and null ids are packed like others, rows of one id and length in any order; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    ready(spark)
    folder = shared_dir(spark, "packing")
    length = F.greatest(F.coalesce(F.col(f"`{length_col}`").cast("long"), F.lit(0)), F.lit(0)) if length_col else F.regexp_count(text_or_empty(F.col(f"`{text_col}`")), F.lit(WORD)).cast("long")
    rows = stash(docs.select(F.col(f"`{id_col}`").alias("doc_id"), length.alias("n_tokens")), folder, "lengths")
    return fit(rows, folder, buckets=buckets, budget=budget).place(rows)


def pack_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """The rows of pack, lengths counted in ids of the vocabulary file at path, with the ids themselves (little-endian, of the width that its size needs).

    Texts are encoded twice, to count and to pack, so that the ids lie on no disk but in the result.
    """
    from kestrel.llm import token_files

    spark = docs.sparkSession
    folder = shared_dir(spark, "packing")
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    lengths = stash(token_files.with_counts(source, path), folder, "lengths")
    plan = fit(lengths, folder, buckets=buckets, budget=budget)
    discard(folder, "lengths")
    return plan.place(token_files.with_ids(source, path))


def batches(packed: DataFrame) -> DataFrame:
    """One row per batch of pack_ids: bucket, batch, padded_tokens, n_docs, doc_ids and ids in order of slots; the budget bounds each, but for single documents beyond it."""
    held = F.array_sort(F.collect_list(F.struct("slot", "doc_id", "ids")))
    rows = packed.groupBy("bucket", "batch").agg(F.max("padded_tokens").alias("padded_tokens"), held.alias("held"))
    return rows.select("bucket", "batch", "padded_tokens", F.size("held").alias("n_docs"), F.col("held.doc_id").alias("doc_ids"), F.col("held.ids").alias("ids"))
