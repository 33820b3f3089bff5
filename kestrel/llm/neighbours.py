"""Approximate nearest neighbours over balanced posting lists.

Fit (bounded sample, on the driver): balanced two-means splits give posting lists of equal size;
their centroids form a graph of near neighbours and a few far links.  Index (every row, on the
executors): a vector goes to the list of its nearest centroid and, near a border, to those of
centroids that are hardly farther.  Search: the lists of the centroids within a ratio of the nearest
one are compared exactly.  Both find centroids by a best-first walk over the graph, many vectors at
a time.  Lists are cut into blocks of bounded size, so no list meets in one task.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kestrel.llm.common import discard, partitions, ready, shared_dir, stash

#: Vectors to a list in the mean, lists at most, and sampled vectors to fit a list on.
LIST_SIZE, MOST_LISTS, SAMPLE_PER_LIST = 128, 4096, 64
#: A vector joins lists whose centroids are at most so much farther than its nearest one, COPIES at most.
BORDER, COPIES = 0.02, 2
#: A query reads the nearest lists, and those whose centroids are at most so much farther than its nearest one, LISTS_READ at most.
RATIO, LEAST_READ, LISTS_READ = 0.11, 112, 192
#: Vectors to a block, and queries to a block.
BLOCK, QUERY_BLOCK = 1024, 128
#: Near and far links of a centroid, centroids that a walk starts from, vectors that walk together, and centroids that a walk of the index holds.
LINKS, FAR_LINKS, STARTS, TOGETHER, HELD = 24, 4, 16, 1024, 24
#: A walk goes on to centroids that are at most so much farther than the nearest one it has found.
WALK = 0.15


@dataclass
class Centroids:
    points: np.ndarray
    links: np.ndarray  # a row per centroid, all different; what is missing is the centroid itself

    def walk(self, x: np.ndarray, held: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of the nearest `held` that a walk finds for each vector, nearest first; -1 and infinity where it found fewer.

        A walk goes on to the links of the nearest centroid that it has not been at, as long as one lies within the ratio of the nearest of all.
        """
        n, rows = len(self.points), len(x)
        held = min(held, n)
        own = (self.points * self.points).sum(axis=1)
        squares = (x * x).sum(axis=1)
        starts = np.linspace(0, n - 1, min(STARTS, n)).astype(np.int64)
        near = squares[:, None] + own[starts] - 2 * x @ self.points[starts].T
        width = max(held, len(starts))
        at = np.full((rows, width), -1, np.int64)
        dist = np.full((rows, width), np.inf)
        at[:, : len(starts)], dist[:, : len(starts)] = starts, np.sqrt(np.maximum(near, 0))
        seen = np.zeros((rows, n), bool)
        seen[:, starts] = True
        been = np.zeros((rows, width), bool)
        live = np.arange(rows)
        while len(live):
            d = np.where(been[live], np.inf, dist[live])
            pick = d.argmin(axis=1)
            best = d[np.arange(len(live)), pick]
            go = np.isfinite(best) & (best <= dist[live].min(axis=1) * (1 + ratio) + 1e-12)
            live, pick = live[go], pick[go]
            if not len(live):
                break
            been[live, pick] = True
            new = self.links[at[live, pick]]
            fresh = ~seen[live[:, None], new]
            seen[live[:, None], new] = True
            e = squares[live, None] + own[new] - 2 * np.einsum("rd,rld->rl", x[live], self.points[new])
            e = np.where(fresh, np.sqrt(np.maximum(e, 0)), np.inf)
            every, every_at = np.concatenate([dist[live], e], axis=1), np.concatenate([at[live], new], axis=1)
            every_been = np.concatenate([been[live], np.zeros(new.shape, bool)], axis=1)
            keep = np.argpartition(every, width - 1, axis=1)[:, :width]
            dist[live], at[live], been[live] = (np.take_along_axis(v, keep, axis=1) for v in (every, every_at, every_been))
        order = np.argsort(dist, axis=1, kind="stable")[:, :held]
        dist, at = np.take_along_axis(dist, order, axis=1), np.take_along_axis(at, order, axis=1)
        return np.where(np.isfinite(dist), at, -1), dist

    def within(self, x: np.ndarray, least: int, most: int, ratio: float, held: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) pairs: for each vector the nearest `least` centroids and those within the ratio of its nearest one, `most` at most."""
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first in range(0, len(x), TOGETHER):
            at, dist = self.walk(x[first : first + TOGETHER], max(most, held), max(ratio, WALK))
            at, dist = at[:, :most], dist[:, :most]
            r, c = np.nonzero(np.isfinite(dist) & ((dist <= dist[:, :1] * (1 + ratio)) | (np.arange(dist.shape[1]) < least)))
            rows.append(r + first)
            found.append(at[r, c])
        return np.concatenate(rows), np.concatenate(found)


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None] - 2 * x @ points.T, 0))


def fit(sample: np.ndarray, lists: int, seed: int = 5) -> Centroids:
    pick = np.random.default_rng(seed)
    heap = [(-len(sample), 0, np.arange(len(sample)))]
    made = 1
    while len(heap) < lists and -heap[0][0] >= 2:
        _, _, rows = heapq.heappop(heap)
        v = sample[rows]
        a, b = v[pick.choice(len(rows), 2, replace=False)]
        for _ in range(6):
            order = np.argsort(((v - a) ** 2).sum(axis=1) - ((v - b) ** 2).sum(axis=1), kind="stable")
            half = len(order) // 2
            a, b = v[order[:half]].mean(axis=0), v[order[half:]].mean(axis=0)
        for part in (rows[order[:half]], rows[order[half:]]):
            heapq.heappush(heap, (-len(part), made, part))
            made += 1
    points = np.stack([sample[rows].mean(axis=0) for _, _, rows in sorted(heap, key=lambda x: x[1])])
    n = len(points)
    near = np.argsort(_distances(points, points), axis=1, kind="stable")[:, : min(LINKS + 1, n)]
    far = pick.integers(0, n, (n, FAR_LINKS))
    ring = ((np.arange(n) + 1) % n)[:, None]  # keeps the graph connected
    links = np.sort(np.concatenate([near, far, ring], axis=1), axis=1)
    links[:, 1:][links[:, 1:] == links[:, :-1]] = -1
    return Centroids(points, np.where(links < 0, np.arange(n)[:, None], links))


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


RESULT = "query_id long, vec_id long, score double"


def search(vectors: DataFrame, is_query=None, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", ratio: float = RATIO, border: float = BORDER) -> DataFrame:
    """For each query row its k nearest other ids: query_id, rank (from 1), vec_id, score (Euclidean distance, exact).

    Queries are the rows that the condition on vec_id holds for.  Null, zero and non-finite vectors
    take no part, nor do null ids and vectors of another size than the commonest (the larger where
    two are as common).  Rows that repeat an id count once, at their nearest.  Fewer candidates than
    k are all returned; ties go to the smaller id.
    """
    spark = vectors.sparkSession
    ready(spark)
    is_query = F.col("vec_id") % 100 == 0 if is_query is None else is_query
    folder = shared_dir(spark, "neighbours")
    usable = _usable(vectors, id_col, vector_col)
    sizes = usable.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], out)
    dims, n = sizes[0]["dims"], sizes[0]["n"]
    rows = usable.where(F.size("v") == dims)
    lists = max(1, min(MOST_LISTS, -(-n // LIST_SIZE)))
    bound = lists * SAMPLE_PER_LIST
    sample = rows.select("v").sample(fraction=min(1.0, bound / n), seed=3).limit(2 * bound).toArrow()["v"].combine_chunks()
    if len(sample) < lists:
        sample = rows.select("v").limit(max(1, lists)).toArrow()["v"].combine_chunks()
    centroids = fit(_matrix(sample, dims), lists)
    shared = spark.sparkContext.broadcast(centroids)  # at most MOST_LISTS points

    def walked(least: int, most: int, within: float, held: int):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(1), dims)
                r, c = shared.value.within(x, least, most, within, held)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(ids[r]), pa.array([x[i].tobytes() for i in r.tolist()], pa.binary())], ["list", "vec_id", "v"])

        return run

    shape = "list int, vec_id long, v binary"
    queries = stash(rows.where(is_query).select("vec_id", "v").repartition(partitions(spark)).mapInArrow(walked(LEAST_READ, LISTS_READ, ratio, LISTS_READ), shape), folder, "queries")
    postings = stash(rows.select("vec_id", "v").mapInArrow(walked(1, COPIES, border, HELD), shape), folder, "postings")

    def blocks(df: DataFrame, most: int, name: str) -> DataFrame:
        """Rows of a list in blocks of about `most`, dealt by the hash of the id."""
        per_list = df.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))  # a row per list
        dealt = df.join(F.broadcast(per_list), "list").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), "parts"))
        packed = dealt.groupBy("list", "part").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("v").alias("vs"))
        return packed.select("list", F.col("ids").alias(f"{name}_ids"), F.col("vs").alias(f"{name}_vs"))

    pairs = blocks(queries, QUERY_BLOCK, "q").hint("merge").join(blocks(postings, BLOCK, "p"), "list")

    def compare(batches):
        for batch in batches:
            for q_ids, q_vs, p_ids, p_vs in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
                a, b = np.array(q_ids.as_py(), np.int64), np.array(p_ids.as_py(), np.int64)
                x = np.frombuffer(b"".join(q_vs.as_py())).reshape(-1, dims)
                y = np.frombuffer(b"".join(p_vs.as_py())).reshape(-1, dims)
                near = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T
                slack = 1e-9 * (1 + np.abs(near).max())  # beyond the rounding of this form; survivors are measured directly
                near[a[:, None] == b[None]] = np.inf
                kth = np.partition(near, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
                r, c = np.nonzero((near <= kth[:, None] + slack) & np.isfinite(near))
                score = np.sqrt(((x[r] - y[c]) ** 2).sum(axis=1))
                order = np.lexsort((b[c], score, r))
                r, c, score = r[order], c[order], score[order]
                place = np.arange(len(r)) - np.searchsorted(r, r, "left")
                # An id that is repeated in the block takes places of its own; then all that survive are kept.
                keep = place < k if len(np.unique(b)) == len(b) else np.ones(len(r), bool)
                yield pa.RecordBatch.from_arrays([pa.array(a[r[keep]]), pa.array(b[c[keep]]), pa.array(score[keep])], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(compare, RESULT).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
