"""Exact Jaccard join of word-shingle sets: prefix buckets, count-vector R-trees, verification.

Documents with equal sets form a class; all else works on classes.  A set's tokens are put in one
order for all (frequent ones last, else by hash); two sets that link share a token among the first
n - ceil(t n) + 1 of each, so buckets of those prefix tokens hold every pair.  In a bucket each
class is a point, its counts of tokens by hash group.  The summed minima of two points bound the
overlap of the sets, those of two rectangles' upper corners bound it for all pairs below: pairs of
R-tree nodes that can't reach the threshold are passed over.  Pairs of points are held against finer
groups that follow the order of the tokens: at the first token that two sets share, nothing before it
is shared, so only the groups from its own on count.  What survives is verified on the sets.

All links come from the trees, which are gone down three times.  First they tell which classes have
any partner that the bounds allow; only their sets are made (those of large buckets count as such).
Then, in ROUNDS rounds, each of those stands in one of its buckets, with its set, and pairs are
verified on the spot; pairs that links of the unit join already are passed over, which makes groups
of copies.  Last come all buckets, but only with classes that are not joined yet.  Groups of copies
therefore cost their size, not its square.  Sets are of 64-bit hashes; texts are hashed anew where
sets are needed, since stored sets would take twice the input.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from kestrel.llm.common import discard, free_name, only, partitions, ready, release, shared_dir, stash, text_or_empty
from kestrel.llm.graph import components
from kestrel.llm.words import ragged, shingle_sets, together

#: Production parameters: words to a shingle, and the threshold in hundredths.
WORDS, HUNDREDTHS = 3, 90
#: Groups of the trees' points; of the finer ones, RARE for tokens by hash and the rest for frequent ones.
GROUPS, FINE, RARE = 64, 256, 192
#: Tokens that are put last in the order, at most; and how often one occurs in a task to be counted.
FREQUENT, OFTEN = 1 << 20, 2
#: Classes to a unit of comparison, and children to an R-tree node.
UNIT, FANOUT = 512, 32
#: First rounds, and classes to a unit there.
ROUNDS, FIRST_UNIT = 2, 128
#: Tokens before a bucket's own that a class brings along.
EARLIER = 32
#: Width of the bands of set sizes.
BAND = 0.05


def _least_overlap(a, b, hundredths: int):
    """Smallest overlap with which sets of these sizes link: 100 o >= h (a + b - o)."""
    return -(-(hundredths * (a + b)) // (100 + hundredths))


def _prefix_size(n, hundredths: int):
    return n - -(-hundredths * n // 100) + 1


def _known(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(tokens), bool)
    return frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens


def _prefixes(tokens: np.ndarray, stops: np.ndarray, frequent: np.ndarray, hundredths: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix tokens of each set, bounds between sets), of sets that lie one after another."""
    n = np.diff(stops)
    sizes = np.where(n > 0, _prefix_size(n, hundredths), 0)
    # Most often the first few tokens hold enough that are not frequent.
    heads = np.minimum(n, 2 * sizes + 8)
    at = np.concatenate([[0], np.cumsum(heads)])
    near = tokens[ragged(stops[:-1], heads)]
    rare = ~_known(near, frequent)
    sofar = np.concatenate([[0], np.cumsum(rare)])
    enough = sofar[at[1:]] - sofar[at[:-1]] >= sizes
    nth = sofar[:-1] - np.repeat(sofar[at[:-1]], heads)
    out_stops = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(out_stops[-1]), np.uint64)
    out[np.repeat(enough, sizes)] = near[rare & (nth < np.repeat(sizes, heads)) & np.repeat(enough, heads)]
    for i in np.flatnonzero(~enough).tolist():
        own = tokens[stops[i] : stops[i + 1]]
        known = _known(own, frequent)
        out[out_stops[i] : out_stops[i + 1]] = np.concatenate([own[~known], own[known]])[: sizes[i]]
    return out, out_stops


def _frequent_tokens(docs: DataFrame, words: int, hundredths: int, folder: str) -> np.ndarray:
    """The commonest of the tokens that come first by hash, FREQUENT at most.  Any choice gives the same links; a good one gives small buckets."""

    def count(batches):
        only("jaccard")
        held, n = [], 0

        def often():
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            keep = times >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(times[keep].astype(np.int64))], ["token", "times"])

        for batch in batches:
            for _, texts in together(batch.column(0)):
                tokens, stops = shingle_sets(texts, words)
                sizes = np.diff(stops)
                # Twice the prefix: what moves up when frequent tokens go last is counted too.
                held.append(tokens[ragged(stops[:-1], np.minimum(sizes, 2 * _prefix_size(sizes, hundredths)))])
                n += len(held[-1])
                if n >= 1 << 21:
                    yield often()
                    held, n = [], 0
        if held:
            yield often()

    found = docs.select("text").mapInArrow(count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    found = stash(found, folder, "frequent")
    steps = found.groupBy(F.floor(F.log2("times") * 8).cast("int").alias("step")).agg(F.count("*").alias("n")).collect()  # a few hundred rows
    least, n = 1 << 30, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        n += r["n"]
        if n > FREQUENT:
            break
        least = r["step"]
    top = found.where(F.floor(F.log2("times") * 8) >= least).select("token").toArrow()["token"].to_numpy()
    discard(folder, "frequent")
    return np.sort(top.astype(np.int64).view(np.uint64))


class Tree:
    """Packed R-tree over count vectors: leaves of points in order of size, and the nodes above, each with its upper corner and least size."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray):
        self.order = np.lexsort((counts.argmax(axis=1), sizes))
        self.sizes, self.counts = sizes[self.order], counts[self.order]
        self.levels = []  # (upper corners, least sizes, largest sizes), leaves first
        corner, least, largest = self.counts, self.sizes, self.sizes
        while True:
            starts = np.arange(0, len(least), FANOUT)
            corner = np.maximum.reduceat(corner, starts, axis=0)
            least = np.minimum.reduceat(least, starts)
            largest = np.maximum.reduceat(largest, starts)
            self.levels.append((corner, least, largest))
            if len(least) == 1:
                break

    def pairs(self, other: Tree, hundredths: int):
        """Pairs (own row, other's row) whose bounds allow a link; both trees are gone down together.  Of a tree with itself each pair comes once."""
        height = max(len(self.levels), len(other.levels)) - 1
        once = other is self

        def below(tree, k, level):
            return range(k * FANOUT, min((k + 1) * FANOUT, len(tree.levels[level - 1][1]))) if level < len(tree.levels) else (k,)

        todo = [(0, 0)]
        for level in range(height, -1, -1):
            a_corner, a_least, a_largest = self.levels[min(level, len(self.levels) - 1)]
            b_corner, b_least, b_largest = other.levels[min(level, len(other.levels) - 1)]
            near = []
            for i, j in todo:
                sizes = (a_largest[i] * 100 >= hundredths * b_least[j]) & (b_largest[j] * 100 >= hundredths * a_least[i])
                if sizes and np.minimum(a_corner[i], b_corner[j]).sum() >= _least_overlap(a_least[i], b_least[j], hundredths):
                    near.append((i, j))
            todo = near if level == 0 else [(x, y) for i, j in near for x in below(self, i, level) for y in below(other, j, level) if not once or x <= y]
        for i, j in todo:
            a, b = slice(i * FANOUT, (i + 1) * FANOUT), slice(j * FANOUT, (j + 1) * FANOUT)
            x, y = _allowed(self.sizes[a], self.counts[a], other.sizes[b], other.counts[b], hundredths)
            if once and i == j:
                x, y = x[x < y], y[x < y]
            yield self.order[x + i * FANOUT], other.order[y + j * FANOUT]


def _allowed(a_sizes, a_counts, b_sizes, b_counts, hundredths: int):
    """Pairs of two leaves' points whose summed minima allow a link."""
    bound = np.minimum(a_counts[:, None], b_counts[None]).sum(axis=2)
    return np.nonzero(bound >= _least_overlap(a_sizes[:, None], b_sizes[None], hundredths))


def _sets(docs: DataFrame, words: int, hundredths: int, frequent) -> DataFrame:
    """(doc_id, row_key, n_shingles, class, counts, tokens) per document; class and what follows are null for empty sets.  tokens: the prefix."""

    def run(batches):
        often = frequent.value
        for batch in batches:
            for first, texts in together(batch.column(2)):
                tokens, stops = shingle_sets(texts, words)
                n = np.diff(stops)
                prefix, prefix_stops = _prefixes(tokens, stops, often, hundredths)
                classes = [xxhash.xxh3_64_intdigest(tokens[a:b]) if b > a else 0 for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
                packed = [c.astype("<u1" if k < 1 << 8 else "<u2" if k < 1 << 16 else "<u4").tobytes() for c, k in _fine_counts_of(tokens, stops, often)]
                none = n == 0
                arrays = [batch.column(0).slice(first, len(n)), batch.column(1).slice(first, len(n)), pa.array(n, pa.int64())]
                arrays += [pa.array(np.array(classes, np.uint64).view(np.int64), mask=none), pa.array(packed, pa.binary(), mask=none), pa.ListArray.from_arrays(pa.array(prefix_stops, pa.int32()), pa.array(prefix.view(np.int64)), mask=pa.array(none))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row_key", "n_shingles", "class", "counts", "tokens"])

    return docs.mapInArrow(run, "doc_id long, row_key long, n_shingles long, class long, counts binary, tokens array<long>")


def _counts_of(tokens: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Points: each set's counts of tokens by hash group."""
    n = len(stops) - 1
    owner = np.repeat(np.arange(n), np.diff(stops))
    return np.bincount(owner * GROUPS + (tokens >> np.uint64(58)).astype(np.int64), minlength=n * GROUPS).reshape(n, GROUPS)


def _fine_group(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Number of each token's fine group; it never falls along the order of the tokens (by hash, frequent ones last)."""
    rare = ((tokens >> np.uint64(32)) * np.uint64(RARE) >> np.uint64(32)).astype(np.int64)
    often = RARE + ((tokens >> np.uint64(32)) * np.uint64(FINE - RARE) >> np.uint64(32)).astype(np.int64)
    return np.where(_known(tokens, frequent), often, rare)


def _in_order(tokens: Column, frequent) -> Column:
    """Arrays of tokens in the order of the sets: by hash, frequent ones last."""

    @F.pandas_udf("array<long>")
    def ordered(lists: pd.Series) -> pd.Series:
        often = frequent.value

        def one(tokens):
            tokens = np.asarray(tokens, np.int64).view(np.uint64)
            return tokens[np.lexsort((tokens, _known(tokens, often)))].view(np.int64)

        return lists.map(one)

    return ordered(tokens)


def _fine_counts_of(tokens: np.ndarray, stops: np.ndarray, frequent: np.ndarray):
    """(counts of a set's tokens by fine group, the largest of them) of each set; a few thousand sets at once."""
    group = _fine_group(tokens, frequent)
    for first in range(0, len(stops) - 1, 4096):
        some = stops[first : first + 4097]
        n = len(some) - 1
        owner = np.repeat(np.arange(n), np.diff(some))
        counts = np.bincount(owner * FINE + group[some[0] : some[-1]], minlength=n * FINE).reshape(n, FINE)
        yield from zip(counts, counts.max(axis=1).tolist(), strict=True)


def _fine_counts(packed: list[bytes]) -> np.ndarray:
    widths = {len(x) // FINE for x in packed}
    if len(widths) == 1:
        return np.frombuffer(b"".join(packed), f"<u{widths.pop()}").reshape(-1, FINE)
    return np.stack([np.frombuffer(x, f"<u{len(x) // FINE}").astype(f"<u{max(widths)}") for x in packed])


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _first_round(members: DataFrame, hundredths: int) -> DataFrame:
    """Verified links of classes in one unit, enough of them to join all that link there: the pairs of the unit's tree, without those that earlier links join.

    Links of classes in different units are found later.
    """

    def links(classes, sets):
        stops = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        tree = Tree(np.diff(stops), _counts_of(np.concatenate(sets), stops))
        group, found = np.arange(len(sets)), []
        for x, y in tree.pairs(tree, hundredths):
            for i, k in zip(x.tolist(), y.tolist(), strict=True):
                if group[i] != group[k] and _overlap(sets[i], sets[k]) >= _least_overlap(len(sets[i]), len(sets[k]), hundredths):
                    found.append((classes[i], classes[k]))
                    group[group == group[k]] = group[i]
        return found

    def run(batches):
        now, classes, sets = None, [], []

        def done():
            out = links(classes, sets) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for token, cls, packed in zip(*(batch.column(i) for i in range(3)), strict=True):
                token = token.as_py()
                if token != now:
                    yield done()
                    now, classes, sets = token, [], []
                classes.append(cls.as_py())
                sets.append(np.frombuffer(packed.as_py(), np.uint64))
        yield done()

    n = partitions(members.sparkSession)
    dealt = members.repartition(n, "token").sortWithinPartitions("token", "class")
    return dealt.select("token", "class", "tokens").mapInArrow(run, "a long, b long")


def _band() -> Column:
    """Number of the band of set sizes; sizes that link lie at most _reach bands apart."""
    return F.floor(F.log(F.col("n_shingles").cast("double")) / -np.log(1 - BAND)).cast("int")


def _reach(hundredths: int) -> int:
    """Bands between sizes that can link at most: 3 at 90 hundredths, 5 at 80."""
    return int(np.ceil(np.log(hundredths / 100) / np.log(1 - BAND) - 1e-9)) if hundredths < 100 else 1


def _near(keyed: DataFrame, hundredths: int, folder: str, name: str) -> DataFrame:
    """Rows (token, n_shingles, ...) that share the token with another row of a size that could link."""
    keyed = keyed.withColumn("band", _band())
    bands = keyed.groupBy("token", "band").agg(F.count("*").alias("rows"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    # A row per band of a token: bounded by the number of bands.
    by_band = Window.partitionBy("token").orderBy("band")
    reach = _reach(hundredths)
    below = F.max("most").over(by_band.rangeBetween(-reach, -1))
    above = F.min("least").over(by_band.rangeBetween(1, reach))
    bands = bands.select("token", "band", "rows", "most", "least", below.alias("below"), above.alias("above"))
    with_others = (F.col("rows") > 1) | (F.col("below") * 100 >= hundredths * F.col("least")) | (F.col("most") * 100 >= hundredths * F.col("above"))
    bands = stash(bands.where(with_others).select("token", "band", "rows", "below", "above"), folder, f"near-{name}")
    release(keyed.sparkSession)
    own = (F.col("rows") > 1) | (F.col("below") * 100 >= hundredths * F.col("n_shingles")) | (F.col("n_shingles") * 100 >= hundredths * F.col("above"))
    return keyed.join(bands.hint("merge"), ["token", "band"]).where(own).drop("band", "rows", "below", "above")


def _units(rows: DataFrame, hundredths: int, folder: str) -> DataFrame:
    """Rows (token, ...) with unit and side: a bucket of up to UNIT classes is a unit, its rows on side 0.

    A larger one is cut into tiles, by bands of set sizes and within a band by hash; each pair of
    tiles whose sizes can link is a unit, with a tile on either side (1 and 2).
    """
    sized = rows.groupBy("token").agg(F.count("*").alias("rows"))
    large = stash(sized.where(F.col("rows") > UNIT).select("token"), folder, "large")
    small = rows.join(large, "token", "left_anti").select("*", F.lit(0).cast("long").alias("unit"), F.lit(0).alias("side"))
    in_large = rows.join(large, "token", "left_semi").withColumn("band", _band())
    parts = stash(in_large.groupBy("token", "band").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("parts")), folder, "bands")
    tiled = in_large.join(parts, ["token", "band"]).withColumn("part", F.pmod(F.xxhash64("class"), "parts"))
    others = parts.select("token", F.col("band").alias("other_band"), F.col("parts").alias("other_parts"))
    met = tiled.join(others, "token").where(F.abs(F.col("band") - F.col("other_band")) <= _reach(hundredths))
    met = met.withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    own = F.struct("band", F.col("part").cast("long").alias("part"))
    other = F.struct(F.col("other_band").alias("band"), F.col("other_part").cast("long").alias("part"))
    met = met.withColumn("unit", F.xxhash64(F.least(own, other), F.greatest(own, other)))
    met = met.withColumn("side", F.when(own == other, 0).when(own < other, 1).otherwise(2))
    return small.unionByName(met.select(*small.columns))


def _candidates(units: DataFrame, hundredths: int, frequent, ends: bool = False) -> DataFrame:
    """Pairs of classes of different groups that the bounds allow; or just the classes that are in such pairs (a = b), once for each batch.

    A pair that links is allowed in the bucket of the first token that both have; elsewhere it may be passed over.

    before: up to EARLIER tokens of a class's open buckets that come next before this one in the order of the sets, null if only
    classes are asked for.  A pair that shares one of these met there; so alike texts of any length
    meet once or a few times, and what a row carries is bounded.  Side 0 is compared with itself, side 1 with side 2.  A unit of up to FANOUT classes is a tree
    with one leaf; many of those are compared at once.
    """

    def few(rows, starts, size):
        """Pairs of rows in one-leaf trees of one size, each from a row of starts."""
        i, k = np.triu_indices(size, 1)
        for first in range(0, len(starts), 1 + (1 << 17) // len(i)):
            at = starts[first : first + 1 + (1 << 17) // len(i), None]
            x, y = (at + i).ravel(), (at + k).ravel()
            n, m = rows["sizes"][x], rows["sizes"][y]
            keep = (rows["groups"][x] != rows["groups"][y]) & (np.minimum(n, m) * 100 >= hundredths * np.maximum(n, m))
            x, y = x[keep], y[keep]
            keep = np.minimum(rows["counts"][x], rows["counts"][y]).sum(axis=1) >= _least_overlap(rows["sizes"][x], rows["sizes"][y], hundredths)
            yield x[keep], y[keep]

    def many(rows, first, stop):
        sides = rows["sides"][first:stop]
        a, b = first + np.flatnonzero(sides < 2), first + np.flatnonzero(sides != 1)
        if not len(a) or not len(b):
            return
        left = Tree(rows["sizes"][a], rows["counts"][a])
        right = left if sides[0] == 0 else Tree(rows["sizes"][b], rows["counts"][b])
        for x, y in left.pairs(right, hundredths):
            x, y = a[x], b[y]
            keep = rows["groups"][x] != rows["groups"][y]
            yield x[keep], y[keep]

    def from_here(rows, x, y):
        """Whether the fine groups from the bucket's token on hold enough that both may have, of each pair."""
        keep = np.zeros(len(x), bool)
        for first in range(0, len(x), 1 << 14):
            i, k = x[first : first + (1 << 14)], y[first : first + (1 << 14)]
            both = np.minimum(rows["fine"][i], rows["fine"][k]) * (rows["place"][i, None] <= np.arange(FINE))
            keep[first : first + (1 << 14)] = both.sum(axis=1, dtype=np.int64) >= _least_overlap(rows["sizes"][i], rows["sizes"][k], hundredths)
        return keep

    def pairs(rows, cuts):
        """Pairs of rows of one unit; units lie between cuts."""
        sizes = np.diff(cuts)
        small = (sizes <= FANOUT) & (rows["sides"][cuts[:-1]] == 0)
        for size in np.unique(sizes[small & (sizes > 1)]).tolist():
            yield from few(rows, cuts[:-1][small & (sizes == size)], size)
        for first, stop in zip(cuts[:-1][~small].tolist(), cuts[1:][~small].tolist(), strict=True):
            yield from many(rows, first, stop)

    def found(table, cuts):
        columns = {x: table.column(x).to_numpy() for x in ("class", "group", "n_shingles", "side")}
        fine = _fine_counts(table.column("counts").to_pylist())
        rows = {"sizes": columns["n_shingles"], "groups": columns["group"], "sides": columns["side"], "fine": fine, "counts": fine.reshape(len(fine), GROUPS, -1).sum(axis=2, dtype=np.int32)}
        rows["place"] = _fine_group(table.column("token").to_numpy().view(np.uint64), frequent.value)
        out = [np.zeros((2, 0), np.int64)]
        before = table.column("before").combine_chunks()
        values, stops = before.flatten().to_numpy(), np.concatenate([[0], np.cumsum(before.value_lengths().fill_null(0).to_numpy())])
        earlier = lru_cache(maxsize=None)(lambda i: set(values[stops[i] : stops[i + 1]].tolist()))
        for x, y in pairs(rows, cuts):
            keep = from_here(rows, x, y)
            x, y = x[keep], y[keep]
            if not ends:
                keep = np.array([earlier(i).isdisjoint(earlier(k)) for i, k in zip(x.tolist(), y.tolist(), strict=True)], bool)
                x, y = x[keep], y[keep]
            a, b = columns["class"][x], columns["class"][y]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        out = np.concatenate(out, axis=1)
        out = np.stack([np.unique(out)] * 2) if ends else np.unique(out, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            # The last unit may go on in the next batch.
            token, unit = held.column("token").to_numpy(), held.column("unit").to_numpy()
            cuts = np.flatnonzero((token[1:] != token[:-1]) | (unit[1:] != unit[:-1])) + 1
            if len(cuts):
                cuts = np.concatenate([[0], cuts])
                yield found(held.slice(0, cuts[-1]), cuts)
                held = held.slice(cuts[-1])
        if held is not None:
            yield found(held, np.array([0, held.num_rows]))

    n = partitions(units.sparkSession)
    dealt = units.repartition(n, "token", "unit").sortWithinPartitions("token", "unit")
    return dealt.select("token", "unit", "side", "class", "group", "n_shingles", "counts", "before").mapInArrow(run, "a long, b long")


def _hopeful(rows: DataFrame, hundredths: int, frequent, folder: str) -> DataFrame:
    """(class) of rows (token, class, n_shingles, counts) that have a partner in one of their buckets, as far as the bounds tell; all of buckets of more than UNIT classes."""
    large = stash(rows.groupBy("token").agg(F.count("*").alias("rows")).where(F.col("rows") > UNIT).select("token"), folder, "large-buckets")
    small = rows.join(large, "token", "left_anti").select("*", F.lit(0).cast("long").alias("unit"), F.lit(0).alias("side"), F.col("class").alias("group"), F.lit(None).cast("array<long>").alias("before"))
    found = _candidates(small, hundredths, frequent, ends=True).select(F.col("a").alias("class"))
    return found.unionByName(rows.join(large, "token", "left_semi").select("class")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            a, b = [], []
            for x, y, s, t in zip(*(batch.column(i) for i in range(4)), strict=True):
                s, t = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(t.as_py(), np.uint64)
                if _overlap(s, t) >= _least_overlap(len(s), len(t), hundredths):
                    a.append(x.as_py())
                    b.append(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("tokens").alias("s")), "a").join(sets.select(F.col("class").alias("b"), F.col("tokens").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def join(docs: DataFrame, words: int = WORDS, hundredths: int = HUNDREDTHS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of grouped without the group."""
    return grouped(docs, words, hundredths, id_col, text_col).drop("group")


def grouped(docs: DataFrame, words: int = WORDS, hundredths: int = HUNDREDTHS, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id that links lead to), row_key (of id and text), group (null for empty sets).

    Two groups have one component_id where rows repeat an id with unlike texts.

    A text with fewer words than a shingle is one shingle of all of them.  Null, empty and wordless
    texts have no shingles and are in no group: their component is their own id.  Repeated rows are
    equal sets and so are in one group.  A null id is in its group's component but never names one,
    unless the whole group has none.  An empty table gives an empty result.  The result is read from the folder.
    """
    if not 80 <= hundredths <= 100:
        raise ValueError("thresholds are from 80 hundredths on")
    spark = docs.sparkSession
    ready(spark)
    folder = folder or shared_dir(spark, "jaccard")
    text = text_or_empty(F.col(text_col))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("row_key"), text.alias("text"))
    frequent = spark.sparkContext.broadcast(_frequent_tokens(source, words, hundredths, folder))  # FREQUENT tokens at most
    full = stash(_sets(source, words, hundredths, frequent), folder, "features")
    of_docs = stash(full.select("doc_id", "row_key", "n_shingles", "class"), folder, "documents")
    some = of_docs.where("class is not null")
    classes = stash(
        full.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least_id"), F.min("row_key").alias("row_key"), F.first("n_shingles").alias("n_shingles"), F.first("counts").alias("counts"), F.first("tokens").alias("tokens")),
        folder, "classes",
    )
    discard(folder, "features")
    release(spark)
    shared = stash(_near(classes.select("class", "n_shingles", F.explode("tokens").alias("token")), hundredths, folder, "buckets").select("class", "token"), folder, "shared")
    classes = stash(classes.drop("tokens"), folder, "points")
    for name in ("classes", "near-buckets"):
        discard(folder, name)
    release(spark)
    hopeful = stash(_hopeful(shared.join(classes.select("class", "n_shingles", "counts"), "class"), hundredths, frequent, folder), folder, "hopeful")
    release(spark)
    buckets = stash(shared.join(hopeful, "class", "left_semi"), folder, "buckets")
    discard(folder, "shared")
    release(spark)

    # The sets of the classes that may link, from one document each, and the bucket of each first round: that of the least hash, which copies share.
    tokens = [f"token_{r}" for r in range(ROUNDS)]
    firsts = buckets.groupBy("class").agg(*(F.min_by("token", F.xxhash64("token", F.lit(r))).alias(t) for r, t in enumerate(tokens)))
    firsts = stash(firsts, folder, "firsts")
    alone = None
    for t in tokens:
        met = firsts.groupBy(F.col(t).alias("token")).agg(F.count("*").alias("n"), F.min("class").alias("class")).where("n = 1").select("class", F.lit(t).alias("round"))
        alone = met if alone is None else alone.unionByName(met)
    alone = alone.groupBy("class").agg(*(F.max(F.col("round") == t).alias(f"alone_{t}") for t in tokens))
    firsts = firsts.join(alone, "class", "left").select("class", *(F.when(~F.coalesce(f"alone_{t}", F.lit(False)), F.col(t)).alias(t) for t in tokens))
    wanted = stash(firsts.join(classes.select("class", "row_key"), "class"), folder, "wanted")

    def sets_of(batches):
        for batch in batches:
            for first, texts in together(batch.column(ROUNDS + 1)):
                values, stops = shingle_sets(texts, words)
                packed = [values[a:b].tobytes() for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(packed)) for i in range(ROUNDS + 1)), pa.array(packed, pa.binary())], ["class", *tokens, "tokens"])

    texts = source.select("row_key", "text").join(wanted.hint("merge"), "row_key").groupBy("row_key").agg(*(F.first(c).alias(c) for c in ("class", *tokens, "text")))
    sets = texts.select("class", *tokens, "text").mapInArrow(sets_of, "class long, " + "".join(f"{t} long, " for t in tokens) + "tokens binary")
    sets = stash(sets, folder, "sets", "none")
    release(spark)
    links = None
    for r, t in enumerate(tokens):
        # A bucket that many share is cut into parts, in each round in another way, so that groups of any size grow together.
        sized = wanted.where(F.col(t).isNotNull()).groupBy(F.col(t).alias("token")).agg(F.ceil(F.count("*") / FIRST_UNIT).cast("int").alias("parts")).where("parts > 1")
        sized = stash(sized, folder, f"large-firsts-{r}")
        part = F.pmod(F.xxhash64("class", F.lit(r)), "parts")
        members = sets.where(F.col(t).isNotNull()).select(F.col(t).alias("token"), "class", "tokens").join(sized, "token", "left")
        members = members.withColumn("token", F.when(F.col("parts") > 1, F.xxhash64("token", part)).otherwise(F.col("token")))
        found = stash(_first_round(members, hundredths), folder, f"links-{r}")
        links = found if links is None else links.unionByName(found)
        release(spark)
    links = stash(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), folder, "links")
    groups = components(links, f"{folder}/components-1")
    by_group = buckets.join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("group", F.coalesce("component", "class")).drop("component")
    by_group = stash(by_group, folder, "grouped")
    open_tokens = stash(by_group.groupBy("token").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("token"), folder, "open")
    still = stash(by_group.join(open_tokens, "token"), folder, "still")
    discard(folder, "grouped")
    points = still.groupBy("class").agg(F.first("group").alias("group"), F.collect_list("token").alias("open")).withColumn("open", _in_order(F.col("open"), frequent))
    points = stash(points.join(classes.select("class", "n_shingles", "counts"), "class"), folder, "points-open")
    rows = points.select("class", "group", "n_shingles", "counts", "open", F.posexplode("open").alias("at", "token"))
    rows = rows.withColumn("before", F.slice("open", F.greatest(F.lit(1), F.col("at") - EARLIER + 1), F.least("at", F.lit(EARLIER)))).drop("open", "at")
    pairs = stash(_candidates(_units(rows, hundredths, folder), hundredths, frequent).distinct(), folder, "pairs")
    release(spark)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = stash(sets.select("class", "tokens").join(ends.hint("merge"), "class"), folder, "pair-sets", "none")
    discard(folder, "sets")
    release(spark)
    more = stash(_verified(pairs, sets, hundredths), folder, "links-more")
    for name in ("pair-sets", "points-open", "still", "buckets", "wanted", "firsts"):
        discard(folder, name)
    release(spark)
    final = components(links.unionByName(more), f"{folder}/components-2")

    named = classes.select("class", "least_id").join(final.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = stash(named, folder, "named")
    names = stash(named.groupBy("component").agg(F.min("least_id").alias("component_id")), folder, "names")
    by_class = stash(named.join(names, "component").select("class", "component_id", F.col("component").alias("group")), folder, "by-class")
    placed = some.select("doc_id", "row_key", "n_shingles", "class").join(by_class, "class").select("doc_id", "n_shingles", "component_id", "row_key", "group")
    return placed.unionByName(of_docs.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row_key", F.lit(None).cast("long").alias("group")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One document of each group, that of the smallest id; all columns as they were.

    Rows that repeat an id and text are one document.  Of documents of one id that are alike one
    stays; groups in which no row has an id lose only repeated rows.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "jaccard")
    groups = grouped(docs, id_col=id_col, text_col=text_col, folder=folder, **parameters)
    key = free_name(docs, "row_key")
    named = groups.where("doc_id = component_id").groupBy("component_id", "group").agg(F.min("row_key").alias(key)).select(key)
    unnamed = groups.where("component_id is null").select(F.col("row_key").alias(key)).distinct()
    kept = stash(named.unionByName(unnamed), shared_dir(spark, "kept"), "kept")
    discard(folder)
    keyed = docs.withColumn(key, F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")))
    return keyed.join(kept.hint("merge"), key).dropDuplicates([key]).drop(key)
