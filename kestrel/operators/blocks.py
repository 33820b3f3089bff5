"""Whole duplicate blocks: the maximal repeats of normalized lines over all files, and where they stand.

A block is a run of windows that stands in several places of two files or more, and that can't be
made longer on either side without losing a place.  A suffix tree has all of them as nodes; it is
built here without an order of suffixes and without pairs of places, in a number of steps that is
the logarithm of the longest repeat:

- runs of 1, 2, 4, ... windows are named by doubling, inside of each file;
- all places start as leaves under one root, with an interval of lengths from 0 to a power of two;
- each step halves the intervals.  The leaves of a class that agree on the lower half form a class of
  their own: it goes on with the upper half if it has several leaves, and is one leaf of the lower
  half, with one place that stands for it.  Where nothing branches, nothing is carried on.

A step's rows are fewer than twice the repeated windows, however often a block stands somewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kestrel.operators import shared

_STATS = ["places", "low", "high", "low_before", "high_before"]


def _merged() -> list[Column]:
    """Counts of a class from those of its leaves: rows of the table, first place, places, least and greatest file and line before."""
    return [
        F.count("*").alias("leaves"),
        F.min("place").alias("place"),
        F.sum("places").alias("places"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min("low_before").alias("low_before"),
        F.max("high_before").alias("high_before"),
    ]


def _named(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def repeated(found: DataFrame, total: int, key: str = "doc_id") -> DataFrame:
    """Windows (key, seq, line_no, hash) of those, `total` in all, that stand in two files or more."""
    groups = found.groupBy("hash").agg(F.min(key).alias("_low"), F.max(key).alias("_high"), F.count("*").alias("_n"))
    groups = groups.where("_low <> _high").select("hash", "_n")
    return shared.lookup(found, groups, "hash", "_n", total).select(key, "seq", "line_no", "hash")


def _doubled(windows: DataFrame, levels: int, folder: str, key: str) -> DataFrame:
    """place, low, high, before and d0, d1, ...: names of the runs of 1, 2, 4, ... windows that start there, null where the run is not repeated throughout."""
    order = Window.partitionBy(key, "island").orderBy("seq")
    rows = windows.withColumn("d0", F.col("hash")).withColumn("before", F.lag("hash").over(order))
    for k in range(levels):
        after = F.lead(f"d{k}", 1 << k).over(order)
        rows = rows.withColumn(f"d{k + 1}", F.when(after.isNotNull() & F.col(f"d{k}").isNotNull(), _named(F.col(f"d{k}"), after)))
    place = F.struct(F.col(key).alias("file"), F.col("seq").alias("seq"))
    return shared.stash(rows.select(place.alias("place"), "line_no", "before", *(f"d{k}" for k in range(levels + 1))), f"{folder}/doubled")


def _branching(table: DataFrame, levels: int, n: int, folder: str) -> DataFrame:
    """(parent, length, place, stats): the leaves at length + 1 of each class of that length which has several."""
    alone = _named(F.lit("first"), F.col("place.file").cast("string"), F.col("place.seq").cast("string"))
    before = F.coalesce("before", alone)
    leaves = table.select(F.lit("").alias("parent"), F.lit(0).cast("long").alias("length"), "place", F.lit(1).cast("long").alias("places"), F.col("place.file").alias("low"), F.col("place.file").alias("high"), before.alias("low_before"), before.alias("high_before"))
    for k in range(levels - 1, -1, -1):
        half = 1 << k
        runs = table.where(f"d{k} is not null").select(F.col("place").alias("at"), F.col(f"d{k}").alias("run"))
        at = F.struct(F.col("place.file").alias("file"), (F.col("place.seq") + F.col("length")).alias("seq"))
        ends = _named(F.lit("end"), F.col("place.file").cast("string"), F.col("place.seq").cast("string"))
        split = leaves.withColumn("at", at).join(runs, "at", "left").drop("at")
        split = split.withColumn("mid", _named(F.col("parent"), F.lit(str(k)), F.coalesce("run", ends))).drop("run")
        middle = split.groupBy("mid").agg(F.first("parent").alias("parent"), F.first("length").alias("length"), *_merged())
        upper = shared.lookup(split, middle.where("leaves > 1").select("mid", "leaves"), "mid", "leaves", n)
        upper = upper.select(F.col("mid").alias("parent"), (F.col("length") + half).alias("length"), "place", *_STATS)
        parents = middle.groupBy("parent").agg(F.count("*").alias("n")).where("n > 1")
        lower = shared.lookup(middle, parents, "parent", "n", n).select("parent", "length", "place", *_STATS)
        leaves = shared.stash(upper.unionByName(lower), f"{folder}/leaves-{k}")
    return leaves.where("length > 0")


def _nearest(nodes: DataFrame, links: DataFrame, total: int, folder: str) -> DataFrame:
    """(node, block): the reported node at or above each node, null without one; links (node, up), by pointer jumping."""
    heads = nodes.join(links, "node", "left").select("node", F.when(F.col("reported"), F.col("node")).alias("block"), F.when(~F.col("reported"), F.col("up")).alias("up"))
    heads, step = shared.stash(heads, f"{folder}/heads-0"), 0
    while heads.where("up is not null").limit(1).count():
        step += 1
        wanted = heads.where("up is not null").groupBy("up").agg(F.count("*").alias("n"))
        above = heads.select(F.col("node").alias("up"), F.col("block").alias("_block"), F.col("up").alias("_up")).join(wanted, "up")
        moved = shared.lookup(heads.where("up is not null"), above, "up", "n", total)
        moved = moved.select("node", F.col("_block").alias("block"), F.col("_up").alias("up"))
        heads = shared.stash(heads.where("up is null").unionByName(moved), f"{folder}/heads-{step}")
    return heads.select("node", "block")


def listed(blocks: DataFrame, places: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each block and place of its own; blocks all of whose places go on to longer ones have one row without a place."""
    return blocks.join(places.select("first", "first_seq", "length", key, "seq", "line_no"), ["first", "first_seq", "length"], "left")


def whole_blocks(found: DataFrame, size: int, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(blocks, places) of windows (key, seq, line_no, hash) of `size` normalized lines.

    blocks: first, first_seq, first_line (the first place by file and line), length in normalized lines,
    places, and the same three of the next shorter block that this one begins with (shorter_first,
    shorter_seq, shorter_length; null without one).
    places: first, first_seq, length of a block beside key, seq, line_no: the longest block that starts
    there.  The other places of a block are those of the blocks that begin with it, so nothing is listed twice.
    """
    folder = shared.folder(found.sparkSession, "blocks")
    found = shared.stash(found.select(key, "seq", "line_no", "hash"), f"{folder}/found")  # texts are split once
    rows = repeated(found, found.count(), key)
    island = F.col("seq") - F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    rows = shared.stash(rows.withColumn("island", island), f"{folder}/repeated")
    longest, n = rows.groupBy(key, "island").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    levels = max(1, longest.bit_length())  # no run is as long as 2 to this power
    table = _doubled(rows, levels - 1, folder, key)
    children = _branching(table, levels, 2 * n, folder)
    node = F.struct("parent", "length").alias("node")
    nodes = children.groupBy("parent", "length").agg(*_merged()).select(node, "leaves", "place", "places", ((F.col("low") != F.col("high")) & (F.col("low_before") != F.col("high_before"))).alias("reported"))
    nodes = shared.stash(nodes, f"{folder}/nodes")
    total = nodes.count()
    # A child's topmost node has the same places: the same first one, and as many.
    tops = nodes.select("place", "places", F.col("node").alias("below"))
    links = children.where("places > 1").select("place", "places", node).join(tops, ["place", "places"])
    nearest = _nearest(nodes, links.select(F.col("below").alias("node"), F.col("node").alias("up")), total, folder)
    named = nodes.select(F.col("node").alias("block"), F.col("place.file").alias("first"), F.col("place.seq").alias("first_seq"), (F.col("node.length") + size - 1).alias("length"), "places")
    lines = table.select("place", "line_no")
    blocks = shared.stash(named.join(nodes.where("reported").select(F.col("node").alias("block"), "place"), "block").join(lines, "place"), f"{folder}/blocks")
    up = links.select(F.col("below").alias("block"), "node").join(nearest.where("block is not null").withColumnRenamed("block", "shorter"), "node").select("block", "shorter")
    shorter = blocks.select(F.col("block").alias("shorter"), F.col("first").alias("shorter_first"), F.col("first_seq").alias("shorter_seq"), F.col("length").alias("shorter_length"))
    counted = up.groupBy("shorter").agg(F.count("*").alias("n"))
    up = shared.lookup(up, shorter.join(counted, "shorter"), "shorter", "n", total).drop("shorter")
    out = blocks.join(up, "block", "left").select("first", "first_seq", F.col("line_no").alias("first_line"), "length", "places", "shorter_first", "shorter_seq", "shorter_length")
    # A single place under a node has it as its longest repeat.
    single = shared.stash(children.where("places = 1").select("place", node).join(nearest.where("block is not null"), "node").select("place", "block").join(lines, "place"), f"{folder}/single")
    held = single.groupBy("block").agg(F.count("*").alias("n"))
    own = shared.lookup(single, blocks.drop("place", "places", "line_no").join(held, "block"), "block", "n", single.count())
    return out, own.select("first", "first_seq", "length", F.col("place.file").alias(key), F.col("place.seq").alias("seq"), "line_no")
