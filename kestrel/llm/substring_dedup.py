"""Passages that repeat across documents: paragraph MinHash banding, verified, clustered by components.

Two kinds of paragraphs are looked at.  Lines of LINE_WORDS words or more get MinHash bands; lines
that collide in a band are joined to a leader of the bucket, verified by the exact Jaccard
similarity of their word shingles, and clustered by components.  Then all lines of a bucket that are
not in one component yet are compared with each other, in tiles of bounded size.

A passage that was put into the middle of a line is no paragraph of its own.  For those a window of
WINDOW words starts wherever a hash of two neighbouring words is the least of CUT in a row, which
depends on nothing outside the passage, so that equal passages have equal windows (similarity 1).
The first such place of a passage is among its first CUT words: one of WINDOW + CUT = 50 words or
more always has a window.

Of each cluster that lies in two documents or more the first occurrence (smallest doc_id) stays and
the others are removed.  Those of a document that overlap or adjoin make a run, which is extended
word by word as far as the words beside its outermost windows equal those beside their first
occurrence.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kestrel.llm.common import discard, free_name, mix, only, partitions, ready, release, shared_dir, stash, text_or_empty
from kestrel.llm.graph import components
from kestrel.llm.words import BASE, Words, ragged, runs_of, together

#: Words to a shingle, and the similarity in hundredths.
WORDS, HUNDREDTHS = 5, 80
#: Bands and rows: lines at the threshold collide with probability 1 - (1 - 0.8^3)^8 = 0.997.
BANDS, ROWS = 8, 3
LINE_WORDS, CUT, WINDOW = 20, 30, 20
#: Lines to a tile of a bucket.
TILE = 256
#: A passage goes on beyond its outermost window by fewer words, or another window would be there.
BESIDE = CUT + WINDOW
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
UNIT = "row_key long, doc_id long, start int, n_words int, class long, bands array<long>"
ODD = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)).reshape(BANDS, ROWS)
FACTORS = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)
MOST = np.uint64((1 << 64) - 1)


def lines_of(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after the last) of each line that has words, over all texts."""
    newlines = np.flatnonzero(found.data == 10)
    cuts = np.unique(np.concatenate([found.bounds, np.searchsorted(found.starts, newlines)]))
    return cuts[:-1], cuts[1:]


def _between(values: np.ndarray, fold: np.ufunc, starts: np.ndarray, ends: np.ndarray, nothing) -> np.ndarray:
    """fold over values[start:end] of each pair; ends lie after starts."""
    return fold.reduceat(np.append(values, nothing), np.stack([starts, ends], axis=1).ravel())[::2]


def line_units(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, class, band keys) of the lines of LINE_WORDS words or more; lines of one class are equal."""
    starts, ends = lines_of(found)
    long = ends - starts >= LINE_WORDS
    starts, ends, h = starts[long], ends[long], found.hashes
    keys = np.zeros((len(starts), BANDS), np.uint64)
    if not len(starts):
        return starts, ends, keys[:, 0], keys
    power = np.cumprod(np.full(len(h), BASE, np.uint64), dtype=np.uint64)
    inverse = np.cumprod(np.full(len(h), pow(BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)
    classes = mix(_between(h * power, np.add, starts, ends, np.uint64(0)) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    shingles = runs_of(h, WORDS)
    for b in range(BANDS):
        for r in range(ROWS):
            keys[:, b] = mix(keys[:, b] + _between(shingles * ODD[b, r], np.minimum, starts, ends - WORDS + 1, MOST) + np.uint64(b + 1))
    return starts, ends, classes, keys


def window_units(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """(start, class) of the windows, WINDOW words each."""
    h, bounds = found.hashes, found.bounds
    sizes = np.diff(bounds)
    if not (sizes >= WINDOW).any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # The upper half of a hash of two words, and the place: the least of both is the first of the least.
    key = (runs_of(h, 2) >> np.uint64(32) << np.uint64(32)) | np.arange(len(h) - 1, dtype=np.uint64)
    at = []
    if len(key) >= CUT:
        least, width = key, 1
        while width * 2 <= CUT:
            least, width = np.minimum(least[:-width], least[width:]), width * 2
        least = np.minimum(least[: len(key) - CUT + 1], least[CUT - width : CUT - width + len(key) - CUT + 1])
        # CUT pairs of words from here on lie in one text.
        inside = np.ones(len(least), bool)
        over = (bounds[1:, None] + np.arange(-CUT, 0)[None, :]).ravel()
        inside[over[(over >= 0) & (over < len(least))]] = False
        at.append(least[inside])
    short = (sizes >= WINDOW) & (sizes <= CUT)
    if short.any():
        at.append(_between(key, np.minimum, bounds[:-1][short], bounds[1:][short] - 1, MOST))
    at = np.unique(np.concatenate(at) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[at + WINDOW <= bounds[np.searchsorted(bounds, at, "right")]]
    return at, mix((h[at[:, None] + np.arange(WINDOW)] * FACTORS).sum(axis=1, dtype=np.uint64))


def _units(source: DataFrame) -> DataFrame:
    def run(batches):
        only("substrings")
        for batch in batches:
            for first, texts in together(batch.column(2)):
                found = Words(texts)
                starts, ends, classes, keys = line_units(found)
                at, window_classes = window_units(found)
                starts, ends, classes = np.concatenate([starts, at]), np.concatenate([ends, at + WINDOW]), np.concatenate([classes, window_classes])
                text = np.searchsorted(found.bounds, starts, "right") - 1
                which = pa.array(text + first)
                stops = np.minimum(np.arange(len(starts) + 1), len(keys)) * BANDS
                bands = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(keys.ravel().view(np.int64)), mask=pa.array(np.arange(len(starts)) >= len(keys)))
                columns = [batch.column(0).take(which), batch.column(1).take(which), *(pa.array(x.astype(np.int32)) for x in (starts - found.bounds[text], ends - starts)), pa.array(classes.view(np.int64)), bands]
                table = pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in UNIT.split(", ")])
                yield from (table.slice(i, 20_000) for i in range(0, len(starts), 20_000))

    return source.select("row_key", "doc_id", "text").mapInArrow(run, UNIT)


def _near_lines(units: DataFrame, source: DataFrame, folder: str) -> DataFrame:
    """(class, component) of lines that are like another line but not equal to it."""
    lines = units.where("bands is not null").groupBy("class").agg(F.min(F.struct("row_key", "start", "n_words")).alias("at"), F.first("bands").alias("bands"))
    lines = stash(lines, folder, "lines")
    release(source.sparkSession)
    keyed = lines.select("class", F.explode("bands").alias("key"))  # the band is part of its key
    # Each bucket has a leader, another one from band to band.
    leader = F.min_by("class", F.xxhash64("class", "key"))
    buckets = keyed.groupBy("key").agg(leader.alias("leader"), F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("key", "leader")
    buckets = stash(buckets, folder, "line-buckets")
    release(source.sparkSession)
    pairs = keyed.join(buckets, "key").where("class <> leader").select(F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b")).distinct()
    pairs = stash(pairs, folder, "line-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(lines, "class")
    wanted = stash(wanted.select("class", "at.*").groupBy("row_key").agg(F.collect_list(F.struct("class", "start", "n_words")).alias("lines")), folder, "line-places")

    def shingles(batches):
        for batch in batches:
            for first, texts in together(batch.column(0)):
                found, of = Words(texts), batch.column(1).slice(first, len(texts))
                at = of.flatten()
                start, n = at.field("start").to_numpy(), at.field("n_words").to_numpy()
                start = start + np.repeat(found.bounds[:-1], of.value_lengths().to_numpy())
                every = runs_of(found.hashes, WORDS)
                sets = [np.unique(every[a : a + k - WORDS + 1]).tobytes() for a, k in zip(start.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([at.field("class"), pa.array(sets, pa.binary())], ["class", "shingles"])

    texts = source.select("row_key", "text").join(wanted.hint("merge"), "row_key").groupBy("row_key").agg(F.first("text").alias("text"), F.first("lines").alias("lines"))
    # Every line of a bucket is in a pair with its leader, so all lines that the tiles need are here.
    sets = stash(texts.select("text", "lines").mapInArrow(shingles, "class long, shingles binary"), folder, "line-sets")
    release(source.sparkSession)

    def verify(batches):
        for batch in batches:
            a, b = [], []
            for x, y, s, t in zip(*(batch.column(i) for i in range(4)), strict=True):
                s, t = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(t.as_py(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= HUNDREDTHS * (len(s) + len(t) - both):
                    a.append(x.as_py())
                    b.append(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("s")), "a").join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("t")), "b")
    links = stash(both.select("a", "b", "s", "t").mapInArrow(verify, "a long, b long"), folder, "line-links")
    release(source.sparkSession)
    groups = components(links, f"{folder}/line-groups").withColumnRenamed("node", "class")
    members = keyed.join(buckets.select("key"), "key").join(groups, "class", "left").withColumn("group", F.coalesce("component", "class")).drop("component")
    more = stash(_links_of_tiles(stash(members, folder, "line-members"), sets, folder), folder, "line-links-more")
    release(source.sparkSession)
    return components(links.unionByName(more), f"{folder}/line-components").withColumnRenamed("node", "class")


def _links_of_tiles(members: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Links (a, b) between lines of a bucket that are in different groups: enough of them to join all that are alike.

    A bucket is dealt into tiles of about TILE lines by hash, and each pair of its tiles is one unit of
    work (side 0: a tile with itself, 1 and 2: with another), so no task gets a bucket whole.
    """
    open_buckets = members.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("x <> y").select("key", "tiles")
    rows = members.join(stash(open_buckets, folder, "line-open"), "key")
    own, other = F.col("own"), F.col("other")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    unit = F.xxhash64("key", F.least(own, other), F.greatest(own, other))
    rows = rows.select(unit.alias("unit"), F.when(own == other, 0).when(own < other, 1).otherwise(2).alias("side"), "class", "group")
    rows = rows.join(sets, "class")

    def links(rows):
        """Verified links of one unit; lines that earlier links of the unit join are passed over."""
        sides, classes, groups = (np.array(x, np.int64) for x in rows[:3])
        tokens = [np.frombuffer(x.as_py(), np.uint64) for x in rows[3]]
        sizes = np.array([len(x) for x in tokens])
        _, number = np.unique(np.concatenate(tokens), return_inverse=True)
        owner = np.repeat(np.arange(len(tokens)), sizes)
        by_number = owner[np.argsort(number, kind="stable")]
        stops = np.concatenate([[0], np.cumsum(np.bincount(number))])
        numbers, found = np.split(number, np.cumsum(sizes)[:-1]), []
        for i in np.flatnonzero(sides < 2).tolist():
            others = groups != groups[i]
            others[: i + 1] &= sides[0] != 0
            if sides[0] != 0:
                others &= sides == 2
            if not others.any():
                continue
            holders = np.concatenate([by_number[stops[t] : stops[t + 1]] for t in numbers[i].tolist()])
            both = np.bincount(holders, minlength=len(tokens))
            for k in np.flatnonzero(others & (100 * both >= HUNDREDTHS * (sizes + sizes[i] - both))).tolist():
                if groups[k] != groups[i]:
                    found.append(sorted((int(classes[i]), int(classes[k]))))
                    groups[groups == groups[k]] = groups[i]
        return found

    def run(batches):
        now, rows = None, [[], [], [], []]
        for batch in batches:
            out = []
            for unit, side, cls, group, tokens in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if unit != now:
                    out += links(rows) if len(rows[0]) > 1 else []
                    now, rows = unit, [[], [], [], []]
                for x, y in zip(rows, (side, cls, group, tokens), strict=True):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        out = links(rows) if len(rows[0]) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    dealt = rows.repartition(partitions(members.sparkSession), "unit").sortWithinPartitions("unit", "side")
    return dealt.select("unit", "side", "class", "group", "shingles").mapInArrow(run, "a long, b long").distinct()


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """The runs of repeated passages: doc_id, start_word, n_words, removed, cluster, row_key.

    Words are runs without ASCII white space, counted from 0 over the whole text.  A run with
    removed = false holds first occurrences and stays.  Documents without a repeated passage have
    no row, so null, empty and wordless texts have none, nor has an empty table.  Rows that repeat an
    id and text are one document; null ids come last in the choice of first occurrences, ties go by
    content.  The result is read from the folder.
    """
    spark = docs.sparkSession
    ready(spark)
    folder = folder or shared_dir(spark, "substrings")
    source = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    units = stash(_units(source), folder, "units")
    near = stash(_near_lines(units, source, folder), folder, "near-lines")
    for name in ("lines", "line-buckets", "line-pairs", "line-places", "line-sets", "line-links", "line-members", "line-open", "line-links-more"):
        discard(folder, name)
    # Lines of one component go by its name; windows and all other lines by their own class.
    windows = units.where("bands is null").drop("bands").withColumnRenamed("class", "cluster").withColumn("window", F.lit(True))
    lines = units.where("bands is not null").drop("bands").join(near, "class", "left").withColumn("cluster", F.coalesce("component", "class")).drop("component", "class").withColumn("window", F.lit(False))
    named = windows.unionByName(lines)
    many = named.groupBy("cluster").agg(F.min("row_key").alias("x"), F.max("row_key").alias("y")).where("x <> y").select("cluster")
    many = stash(many, folder, "clusters")
    release(spark)
    found = stash(named.join(many.hint("merge"), "cluster"), folder, "repeated")
    discard(folder, "units")
    release(spark)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "start")
    firsts = found.groupBy("cluster").agg(F.min(place).alias("first")).select("cluster", F.col("first.row_key").alias("first_key"), F.col("first.start").alias("first_start"))
    firsts = stash(firsts, folder, "firsts")
    is_first = (F.col("row_key") == F.col("first_key")) & (F.col("start") == F.col("first_start"))
    judged = stash(found.join(firsts, "cluster").withColumn("removed", ~is_first), folder, "judged")
    discard(folder, "repeated")
    release(spark)
    # Overlapping and adjoining passages of a document make a run.
    end = F.col("start") + F.col("n_words")
    ordered = Window.partitionBy("row_key", "removed").orderBy("start", "n_words", "cluster")
    reach = F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    runs = judged.withColumn("begins", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("run", F.sum("begins").over(ordered))
    # The outermost windows and their first occurrences; a line's ends are its own.
    first = [F.col("window").alias("window"), F.col("first_key").alias("key"), F.col("first_start").alias("at")]
    at_left = F.min(F.struct("start", "n_words", *first)).alias("l")
    at_right = F.min(F.struct((-end).alias("end"), "n_words", *first)).alias("r")
    runs = runs.groupBy("row_key", "removed", "run").agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start_word"), F.max(end).alias("stop"), F.min("cluster").alias("cluster"), at_left, at_right)
    runs = stash(runs, folder, "runs")
    discard(folder, "judged")
    release(spark)
    left = F.struct(F.lit(-1).alias("side"), F.col("start_word").alias("at"), F.col("l.key").alias("first_key"), F.col("l.at").alias("first_at"), F.col("l.window").alias("window"))
    right = F.struct(F.lit(1).alias("side"), F.col("stop").alias("at"), F.col("r.key").alias("first_key"), (F.col("r.at") + F.col("r.n_words")).alias("first_at"), F.col("r.window").alias("window"))
    ends = runs.where("removed").select("row_key", "run", F.explode(F.array(left, right)).alias("e")).select("row_key", "run", "e.*").where("window").drop("window")
    more = _extensions(stash(ends, folder, "ends"), source, folder).groupBy("row_key", "run").agg(*(F.sum(F.when(F.col("side") == side, F.col("more"))).cast("int").alias(name) for side, name in ((-1, "more_l"), (1, "more_r"))))
    start, stop = F.col("start_word") - F.coalesce("more_l", F.lit(0)), F.col("stop") + F.coalesce("more_r", F.lit(0))
    extended = runs.where("removed").join(more, ["row_key", "run"], "left")
    return _joined(extended.unionByName(runs.where("not removed"), allowMissingColumns=True).select("doc_id", start.alias("start_word"), (stop - start).alias("n_words"), "removed", "cluster", "row_key"))


def _joined(runs: DataFrame) -> DataFrame:
    """The runs of a document that overlap or adjoin once they are extended, as one."""
    end = F.col("start_word") + F.col("n_words")
    ordered = Window.partitionBy("row_key", "removed").orderBy("start_word", "n_words", "cluster")
    reach = F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("begins", F.when(reach.isNull() | (F.col("start_word") > reach), 1).otherwise(0)).withColumn("run", F.sum("begins").over(ordered))
    whole = runs.groupBy("row_key", "removed", "run").agg(F.min("doc_id").alias("doc_id"), F.min("start_word").alias("from"), F.max(end).alias("stop"), F.min("cluster").alias("cluster"))
    return whole.select("doc_id", F.col("from").alias("start_word"), (F.col("stop") - F.col("from")).cast("int").alias("n_words"), "removed", "cluster", "row_key")


def _extensions(ends: DataFrame, source: DataFrame, folder: str) -> DataFrame:
    """(row_key, run, side, more): the words by which a run goes on beyond its outermost window, as its first occurrence does.

    Both places' next BESIDE words are hashed from the texts and compared.
    """
    places = ends.select("row_key", "at", "side").unionByName(ends.select(F.col("first_key").alias("row_key"), F.col("first_at").alias("at"), "side")).distinct()
    per_text = stash(places.groupBy("row_key").agg(F.collect_list(F.struct("at", "side")).alias("places")), folder, "end-places")
    texts = source.select("row_key", "text").join(per_text.hint("merge"), "row_key").groupBy("row_key").agg(F.first("places").alias("places"), F.first("text").alias("text"))

    def run(batches):
        for batch in batches:
            for first, texts in together(batch.column(2)):
                found, of = Words(texts), batch.column(1).slice(first, len(texts))
                own, sizes = of.flatten(), of.value_lengths().to_numpy()
                text = np.repeat(np.arange(len(texts)), sizes)
                at, side = own.field("at").to_numpy(), own.field("side").to_numpy()
                here = found.bounds[text] + at
                room = np.minimum(np.where(side > 0, found.bounds[text + 1] - here, at), BESIDE)
                # From the place outwards: words here, here + 1, ... or here - 1, here - 2, ...
                step = ragged(np.zeros(len(room), np.int64), room)
                word = np.repeat(here, room) + np.where(np.repeat(side, room) > 0, step, -1 - step)
                stops = np.concatenate([[0], np.cumsum(room)])
                beside = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array((found.hashes[word] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + first)), own.field("at"), own.field("side"), beside], ["row_key", "at", "side", "words"])

    beside = texts.select("row_key", "places", "text").mapInArrow(run, "row_key long, at int, side int, words array<int>")
    beside = stash(beside, folder, "beside")
    discard(folder, "end-places")
    release(source.sparkSession)
    first = beside.select(F.col("row_key").alias("first_key"), F.col("at").alias("first_at"), "side", F.col("words").alias("first_words"))
    both = ends.join(beside, ["row_key", "at", "side"]).join(first, ["first_key", "first_at", "side"])
    unlike = F.array_position(F.zip_with("words", "first_words", lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return both.select("row_key", "run", "side", F.when(unlike > 0, unlike - 1).otherwise(F.size("words")).alias("more"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these runs of words (start, number), in ascending order, and the white space after each."""
    data = text.encode()
    words = [m.span() for m in WORD.finditer(data)]
    out, at = [], 0
    for start, n in spans:
        begin = words[start][0]
        stop = words[start + n][0] if start + n < len(words) else len(data)
        out.append(data[at : max(at, begin)])
        at = max(at, stop)
    return b"".join([*out, data[at:]]).decode()


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents without the passages that are removed; all columns stay, and length_col, if the table has it, counts the new text's code points.

    A document of nothing else than removed passages goes, all others stay: those with a null, empty
    or wordless text as they are, and rows that repeat an id and text alike.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    ready(spark)
    key, spans_of = free_name(docs, "row_key", "spans")
    folder = shared_dir(spark, "substrings")
    spans = repeats(docs, id_col, text_col, folder).where("removed").groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start_word", "n_words"))).alias(spans_of))
    spans = stash(spans.withColumnRenamed("row_key", key), shared_dir(spark, "removals"), "spans")
    discard(folder)
    release(spark)
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(spans, key, "left").drop(key)
    names, schema = docs.columns, docs.schema
    text_at, spans_at = names.index(text_col), len(names)
    length_at = names.index(length_col) if length_col in names else None

    def run(batches):
        for batch in batches:
            texts, spans = batch.column(text_at), batch.column(spans_at)
            new, sizes, keep = [], [], []
            old = batch.column(length_at) if length_at is not None else None
            for i in range(batch.num_rows):
                if spans[i].is_valid:
                    text = cut(texts[i].as_py(), [(x["start_word"], x["n_words"]) for x in spans[i].as_py()])
                    new.append(text)
                    sizes.append(len(text))
                    keep.append(bool(text.encode().split()))
                else:
                    new.append(texts[i].as_py())
                    sizes.append(old[i].as_py() if old is not None else None)
                    keep.append(True)
            columns = batch.columns[: len(names)]
            columns[text_at] = pa.array(new, texts.type)
            if length_at is not None:
                columns[length_at] = pa.array(sizes, old.type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, schema)
