"""Source-text analytics: lines, normalisation, pattern tables, duplicate windows, islands, markup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def _split(text: Column) -> Column:
    """Lines of a text without a trailing empty one.  Plain replacements and one-character splits run without a regular expression."""
    plain = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.split(F.when(plain.endswith("\n"), F.substring(plain, F.lit(1), F.length(plain) - 1)).otherwise(plain), "\n")


def lines(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 1, line); a trailing empty line is dropped."""
    split = files.select(key, F.posexplode(_split(F.col(text))).alias("pos", "line"))
    return split.select(key, (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def _plain(line: Column) -> Column:
    """A line with white space collapsed."""
    uneven = line.contains("  ") | line.contains("\t")  # most lines are not
    return F.trim(F.when(uneven, F.regexp_replace(line, "[ \t]+", " ")).otherwise(line))


def _counts(line: Column) -> Column:
    """Whether a collapsed line is no comment, import or trivial one."""
    left = reduce(lambda a, b: a | b, (line.startswith(x) for x in ("#", "//", "import ", "from ")))
    return ~left & (F.octet_length(line) >= 3)


def normalized(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines without comments, imports and trivial ones, white space collapsed, numbered anew."""
    kept = rows.withColumn("line", _plain(F.col("line"))).where(_counts(F.col("line")))
    return kept.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("line_no")).cast("long"))


def windows(files: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seq, line_no, hash) of each run of `size` normalized lines of a file.

    A file's lines are split, normalized and joined in arrays of its own row; only hashes leave it.
    The hash is MD5: it names groups only.
    """
    kept = F.filter(F.transform(_split(F.col(text)), lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), _plain(x).alias("line"))), lambda x: _counts(x["line"]))
    rows = files.select(key, kept.alias("kept")).where(F.size("kept") >= size).withColumn("lines", F.transform("kept", lambda x: x["line"]))
    run = F.col("lines")
    for k in range(1, size):  # each line with the k-th after it, for all lines at once
        run = F.zip_with(run, F.slice("lines", F.lit(k + 1), F.size("lines")), lambda x, y: F.concat(x, F.lit("\n"), y))
    hashed = F.zip_with("kept", run, lambda x, r: F.struct(x["line_no"].alias("line_no"), F.md5(r).alias("hash")))
    found = rows.select(key, F.posexplode(F.slice(hashed, F.lit(1), F.size("lines") - size + 1)).alias("seq", "w"))
    return found.select(key, (F.col("seq") + 1).cast("long").alias("seq"), "w.line_no", "w.hash")


def duplicate_windows(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Windows that stand in more than one file: hash, files, first file (J19 by groups: no pairs are made)."""
    groups = found.groupBy("hash").agg(F.countDistinct(key).alias("files"), F.min(key).alias("first"), F.count("*").alias("places"))
    return groups.where("files > 1")


def duplicate_places(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(hash, first, first_seq, first_line, key, seq, line_no): each window beside the first place of its hash in another file (J19): n places give n - 1 rows and not all pairs."""
    places = found.groupBy("hash").agg(F.min(F.struct(F.col(key).alias("first"), F.col("seq").alias("first_seq"), F.col("line_no").alias("first_line"))).alias("p"), F.max(key).alias("_last"))
    places = places.where(F.col("_last") != F.col("p.first")).select("hash", "p.*")
    return found.join(places, "hash").where(F.col(key) != F.col("first")).select("hash", "first", "first_seq", "first_line", key, "seq", "line_no")


def duplicate_blocks(found: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """(first, key, first_line, line, length): the longest runs that a file shares with the first file that holds them.

    Each window meets only the first place of its hash, so a passage that stands in n files gives n - 1
    blocks and not all pairs; windows on one diagonal join to a block, measured in normalized lines (Q32).
    """
    w = Window.partitionBy("first", key, "diagonal").orderBy("seq")
    met = duplicate_places(found, key).withColumn("diagonal", F.col("seq") - F.col("first_seq")).withColumn("island", F.col("seq") - F.row_number().over(w))
    runs = met.groupBy("first", key, "diagonal", "island").agg(F.min("first_line").alias("first_line"), F.min("line_no").alias("line"), (F.count("*") + size - 1).alias("length"))
    return runs.select("first", key, "first_line", "line", "length")


def section_fill(rows: DataFrame, heading: Column, key: str = "doc_id") -> DataFrame:
    """Lines with the last heading at or before them (W9); lines before the first have none."""
    w = Window.partitionBy(key).orderBy("line_no")
    return rows.withColumn("section", F.last(F.when(heading, F.col("line")), ignorenulls=True).over(w))


def lookahead_missing(rows: DataFrame, opening: str, closing: str, ahead: int = 3, key: str = "doc_id") -> DataFrame:
    """Lines with the opening word and the closing one neither on them nor on the next few."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(0, ahead)
    near = F.max(F.col("line").contains(closing)).over(w)
    return rows.withColumn("_near", near).where(F.col("line").contains(opening) & ~F.col("_near")).drop("_near")


def keyword_hits(rows: DataFrame, keywords: list[str], per_keyword: int, key: str = "doc_id") -> DataFrame:
    """First keyword that a line contains, the first `per_keyword` lines of each (J9, W1): a top-k report."""
    low = F.lower("line")
    word = F.coalesce(*(F.when(low.contains(k), k) for k in keywords))
    hits = rows.withColumn("keyword", word).where("keyword is not null")
    n = F.row_number().over(Window.partitionBy("keyword").orderBy(key, "line_no"))
    return hits.withColumn("n", n.cast("long")).where(F.col("n") <= per_keyword).select("keyword", "n", key, "line_no")


def islands(rows: DataFrame, test: Column, least: int, key: str = "doc_id") -> DataFrame:
    """Runs of at least `least` lines that pass the test, one after the other."""
    hit = rows.where(test).withColumn("island", F.col("line_no") - F.row_number().over(Window.partitionBy(key).orderBy("line_no")))
    runs = hit.groupBy(key, "island").agg(F.min("line_no").alias("first_line"), F.count("*").alias("length"))
    return runs.where(F.col("length") >= least).drop("island")


#: Entities that stand for one character.
ENTITIES = [("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
HTML_LIMIT = 50_000


def _decoded(text: Column) -> Column:
    for entity, char in ENTITIES:  # the ampersand comes last: what it uncovers is text
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_text(html: Column, limit: int | None = HTML_LIMIT) -> Column:
    """Text of a page (S25, X25): comments, scripts, styles and tags go, entities become characters, white space collapses; at most `limit` code points."""
    bare = F.regexp_replace(F.regexp_replace(html, "(?s)<!--.*?-->", " "), "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.trim(F.regexp_replace(_decoded(F.regexp_replace(bare, "<[^>]*>", " ")), "[ \t\r\n]+", " "))
    return F.substring(text, 1, limit) if limit else text


def html_title(html: Column) -> Column:
    """A page's title, '' without one."""
    return F.trim(F.regexp_replace(_decoded(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)), "[ \t\r\n]+", " "))


def reusable_markup(pages: DataFrame, least_pages: int = 3, least_uses: int = 3, key: str = "page_id", html: str = "html") -> DataFrame:
    """Tags with a class that occur often on several pages."""
    tags = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit('<([a-z0-9]+ class="[^"]*")'), F.lit(1))).alias("pattern"))
    return tags.groupBy("pattern").agg(F.count("*").alias("uses"), F.countDistinct(key).alias("pages")).where((F.col("uses") >= least_uses) & (F.col("pages") >= least_pages))


def unused(definitions: DataFrame, uses: DataFrame, on: list[str]) -> DataFrame:
    """Definitions that nothing uses."""
    return definitions.join(uses.select(on).distinct(), on, "left_anti")
