"""Secret scans, and how widely each candidate is copied over the corpus; DataFrame functions only.

A candidate that many owners hold is an example that was copied around; one that fewer hold, in
however many repositories, and that looks random is taken for a live credential and gets a span of
its own (kind "live") over the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kestrel.llm.common import shared_dir, stash, text_or_empty

#: Fixed values.  A match is kept if its value (group 2, else the match) has the least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "live")
LEAST_VALUE = 6
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[-_]|xxxx|1234567|abcdef"
#: A live-looking value: length and distinct characters at least; a shorter one has letters, digits and distinct characters for half its length.
LIVE_LENGTH, LIVE_CHARS = 16, 8
#: Owners from which on a candidate is an example that was copied around.
EXAMPLE_OWNERS = 3


def _pieces(text: Column, pattern: str, group: int) -> Column:
    """For each match in order: code points since the last match, those of the match, its value; null where nothing matches.

    The last entry has what follows the last match and no match.
    """
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    found = F.transform(zipped, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("len"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), found)


def scan(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", folder: str | None = None, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, spans) of whole texts.

    documents: the columns to keep as one struct doc, and _row, a number for each row (repeated rows have their own).
    spans: _row, kind, start, end (code points, end exclusive), verdict (live, example or shared)
    and owners and repositories that hold the value; the base kinds, and "live" spans besides.
    Null or empty text has no spans; a null owner or repository counts as one owner or repository.
    """
    folder = folder or shared_dir(docs.sparkSession, "secrets")
    keep = docs.columns if keep is None else keep
    text = text_or_empty(F.col(f"`{text_col}`"))
    found = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"),
        F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("")).alias("_owner"),
        F.coalesce(F.col(f"`{repository_col}`").cast("string"), F.lit("")).alias("_repository"),
        _pieces(text, ASSIGN, 2).alias("_assign"),
        _pieces(text, ACCESS, 0).alias("_access"),
        _pieces(text, HEX, 0).alias("_hex"),
    )
    found = stash(found, folder, "found")
    own = ["_row", "_owner", "_repository"]
    pieces = None
    for number, kind in enumerate(KINDS[:3]):
        one = found.where(F.col(f"_{kind}").isNotNull()).select(*own, F.posexplode(f"_{kind}").alias("pos", "x")).where("x.len is not null")
        one = one.select(*own, F.lit(number).alias("no"), "pos", "x.*")
        pieces = one if pieces is None else pieces.unionByName(one)
    sofar = Window.partitionBy("_row", "no").orderBy("pos")
    stop = F.sum(F.col("gap").cast("long")).over(sofar) + F.sum(F.col("len").cast("long")).over(sofar)
    hits = pieces.withColumn("end", stop).where((F.col("no") > 0) | (F.length("value") >= LEAST_VALUE))
    distinct = F.size(F.array_distinct(F.split("value", "")))
    short = F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]") & (distinct * 2 >= F.length("value"))
    looks = F.when(F.length("value") >= LIVE_LENGTH, distinct >= LIVE_CHARS).otherwise(short) & ~F.col("value").rlike(PLACEHOLDER)
    hits = hits.select(*own, "no", (F.col("end") - F.col("len")).alias("start"), "end", F.length("value").alias("width"), looks.alias("looks"), F.sha2("value", 256).alias("secret"))
    hits = stash(hits, folder, "hits")
    # Distinct holders first, then owners, then candidates: each step sums on the map side, so no candidate meets in one task.
    holders = hits.groupBy("secret", "_owner", "_repository").agg(F.lit(1).alias("one"))
    by_owner = holders.groupBy("secret", "_owner").agg(F.count("*").alias("repositories"))
    spread = by_owner.groupBy("secret").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    spread = stash(spread, folder, "spread")
    verdict = (
        F.when(F.col("owners") >= EXAMPLE_OWNERS, "example")
        .when(F.col("looks"), "live")
        .otherwise("shared")
    )
    judged = hits.join(spread, "secret").withColumn("verdict", verdict)
    shape = ["_row", "no", "start", "end", "verdict", "owners", "repositories"]
    # A value may be found by two kinds; its live span is one.
    live = judged.where("verdict = 'live'").withColumns({"start": F.col("end") - F.col("width"), "no": F.lit(3)}).select(shape).distinct()
    spans = stash(judged.select(shape).unionByName(live), folder, "spans")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("no") + 1)
    return found, spans.withColumn("kind", kind)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _matched():
    return F.col("_assign").isNotNull() | F.col("_access").isNotNull() | F.col("_hex").isNotNull()


def report(docs: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_shared.

    Null and empty texts have counts of 0, empty spans and the digest of an empty string.  Repeated
    rows have a row each, which count as one holder of their secrets; an empty table gives no rows.
    """
    found, spans = scan(docs, keep=[id_col], **columns)
    own_id = F.col("doc")[id_col].alias("doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("start", "no", "end", "kind", "verdict")))
    per_row = spans.groupBy("_row").agg(ordered.alias("s"))
    # Rows without a match skip the join.
    rows = found.where(_matched()).select("_row", own_id).join(per_row, "_row", "left")
    rows = rows.unionByName(found.where(~_matched()).select("_row", own_id, F.lit(None).cast(dict(per_row.dtypes)["s"]).alias("s")))
    s = F.coalesce(F.col("s"), F.array().cast(dict(per_row.dtypes)["s"]))
    base = F.filter(s, lambda x: x["no"] < 3)

    def count(field: str, value, upto: int = 3) -> Column:
        return F.size(F.filter(s, lambda x: (x["no"] <= upto) & (x[field] == value))).cast("long")

    return rows.select(
        "doc_id",
        *(count("kind", k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(s).alias("spans"),
        count("kind", "live").alias("n_live"),
        *(count("verdict", v, upto=2).alias(f"n_{v}") for v in ("example", "shared")),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", length_col: str | None = "n_chars", **columns: str) -> DataFrame:
    """The documents with each live credential in the text put out by the mark; all columns stay, and length_col, if the table has it, counts the new text's code points.

    Texts without a live credential, null and empty ones among them, stay as they are, and repeated
    rows are changed alike; an empty table gives an empty one.
    """
    found, spans = scan(docs, text_col=text_col, **columns)
    live = spans.where("kind = 'live'").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    text = F.col("doc")[text_col]
    empty = F.array().cast(dict(live.dtypes)["_spans"])
    before = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))), F.coalesce(F.col("_spans"), empty))
    # Text from the end of each span to the start of the next; spans that overlap leave nothing between them.
    ends = F.transform(before, lambda x, i: F.struct(F.array_max(F.transform(F.slice(before, 1, i + 1), lambda y: y["end"])).alias("at"), F.get(before, i + 1)["start"].alias("stop")))
    kept = F.transform(
        F.filter(ends, lambda x: x["stop"].isNull() | (x["stop"] >= x["at"])),
        lambda x: F.substring(text, (x["at"] + 1).cast("int"), F.coalesce(x["stop"] - x["at"], F.length(text).cast("long")).cast("int")),
    )
    rows = found.where(_matched()).join(live, "_row", "left").withColumn("_text", F.when(F.col("_spans").isNotNull(), F.array_join(kept, mark)).otherwise(text))
    new = {text_col: F.col("_text")}
    if length_col in docs.columns:
        old = F.col("doc")[length_col]
        new[length_col] = F.when(F.col("_spans").isNotNull(), F.length("_text").cast(docs.schema[length_col].dataType)).otherwise(old)
    changed = rows.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))
    return changed.unionByName(found.where(~_matched()).select(*(F.col("doc")[c].alias(c) for c in docs.columns)))
