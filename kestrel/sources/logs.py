"""Session logs, prompts and the history index: JSON lines, of which malformed ones fall out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kestrel.functions import scalars as S
from kestrel.operators import shared

USAGE = "struct<input_tokens: long, output_tokens: long, cache_read_input_tokens: long, cache_creation_input_tokens: long>"
ENTRY = f"type string, sessionId string, timestamp string, durationMs long, message struct<model: string, content: string, usage: {USAGE}>"
BLOCKS = "array<struct<type: string, text: string>>"
#: Rows of one session that go to a task together.
BLOCK = 1 << 17


def read_lines(spark: SparkSession, glob: str) -> DataFrame:
    """(file, line) of non-blank lines."""
    return spark.read.text(glob).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("value") != "")


def entries(lines: DataFrame) -> DataFrame:
    """(file, session, stem, folder, type, timestamp, duration_ms, model, content, the four counters) of well-formed lines.

    A message that is no object gives nulls for its fields; counters that are missing are null.
    """
    e = F.from_json("line", ENTRY, {"mode": "PERMISSIVE"})
    usage = lambda f: F.col(f"e.message.usage.{f}")
    rows = lines.select("file", "line", e.alias("e")).where(F.get_json_object("line", "$.type").isNotNull() & F.col("e").isNotNull())
    return rows.select(
        "file",
        F.col("e.sessionId").alias("session"),
        F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("stem"),
        F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("folder"),
        F.col("e.type").alias("type"),
        F.col("e.timestamp").alias("timestamp"),
        F.col("e.durationMs").alias("duration_ms"),
        F.col("e.message.model").alias("model"),
        F.col("e.message.content").alias("content"),
        usage("input_tokens").alias("input_tokens"),
        usage("output_tokens").alias("output_tokens"),
        usage("cache_read_input_tokens").alias("cache_read"),
        usage("cache_creation_input_tokens").alias("cache_write"),
        F.get_json_object("line", "$.message").rlike(r"^\s*\{").alias("is_object"),
    )


def project_name(folder: Column) -> Column:
    """The last part of an encoded project folder (Q3)."""
    return F.substring_index(F.trim(folder, F.lit("-")), "-", -1)


def assistant_records(rows: DataFrame) -> DataFrame:
    """(session_id, project, model, the four counters) of assistant lines, the session being the file's name."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    kept = rows.where("type = 'assistant' AND is_object")
    return kept.select(F.col("stem").alias("session_id"), project_name(F.col("folder")).alias("project"), F.coalesce("model", F.lit("unknown")).alias("model"), *(zero(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_write")))


def text_of(content: Column) -> Column:
    """What a user typed (X24): a string, or the text blocks joined by line ends; '' if any block is a tool's result."""
    blocks = F.from_json(content, BLOCKS)
    texts = F.filter(F.transform(F.filter(blocks, lambda b: b.type == "text"), lambda b: S.stripped(b.text)), lambda t: t != "")
    listed = F.when(F.exists(blocks, lambda b: b.type == "tool_result"), "").otherwise(F.array_join(texts, "\n"))
    return F.coalesce(F.when(content.rlike(r"^\s*\[\s*[\{\]]"), listed).otherwise(S.stripped(content)), F.lit(""))


def user_prompts(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(timestamp, session_id, text) of typed prompts, newest first."""
    text = text_of(F.col("content"))
    found = rows.where("type = 'user'").select(F.coalesce("timestamp", F.lit("")).alias("timestamp"), F.col("stem").alias("session_id"), text.alias("text")).where("text != ''").orderBy(F.desc("timestamp"), "session_id", "text")
    return found.limit(limit) if limit else found


def session_summaries(rows: DataFrame) -> DataFrame:
    """A row per session with a model (S6, A9): first model and text, commands in it, last duration, turns, sums.

    Lines of subagents stay out.  Lines are ordered by timestamp; those without one come first (T9).
    """
    rows = rows.where(~F.col("file").contains("subagents") & F.col("session").isNotNull()).withColumn("at", F.coalesce("timestamp", F.lit("")))
    of = lambda kind, value, order: F.when((F.col("type") == kind) & value.isNotNull(), order)
    text = F.when(F.col("type") == "user", F.nullif(text_of(F.col("content")), F.lit("")))
    # Texts make the sums sort their rows: what a task sorts is dealt out first, a session's neighbouring rows together and a long session in blocks.
    rows = rows.select(F.col("session"), "type", "at", "model", text.alias("text"), "duration_ms", "input_tokens", "output_tokens", "cache_read", "cache_write")
    block = F.floor(F.monotonically_increasing_id() / BLOCK)
    rows = rows.withColumn("_block", block).repartition(shared.partitions(rows.sparkSession), "session", "_block")
    found = rows.groupBy(F.col("session").alias("session_id")).agg(
        F.min_by("model", of("assistant", F.col("model"), F.struct("at", "model"))).alias("model"),
        F.min_by("text", of("user", F.col("text"), F.struct("at", "text"))).alias("first"),
        F.max_by("duration_ms", of("system", F.col("duration_ms"), F.struct("at", "duration_ms"))).alias("duration_ms"),
        F.count_if(F.col("type") == "assistant").alias("turns"),
        *(F.coalesce(F.sum(F.when(F.col("type") == "assistant", F.col(c))), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_write")),
    )
    first = F.substring("first", 1, 500)
    commands = F.filter(F.split(first, r"\s+"), lambda w: w.startswith("/") & (F.length(w) > 1))
    return found.where("model IS NOT NULL").withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).withColumn("commands", commands).withColumn("first", first)


def history_index(lines: DataFrame, day: str) -> DataFrame:
    """(session_id, project) that the history names on a day up to 23:59:59.000; the last line of a session counts."""
    e = F.from_json("line", "timestamp long, sessionId string, project string")
    start = F.unix_millis(F.lit(day).cast("timestamp"))
    rows = lines.select(e.alias("e")).select("e.*").where(F.col("timestamp").between(start, start + 86_399_000) & (F.coalesce("sessionId", F.lit("")) != ""))
    return rows.groupBy(F.col("sessionId").alias("session_id")).agg(F.max_by("project", F.struct("timestamp", "project")).alias("project"))
