"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kestrel.llm import token_files

    manifest = token_files.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    return token_files.read(manifest)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm import warc

    return warc.read(warc.write(_table(spark, sf_dir, "pages"), least=0))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm import secrets

    return secrets.report(_table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm import neighbours

    return neighbours.search(_table(spark, sf_dir, "embeddings"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm import jaccard_join

    return jaccard_join.join(_table(spark, sf_dir, "documents")).drop("row_key")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kestrel.llm import packing, token_files

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(token_files.with_counts(docs, public_tokenizers.path("word_bpe_49k.json")), length_col="n_tokens")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm import fingerprints

    return fingerprints.compare_with_next(_table(spark, sf_dir, "documents"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm import substring_dedup

    return substring_dedup.repeats(_table(spark, sf_dir, "documents")).drop("row_key")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm import language

    return language.identify(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kestrel.llm import bpe

    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm import exact_dedup

    return exact_dedup.dedup(_table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm import resampling

    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.llm import conversations

    return conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_token_files": op1_token_files, "op2_warc": op2_warc, "op3_secrets": op3_secrets, "op4_neighbours": op4_neighbours, "op7_jaccard_join": op7_jaccard_join, "op8_packing": op8_packing, "op5_fingerprints": op5_fingerprints, "op6_bpe": op6_bpe, "op9_substrings": op9_substrings, "op10_language": op10_language, "op11_exact_dedup": op11_exact_dedup, "op12_resampling": op12_resampling, "op13_conversations": op13_conversations}


def _secrets_sql() -> str:
    """op3_secrets in DuckDB's SQL: places are sums of the lengths of matches and of what lies between them."""
    from kestrel.llm import secrets

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    # Matches of these two are followed by no letter that they could take, so they need no possessive mark here.
    shapes = [(secrets.ASSIGN, 2), (secrets.ACCESS.removesuffix("+"), 0), (secrets.HEX.removesuffix("+"), 0)]
    found = " UNION ALL ".join(
        f"SELECT r, owner, {no} AS no, unnest(range(len(h))) AS pos, unnest(h) AS hit, unnest(v) AS val, unnest(g[1:len(h)]) AS gap "
        f"FROM (SELECT r, owner, regexp_extract_all(t, {quoted(p)}, 0) AS h, regexp_extract_all(t, {quoted(p)}, {group}) AS v, string_split_regex(t, {quoted(p)}) AS g FROM d)"
        for no, (p, group) in enumerate(shapes)
    )
    kinds = "[" + ", ".join(map(quoted, secrets.KINDS)) + "]"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner FROM documents), m AS ({found}),
  placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, no ORDER BY pos) AS stop, len(list_distinct(string_split(val, ''))) AS chars FROM m),
  hits AS (SELECT r, owner, no, stop - length(hit) AS start, stop, val, NOT regexp_matches(val, {quoted(secrets.PLACEHOLDER)}) AND CASE WHEN length(val) >= {secrets.LIVE_LENGTH} THEN chars >= {secrets.LIVE_CHARS}
    ELSE regexp_matches(val, '[A-Za-z]') AND regexp_matches(val, '[0-9]') AND chars * 2 >= length(val) END AS looks FROM placed WHERE no > 0 OR length(val) >= {secrets.LEAST_VALUE}),
  spread AS (SELECT val, count(DISTINCT owner) AS owners FROM hits GROUP BY val),
  judged AS (SELECT r, no, start, stop, length(val) AS width, CASE WHEN owners >= {secrets.EXAMPLE_OWNERS} THEN 'example' WHEN looks THEN 'live' ELSE 'shared' END AS verdict FROM hits JOIN spread USING (val)),
  spans AS (SELECT r, no, start, stop, verdict FROM judged UNION ALL SELECT DISTINCT r, 3, stop - width, stop, verdict FROM judged WHERE verdict = 'live'),
  named AS (SELECT *, {kinds}[no + 1] || ':' || start || ':' || stop AS span FROM spans)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (WHERE no = 0) AS n_assign, count(*) FILTER (WHERE no = 1) AS n_access, count(*) FILTER (WHERE no = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, no, stop) FILTER (WHERE no < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, no, stop), '') AS spans,
  count(*) FILTER (WHERE no = 3) AS n_live, count(*) FILTER (WHERE no < 3 AND verdict = 'example') AS n_example, count(*) FILTER (WHERE no < 3 AND verdict = 'shared') AS n_shared
FROM d LEFT JOIN named USING (r) GROUP BY r"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

EXACT_DEDUP_SQL = f"""WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_secrets": _secrets_sql(), "op11_exact_dedup": EXACT_DEDUP_SQL}
