"""Documents to packed training batches: five stages, each on what the one before it kept.

All stages but the last return the columns of documents as they are, with whatever others the table
has, of any name; null ids, sources, languages and lengths are kept, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrel.llm import jaccard_join, language, packing, secrets, substring_dedup
from kestrel.llm.common import shared_dir, stash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letters, or a score under one half) go.

    So do null and empty texts, and all documents if none has a language to learn from; repeated rows stay or go alike.
    """
    return language.keep_decided(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their shingles of five words) stays, the one of the smallest id.

    Rows that repeat an id and a text are one document; null and empty texts are in no group and stay.
    """
    return jaccard_join.keep_first(docs, words=5, hundredths=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut out; a document of nothing else goes.

    Null and empty texts stay as they are; repeated rows are cut alike, and of two equal texts that of the smaller id stays whole.
    """
    return substring_dedup.remove(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials of fewer than three owners are put out by a mark.

    All documents stay, null and empty texts as they are; a null source counts as one owner.
    """
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's length bucket, batch and slot, with its token ids.

    A null or empty text has no ids and takes a slot; repeated rows have a slot each; no documents give no rows.
    """
    import public_tokenizers

    return packing.pack_ids(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("secret_scans", secret_scans), ("packing", packed)]

#: No stage but the secret scan can be said in SQL; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
