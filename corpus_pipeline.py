"""Corpus pipeline: quality rules, near duplicates, personal data, source mixing, tokens.

Each stage works on the rows that the one before kept, written as Parquet and read
again. All but the last return the columns of ``documents``, and further columns that
their input has, whatever their names.

Defined results: a null or empty text has no words, so the quality rules reject it; rows
without a doc_id or source, and rows that repeat others in part or in whole, are rows
like any other; texts of any length are read whole; an empty table gives empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequill.llm import bpe, hostrules, mixing, nearcopies, pii
from tracequill.session import drop_path, scope, scratch_path

#: No source is taken more than twice as often as the least repeated one.
MAX_REPETITION = 2.0
TARGET_ENTROPY = 0.97
#: Bytes of rows that a Python worker gets at once: texts stand in the JVM, in the worker and in what it returns.
ARROW_BATCH = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to :data:`ARROW_BATCH`; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if not now.isdecimal() or int(now) > ARROW_BATCH:
        spark.conf.set(key, str(ARROW_BATCH))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go.

    Hosts are judged by the rows of ``docs``; a null source is a host; repeated rows count as often as they occur.
    """
    _small_batches(spark)
    return hostrules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts with a five-word Jaccard similarity of 0.8 or more the smallest doc_id stays.

    Links come from SimHash fingerprints in Gray order, are held against exact similarity, and
    completed by an exact filter. Rows without a doc_id come last; of equal doc_ids the first row
    stays; texts without words are copies.
    """
    _small_batches(spark)
    return nearcopies.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are masked in the text; n_chars follows.

    Overlapping spans make one mask, named by the first; a null text stays null, with null n_chars.
    """
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once at least; rows of rarer sources again, up to the repetition limit.

    A null source is a source; texts without words are taken once; ties in the order go by the row's place.
    """
    return mixing.mixed(docs, TARGET_ENTROPY, MAX_REPETITION, budget="cover")


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row; a null text has no tokens, repeated rows repeat."""
    _small_batches(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", source_mixing),
    ("bpe", byte_pairs),
]

#: XXH64 hashes and byte-pair merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        with scope(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
