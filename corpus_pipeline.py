"""The corpus pipeline: five stages, each on what the one before it kept.

For every stage: an empty table gives an empty one; columns beyond doc_id and text are carried along whatever their names (n_chars
alone is counted anew where texts are cut), the last stage's result aside; rows without an id are rows like others, and rows that share one
are told apart by all their columns; bytes that are no UTF-8 are handled as the operator says; nothing depends on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionweave.llm import bpe, language, mixing, simhash, suffixes
from mentionweave.llm.common import bounded, discard, table, tidied, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised; texts that are null or without a letter go, as do rejected ones. Ties go to the first language of the alphabet."""
    bounded(spark)
    return language.reject(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose five-word shingles are alike by 0.8 or more: that of the least id, then of the least hash of the row."""
    return simhash.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text without strings of 200 bytes that occur again, and n_chars counted anew."""
    cut = suffixes.deduplicate(docs)
    if "n_chars" not in cut.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the rates say that bring the labelled domains to their target shares; all once where there are no labels."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with number and digests of the token ids of each row, and of what they decode to."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("simhash", drop_near_duplicates),
    ("suffixes", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trained models and merges of transforms are beyond SQL; tests hold near copies, removals, rates and ids against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each written as Parquet and read again; what a stage has used is deleted after it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with tidied() as keep:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep(docs)
        if before is not None:
            discard(before)
        before = docs
    return docs
