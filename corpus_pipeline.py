"""A training corpus from `documents` in four stages: language, near duplicates, repeated passages, packing.

Each stage is one operator of tidewake.llm on all that the stage before kept; run() writes each result as Parquet in the
shared folder and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import langid, packing, recompression, simhash
from tidewake.llm.common import Work, table

#: Documents whose language has a lower probability are rejected: no language stands out in them.
LEAST_SCORE = 0.4
VOCABULARY = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or without a language that stands out; fills in a missing lang."""
    return langid.accepted(docs, langid.fitted(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays: that with the smallest doc_id."""
    return simhash.keep_one(docs, size=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 20 words and more that an earlier document, or place, has; a document that is left empty goes."""
    return recompression.without_repeats(docs, window=20).filter(F.coalesce(F.col("text"), F.lit("")).rlike("[^ \\t-\\r]"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids: a row for each piece of a document."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packed", packed)]

#: SQL has neither the network nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    work, docs = Work(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
