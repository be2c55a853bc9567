"""Queries on token ids: packing, BPE encoding and decoding, and Elias-Fano shards."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewake.llm import bpe, eliasfano, packing
from tidewake.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eliasfano.boundaries(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


QUERIES = {"op5_packing": op5_packing, "op7_bpe": op7_bpe, "op10_elias_fano": op10_elias_fano}
