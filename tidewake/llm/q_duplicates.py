"""Queries on duplicates: SimHash classes and repeated word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import recompression, simhash
from tidewake.llm.common import table

WINDOW = 20


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.similar_classes(table(spark, sf_dir, "documents"), size=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.marked(table(spark, sf_dir, "documents"), WINDOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in recompression.sliced(batches):
            kept = [recompression.kept_words(text, spans, WINDOW) for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            n = pa.array([n for _, n in kept], pa.int64())
            removed = pa.array([n - len(x) for x, n in kept], pa.int64())
            digest = pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x, _ in kept], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, removed, digest], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return found.select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


QUERIES = {"op6_recompression": op6_recompression, "op9_simhash": op9_simhash}
