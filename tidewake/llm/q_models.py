"""Queries of trained models: language identification and main text of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import html_text, langid
from tidewake.llm.common import table


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, trees = table(spark, sf_dir, "pages"), html_text.fitted(table(spark, sf_dir, "pages"))
    renamed = pages.withColumn("key", F.struct("page_id", "url"))
    found = html_text.extract(renamed, trees, "key")
    return found.select("key.page_id", "key.url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fitted(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_html": op2_html, "op4_langid": op4_langid}
