from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
SMALL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, ties, and columns with clashing names."""
    long_ = " ".join(f"w{k % 977}" for k in range(40_000))
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, "  \n\t ", "en", "a", 5), (4, "naïve café – 漢字 😀", "fr", "b", 18), (5, long_, "en", "b", len(long_)), (6, long_, None, "b", len(long_)), (7, "a b", "en", "a", 3), (7, "a b", "en", "a", 3), (None, "no id here", "en", "a", 10), (8, "x" * 5000, "de", "a", 5000), (9, "the same words again", "en", "c", 20), (10, "the same words again", "en", "c", 20), (11, "<|endoftext|> don't  stop", "en", "c", 25)]
    d = spark.createDataFrame(rows, SMALL)
    return d.selectExpr("*", "1 AS start", "'k' AS key", "2 AS value", "3 AS length", "'z' AS spans", "0 AS fp")
