from __future__ import annotations

import pytest
from pyspark.sql import functions as F

LONG = "word" * 3 + " longer " * 9000 + "z" * 5000


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that tables should not have: nulls in every column, empty and long texts, repeats, and
    columns whose names clash with those of the operators."""
    rows = [(1, "the first text of all, with some words in it"), (2, None), (3, ""), (4, "   \n "),
            (None, "a text without an id"), (None, None), (5, LONG), (6, LONG),
            (7, "the first text of all, with some words in it"),
            (7, "the first text of all, with some words in it"), (8, "é ñ   日本語 \x00 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("score", "fp", "key", "found", "spans", "chunk", "token_ids", "label", "block",
                 "source", "lang"):
        df = df.withColumn(name, F.lit("clash" if name != "source" else None).cast("string"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
