from __future__ import annotations

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        # names that the operators use themselves
        StructField("score", StringType()),
        StructField("print", StringType()),
        StructField("key", StringType()),
    ]
)


@pytest.fixture
def documents(spark):
    """Builds a documents table with extra columns from (doc_id, text, lang) rows."""

    def build(rows):
        full = [(i, t, lang, "s", None if t is None else len(t), "x", "y", "z") for i, t, lang in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return build


HARD = [
    (None, None, None),
    (1, None, "en"),
    (2, "", None),
    (3, " \t\n", "en"),
    (4, "a", "en"),
    (4, "a", "en"),
    (5, "12345 !!!", "en"),
    (6, "word " * 40_000, "en"),
    (None, "a row without an id, of several words", "en"),
]


@pytest.fixture
def hard_documents(documents):
    """Nulls, empty and very long texts, repeated rows."""
    return documents(HARD)


@pytest.fixture
def no_documents(documents):
    return documents([])
