from __future__ import annotations

import pytest

from skillstrata.llm.common import workers_find_package

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm_spark(spark):
    workers_find_package(spark)
    return spark


@pytest.fixture(scope="session")
def documents(llm_spark):
    """The rows of the small documents table as Python values."""
    return {r.doc_id: r for r in llm_spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture
def odd(llm_spark):
    """Documents with NULLs, empty and long texts, repeated rows and columns whose names clash with outputs."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, "one two three four", "a", 5),
        (1, "one two three four", "a", 5),
        (2, None, None, None),
        (3, "", "b", 5),
        (4, " \t\n\r ", "a", 5),
        (None, "Some text without an id", "b", 5),
        (5, long, "b", 5),
        (6, "word", None, 5),
    ]
    schema = "doc_id long, text string, source string, n long"
    extra = ("kept", "n_words", "fp", "ids", "n_tokens", "n_lines", "_gone", "n_entities", "size", "fields")
    from pyspark.sql import functions as F

    return llm_spark.createDataFrame(rows, schema).withColumns({name: F.lit("clash") for name in extra})


@pytest.fixture
def none(llm_spark):
    return llm_spark.createDataFrame([], "doc_id long, text string, source string")
