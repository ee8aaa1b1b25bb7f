"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from harness.catalog import QUERIES
from harness.oracle import ORACLE_SQL
from tests.compare import SF_DIR, connect, difference


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["role", "skill", "postings"]
    assert df.count() == 15


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert difference(spark, duck, name, QUERIES[name], ORACLE_SQL[name], SF_DIR) is None
