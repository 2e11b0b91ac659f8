"""Every catalog query with a SQL counterpart gives the same rows, types included."""

import pytest

from compare import compare, connect
from srcloom.plans.catalog import CATALOG
from srcloom.plans.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    assert compare(spark, db, CATALOG[name], ORACLES[name], SF_DIR) == []


# Approximate search has no SQL; tests/test_tables.py holds it against exact search.
WITHOUT_SQL = {"vector_buckets"}


def test_every_query_has_sql():
    assert set(CATALOG) == set(ORACLES) | WITHOUT_SQL


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["file_path", "function_count", "total_tokens"] and rows.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
