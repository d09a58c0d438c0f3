"""Every registered query against its SQL at the smallest scale."""

import importlib

import duckdb
import pytest

from checks.compare import compare
from checks.views import TABLES

SF_DIR = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")


@pytest.fixture(scope="module")
def connection():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


# All documents have a vector at this scale, so nothing is pending.
EMPTY = {"pending_oldest"}


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, connection, name):
    report = compare(spark, connection, SF_DIR, name)
    if name in EMPTY and not report.startswith("OK"):
        assert entry.queries()[name](spark, SF_DIR).isEmpty() and not connection.execute(entry.oracle_sql()[name]).fetchall()
        return
    assert report.startswith(("OK", "ROWS")), report


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
