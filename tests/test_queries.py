"""Every registered query against its SQL on the same tables."""

import duckdb
import oracle
import pytest
from conftest import SF_DIR

import __spark_entry__ as contract

# The corpus operators have tests of their own.
QUERIES = {n: q for n, q in contract.queries().items() if n != "pipeline" and not n.startswith("op")}
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def sql() -> duckdb.DuckDBPyConnection:
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLES)
    assert set(ORACLES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    columns, found = oracle.spark_rows(QUERIES[name](spark, SF_DIR))
    assert found
    assert (columns, found) == oracle.sql_rows(sql, ORACLES[name])


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["avg_page_rank"]
    assert result.count() == 1
