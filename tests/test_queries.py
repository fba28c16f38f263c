"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as contract
from checks import queries as checks_queries
from checks.compare import difference, duck

#: trained models: held against plain training in test_cues.py
NO_SQL = {"learned_requests"}
QUERIES, SQL = {name: contract.queries()[name] for name in checks_queries.QUERIES}, contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) - NO_SQL <= set(SQL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NO_SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    what, _ = difference(spark, name, QUERIES[name], SQL[name], con, sf_dir)
    assert what is None


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert sorted(row["rank"] for row in rows) == list(range(1, len(rows) + 1))
