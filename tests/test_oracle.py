"""Every registered query against its SQL in DuckDB."""

import pytest

from checks.compare import connect, mismatch
from checks.oracles import oracle_sql
from checks.queries import queries

QUERIES = queries()
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    assert mismatch(QUERIES[name](spark, sf_dir), con.sql(SQL[name])) is None


def test_entry(spark):
    import __spark_entry__
    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "column" and df.count() == 8
