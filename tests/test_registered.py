"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry_point

CALLS, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(CALLS)


@pytest.mark.parametrize("name", list(CALLS))
def test_query_matches_sql(spark, con, sf_dir, name):
    rows, same, _, note = compare(spark, con, name, CALLS[name], SQL.get(name), sf_dir)
    assert same is not False, note
    if SQL.get(name) is None:
        assert rows >= 0


def test_entry(spark):
    result = entry_point.entry(spark)
    assert result.columns == ["hourBucket", "status", "cnt", "zscore"]
    assert result.count() > 0
