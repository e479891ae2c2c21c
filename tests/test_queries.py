"""Every query runs; those with SQL agree with DuckDB."""

import pytest

from flatewise import queries as Q

from .conftest import SF


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_agrees_with_sql(name, same_as_sql):
    same_as_sql(Q.QUERIES[name], Q.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(Q.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
