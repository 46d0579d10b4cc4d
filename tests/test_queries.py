"""Every registered query against its SQL on a small copy of the tables."""

import pytest

import checks
from checks.compare import difference

QUERIES, SQL = checks.queries(), checks.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, name):
    assert difference(spark, sf_dir, QUERIES[name], SQL[name]) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
