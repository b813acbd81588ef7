"""Every registered query that SQL can say, next to its SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import compare, connect


@pytest.fixture(scope="module")
def con(base):
    return connect(base)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, base, con, name):
    df = queries()[name](spark, base)
    assert compare(df.columns, df.collect(), con, oracle_sql()[name]) == []


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
