"""Every query beside its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import UNCOMPARED, compare

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 80


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_beside_its_sql(spark, small, name):
    bad, _ = compare(spark, small, name, QUERIES[name], SQL[name])
    assert bad is None, bad


@pytest.mark.parametrize("name", sorted({*QUERIES} - {*SQL}))
def test_query_runs(spark, small, name):
    """Queries that SQL can't express: here only that they run; their results are held against brute force elsewhere."""
    assert compare(spark, small, name, QUERIES[name], None)[0] == UNCOMPARED


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score", "matched", "rank"]
