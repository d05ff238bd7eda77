"""Every registered query runs, and equals its SQL where it has one."""

from __future__ import annotations

import pytest

import lexitab.plans.all  # noqa: F401
from lexitab.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, small, duck):
    assert_same(QUERIES[name](spark, small), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs_the_same_twice(name, spark, small):
    first = sorted(map(str, QUERIES[name](spark, small).collect()))
    assert first and first == sorted(map(str, QUERIES[name](spark, small).repartition(3).collect()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
