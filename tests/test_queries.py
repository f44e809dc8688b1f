"""Every registered query: stable schema, and equal to its SQL twin where it has one."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(tiny):
    return compare.connect(tiny)


def test_registry():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, duck, name):
    df = QUERIES[name](spark, tiny)
    got = compare.spark_rows(df)
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        assert compare.difference(got, compare.sql_rows(duck, ORACLES[name])) is None


def test_entry(spark, tiny):
    assert entry.entry(spark).count() > 0
