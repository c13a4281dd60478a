"""Every registered query runs; those with SQL agree with it."""

from __future__ import annotations

import pytest

import stemma.queries  # noqa: F401
from stemma.catalog import ORACLE, QUERIES

from .oracle import connect, same_rows


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE:
        same_rows(df, con, ORACLE[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(ORACLE) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
