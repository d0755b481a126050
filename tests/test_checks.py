"""Every registered query against its SQL on the smallest data set."""

import pytest
from compare import compare, duck

from logquarry.catalog import CHECKS, QUERIES

SLOW = {"train_importance"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, sf, name):
    ok, rows, _, note = compare(spark, con, name, sf, QUERIES, CHECKS)
    assert ok, note
    assert rows >= 0


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.count() == 17
    assert "issue_category" in out.columns
