"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests import harness

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return harness.connect(SF)


@pytest.mark.parametrize("key", list(entry.queries()))
def test_query_equals_sql(spark, con, key):
    ok, note = harness.compare(spark, key, SF, con)
    assert ok, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
