"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.check import compare

NAMES = list(entry.queries())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, duck, base):
    ok, text = compare(spark, duck, base, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).count() > 0
