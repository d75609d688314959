"""Every registered query that has an SQL twin, against DuckDB on the smallest tables."""

import pytest
from compare import compare

import __spark_entry__ as entry_module

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, duck, sf, key):
    ok, message = compare(spark, duck, key, QUERIES[key], ORACLES[key], sf)
    assert ok, message


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_no_oracle_without_query():
    assert set(ORACLES) <= set(QUERIES)
