"""Every registered query with an oracle matches DuckDB at sf0.01."""

import pytest

from conftest import SF01
from oracle_compare import compare, duck

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_oracle(spark, con, name):
    r = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SF01, con)
    assert r["ok"], r


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
