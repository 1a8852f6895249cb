"""Every registered query against its SQL in DuckDB (and a rows check where there is none)."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import compare, connect

# Many model fits each: run with `-m slow`; the driver runs them at every round.
SLOW = {"single_level_scores", "two_level_scores"}


@pytest.fixture(scope="session")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize(
    "name", [pytest.param(n, marks=pytest.mark.slow) if n in SLOW else n for n in queries()])
def test_query_matches_oracle(spark, con, sf_dir, name):
    ok, note = compare(spark, con, sf_dir, name, queries()[name], oracle_sql().get(name))
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
