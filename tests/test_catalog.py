"""Every registered query: same rows as its SQL twin, or rows with a stable schema."""

import pytest

import __spark_entry__ as entry_point
from tests.oracle import compare, connect

QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, connection, name):
    assert compare(QUERIES[name](spark, sf_dir), connection, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert {r["metric"] for r in entry_point.entry(spark).collect()} >= {"accuracy", "auc_roc"}


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
