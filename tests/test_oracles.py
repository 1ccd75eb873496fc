"""Every query that has SQL equals it on the smallest tables; every other one runs."""

import oracle
import pytest

from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert oracle.difference(QUERIES[name](spark, SF), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and df.schema == QUERIES[name](spark, SF).schema


def test_entry_without_training_operators(spark):
    """The entry works from the core alone."""
    assert QUERIES["grpo_advantage"](spark, SF).count() > 0
    assert not [n for n in QUERIES if n.startswith("p1_")]
