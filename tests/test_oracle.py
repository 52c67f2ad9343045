"""Every registered query against its SQL on the same tables."""

import pytest

import __spark_entry__ as contract
import oracle

SF = f"{oracle.TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert oracle.compare(contract.queries()[name](spark, SF), con, contract.oracle_sql()[name]) == ""


def test_entry(spark):
    assert contract.entry(spark).columns == ["metric", "n", "mean", "std", "median", "min", "max"]


def test_every_oracle_names_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
