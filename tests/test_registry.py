"""Every registered query against its oracle, at the smallest scale."""

import pytest

import __spark_entry__ as contract
from check import compare
from registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ok, text = compare(spark, SF, name)
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
