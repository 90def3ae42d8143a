"""Every registered query against its SQL in DuckDB, and the contract file."""

import pytest

import __spark_entry__ as contract
from checks.compare import compare
from checks.oracle_sql import ORACLE
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equal_to_sql(spark, name):
    problem, _, _ = compare(spark, SF, name, QUERIES[name], ORACLE[name])
    assert problem == ""


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.count() > 0 and frame.columns[0] == "vendedor_limpio"


def test_same_keys():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
