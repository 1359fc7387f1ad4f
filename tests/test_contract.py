"""Every registered query against its expected SQL on the smallest test folder."""

import os

import pytest

import __spark_entry__ as contract
from tools.compare import differences

FOLDER = "/root/testdata/sf0.001"
# Queries that an optional package registers are tested beside it.
OPTIONAL = set(contract.text_operators.QUERIES) | {"pipeline"} if contract.text_operators else set()
QUERIES = [key for key in contract.queries() if key not in OPTIONAL]


def test_every_query_has_expected_sql():
    assert set(QUERIES) == set(contract.oracle_sql()) - OPTIONAL


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
@pytest.mark.parametrize("key", QUERIES)
def test_query(spark, key):
    assert differences(spark, FOLDER, key) == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
def test_entry(spark):
    assert contract.entry(spark).count() > 0
