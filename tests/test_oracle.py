"""Every registered query against its SQL, on the smallest data."""

import os

import oracle
import pytest

from __spark_entry__ import entry
from twinledger.catalog import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", list(queries()))
def test_same_result(spark, duck, name):
    assert oracle.compare(spark, duck, FOLDER, queries()[name], oracle_sql()[name]) == ""


def test_entry(spark):
    assert entry(spark).count() == 1500
