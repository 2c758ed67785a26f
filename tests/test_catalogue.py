"""Every query of the catalogue against its SQL on the smallest tables."""

from pathlib import Path

import pytest
from compare import connect, difference

import __spark_entry__ as contract
from folioscope import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables not present")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


catalogue.load_all()


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_equals_its_sql(spark, db, name):
    assert difference(catalogue.QUERIES[name](spark, FOLDER), db, catalogue.SQL[name]) is None


def test_the_contract_has_the_whole_catalogue():
    assert set(catalogue.QUERIES) <= set(contract.queries()) and set(catalogue.SQL) <= set(contract.oracle_sql())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
