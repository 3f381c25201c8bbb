"""Every registered query against its SQL, and the driver contract."""

import pytest

import __spark_entry__ as entry_module
from checks.compare import connect, differences
from checks.oracle import ORACLE
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, db, sf, name):
    rows, notes = differences(spark, db, name, sf)
    assert not notes


def test_contract(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) - set(ORACLE) == set()
    assert entry_module.entry(spark).count() > 0
