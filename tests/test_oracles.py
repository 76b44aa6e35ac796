"""Every registered query against its SQL on the given tables."""

import pytest

import __spark_entry__ as registered
from check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registered.CORE))
def test_query_equals_sql(spark, duck, name):
    difference = compare(registered.queries()[name](spark, SF_DIR), duck, registered.oracle_sql()[name])
    assert difference is None, difference


def test_every_query_has_sql():
    assert set(registered.CORE) <= set(registered.oracle_sql()) <= set(registered.queries())


def test_entry(spark):
    df = registered.entry(spark)
    assert df.columns == ["key", "value"] and df.count() == 5
