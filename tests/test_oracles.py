"""Every registered query against its SQL oracle at the smallest scale."""

import pytest

import __spark_entry__
from checks import catalog
from checks.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_oracle(spark, connection, name):
    good, note = compare(spark, connection, SF_DIR, name)
    assert good, note
