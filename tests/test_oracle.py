"""Every registered query against its SQL oracle on the smallest driver tables."""

import os

import pytest
from oracle import compare, connect

from tallyforge.catalog import Tables, load

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REGISTRY = load()


@pytest.fixture(scope="session")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, name):
    entry = REGISTRY[name]
    df = entry.run(Tables(spark, FOLDER))
    if entry.sql is None:
        assert df.count() > 0
    else:
        assert compare(df, duck, entry.sql) is None
