"""The training-data queries against their SQL on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from check_oracles import compare, views

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


@pytest.mark.parametrize("name", [name for name in entry.oracle_sql() if re.match(r"op\d+_", name)])
def test_query(spark, con, name):
    rows, same, _, _ = compare(spark, con, FOLDER, name)
    assert rows > 0 and same
