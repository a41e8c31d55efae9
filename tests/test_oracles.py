"""Every registered query against its SQL on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from check_oracles import compare, views

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


# Training-data queries have their tests beside their operators.
OWN = [name for name in entry.queries() if not re.match(r"op\d+_|pipeline$", name)]


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    rows, same, got, want = compare(spark, con, FOLDER, name)
    assert rows > 0
    assert same in (True, None)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
