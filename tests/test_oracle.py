"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle import compare, connect

from sparkprep.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, name, FOLDER, QUERIES, ORACLES) is None
