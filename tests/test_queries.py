"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from kindstore.catalog import ORACLES, QUERIES
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, name):
    assert compare(spark, name, FOLDER) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
