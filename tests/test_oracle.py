"""Every registered query agrees with its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from compare import compare, database

from snapdrift import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, con, name):
    got, want, diff = compare(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], FOLDER)
    assert not diff
    assert got, "a query that finds nothing checks nothing"


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
