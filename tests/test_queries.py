"""Every registered query against its SQL, on the smallest tables."""

import pytest
from check_oracles import compare, connect

from __spark_entry__ import entry
from bindings import ORACLES, QUERIES

ROWS_ONLY: set[str] = set()
# Nothing to show on tables this small.
MAY_BE_EMPTY = set()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = connect(sf_dir)
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, sf_dir, name):
    problem = compare(spark, db, sf_dir, name)
    assert problem is None or (problem == "no rows" and name in MAY_BE_EMPTY)


def test_entry(spark, sf_dir):
    assert entry(spark).count() > 0
