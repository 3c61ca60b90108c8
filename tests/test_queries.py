"""Every registered query of the engine proper against its SQL, over whole small tables."""

import pytest

from tests import oracle
from tidecurve.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, duck, name):
    ours, theirs = QUERIES[name](spark, sf), duck.sql(SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert oracle.rows(ours.columns, ours.collect()) == oracle.rows(theirs.columns, theirs.fetchall())
