"""Every registered query against its SQL on the smallest tables; those without SQL give rows."""

import pytest

from dossier.plans import catalog
from tests.compare import assert_same, connect

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf, con, name):
    assert_same(QUERIES[name](spark, sf), con, ORACLE[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() > 0
