"""Every registered query against its SQL at the smallest scale; the rest must return rows."""

import pytest

import oracle
from reachworks.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("slug", sorted(catalog.ORACLE))
def test_matches_sql(spark, con, slug):
    assert oracle.compare(spark, con, FOLDER, catalog.QUERIES[slug], catalog.ORACLE[slug]) is None


@pytest.mark.parametrize("slug", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_returns_rows(spark, slug):
    assert not catalog.QUERIES[slug](spark, FOLDER).isEmpty()


def test_contract(spark):
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
