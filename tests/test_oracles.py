import pytest

from folioscope.plans import catalog

from .compare import engine, same


@pytest.fixture(scope="module")
def con():
    return engine()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    same(spark, con, catalog.queries()[name], catalog.oracle_sql()[name])
