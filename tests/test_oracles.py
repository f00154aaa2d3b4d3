import pytest

import framelode.plans  # noqa: F401
from framelode.plans import registry
from tests.oracle import connect, differs

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_are_those_of_the_sql(spark, db, name):
    assert differs(registry.queries()[name](spark, SMALL), registry.oracle_sql()[name], db) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_queries_without_sql_give_rows(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0
