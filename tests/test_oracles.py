"""Every query with SQL gives that SQL's rows."""

import pytest
from compare import assert_same
from corpusloom.index_queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_registry_has_sql_only_for_registered_queries():
    import __spark_entry__ as registry

    assert set(registry.oracle_sql()) <= set(registry.queries())
