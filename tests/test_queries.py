import pytest

from docgrain.plans import registry
from oracle import same

QUERIES, SQL = registry.queries(fixed=True), registry.oracle_sql(fixed=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    same(spark, small, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_flagship(spark, small):
    assert registry.flagship(spark, small).count() > 0


def test_registered_queries_read_tables(spark):
    assert set(QUERIES) - set(registry.queries()) == set(registry.FIXED)
    for query in registry.queries().values():
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
            query(spark, "/nowhere").collect()
