import pytest

from clausewright.plans import registry

from .conftest import SF, same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    a, b = same(registry.QUERIES[name](spark, SF), duck, registry.ORACLE_SQL[name])
    assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
