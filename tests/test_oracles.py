import pytest

from foliowright.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, check):
    check(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
