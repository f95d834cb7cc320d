import pytest

from graphloom.llm import queries

from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(same_as_sql, name):
    same_as_sql(name)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert queries.queries()[name](spark, DATA).count() >= 0
