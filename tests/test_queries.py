import pytest

import __spark_entry__ as entry_points
from graphloom.plans import general, reference

SQL = reference.oracle_sql() | general.oracle_sql()
# the rows do not depend on the order, which test_enrichment covers
ORDERS = {f"term_rank_table_{s}_{by}" for s, by in reference.TABLES if by != "max"}


@pytest.mark.parametrize("name", sorted(set(SQL) - ORDERS))
def test_query_matches_sql(same_as_sql, name):
    same_as_sql(name)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry_points.queries())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == [
        "term_id",
        "p_value",
        "z_score",
        "lambda",
        "observed_edges",
        "log2_Anscombe",
        "log2_RelChange",
    ]
    assert df.count() == 10
