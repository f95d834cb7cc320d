import glob
import math
import os

import duckdb
import pytest

from graphloom.session import local_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=2, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Checks a named query against its SQL on the smallest test tables."""
    import __spark_entry__ as entry_points

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")

    def plain(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else round(value, 5) + 0.0
        return value

    def check(name):
        df = entry_points.queries()[name](spark, DATA)
        names = sorted(df.columns)
        rows = df.select(*names).collect()
        answer = con.execute(entry_points.oracle_sql()[name])
        found = [d[0] for d in answer.description]
        assert sorted(found) == names
        order = [found.index(c) for c in names]
        expected = [tuple(plain(r[i]) for i in order) for r in answer.fetchall()]
        assert sorted(map(repr, (tuple(map(plain, r)) for r in rows))) == sorted(map(repr, expected))

    return check


@pytest.fixture
def rows_of():
    """A DataFrame's rows as a sorted list of tuples."""

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return rows
