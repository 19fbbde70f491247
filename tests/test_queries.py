"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from geoloom.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    ours = QUERIES[name](spark, DATA)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(ours.columns) == sorted(names)
    theirs = [tuple(map(plain, r)) for r in result.fetchall()]
    mine = [tuple(plain(r[c]) for c in names) for r in ours.collect()]
    assert sorted(mine, key=repr) == sorted(theirs, key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_without_llm(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "name", "country", "completeness"]
