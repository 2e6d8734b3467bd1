"""Every query that has SQL gives the SQL's rows, on the smallest tables."""

import os

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {name: f for name, f in __spark_entry__.queries().items() if not name.startswith("op") and name != "pipeline"}
SQL = {name: sql for name, sql in __spark_entry__.oracle_sql().items() if name in QUERIES}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(rows):
    flat = lambda x: round(x, 6) if isinstance(x, float) else x if x is None or isinstance(x, (int, bool, str)) else str(x)
    return sorted((tuple(map(flat, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({SQL[name]}) q").fetchall()
    assert plain(df.select(*columns).collect()) == plain(expected)
