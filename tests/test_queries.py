"""Every query with SQL gives the SQL's rows."""

import glob
import os

import duckdb
import pytest

from plumaria.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(found, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in at)) for r in found)


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    cur = con.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(cur.fetchall(), names)
