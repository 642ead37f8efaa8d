"""Every query of the plans over the smallest tables, held against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from spanforge import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", plans.QUERIES)
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in plans.ORACLE_SQL:
        answer = duck.sql(plans.ORACLE_SQL[name])
        assert sorted(answer.columns) == columns
        want = sorted((tuple(plain(dict(zip(answer.columns, r, strict=True))[c]) for c in columns) for r in answer.fetchall()), key=repr)
        assert got == want
