"""Every query with SQL returns DuckDB's rows on the smallest tables."""

import os
from glob import glob

import duckdb
import pytest

from cartulary.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(rows):
    one = lambda v: round(float(v), 5) if isinstance(v, float) else v
    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, tables, name):
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = tables.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalog.SQL[name]})").fetchall()
    assert plain(map(tuple, got.select(columns).collect())) == plain(want)
