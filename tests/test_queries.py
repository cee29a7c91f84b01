"""Each query with SQL, run by Spark and by DuckDB on the smallest tables, must give the same rows."""

import glob
import os

import duckdb
import pytest

from pixelloom.plans import decode_queries, file_queries, queries, stream_queries

SF = "/root/testdata/sf0.001"
QUERIES = {**queries.QUERIES, **decode_queries.QUERIES, **file_queries.QUERIES, **stream_queries.QUERIES}
ORACLES = {**queries.ORACLES, **decode_queries.ORACLES, **file_queries.ORACLES, **stream_queries.ORACLES}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in want.fetchall())
    assert rows == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


def test_every_codec_is_told(spark):
    rows = QUERIES["decode_each_codec"](spark, SF).collect()
    assert len(rows) == len(queries.HEADERS) and {r["codec"] for r in rows if r["codec"]} == {n for n, _, _ in queries.HEADERS if n}
    assert all(r["ok"] == (r["width"] is not None) for r in rows)
