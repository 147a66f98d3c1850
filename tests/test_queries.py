"""Every registered query with SQL against DuckDB on the smallest tables; the others for rows."""

import glob
import os

import duckdb
import pytest

from seqlake.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if x is None:
        return "null"
    if isinstance(x, float):
        return "null" if x != x else f"{x:.5g}"
    return str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = [r.asDict() for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    key = sorted(columns)
    want = sorted(tuple(plain(float(dict(zip(columns, r))[c]) if str(type(dict(zip(columns, r))[c])).find("Decimal") > 0 else dict(zip(columns, r))[c]) for c in key) for r in cur.fetchall())
    got = sorted(tuple(plain(float(r[c]) if str(type(r[c])).find("Decimal") > 0 else r[c]) for c in key) for r in rows)
    # Whole numbers may come as floats on one side.
    tidy = lambda rows: [tuple(v[:-2] if v.endswith(".0") else v for v in r) for r in rows]
    assert tidy(got) == tidy(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_reads_given_tables(spark, name):
    files = QUERIES[name](spark, DATA).inputFiles()
    assert files and all(DATA in f for f in files)
