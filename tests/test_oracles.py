"""Every query with SQL agrees with DuckDB on the smallest tables; the others run."""

import glob
import math

import duckdb
import pytest

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()
CORE = [n for n in entry.queries() if n in ORACLE]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    try:
        return float(f"{float(v):.6g}")
    except (TypeError, ValueError):
        return str(v)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", CORE)
def test_matches_sql(spark, data, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {p.rsplit('/', 1)[1][:-8]} as select * from '{p}'")
    df = entry.queries()[name](spark, data)
    got, want = df.collect(), con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_entry(spark, monkeypatch, data):
    monkeypatch.setenv("TIDEMARK_ENTRY_DIR", data)
    assert entry.entry(spark).columns


def test_names_agree():
    assert set(ORACLE) <= set(entry.queries())
