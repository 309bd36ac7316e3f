"""Every query with SQL gives the same rows as DuckDB on the smallest tables; the others give rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from tessera.plans import workloads

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = workloads.queries(), workloads.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v + 0.0, 9))
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(str([norm(v) for v in r]) for r in df.select(*cols).collect())
    res = con.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(str([norm(r[i]) for i in at]) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_without_sql(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["series_id", "window_idx", "mean_value", "risk"] and out.count() > 0
    assert set(ORACLE) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
