"""Every query that has SQL gives the rows of that SQL in DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__

CASES = [(m, name) for m in __spark_entry__.REFERENCE for name in m.SQL]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_query_matches_sql(spark, duck, sf, module, name):
    df = module.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = duck.execute(module.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in at) for r in cur.fetchall()]
    assert ordered(df.select(*cols).collect()) == ordered(want)
