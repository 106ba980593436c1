"""Driver contract: entry(), queries() and their SQL twins (DuckDB) on sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tessera.plans.registered import QUERIES, SQL
from tessera.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["period", "rank", "naic", "company", "value"]


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) and set(QUERIES) <= set(E.queries())
    assert set(SQL) <= set(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(rows):
    out = []
    for r in rows:
        vals = []
        for v in r:
            if isinstance(v, float):
                vals.append(None if math.isnan(v) else round(v, 6))
            elif isinstance(v, int) and not isinstance(v, bool):
                vals.append(float(v))
            else:
                vals.append(v)
        out.append(tuple(vals))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    sp = E.queries()[name](spark, SF)
    cols = sorted(sp.columns)
    got = norm(tuple(r[c] for c in cols) for r in sp.collect())
    res = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    want = norm(tuple(r[i] for i in idx) for r in res.fetchall())
    assert got == want
