"""Hard negatives against brute force."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as H
from tessera.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"
WILD = float("inf")


def brute(rows, every=5, positives=5, negatives=3):
    """Result rows in plain Python, from rows in any order."""
    live = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], lab) for i, v, lab in rows
            if i is not None and v is not None and lab is not None
            and all(x is not None and np.isfinite(x) for x in v)]
    first = {}
    for i, v, lab in sorted(live, key=lambda r: (r[0], r[2], r[1])):
        if i % every == 0:
            first.setdefault(i, (v, lab))
    out = []
    for a, (va, la) in first.items():
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, lab == la)  # noqa: B905
                        for i, v, lab in live if i != a)
        for s, i, _ in [x for x in scored if x[2]][:positives]:
            s = -s
            inside = [x for x in scored if not x[2] and 50 * s <= -100 * x[0] <= 95 * s]
            out += [(a, i, k, j, s, -t) for k, (t, j, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def awkward_vectors(seed, n=400, dims=6):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, -0.1, 0.0, 0.1, 0.3, 0.5, 0.7]) for _ in range(dims)],
             rng.randrange(3)) for i in range(n)]
    rows += [(n + i, rows[5][1], rng.randrange(3)) for i in range(60)]  # a common vector
    rows += [rows[7], rows[7], (10, rows[3][1], 2), (15, None, 1), (20, [0.1, None], 1),
             (1001, [0.1] * dims, None), (1002, [WILD] * dims, 1), (1003, [float("nan")], 1),
             (1005, [], 1), (1010, [0.5], 0), (None, [0.5] * dims, 1), (-5, [0.3] * dims, 1),
             (1015, [-0.5] * dims, 77), (1020, [0.0] * dims, 2)]
    rng.shuffle(rows)
    return rows


def mined(spark, rows, **settings):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns(
        {c: F.lit("x") for c in ("id", "score", "anchor", "is_anchor", "key", "vector")})
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % 5 == 0, **settings).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = awkward_vectors(seed)
    want = brute(rows)
    assert len(want) > 500 and {r[2] for r in want} == {1, 2, 3}
    assert mined(spark, rows) == want


def test_blocks_change_nothing(spark):
    rows = [r for r in awkward_vectors(3) if r[0] != 1005]
    pack = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
         pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["a", "b", "c"])
    for size in (1, 50, 10_000):
        got = list(H._blocks([pack.slice(k, 37) for k in range(0, len(rows), 37)], 256, size))
        assert sum(len(b) for b in got) == len([r for r in rows if r[0] is not None and r[1] is not None
            and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1])])
        for b in got:
            assert (np.diff(b.ids) >= 0).all() and len(b.labels) == len(b.vectors)


def test_keys_sort_as_numbers():
    rng = random.Random(4)
    told = [(rng.randrange(-9, 9), rng.choice([-(1 << 62), -3, 0, 5, 1 << 62]), rng.randrange(2),
             rng.randrange(-(1 << 63), 1 << 63)) for _ in range(300)]
    keys = [k for a, s, kind, i in told
            for k in H._pack(np.array([a]), np.array([s]), kind, np.array([i])).to_pylist()]
    assert [H._unpack(k) for k in keys] == told
    assert [H._unpack(k) for k in sorted(keys)] == sorted(told, key=lambda t: (t[0], -t[1], t[2], t[3]))


def test_large_components_and_no_rows(spark):
    rows = [(5, [5e6, 1.0], 1), (1, [5e6, 2.0], 1), (2, [4e6, 1.0], 0), (3, [4e6, 3.0], 0)]
    assert mined(spark, rows) == brute(rows) != []
    with pytest.raises(Exception, match="64 bits|too big|too large"):
        mined(spark, [(5, [1e30], 1), (1, [1e30], 1), (2, [1e30], 0)])
    assert mined(spark, [(1, [0.5], 1)]) == []
    assert spark.createDataFrame([], SCHEMA).transform(
        lambda d: H.mine(d, F.col("vec_id") % 5 == 0)).collect() == []
    with pytest.raises(ValueError, match="windows"):
        H.mine(spark.createDataFrame([], SCHEMA), F.lit(True), upper=101)


def test_query_matches_sql(spark):
    got = sorted(tuple(r) for r in QUERIES["op13_hard_negatives"](spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = sorted(con.execute(SQL["op13_hard_negatives"]).fetchall())
    assert got == want and len(got) > 100
