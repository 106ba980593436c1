"""Views on small hand-made panels: null rules, ties, others, gaps, growth."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import ranking as R
from tessera.operators import series as S
from tessera.plans.viewspec import ViewSpec, resolve
from tessera.plans.views import snapshot_view

COLS = ("period string, naic string, company string, policy_type string, line string, "
        "is_wind_only boolean, pif double, tiv double, tiv_incl_wind double, dpw double, "
        "new_written double, received_in double, cancelled double, nonrenewed double, "
        "transferred_out double")
PL = "Personal Residential"


def panel(spark, rows):
    full = []
    for r in rows:
        d = {"period": "2024Q1", "naic": "1", "company": "C", "policy_type": PL + " - X",
             "line": PL, "is_wind_only": False, "pif": None, "tiv": None,
             "tiv_incl_wind": None, "dpw": None, "new_written": None, "received_in": None,
             "cancelled": None, "nonrenewed": None, "transferred_out": None}
        d.update(r)
        full.append(tuple(d.values()))
    return spark.createDataFrame(full, COLS)


def test_all_suppressed_entity_absent_from_rank_but_net_flow_zero(spark):
    p = panel(spark, [{"naic": "1", "tiv": 5.0, "new_written": 2.0},
                      {"naic": "2", "tiv": None}])
    rank = snapshot_view(p, ViewSpec(metric="tiv", period="2024Q1")).collect()
    assert [r.naic for r in rank] == ["1"]
    nf = {r.naic: r.value for r in snapshot_view(p, ViewSpec(metric="net_flow",
                                                             period="2024Q1")).collect()}
    assert nf == {"1": 2.0, "2": 0.0}


def test_zero_denominator_ratio_null(spark):
    p = panel(spark, [{"naic": "1", "pif": 0.0, "dpw": 5.0}, {"naic": "2", "pif": 2.0, "dpw": 5.0}])
    v = {r.naic: r.value for r in M.entity_values(p, "avg_premium").collect()}
    assert v == {"1": None, "2": 2.5}


def test_tie_order(spark):
    p = panel(spark, [{"naic": k, "tiv": 7.0} for k in ("00123", "10064", "9")])
    got = [(r.rank, r.naic) for r in snapshot_view(p, ViewSpec(metric="tiv", period="2024Q1"))
           .orderBy("rank").collect()]
    assert got == [(1, "9"), (2, "10064"), (3, "00123")]


def test_share_and_others(spark):
    p = panel(spark, [{"naic": str(i), "tiv": float(v)} for i, v in enumerate([50, 30, 15, 5])])
    rows = snapshot_view(p, ViewSpec(mode="share", metric="tiv", topn=2, period="2024Q1")).collect()
    by = {r.company if r.rank is None else r.naic: r for r in rows}
    assert by["0"].share == 0.5 and by["1"].share == 0.3
    assert by["All others"].value == 20.0 and by["All others"].share == 0.2
    assert by["All others"].naic is None
    assert sum(r.share for r in rows) == pytest.approx(1.0)


def test_no_others_row_when_tail_not_positive(spark):
    p = panel(spark, [{"naic": "1", "new_written": 10.0}, {"naic": "2", "new_written": 5.0},
                      {"naic": "3", "cancelled": 4.0}, {"naic": "4", "cancelled": 3.0}])
    rows = snapshot_view(p, ViewSpec(mode="share", metric="net_flow", topn=2,
                                     period="2024Q1")).collect()
    assert all(r.company != "All others" for r in rows) and len(rows) == 2


def test_ratio_metric_share_is_null(spark):
    p = panel(spark, [{"naic": "1", "dpw": 1.0, "tiv": 10.0}, {"naic": "2", "dpw": 3.0, "tiv": 10.0}])
    rows = snapshot_view(p, ViewSpec(mode="share", metric="rate_on_line", period="2024Q1")).collect()
    assert all(r.share is None for r in rows)
    tot = M.slice_totals(p, "rate_on_line").first().total
    assert tot == pytest.approx(0.2)


def test_others_of_a_ratio_metric_is_the_ratio_of_sums(spark):
    p = panel(spark, [{"naic": "1", "dpw": 8.0, "tiv": 10.0}, {"naic": "2", "dpw": 1.0, "tiv": 700.0},
                      {"naic": "3", "dpw": 0.00044, "tiv": 0.3}, {"naic": "4", "dpw": 2.0}])
    rows = snapshot_view(p, ViewSpec(mode="share", metric="rate_on_line", topn=1,
                                     period="2024Q1")).collect()
    assert [(r.naic, r.rank) for r in rows] == [("1", 1), (None, None)]
    assert rows[1].value == pytest.approx(3.00044 / 700.3)


def test_all_entities_and_order(spark):
    p = panel(spark, [{"naic": str(i), "tiv": float(i % 7), "period": f"2024Q{1 + i % 2}"}
                      for i in range(50)])
    rows = snapshot_view(p, ViewSpec(mode="share", metric="tiv", topn=None),
                         all_periods=True).collect()
    assert len(rows) == 50 and all(r.naic is not None for r in rows)
    assert [(r.period, r.rank) for r in rows] == sorted((r.period, r.rank) for r in rows)
    assert ViewSpec(topn=None).topn is None
    with pytest.raises(ValueError):
        ViewSpec(topn=0)


def test_selection_by_long_list_and_by_table(spark):
    from tessera.operators.slicing import select_entities
    p = panel(spark, [{"naic": str(i), "tiv": 1.0} for i in range(30)])
    keys = [str(i) for i in range(0, 6000, 3)]
    table = spark.createDataFrame([(k,) for k in keys], "k string")
    for chosen in (keys, table):
        assert {r.naic for r in select_entities(p, chosen).collect()} == {
            str(i) for i in range(0, 30, 3)}


def test_all_target_is_zero_in_an_empty_quarter(spark):
    p = panel(spark, [{"period": "2024Q1", "tiv": 10.0, "dpw": 1.0},
                      {"period": "2024Q3", "tiv": 5.0, "dpw": 1.0}])
    periods = spark.createDataFrame([(f"2024Q{q}",) for q in (3, 1, 2)], "period string")
    for basis in ("position", "calendar"):
        out = S.series(p, "tiv", "all", periods, "2024Q1", "2024Q3", transform="qoq", basis=basis)
        got = {r.period: (r.value, r.display) for r in out.collect()}
        assert got["2024Q2"] == (0.0, -100.0) and got["2024Q3"] == (5.0, None)
    ratio = S.series(p, "rate_on_line", "all", periods, "2024Q1", "2024Q3")
    assert {r.period: r.value for r in ratio.collect()}["2024Q2"] is None


def test_new_and_dropped(spark):
    p = panel(spark, [{"period": q, "naic": k, "tiv": 1.0} for q, k in
                      [("2023Q4", "a"), ("2024Q1", "a"), ("2024Q1", "b"), ("2024Q3", "a"),
                       ("2024Q3", "c")]])
    for periods in (["2023Q4", "2024Q1", "2024Q2", "2024Q3"],):
        got = sorted(tuple(r) for r in S.new_and_dropped(p, periods).select(
            "period", "naic", "change").collect())
        assert got == [("2024Q1", "b", "new"), ("2024Q2", "a", "dropped"), ("2024Q2", "b", "dropped"),
                       ("2024Q3", "a", "new"), ("2024Q3", "c", "new")]


def test_series_captions(spark):
    from tessera.plans.views import dataset_caption, series_captions
    p = panel(spark, [{"period": "2024Q1", "naic": "1", "dpw": 2.0, "tiv": 10.0},
                      {"period": "2024Q1", "naic": "2", "dpw": 4.0, "tiv": 20.0},
                      {"period": "2024Q2", "naic": "1", "dpw": 2.0}])
    spec = ViewSpec(mode="series", metric="dpw", period_from="2024Q2", period_to="2024Q1",
                    entities=("1",))
    assert {r.period: (r.carriers, r.slice_total) for r in series_captions(p, spec).collect()} == {
        "2024Q1": (1, 2.0), "2024Q2": (1, 2.0)}
    got = series_captions(p, spec.with_(metric="rate_on_line", entities=())).collect()
    assert {r.period: (r.carriers, r.slice_total) for r in got} == {
        "2024Q1": (2, pytest.approx(0.2)), "2024Q2": (0, None)}
    assert tuple(dataset_caption(p).first()) == ("2024Q1", "2024Q2", 2, 3, 2)


def test_gap_quarter_and_growth(spark):
    rows = [{"period": p, "naic": "1", "tiv": v} for p, v in
            [("2023Q1", 100.0), ("2023Q2", 110.0), ("2023Q4", 121.0), ("2024Q1", 0.0),
             ("2024Q2", 5.0)]]
    rows += [{"period": "2023Q3", "naic": "2", "tiv": 1.0}]
    p = panel(spark, rows)
    periods = ["2023Q1", "2023Q2", "2023Q3", "2023Q4", "2024Q1", "2024Q2"]
    out = S.series(p, "tiv", "all", periods, "2024Q2", "2023Q1", entities=["1"], transform="qoq")
    got = {r.period: (r.value, r.display) for r in out.collect()}
    assert got["2023Q2"][1] == pytest.approx(10.0)
    assert got["2023Q3"] == (None, None)       # gap: null value and null growth
    assert got["2023Q4"] == (121.0, None)      # and null growth the quarter after
    assert got["2024Q2"][1] is None            # zero base → null
    assert len(got) == 6                       # reversed range handled


def test_negative_base_growth(spark):
    rows = [{"period": "2024Q1", "naic": "1", "cancelled": 10.0},
            {"period": "2024Q2", "naic": "1", "new_written": 5.0}]
    p = panel(spark, rows)
    out = S.series(p, "net_flow", "all", ["2024Q1", "2024Q2"], "2024Q1", "2024Q2",
                   entities=["1"], transform="qoq")
    got = {r.period: r.display for r in out.collect()}
    assert got["2024Q2"] == pytest.approx(-150.0)


def test_calendar_basis_reads_before_range(spark):
    rows = [{"period": p, "naic": "1", "tiv": v} for p, v in
            [("2023Q1", 100.0), ("2023Q2", 50.0), ("2024Q1", 150.0), ("2024Q2", 75.0)]]
    p = panel(spark, rows)
    periods = ["2023Q1", "2023Q2", "2024Q1", "2024Q2"]
    pos = S.series(p, "tiv", "all", periods, "2024Q1", "2024Q2", entities=["1"],
                   transform="yoy")
    cal = S.series(p, "tiv", "all", periods, "2024Q1", "2024Q2", entities=["1"],
                   transform="yoy", basis="calendar")
    assert all(r.display is None for r in pos.collect())
    assert {r.period: r.display for r in cal.collect()} == {"2024Q1": 50.0, "2024Q2": 50.0}


def test_all_target_and_grouping_sets(spark):
    p = panel(spark, [{"naic": "1", "tiv": 2.0}, {"naic": "2", "tiv": 3.0}, {"naic": "3"}])
    out = S.series(p, "tiv", "all", ["2024Q1"], "2024Q1", "2024Q1")
    r = out.first()
    assert (r.target, r.value) == ("__ALL__", 5.0)
    gs = {(r.naic, r.is_total): r.value for r in M.entity_and_totals(p, "tiv").collect()}
    assert gs == {("1", False): 2.0, ("2", False): 3.0, ("3", False): None, (None, True): 5.0}


def test_distributed_rank_matches_window(spark):
    rows = [{"period": f"2024Q{1 + i % 2}", "naic": str(i), "tiv": float((i * 37) % 11)}
            for i in range(300)]
    p = panel(spark, rows)
    vals = M.entity_values(p, "tiv")
    a = R.rank_top(vals, None).select("period", "naic", "rank")
    b = R.rank_top(vals, 1000).select("period", "naic", "rank")
    assert a.exceptAll(b).count() == 0 and a.count() == 300


def test_resolve_defaults_and_rules():
    periods = [f"{y}Q{q}" for y in (2022, 2023, 2024) for q in (1, 2, 3, 4)]
    s = resolve(ViewSpec(metric="net_flow", wind="incl"), periods)
    assert s.period == "2024Q4" and s.period_from == "2022Q4" and s.period_to == "2024Q4"
    assert s.wind == "all"
    s2 = resolve(ViewSpec(period_from="2024Q2", period_to="2023Q1"), periods)
    assert (s2.period_from, s2.period_to) == ("2023Q1", "2024Q2")
    with pytest.raises(ValueError):
        resolve(ViewSpec(line="Commercial Residential", segments=("Personal Residential - X",)),
                periods, {"Personal Residential - X": "Personal Residential"})
    with pytest.raises(ValueError):
        ViewSpec(metric="nope")


def test_wind_fallback_and_resort(spark):
    from tessera.operators.slicing import metric_column
    assert metric_column("tiv", "incl", ["tiv", "tiv_incl_wind"]) == "tiv_incl_wind"
    assert metric_column("tiv", "excl", ["tiv", "tiv_incl_wind"]) == "tiv"
    assert metric_column("net_flow", "incl", []) == "net_flow"
    p = panel(spark, [{"naic": str(i), "tiv": float(v), "company": c}
                      for i, (v, c) in enumerate([(5, "b"), (9, "a"), (1, "C")])])
    out = snapshot_view(p, ViewSpec(metric="tiv", period="2024Q1", sort_col="company",
                                    sort_dir=1))
    assert [r.company for r in out.collect()] == ["0", "1", "2"]


def test_distributed_rank_hot_period_is_split(spark):
    """One period holds most rows: the range split spreads it over several
    ranges, and the numbering stays exact."""
    from pyspark.sql import Window
    rows = [("2024Q1" if i % 10 else "2024Q2", f"{i:05d}", float((i * 7919) % 1013))
            for i in range(3000)]
    vals = spark.createDataFrame(rows, "period string, naic string, value double")
    ranked = R.distributed_rank(vals, "period", "value", "naic", partitions=8)
    w = Window.partitionBy("period").orderBy(F.col("value").desc(), F.col("naic"))
    want = vals.withColumn("rank", F.row_number().over(w).cast("bigint"))
    assert ranked.select("period", "naic", "rank").exceptAll(
        want.select("period", "naic", "rank")).count() == 0
    hot = vals.filter(F.col("period") == "2024Q1").repartitionByRange(
        8, F.col("period"), F.col("value").desc(), F.col("naic"))
    assert hot.select(F.spark_partition_id().alias("p")).distinct().count() > 1
