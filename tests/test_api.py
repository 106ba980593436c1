"""Catalogue, context, captions, labelled tables, dataset loading."""

import os

import pytest
from pyspark.sql import functions as F

from tessera import catalog as C
from tessera.functions import labelled
from tessera.operators.slicing import metrics_on_offer
from tessera.plans.viewspec import ViewSpec, context_frame, context_rows
from tessera.plans.views import captions, snapshot_view
from tessera.sources import sinks as SK
from tessera.sources.tables import filings_from_tables


def test_metrics_on_offer(spark):
    present = spark.createDataFrame([("tiv",), ("pif",), ("tiv_incl_wind",)], "key string")
    got = sorted(r.id for r in metrics_on_offer(C.metrics_frame(spark), present).collect())
    assert got == ["avg_premium", "net_flow", "pif", "rate_on_line", "tiv", "wind_concentration"]


def test_context_rows():
    rows = dict(context_rows(ViewSpec(mode="series", metric="tiv", wind="incl", topn=5,
                                      period_from="2023Q1", period_to="2024Q1",
                                      transform="yoy", line="Commercial Residential"),
                             "tiv_incl_wind"))
    assert rows == {"mode": "series", "metric": "Exposure / TIV ($)", "wind": "incl",
                    "wind column": "tiv_incl_wind", "line": "Commercial Residential",
                    "period_from": "2023Q1", "period_to": "2024Q1", "transform": "yoy"}
    rows = dict(context_rows(ViewSpec(topn=None, segments=("a", "b"), period="2024Q1",
                                      transform="qoq")))
    assert rows == {"mode": "rank", "metric": "Exposure / TIV ($)", "topn": "all",
                    "segments": "a, b", "period": "2024Q1"}


def test_context_frame_captions_and_labels(spark):
    assert context_frame(spark, ViewSpec(period="1998Q1")).count() == 3
    fl = filings_from_tables(spark, "/root/testdata/sf0.001")
    spec = ViewSpec(mode="share", metric="dpw", topn=3, period="1998Q1")
    snap = snapshot_view(fl, spec)
    cap = captions(fl, spec).first()
    n_ent = fl.filter((F.col("period") == "1998Q1") & F.col("dpw").isNotNull()) \
              .select("naic").distinct().count()
    assert cap.carriers == n_ent and cap.carriers > 3
    shares = {r.company: r.value for r in snap.collect()}
    assert cap.slice_total == pytest.approx(sum(shares.values()))
    ratio = captions(fl, spec.with_(metric="rate_on_line")).first()
    assert 0 < ratio.slice_total < 1
    lab = labelled(snap, "dpw", share_col="share").filter(F.col("rank") == 1).first()
    assert lab.value_label.startswith("$") and lab.share_label.endswith("%")


def test_load_dataset_missing(spark, tmpdir_path):
    with pytest.raises(SK.DatasetNotFoundError):
        SK.load_dataset(spark, os.path.join(tmpdir_path, "nothing"))


def test_state_rules():
    from tessera.plans.viewspec import change
    s = ViewSpec(metric="tiv", wind="incl", line="Personal Residential",
                 segments=("Personal Residential - X",), sort_col="value")
    s2 = change(s, line="Commercial Residential")
    assert s2.segments == () and s2.sort_col == "value"
    s3 = change(s, metric="net_flow")
    assert s3.sort_col is None and s3.wind == "all" and s3.segments == s.segments
    assert change(s, mode="share").sort_col is None


def test_suppressed_entities_unranked(spark):
    from tessera.operators import ranking as R
    p = spark.createDataFrame(
        [("2024Q1", "1", "A", 5.0, []), ("2024Q1", "2", "B", None, ["tiv"]),
         ("2024Q1", "2", "B", None, ["tiv"]), ("2024Q1", "3", "C", None, [])],
        "period string, naic string, company string, tiv double, suppressed array<string>")
    un = R.suppressed_entities(p, "tiv")
    assert [(r.naic, r.n_suppressed) for r in un.collect()] == [("2", 2)]
    view = snapshot_view(p.withColumn("line", F.lit("x")).withColumn("is_wind_only", F.lit(False))
                          .withColumn("policy_type", F.lit("x")),
                         ViewSpec(metric="tiv", period="2024Q1"))
    out = R.append_unranked(view, un)
    assert sorted((r.naic, r.rank) for r in out.collect()) == [("1", 1), ("2", None)]


def test_report_tables_and_text(spark):
    from tessera.operators.quality import render_report, report_tables
    tables = report_tables({
        "totals": spark.createDataFrame([(1, 2)], "periods long, files long"),
        "checksums": spark.createDataFrame(
            [("2024Q1", "B", "tiv", 10.0, 12.5, 2, "mismatch", 1.0),
             ("2024Q1", "B", "pif", 3.0, None, 2, "no_total", None)],
            "period string, layout string, metric string, body_sum double, total double, "
            "rows long, status string, diff double"),
        "warnings": spark.createDataFrame([("B", "a|b.xlsx", "no_header", "none")],
                                          "layout string, path string, code string, detail string"),
        "facts_b": spark.range(3)})
    assert list(tables) == ["totals", "checksums", "warnings"]
    text = render_report(tables).split("\n")
    assert "| 2024Q1 | B | pif | 3 |  | 2 | no_total |" in text
    assert "| 2024Q1 | B | tiv | 10 | 12.5 | 2 | mismatch |" in text
    assert "| B | a\\|b.xlsx | no_header | none |" in text and "## Dataset (1)" in text


def test_wind_fallback_uses_headers_seen(spark):
    """A parsed grid has every key as a column; P2 must follow the headers seen."""
    from cells_util import cells_df
    from tessera.operators import grid as G
    from tessera.plans.views import wind_applied
    from tessera.sources import files as FS
    path = "d/filing_by_company_and_policy_type_2024q2.xlsx"
    rows = [["NAIC Code", "Company Name", "Policy Type", "Total Value of Exposure",
             "Value of Exposure for policies that Include Wind"],
            ["1", "A", "Personal Residential - X", 10, 4], ["2", "B", "Personal Residential - X", 5, 5]]
    files = FS.describe_files(spark.createDataFrame([(path,)], "path string"))
    res = G.parse_grid(cells_df(spark, path, rows), files, "B")
    seen = {r.key for r in res["metrics_seen"].collect()}
    assert "tiv_excl_wind" in res["facts"].columns and "tiv_excl_wind" not in seen
    spec = ViewSpec(metric="tiv", wind="excl", period="2024Q2")
    assert wind_applied(res["facts"], spec, seen) == "tiv"
    got = [(r.naic, r.value) for r in snapshot_view(res["facts"], spec, available=seen).collect()]
    assert got == [("1", 10.0), ("2", 5.0)]
    incl = snapshot_view(res["facts"], spec.with_(wind="incl"), available=seen).collect()
    assert [(r.naic, r.value) for r in incl] == [("2", 5.0), ("1", 4.0)]


def test_headers_seen_reach_every_operator(spark):
    """One quarter lacks the wind column, the other the whole metric: no zero totals."""
    from cells_util import cells_df
    from tessera.operators import grid as G
    from tessera.operators import metrics as M
    from tessera.operators import reshape as RS
    from tessera.operators import series as S
    from tessera.sources import files as FS
    one, two = (f"d/filing_by_company_and_policy_type_2024q{q}.xlsx" for q in (1, 2))
    pt = "Personal Residential - X"
    cells = cells_df(spark, one, [["NAIC Code", "Company Name", "Policy Type",
                                   "Total Value of Exposure"], ["1", "A", pt, 7], ["2", "B", pt, None]])
    cells = cells.unionByName(cells_df(spark, two, [
        ["NAIC Code", "Company Name", "Policy Type", "Total Number of Policies in Force"],
        ["1", "A", pt, "."]]))
    files = FS.describe_files(spark.createDataFrame([(one,), (two,)], "path string"))
    res = G.parse_grid(cells, files, "B")
    facts, seen = res["facts"], {r.key for r in res["metrics_seen"].collect()}
    assert seen == {"tiv", "pif"}
    kw = dict(wind="incl", available=seen)
    first = facts.filter("period = '2024Q1'")
    assert M.slice_totals(first, "tiv", **kw).first().total == 7.0
    assert M.slice_totals_many(first, ["tiv"], **kw).first().tiv == 7.0
    assert {r.value for r in M.entity_and_totals(first, "tiv", **kw).collect()} == {7.0, None}
    assert M.multi_metric(first, ["tiv"], **kw).filter("naic = '1'").first().tiv == 7.0
    assert M.free_rollup(first, ["line"], ["tiv"], **kw).first().tiv == 7.0
    assert [r.share for r in S.shares(first, "tiv", **kw).collect()] == [1.0]
    assert M.breakdown(first, "tiv", wind_split=True, available=seen).first().basis == "all"
    delta = S.share_delta(facts, "tiv", ["2024Q1", "2024Q2"], "2024Q1", "2024Q2", **kw)
    assert {(r.period, r.share) for r in delta.collect()} == {("2024Q1", 1.0), ("2024Q2", None)}
    rank = S.growth_rank(facts, "tiv", "2024Q1", **kw).collect()
    assert rank == []
    # Absent column → no row; blank → null; '.' → null and flag.
    long = {(r.period, r.naic_code, r.metric): (r.value, r.is_suppressed)
            for r in RS.observations(facts).collect()}
    assert long == {("2024Q1", "1", "tiv"): (7.0, False), ("2024Q1", "2", "tiv"): (None, False),
                    ("2024Q2", "1", "pif"): (None, True)}
