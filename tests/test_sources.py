"""Workbooks on disk → ingest; re-pulls; stream ingest; sinks."""

import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import files as FS
from tessera.sources import sinks as SK
from tessera.sources import workbooks as WB
from xlsx_util import write_xlsx

B_HEAD = ["NAIC Code", "Company Name", "Policy Type",
          "Number of Policies in Force that Exclude Wind", "Total Number of Policies in Force",
          "Total Value of Exposure", "Direct Premium Written"]
A_HEAD = ["Rank by Total PIF", "Company Name", "NAIC Code", "Total Number of Policies in Force",
          "Number of Policies in Force that are Commercial",
          "Number of Policies in Force that are Personal",
          "Total Direct Premium Written for Policies in Force",
          "Direct Premium Written for Policies in Force that are Commercial",
          "Direct Premium Written for Policies in Force that are Personal"]


def b_sheet(period, rows, pulled="7/20/2024"):
    body = [[naic, name, pt, None, pif, tiv, dpw] for naic, name, pt, pif, tiv, dpw in rows]
    total = [None, "Total", None, None, sum(r[3] for r in rows if isinstance(r[3], (int, float))),
             "$" + format(sum(r[4] for r in rows if isinstance(r[4], (int, float))), ",.2f"), None]
    return [[f"Policy type report {period}"], [f"(Data pulled on {pulled})"], None, B_HEAD,
            *body, total]


def make_folder(d):
    write_xlsx(os.path.join(d, "filing_by_company_and_policy_type_2024q1_20240420t080000.xlsx"),
               b_sheet("2024Q1", [(10064, "Acme", "Personal Residential - HO3", 10, 100.0, 5.5),
                                  ("00123", "Beta Mutual", "Commercial Residential - Condo", ".", 50.0, 1.0)]))
    # an older pull of the same quarter: must be ignored
    write_xlsx(os.path.join(d, "filing_by_company_and_policy_type_2024q1_20240401t080000.xlsx"),
               b_sheet("2024Q1", [(10064, "Acme OLD", "Personal Residential - HO3", 999, 1.0, 1.0)]))
    write_xlsx(os.path.join(d, "filing_by_company_and_policy_type_2024q2_20240720t080000.xlsx"),
               b_sheet("2024Q2", [(10064, "Acme Ins", "Personal Residential - HO3", 12, 120.0, 6.0),
                                  (9, "Gamma", "Personal Residential - HO3 - Wind Only", 3, 30.0, True)]))
    write_xlsx(os.path.join(d, "filing_by_company_and_commercial_personal_2024q2.xlsx"),
               [["A report"], [None], A_HEAD, [1, "Acme", 10064, 12, 2, 10, 6.0, 1.0, 5.0],
                [None, "TOTAL", None, 12, 2, 10, 6.0, 1.0, 5.0]])
    write_xlsx(os.path.join(d, "notes_2024q2.xlsx"), [["not a filing"]])
    write_xlsx(os.path.join(d, "filing_by_company_and_policy_type_undated.xlsx"), [["x"]])
    open(os.path.join(d, "readme.txt"), "w").write("ignore me")


def test_workbook_cells_first_sheet_only(tmpdir_path):
    p = os.path.join(tmpdir_path, "w.xlsx")
    write_xlsx(p, [["a", 1.5, True], None, [None, "b"]], decoy=[["DECOY"]])
    cells = list(WB.workbook_cells(open(p, "rb").read()))
    assert cells == [(1, 1, "s", "a"), (1, 2, "n", "1.5"), (1, 3, "b", "TRUE"), (3, 2, "s", "b")]


def test_ingest_folder(spark, tmpdir_path):
    make_folder(tmpdir_path)
    ds = WB.ingest_folder(spark, tmpdir_path)
    files = sorted((r.layout, r.period, os.path.basename(r.path)) for r in ds["files"].collect())
    assert files == [("A", "2024Q2", "filing_by_company_and_commercial_personal_2024q2.xlsx"),
                     ("B", "2024Q1", "filing_by_company_and_policy_type_2024q1_20240420t080000.xlsx"),
                     ("B", "2024Q2", "filing_by_company_and_policy_type_2024q2_20240720t080000.xlsx")]
    fb = {(r.period, r.naic): r for r in ds["facts_b"].collect()}
    assert set(fb) == {("2024Q1", "10064"), ("2024Q1", "00123"), ("2024Q2", "10064"), ("2024Q2", "9")}
    assert fb[("2024Q1", "10064")].pif == 10.0 and fb[("2024Q1", "10064")].company == "Acme"
    assert fb[("2024Q1", "00123")].pif is None and list(fb[("2024Q1", "00123")].suppressed) == ["pif"]
    assert fb[("2024Q2", "9")].dpw == 1.0 and fb[("2024Q2", "9")].is_wind_only
    fa = ds["facts_a"].first()
    assert (fa.naic, fa.a_pif, fa.a_dpw_personal) == ("10064", 12.0, 5.0)
    per = {r.period: r for r in ds["periods"].collect()}
    assert (per["2024Q2"].has_A, per["2024Q2"].has_B) == (True, True)
    assert (per["2024Q1"].has_A, per["2024Q1"].pulled_at) == (False, "7/20/2024")
    found = {(os.path.basename(r.path), r.code) for r in ds["conflicts"].collect()}
    assert ("notes_2024q2.xlsx", "no_layout") in found
    assert ("filing_by_company_and_policy_type_undated.xlsx", "no_period") in found
    assert per["2024Q2"].title == "A report"
    comp = {r.naic: r.name for r in ds["companies"].collect()}
    assert comp["10064"] == "Acme"
    checks = {(r.layout, r.period): r.status for r in ds["checksums"].collect()}
    assert checks[("B", "2024Q1")] == "ok" and checks[("A", "2024Q2")] == "ok"
    metrics = sorted(r.key for r in ds["metrics_b"].collect())
    assert metrics == ["dpw", "pif", "pif_excl_wind", "tiv"]


def test_no_workbooks_fails(spark, tmpdir_path):
    open(os.path.join(tmpdir_path, "x.txt"), "w").write("no")
    write_xlsx(os.path.join(tmpdir_path, "other.xlsx"), [["x"]])
    with pytest.raises(FS.NoWorkbooksError):
        WB.choose_workbooks(spark, tmpdir_path)


def test_cells_without_references(tmpdir_path):
    """The r attributes of rows and cells are optional."""
    import re
    import zipfile
    p, q = (os.path.join(tmpdir_path, n) for n in ("w.xlsx", "no_refs.xlsx"))
    write_xlsx(p, [["a", 1.5, True], ["x", "y"]])
    with zipfile.ZipFile(p) as src, zipfile.ZipFile(q, "w") as dst:
        for name in src.namelist():
            data = src.read(name)
            if "worksheets" in name:
                data = re.sub(rb'(<(?:row|c))((?: [^>]*?)?) r="[^"]*"', rb"\1\2", data)
                assert b' r="' not in data
            dst.writestr(name, data)
    want = list(WB.workbook_cells(open(p, "rb").read()))
    assert len(want) == 5 and list(WB.workbook_cells(open(q, "rb").read())) == want


def test_ingest_reports_rejected_and_bodyless_workbooks(spark, tmpdir_path):
    make_folder(tmpdir_path)
    write_xlsx(os.path.join(tmpdir_path, "filing_by_company_and_policy_type_2024q3.xlsx"),
               [["Third (7/1/2024-9/30/2024)"], ["(Data pulled on 10/20/2024)"], None, ["No", "Header"]])
    write_xlsx(os.path.join(tmpdir_path, "filing_by_company_and_policy_type_2024q4.xlsx"),
               [["Fourth (10/1/2024-9/30/2024)"], None, B_HEAD, [None, "Total", None, None, 50, 1.0, 1.0],
                [None, "Total", None, None, 60, 2.0, 1.0], [None, "a footnote"]])
    ds = WB.ingest_folder(spark, tmpdir_path)
    checks = {(r.layout, r.period, r.metric): (r.body_sum, r.total, r.status)
              for r in ds["checksums"].collect()}
    assert checks["B", "2024Q4", "pif"] == (0.0, 60.0, "mismatch")
    assert checks["B", "2024Q3", "pif"] == (0.0, None, "no_total")
    assert {m for layout, _, m in checks if layout == "B"} == {"pif", "tiv", "dpw", "pif_excl_wind"}
    periods = {r.period: r for r in ds["periods"].collect()}
    assert set(periods) == {"2024Q1", "2024Q2", "2024Q3", "2024Q4"}
    third = periods["2024Q3"]
    assert (third.has_A, third.has_B, third.pulled_at, third.title_period) == (
        False, False, "10/20/2024", "2024Q3")
    assert periods["2024Q4"].title_period == "2024Q3"  # does not agree with the name
    cover = {r.period: (r.files, r.has_B, r.pulled_at) for r in ds["coverage"].collect()}
    assert cover["2024Q3"] == (1, False, "10/20/2024") and cover["2024Q2"][0] == 2
    assert ds["totals"].first().files == 5
    from tessera.operators.quality import render_report, report_tables
    text = render_report(report_tables(ds))
    for part in ("no_header", "2024Q4", "mismatch", "Suppressed and empty cells", "| 2024Q2 | new | 1 |"):
        assert part in text


def test_publish_replaces_the_dataset(spark, tmpdir_path):
    src, out = (os.path.join(tmpdir_path, d) for d in ("in", "out"))
    os.makedirs(src)
    make_folder(src)
    ds = WB.ingest_folder(spark, src)
    SK.publish(ds, out)
    SK.publish(ds, out)  # again: the same dataset
    got = SK.load_dataset(spark, out)
    assert got["facts_b"].count() == 4 and got["periods"].count() == 2
    # A publish that dies before its last step is not seen.
    broken = dict(ds, companies=spark.range(1).select(F.raise_error(F.lit("died")).alias("x")))
    with pytest.raises(Exception, match="died"):
        SK.publish({"facts_b": ds["facts_b"].limit(1), "companies": broken["companies"]}, out)
    assert SK.load_dataset(spark, out)["facts_b"].count() == 4
    # A quarter that left the source is gone from every table.
    less = dict(ds, facts_b=ds["facts_b"].filter("period = '2024Q2'"),
                periods=ds["periods"].filter("period = '2024Q2'"))
    SK.publish(less, out)
    got = SK.load_dataset(spark, out)
    assert {r.period for r in got["facts_b"].collect()} == {"2024Q2"} == {
        r.period for r in got["periods"].collect()}


def csv_lines(path):
    return [line for f in sorted(glob.glob(os.path.join(path, "part-*.csv")))
            for line in open(f, newline="").read().split("\n")[:-1]]


def test_csv_export_quoting_numbers_and_order(spark, tmpdir_path):
    df = spark.createDataFrame(
        [(3, 'A"b,c', 1.25, None), (1, " padded ", 3098225107375.0, "x"), (2, "plain", None, "y"),
         (5, "small", 0.1234567890123, ""), (4, "neg", -1e-7, "z"), (6, "big", 1e22, "w")],
        "n int, company string, value double, naic string").orderBy("n")
    out = os.path.join(tmpdir_path, "csv")
    SK.export_csv(df, out, labels={"company": "Company", "value": "Value", "naic": "NAIC", "n": "No"},
                  single_file=True)
    assert csv_lines(out) == ["No,Company,Value,NAIC", "1, padded ,3098225107375,x", "2,plain,,y",
                              '3,"A""b,c",1.25,', "4,neg,-0.0000001,z", "5,small,0.1234567890123,",
                              "6,big,10000000000000000000000,w"]


def test_exported_view_keeps_its_order(spark, tmpdir_path):
    from tessera.plans.viewspec import ViewSpec
    from tessera.plans.views import snapshot_view
    rows = [("2024Q1", str(i), "C", "Personal Residential - X", "Personal Residential", False,
             float((i * 37) % 101) + 0.5) for i in range(100)]
    p = spark.createDataFrame(rows, "period string, naic string, company string, policy_type string, "
                                    "line string, is_wind_only boolean, tiv double").repartition(7)
    out = os.path.join(tmpdir_path, "csv")
    view = snapshot_view(p, ViewSpec(metric="tiv", period="2024Q1", topn=None))
    SK.export_csv(view.select("rank", "naic", "value"), out, single_file=True)
    want = sorted(((i * 37) % 101 + 0.5, str(i)) for i in range(100))[::-1]
    assert csv_lines(out)[1:] == [f"{k},{n},{v}" for k, (v, n) in enumerate(want, start=1)]


def drop_q1(src, stamp, rows, sheet=None):
    write_xlsx(os.path.join(src, f"filing_by_company_and_policy_type_2024q1_{stamp}.xlsx"),
               sheet or b_sheet("2024Q1", rows))


def test_stream_ingest_new_quarters_repulls_and_replay(spark, tmpdir_path):
    from tessera.streaming import ingest as SI
    src, out, ck, pub = (os.path.join(tmpdir_path, d) for d in ("drop", "out", "ck", "pub"))
    os.makedirs(src)
    x = "Personal Residential - X"

    def run():
        SI.ingest_stream(spark, src, out, ck).awaitTermination()
        ds = SI.load_stream(spark, out)
        return ds, sorted((r.period, r.naic, r.pif) for r in ds["facts_b"].collect())

    drop_q1(src, "20240420t080000", [(1, "A", x, 1, 1.0, 1.0)])
    assert run()[1] == [("2024Q1", "1", 1.0)]
    # A new quarter and a newer pull of Q1 arrive.
    write_xlsx(os.path.join(src, "filing_by_company_and_policy_type_2024q2_20240720t080000.xlsx"),
               b_sheet("2024Q2", [(1, "A", x, 2, 2.0, 2.0)]))
    drop_q1(src, "20240501t080000", [(1, "A", x, 5, 5.0, 5.0), (2, "B", x, 1, 1.0, 1.0)])
    ds, now = run()
    assert now == [("2024Q1", "1", 5.0), ("2024Q1", "2", 1.0), ("2024Q2", "1", 2.0)]
    SK.publish(ds, pub)
    assert SK.load_dataset(spark, pub)["facts_b"].count() == 3
    # An older pull arriving late changes nothing.
    drop_q1(src, "20240301t080000", [(1, "A", x, 99, 9.0, 9.0)])
    assert run()[1] == now
    # A replayed batch writes the same rows again, not twice.
    files = spark.read.format("binaryFile").load(
        os.path.join(src, "filing_by_company_and_policy_type_2024q1_20240501t080000.xlsx"))
    number = [r.batch for r in SI.read_state(spark, out).collect() if "20240501" in r.path][0]
    SI.process_batch(files.unionByName(spark.read.format("binaryFile").load(
        os.path.join(src, "filing_by_company_and_policy_type_2024q2_20240720t080000.xlsx"))), number, out)
    ds = SI.load_stream(spark, out)
    assert sorted((r.period, r.naic, r.pif) for r in ds["facts_b"].collect()) == now
    # A newer pull that is rejected clears its quarter and leaves a warning.
    drop_q1(src, "20240601t080000", [], [["no header here"]])
    ds, now = run()
    assert now == [("2024Q2", "1", 2.0)]
    assert [r.code for r in ds["warnings"].collect()] == ["no_header"]
    assert {r.period: r.has_B for r in ds["periods"].collect()} == {"2024Q1": False, "2024Q2": True}


def test_cluster_session_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from tessera.session import ensure_checkpoint_dir
    fake = SimpleNamespace(
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"),
        conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(fake)
