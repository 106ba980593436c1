"""Cell grids → facts: every trap of FIXTURES §4 on hand-written grids."""

from pyspark.sql import functions as F

from cells_util import cells_df
from tessera.operators import dims as D
from tessera.operators import grid as G
from tessera.operators import quality as Q
from tessera.sources import files as FS

B_HEAD = ["NAIC Code", "Company Name", "Policy Type",
          "Total Number of Policies in Force\n(as of 6/30/2024)",
          "Total Value of Exposure ($)", "Direct Premium Written ($)"]
PATH_B = "d/filing_by_company_and_policy_type_2024q2_20240720t101010.xlsx"


def files_for(spark, *paths):
    return FS.describe_files(spark.createDataFrame([(p,) for p in paths], "path string"))


def parse(spark, rows, path=PATH_B, layout="B"):
    cells = cells_df(spark, path, rows)
    return G.parse_grid(cells, files_for(spark, path), layout)


def facts_of(res, *cols):
    return sorted(tuple(r) for r in res["facts"].select(*cols).collect())


def test_header_in_row_4_and_cleaning(spark):
    rows = [["Title (4/1/2024-6/30/2024)"], ["(Data pulled on 7/20/2024)"], None, B_HEAD,
            ["10064", "Acme", "Personal Residential - HO3", 10, "$1,234.50", "."],
            [" 00123 ", "Beta", "Commercial Residential - Condo - Wind Only", ".", "0", "-"],
            [None, " TOTAL ", None, 10, "$1,234.50", 99]]
    res = parse(spark, rows)
    got = facts_of(res, "naic", "company", "line", "is_wind_only", "pif", "tiv", "dpw")
    assert got == [("00123", "Beta", "Commercial Residential", True, None, 0.0, None),
                   ("10064", "Acme", "Personal Residential", False, 10.0, 1234.5, None)]
    sup = dict((r.naic, list(r.suppressed)) for r in res["facts"].collect())
    assert sup == {"10064": ["dpw"], "00123": ["pif"]}
    tot = res["totals"].first()
    assert (tot.pif, tot.tiv, tot.dpw) == (10.0, 1234.5, 99.0)


def test_header_positions(spark):
    for pos, found in ((3, True), (4, True), (10, True), (11, False)):
        rows = [["t"]] + [None] * (pos - 2) + [B_HEAD, ["1", "A", "Personal Residential - X", 1, 1, 1]]
        res = parse(spark, rows)
        assert (res["facts"].count() == 1) == found, pos
        if not found:
            w = res["warnings"].collect()
            assert [r.code for r in w] == ["no_header"]


def test_column_order_does_not_matter(spark):
    body = ["7", "A", "Personal Residential - X", 5, "$2.00", 3]
    order = [2, 0, 5, 1, 4, 3]
    res1 = parse(spark, [B_HEAD, body])
    res2 = parse(spark, [[B_HEAD[i] for i in order], [body[i] for i in order]])
    cols = ("naic", "company", "policy_type", "pif", "tiv", "dpw")
    assert facts_of(res1, *cols) == facts_of(res2, *cols)


def test_duplicate_header_right_wins_even_null(spark):
    head = B_HEAD + ["Direct Premium Written ($) revised"]
    rows = [head, ["1", "A", "Personal Residential - X", 1, 1, 50, None],
            ["2", "B", "Personal Residential - X", 1, 1, 50, 60]]
    res = parse(spark, rows)
    assert facts_of(res, "naic", "dpw") == [("1", None), ("2", 60.0)]
    col = res["collisions"].first()
    assert (col.key, col.n_columns, list(col.col_nos)) == ("dpw", 2, [6, 7])


def test_ragged_empty_and_keyless_rows(spark):
    rows = [B_HEAD, ["1", "A", "Personal Residential - X", 3],  # ragged: no TIV / DPW
            None,  # empty row
            [None, "Footnote only", None, None],  # no NAIC, no type → dropped
            ["", "NoKey", "Personal Residential - Y", 1],  # type only → kept, naic ''
            ["9", "Surety Co", "Surety", 2]]
    res = parse(spark, rows)
    got = facts_of(res, "naic", "line", "pif", "tiv")
    assert got == [("", "Personal Residential", 1.0, None), ("1", "Personal Residential", 3.0, None),
                   ("9", "Other", 2.0, None)]
    unk = Q.unknown_segments(res["facts"]).collect()
    assert [(r.policy_type, r.rows) for r in unk] == [("Surety", 1)]


def test_two_total_rows_last_wins(spark):
    rows = [B_HEAD, ["1", "A", "Personal Residential - X", 3, 1, 1],
            [None, "Total", None, 100, 1, 1], [None, "TOTAL", None, 3, 1, 1]]
    res = parse(spark, rows)
    assert res["totals"].first().pif == 3.0
    assert res["facts"].count() == 1


def test_missing_dims_rejects_file_only(spark):
    other = "d/filing_by_company_and_policy_type_2024q1.xlsx"
    bad = cells_df(spark, PATH_B, [["Company Name", "Policy Type", "Direct Premium Written"],
                                   ["A", "Personal Residential - X", 1]])
    good = cells_df(spark, other, [B_HEAD, ["1", "A", "Personal Residential - X", 1, 1, 1]])
    res = G.parse_grid(bad.unionByName(good), files_for(spark, PATH_B, other), "B")
    assert [r.period for r in res["facts"].collect()] == ["2024Q1"]
    w = res["warnings"].first()
    assert w.code == "missing_dims" and "naic" in w.detail


def test_layout_a_premium_headers_fixed(spark):
    path = "d/filing_by_company_and_commercial_personal_2024q2.xlsx"
    head = ["Rank by Total PIF", "Company Name", "NAIC Code",
            "Total Number of Policies in Force",
            "Number of Policies in Force that are Commercial",
            "Number of Policies in Force that are Personal",
            "Total Direct Premium Written for Policies in Force",
            "Direct Premium Written for Policies in Force that are Commercial",
            "Direct Premium Written for Policies in Force that are Personal"]
    rows = [head, [1, "A", "10064", 10, 4, 6, 100.5, 40.25, "."]]
    res = parse(spark, rows, path, "A")
    f = res["facts"].first()
    assert (f.a_pif, f.a_pif_commercial, f.a_pif_personal) == (10.0, 4.0, 6.0)
    assert (f.a_dpw, f.a_dpw_commercial, f.a_dpw_personal) == (100.5, 40.25, None)
    assert list(f.suppressed) == ["a_dpw_personal"]


def test_header_text_variants_same_key(spark):
    variants = ["Company Name", "COMPANY NAME", "Company Name", "Company\nName"]
    for v in variants:
        rows = [["NAIC Code", v, "Policy Type", "Total Number of Policies in Force"],
                ["1", "A", "Personal Residential - X", 1]]
        assert parse(spark, rows)["facts"].count() == 1, repr(v)


def test_name_drift_first_seen_wins(spark):
    facts = spark.createDataFrame(
        [("2024Q1", "10064", "Acme Mutual"), ("2024Q2", "10064", "Acme Insurance"),
         ("2023Q4", "10064", "Acme Insurance"), ("2023Q3", "10064", "Acme Mutual"),
         ("2024Q1", "00123", "")], "period string, naic string, company string")
    c = {r.naic: r for r in D.companies(facts).collect()}
    # two names twice each: the one seen first (2023Q3) wins
    assert c["10064"].name == "Acme Mutual"
    assert list(c["10064"].names) == ["Acme Insurance", "Acme Mutual"]
    assert (c["10064"].first, c["10064"].last) == ("2023Q3", "2024Q2")
    assert c["00123"].name == "00123" and list(c["00123"].names) == []


def test_checksum_statuses(spark):
    body = spark.createDataFrame([("P1", 10000.0), ("P2", 10000.0), ("P3", 5.0), ("P4", 1.0),
                                  ("P5", None)], "period string, pif double")
    totals = spark.createDataFrame([("P1", 10001.0), ("P2", 10002.0), ("P3", None), ("P4", 0.0),
                                    ("P5", -10.0)], "period string, pif double")
    got = {r.period: r.status for r in Q.checksum(body, totals, ["pif"]).collect()}
    assert got == {"P1": "ok", "P2": "mismatch", "P3": "no_total", "P4": "mismatch",
                   "P5": "mismatch"}


def test_checksum_starts_from_all_files(spark):
    body = spark.createDataFrame([("f1", "P1", 5.0)], "path string, period string, pif double")
    totals = spark.createDataFrame([("f1", "P1", 5.0), ("f2", "P2", 7.0)],
                                   "path string, period string, pif double")
    files = spark.createDataFrame([("f1", "P1"), ("f2", "P2"), ("f3", "P3")],
                                  "path string, period string")
    got = {r.path: (r.body_sum, r.total, r.rows, r.status) for r in
           Q.checksum(body, totals, ["pif"], ("path", "period"), files=files).collect()}
    assert got == {"f1": (5.0, 5.0, 1, "ok"), "f2": (0.0, 7.0, 0, "mismatch"),
                   "f3": (0.0, None, 0, "no_total")}


def test_all_header_rules_in_one_sheet(spark):
    """Every rule of both layouts finds its key; the order of the rules matters."""
    from tessera import catalog as C
    texts = {
        "pif_excl_wind": "Number of Policies in Force that Exclude Wind coverage",
        "pif_incl_wind": "Number of Policies in Force that Include Wind",
        "pif": "Total Number of Policies in Force", "cancelled": "Number of Policies Canceled",
        "cancelled_hurricane": "Number of Policies Canceled due to Hurricane Risk",
        "nonrenewed": "Number of Policies Nonrenewed",
        "nonrenewed_hurricane": "Policies Nonrenewed due to Hurricane Risk",
        "transferred_out": "Number of Policies Transferred to Other Insurers",
        "new_written": "Number of New Policies Written",
        "received_in": "Number of Policies Received from Other Insurers",
        "tiv_excl_wind": "Total Value of Exposure for Policies that Exclude Wind",
        "tiv_incl_wind": "Total Value of Exposure for Policies that Include Wind",
        "tiv": "Total Value of Exposure", "dpw": "Direct Premium Written",
        "dpw_excl_wind": "Direct Premium Written for Policies that Exclude Wind",
        "dpw_incl_wind": "Direct Premium Written for Policies that Include Wind",
        "claims_opened": "Total Number of Claims Opened", "claims_closed": "Total Number of Claims Closed",
        "claims_pending": "Total Number of Claims Pending",
        "lawsuits_closed_consumer": "Number of Lawsuits Closed with Consideration to the Consumer",
        "lawsuits_closed": "Number of Lawsuits Closed", "lawsuits_opened": "Number of Lawsuits Opened",
        "lawsuits_open_end": "Number of Lawsuits Open at End of quarter"}
    assert set(texts) == set(C.layout_b_metric_keys())
    head = ["NAIC Code", "Company Name", "Policy Type", *texts.values()]
    res = parse(spark, [head, ["1", "A", "Personal Residential - X", *range(len(texts))]])
    fact = res["facts"].first()
    assert [fact[k] for k in texts] == [float(i) for i in range(len(texts))]
    assert list(fact.present) == sorted(texts) and res["collisions"].count() == 0


def test_title_and_pull_date(spark):
    cells = cells_df(spark, PATH_B, [["My Title"], ["(Data pulled on July 20, 2024)"]])
    cells2 = cells_df(spark, "x.xlsx", [["Other"], ["pulled whenever"]])
    got = {r.path: (r.title, r.pulled) for r in FS.title_and_pulled(cells.unionByName(cells2)).collect()}
    assert got == {PATH_B: ("My Title", "July 20, 2024"), "x.xlsx": ("Other", "pulled whenever")}
    t = spark.createDataFrame([("Report 4/1/2022-6/30/2022",), ("January 1, 2026 - March 31, 2026",),
                               ("no dates",)], "t string")
    assert [r[0] for r in t.select(FS.title_period("t")).collect()] == ["2022Q2", "2026Q1", None]


def test_round_trip_panel_to_cells(spark):
    from tessera.sources.sheet_fixtures import panel_to_rows
    from tessera.sources.tables import BOUND_METRICS, filings_from_tables
    fl = filings_from_tables(spark, "/root/testdata/sf0.001")
    grid = panel_to_rows(fl, BOUND_METRICS)
    files = FS.describe_files(grid.filter("row_no = 1").select("path"))
    res = G.parse_grid(grid, files, "B")
    plan = res["facts"]._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "hashpartitioning(path" not in plan
    cells = G.parse_grid(G.cells_of(grid), files, "B")["facts"]
    assert cells.exceptAll(res["facts"]).count() == 0 and cells.count() == res["facts"].count()
    cols = ["period", "naic", "company", "policy_type", *BOUND_METRICS]
    a = fl.select(*cols, F.array_join("suppressed", "|").alias("s"))
    b = res["facts"].select(*cols, F.array_join("suppressed", "|").alias("s"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert res["collisions"].count() == 0 and res["warnings"].count() == 0


def test_table_schemas(spark):
    """The stated columns are those that parsing gives."""
    from pyspark.sql.types import StructType
    files = spark.createDataFrame([], "path string, layout string, period string")
    for layout in "AB":
        parsed = G.parse_grid(spark.createDataFrame([], G.ROWS_SCHEMA), files, layout)
        for table in ("facts", "totals"):
            want = StructType.fromDDL(G.table_schema(table, layout))
            assert parsed[table].dtypes == [(f.name, f.dataType.simpleString()) for f in want]


def test_metric_cells_are_cleaned_by_one_expression(spark):
    """An expression a metric makes a method that the JVM does not compile."""
    grid = spark.createDataFrame([], G.ROWS_SCHEMA)
    files = spark.createDataFrame([], "path string, layout string, period string")
    plan = G.parse_grid(grid, files, "B")["facts"]._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.upper().count("RLIKE") <= 2
