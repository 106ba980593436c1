"""Plan assertions: pushdown, pruning, top-N limits, no single-partition exchange."""

import os

from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import ranking as R
from tessera.operators.slicing import period_range, slice_filings
from tessera.plans.viewspec import ViewSpec
from tessera.plans.views import snapshot_view
from tessera.sources.tables import filings_from_tables

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_column_pruning_reaches_scan(spark):
    fl = filings_from_tables(spark, SF)
    p = plan_of(M.entity_values(fl, "tiv"))
    # only the columns TIV needs are read from lineitem
    assert "l_extendedprice" in p
    assert "l_quantity" not in p and "l_tax" not in p and "l_returnflag" not in p


def test_partition_pruning_on_stored_panel(spark, tmpdir_path):
    fl = filings_from_tables(spark, SF).drop("suppressed")
    out = os.path.join(tmpdir_path, "panel")
    fl.write.partitionBy("period").parquet(out)
    stored = spark.read.parquet(out)
    q = M.entity_values(period_range(slice_filings(stored, line="Commercial Residential"),
                                     "1999Q4", "1998Q1"), "tiv")
    s = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in s and "1998Q1" in s
    assert "PushedFilters: [IsNotNull(line), EqualTo(line,Commercial Residential)]" in s


def test_topn_uses_window_group_limit_and_no_single_partition(spark):
    fl = filings_from_tables(spark, SF)
    q = snapshot_view(fl, ViewSpec(metric="tiv", topn=10), all_periods=True)
    s = q._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in s
    assert "SinglePartition" not in s


def test_share_totals_are_grouped_not_global_window(spark):
    fl = filings_from_tables(spark, SF)
    q = snapshot_view(fl, ViewSpec(mode="share", metric="dpw", topn=5), all_periods=True)
    s = q._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in s


def test_partial_aggregation_before_shuffle(spark):
    fl = filings_from_tables(spark, SF)
    s = plan_of(M.entity_values(fl, "dpw"))
    # the binding's aggregate is split into partial + final around the exchange
    assert s.count("HashAggregate") >= 2 and "partial_sum" in s


def test_distributed_rank_has_no_single_partition(spark):
    fl = filings_from_tables(spark, SF)
    vals = M.entity_values(fl, "tiv")
    q = R.rank_top(vals, None)
    assert "SinglePartition" not in plan_of(q)
    assert q.filter(F.col("rank") == 1).count() == vals.select("period").distinct().count()


#: Views of a few entities: nothing like a panel is written.
CUT = ["rank_topn", "rank_commercial", "net_flow", "rate_on_line", "share_topn_others",
       "share_ratio_metric", "growth_rank", "suppressed_unranked"]
#: Views without names, or of entities that are named in the query.
DIRECT = ["series_compare", "growth_qoq", "growth_calendar", "series_all", "series_all_gap_qoq",
          "share_delta", "new_dropped"]
#: Views of every entity: the columns they need are written once.
WHOLE = {"share_all": {"pif"}, "rank_all": {"dpw"}, "series_every_entity_yoy": {"dpw"},
         "summary_counts": set()}


def counted(spark, monkeypatch, name):
    """(view, [(written name, its plan, its columns)])."""
    from tessera.plans import registered as Q
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    written, write = [], Q.materialize

    def noted(df, label=None, partition_by=None):
        written.append((label, plan_of(df), set(df.columns)))
        return write(df, label, partition_by)

    monkeypatch.setattr(Q, "materialize", noted)
    view = Q.QUERIES[name](spark, SF)
    monkeypatch.setattr(Q, "materialize", write)
    return view, written


def line_item_scans(plan: str) -> list[str]:
    return [line for line in plan.split("\n") if "FileScan" in line and "lineitem" in line]


def test_cut_views_write_only_what_they_show(spark, monkeypatch):
    for name in CUT:
        view, written = counted(spark, monkeypatch, name)
        assert [n for n, _, _ in written] == ["view"], name
        assert view.count() <= 20 * 28 and "CartesianProduct" not in plan_of(view), name
        # One scan for the values; the names scan reads keys alone, of the entities shown.
        assert len(line_item_scans(written[0][1])) <= 1, name
        names = line_item_scans(plan_of(view))
        assert len(names) == 1 and "l_extendedprice" not in names[0], name
        assert "LeftSemi" in plan_of(view), name


def test_one_quarter_reads_one_quarter(spark, monkeypatch):
    """The ship-date window reaches the scan of the registered query itself."""
    _, written = counted(spark, monkeypatch, "rank_commercial")
    scan = plan_of_scan(written[0][1])
    assert "GreaterThanOrEqual(l_shipdate,2000-04-01T00:00" in scan
    assert "LessThan(l_shipdate,2000-07-01T00:00" in scan
    assert "l_tax" not in scan and "l_quantity" not in scan
    _, written = counted(spark, monkeypatch, "growth_rank")
    scan = plan_of_scan(written[0][1])
    assert "1999-04-01" in scan and "2000-04-01" in scan and "Or(" in scan


def plan_of_scan(plan: str) -> str:
    return line_item_scans(plan)[0]


def test_series_push_entities_and_range(spark, monkeypatch):
    for name in DIRECT:
        view, written = counted(spark, monkeypatch, name)
        assert not written, name
        plan = plan_of(view)
        assert "CartesianProduct" not in plan, name
        wide = [s for s in line_item_scans(plan) if "l_partkey" in s]
        assert 1 <= len(wide) <= 2, name
        if name.startswith(("series_compare", "growth")):
            assert all("In(l_suppkey, [" in s for s in wide), name
        if name != "new_dropped":
            assert any("GreaterThanOrEqual(l_shipdate" in s for s in wide), name


def test_views_of_every_entity_write_only_their_columns(spark, monkeypatch):
    for name, metrics in WHOLE.items():
        view, written = counted(spark, monkeypatch, name)
        panel = next((p, c) for n, p, c in written if n == "panel")
        assert panel[1] - {"period", "naic", "company", "policy_type"} == metrics, name
        assert len(line_item_scans(panel[0])) == 1, name
        assert "lineitem" not in plan_of(view) and "CartesianProduct" not in plan_of(view), name


def test_partition_filter_of_a_published_panel(spark, tmpdir_path):
    """P1 and J2 on the stored panel: one quarter opens one partition, and a table of
    quarters chooses partitions while the query runs."""
    from tessera.sources import sinks as SK
    fl = filings_from_tables(spark, SF).drop("suppressed")
    SK.publish({"facts_b": fl}, tmpdir_path)
    stored = SK.load_dataset(spark, tmpdir_path, ("facts_b",))["facts_b"]
    one = M.entity_values(slice_filings(stored, period="1999Q4"), "tiv")
    one.collect()
    assert files_read(one) == 1
    wanted = spark.createDataFrame([("1999Q4", "x"), ("1998Q1", "y")], "period string, why string")
    SK.write_table(wanted, os.path.join(tmpdir_path, "wanted"))
    wanted = spark.read.parquet(os.path.join(tmpdir_path, "wanted")).where("why = 'x'")
    some = M.entity_values(slice_filings(stored, periods=wanted), "tiv")
    assert "dynamicpruning" in plan_of(some).lower()
    rows = some.collect()
    assert {r.period for r in rows} == {"1999Q4"} and len(rows) == one.count()
    assert files_read(some) == files_read(one)


def test_stored_queries_read_their_partitions(spark, monkeypatch):
    """The registered queries over the published panel, as they ran."""
    from tessera.plans import registered_sources as RS
    kept, write = {}, RS.materialize

    def noted(df, label=None, partition_by=None):
        kept[label] = df
        return write(df, label, partition_by)

    monkeypatch.setattr(RS, "materialize", noted)
    assert RS.stored_quarter_rank(spark, SF).count() == 10
    kept["view"].collect()
    assert files_read(kept["view"]) == 1
    some = RS.stored_selection(spark, SF)
    rows = some.collect()
    chosen = len({r.period for r in rows})
    assert "dynamicpruning" in plan_of(some).lower()
    assert 0 < chosen < 28 and files_read(some) == chosen


def files_read(df) -> int:
    """Number of files that the run's fact scan opened, from the plan's metrics."""
    nodes, found = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        elif name == "FileSourceScanExec" and "facts_b" in node.relation().location().rootPaths().toString():
            found.append(node.metrics().apply("numFiles").value())
        kids = node.children()
        nodes += [kids.apply(i) for i in range(kids.size())]
    return max(found)
