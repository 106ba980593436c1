"""Properties on the bound panel."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import reshape as RS
from tessera.plans.viewspec import ViewSpec
from tessera.plans.views import snapshot_view
from tessera.sources.tables import BOUND_METRICS, filings_from_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def panel(spark):
    return filings_from_tables(spark, SF)


def test_shares_and_others_sum_to_one(panel):
    view = snapshot_view(panel, ViewSpec(mode="share", metric="tiv", topn=3), all_periods=True)
    sums = view.groupBy("period").agg(F.sum("share").alias("s")).collect()
    assert sums and all(r.s == pytest.approx(1.0) for r in sums)


def test_grouping_sets_total_equals_sum_of_entities(panel):
    gs = M.entity_and_totals(panel, "dpw")
    tot = {r.period: r.value for r in gs.filter("is_total").collect()}
    ent = {r.period: r.s for r in gs.filter(~F.col("is_total")).groupBy("period")
           .agg(M.exact_sum0("value").alias("s")).collect()}
    assert tot == ent


def test_wide_long_wide_identity(panel):
    long = RS.observations(panel, BOUND_METRICS)
    wide = RS.to_wide(long, BOUND_METRICS)
    a = panel.select(F.col("period"), F.col("naic").alias("naic_code"),
                     F.col("company").alias("company_name"), "line", "policy_type",
                     *BOUND_METRICS)
    b = wide.select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_slice_totals_equal_entity_sums_for_derived(panel):
    nf = M.entity_values(panel, "net_flow").groupBy("period").agg(
        M.exact_sum0("value").alias("s"))
    tot = M.slice_totals(panel, "net_flow")
    j = nf.join(tot, "period")
    assert j.filter(F.col("s") != F.col("total")).count() == 0


def test_input_order_does_not_change_facts(spark, panel):
    shuffled = panel.repartition(7, "naic").sortWithinPartitions(F.rand(1))
    a = snapshot_view(panel, ViewSpec(metric="dpw", topn=5), all_periods=True)
    b = snapshot_view(shuffled, ViewSpec(metric="dpw", topn=5), all_periods=True)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
