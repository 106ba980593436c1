"""The n-gram index against the scan, grouping sets with the wind basis, sketches, orders."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import name_index as NI
from tessera.operators import ranking as R
from tessera.operators import search as SE
from tessera.operators import sketches as SK
from tessera.sources import sinks

NAMES = ["Acme Mutual", "ACME mutual of Florida", "Béta & Söhne", "aaaaaa", "aa", "", "x", "100% (Re)",
         "Gulf  Coast", "mutual mutual", "Ünïon Re"]


def companies(spark, n=400):
    rng = random.Random(7)
    rows = [(str(10_000 + i), rng.choice(NAMES) + rng.choice(["", " Inc", f" {i % 13}"]),
             rng.sample(NAMES, rng.randint(0, 3)) or None) for i in range(n)]
    rows += [("7", None, ["only historic"]), ("123456", "Plain", None)]
    return spark.createDataFrame(rows, "naic string, name string, names array<string>")


def test_index_equals_scan(spark, tmpdir_path):
    base = companies(spark)
    sinks.publish({"companies": base} | NI.index_tables(base), tmpdir_path)
    stored = sinks.load_dataset(spark, tmpdir_path, ("companies", "name_grams", "gram_counts"))
    base, grams, counts = stored.values()
    rng = random.Random(3)
    queries = ["", "a", "aa", "aaa", "AAAA", "mutual", "utual m", "  c", "100", "é", "söh", "zzz", "aaab",
               "0%", "historic", "123456", "% (r"]
    queries += [x[i:i + rng.randint(3, 7)] for x in NAMES for i in (0, 2, 4)]
    for q in queries:
        want = [tuple(r) for r in SE.search_entities(base, q).collect()]
        assert [tuple(r) for r in NI.search_index(base, grams, counts, q).collect()] == want, q
    assert NI.search_index(base, grams, counts, "mutual").count() > 50


def test_look_ups_push_the_grams(spark, tmpdir_path):
    base = companies(spark)
    path = os.path.join(tmpdir_path, "grams")
    NI.name_grams(base).write.parquet(path)
    grams = spark.read.parquet(path)
    plan = NI.search_index(base, grams, NI.gram_counts(grams), "florida")._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "In(gram, [" in text and "LeftSemi" in text
    # Sorted by gram: a file of many grams can be skipped by its bounds.
    order = [r.gram for r in spark.read.parquet(grams.inputFiles()[0]).collect()]
    assert order == sorted(order)


PANEL = ("period string, naic string, line string, is_wind_only boolean, tiv double, tiv_incl_wind double, "
         "tiv_excl_wind double, pif double")


def test_grouping_sets_by_wind_basis(spark):
    rows = [("2024Q1", "1", "C", False, 10.0, 4.0, 6.0, 1.0), ("2024Q1", "2", "C", True, 5.0, None, None, 2.0),
            ("2024Q2", "1", "P", False, None, None, 3.0, None), ("2024Q1", None, "P", False, 7.0, 7.0, 0.0, 4.0)]
    df = spark.createDataFrame(rows, PANEL)
    got = {tuple(r) for r in M.rollup_sets(df, [["line", "wind_basis"], ["naic"], []], ["tiv", "pif"]).collect()}
    assert got == {
        ("C", "all", None, 1, 10.0, 1.0), ("C", "incl", None, 1, 4.0, None), ("C", "excl", None, 1, 6.0, None),
        ("C", "wind_only", None, 1, 5.0, 2.0), ("P", "all", None, 1, 7.0, 4.0),
        ("P", "incl", None, 1, 7.0, None), ("P", "excl", None, 1, 3.0, None),
        (None, None, "1", 6, 10.0, 1.0), (None, None, "2", 6, 5.0, 2.0), (None, None, None, 6, 7.0, 4.0),
        (None, None, None, 7, 22.0, 7.0)}
    ratio = M.rollup_sets(df, [["wind_basis"]], ["wind_concentration"], available={"tiv", "tiv_incl_wind"})
    assert {r.wind_basis for r in ratio.collect()} == {"all", "wind_only", "incl"}
    plan = M.rollup_sets(df, [["line", "wind_basis"], []], ["tiv"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and plan.count("Generate") == 1 and "partial_" in plan


def test_sketches_merge_and_are_replaced(spark):
    facts = spark.range(40_000).select(
        F.concat(F.lit("2024Q"), (F.col("id") % 4 + 1).cast("string")).alias("period"),
        (F.col("id") % 15_000).cast("string").alias("naic"),
        F.when(F.col("id") % 7 > 0, (F.col("id") % 7).cast("string")).alias("policy_type"))
    kept = SK.period_sketches(facts)
    assert kept.count() == 4
    told = SK.estimates(kept).first()
    assert (told.periods, told.facts, told.segments) == (4, 40_000, 6)
    assert abs(told.entities - 15_000) <= SK.BOUND * 15_000
    assert abs(told.pairs - facts.where("policy_type IS NOT NULL").select("naic", "policy_type").distinct()
               .count()) <= SK.BOUND * 40_000
    again = facts.where("period = '2024Q2' AND id < 400")
    newer = SK.estimates(SK.replace_periods(kept, SK.period_sketches(again)), ["period"])
    assert {r.period: r.facts for r in newer.collect()} == {
        "2024Q1": 10_000, "2024Q2": 100, "2024Q3": 10_000, "2024Q4": 10_000}
    none = SK.estimates(SK.period_sketches(facts.limit(0))).first()
    assert (none.periods, none.facts, none.entities) == (0, 0, 0)


def test_resorted_rows_keep_the_order_of_the_view(spark):
    rows = [("2024Q1", 1, "b", 5.0), ("2024Q1", 2, "A", 3.0), ("2024Q1", 3, "a", 3.0), ("2024Q1", 4, None, None),
            ("2024Q1", None, "All others", 3.0)]
    view = spark.createDataFrame(rows, "period string, rank long, company string, value double").repartition(3)

    def order(col, direction):
        out = R.resort(view, col, direction, position="position").collect()
        assert [r.position for r in out] == [1, 2, 3, 4, 5]
        assert [r.rank for r in R.resort(view, col, direction).collect()] == [r.rank for r in out]
        return [r.rank for r in out]

    assert order("value", 1) == [4, 2, 3, None, 1]
    assert order("value", -1) == [1, 2, 3, None, 4]
    assert order("rank", 1) == [None, 1, 2, 3, 4]
    assert order("company", 1) == [4, 3, 2, None, 1]


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_positions_without_one_task(spark, n):
    df = spark.range(n).select(((F.col("id") * 7919) % 1009).alias("x"))
    out = R.positions(df, F.col("x").desc(), partitions=7)
    rows = out.collect()
    assert [r.x for r in rows] == sorted((i * 7919 % 1009 for i in range(n)), reverse=True)
    assert [r.position for r in rows] == list(range(1, n + 1))
