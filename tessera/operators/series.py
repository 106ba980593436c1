"""Series, growth and comparison.

One grouped pass computes every target × period value; ``dense`` spreads them over the
periods of the range so that a missing quarter is a null, not a collapsed gap.
``lag`` is partitioned by target: a partition holds one target's periods, a bound
set by the calendar, not by the data volume. The period catalogue is a table and enters
the plans as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.numbers import growth_pct, safe_ratio
from ..functions.text import period_key, period_text
from . import metrics as M
from .ranking import rank_top, with_names
from .slicing import (ordered_ends, period_range, periods_between, select_entities,
                      select_values)


def prev_period(p: Column, quarters: int) -> Column:
    """Calendar period ``quarters`` before a `YYYYQn` column."""
    k = (F.substring(p, 1, 4).cast("int") * 4 + F.substring(p, -1, 1).cast("int") - 1
         - F.lit(quarters))
    return period_text(F.floor(k / 4).cast("int"), (k % 4 + 1).cast("int"))


def calendar_shift(p: str, steps: int) -> str:
    k = int(p[:4]) * 4 + int(p[-1]) - 1 - steps
    return f"{k // 4}Q{k % 4 + 1}"


def dense(values: DataFrame, periods: Column, key: str = "target", fields=("value",),
          targets: DataFrame | None = None, back: int = 0) -> DataFrame:
    """Every target × every period of the array, missing quarters as nulls.

    One aggregation gathers a target's periods in a map (at most one entry per
    quarter of the calendar), then each target's row is exploded over the array. No
    join against a cross product, and the values are read once. ``targets`` (optional)
    is the list of targets to show, with or without values; else those with a value
    in the array's periods. ``back`` adds ``base``, the value that many calendar
    quarters before.
    """
    entry = F.struct(F.col("period"), F.struct(*fields).alias("v"))
    rows = values.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    if targets is not None:
        rows = targets.join(rows, key, "left")
    rows = rows.withColumn("_p", periods)
    if targets is None:
        rows = rows.where(F.arrays_overlap(F.map_keys("_m"), "_p"))
    out = rows.select(key, "_m", F.posexplode("_p").alias("pos", "period"))
    got = F.try_element_at(F.col("_m"), F.col("period"))
    cols = [got[f].alias(f) for f in fields]
    if back:
        early = F.try_element_at(F.col("_m"), prev_period(F.col("period"), back))
        cols.append(early[fields[0]].alias("base"))
    return out.select(key, "pos", "period", *cols)


def target_values(sl: DataFrame, metric_id: str, wind: str, period_from: str, period_to: str,
                  entities=(), available=None) -> tuple[DataFrame, DataFrame | None]:
    """Values per (target, period) of the range for the chosen entities, ``"all"``
    entities, or the ALL target (W9) when none is chosen.

    Returns (values, targets); targets is None when the values name them all.
    """
    spark = sl.sparkSession
    sl = period_range(sl, period_from, period_to)
    if isinstance(entities, str) and entities == "all":
        # Every entity with a fact in the slice.
        vals = M.entity_values(sl, metric_id, wind, available=available)
        return vals.select(F.col("naic").alias("target"), "period", "value"), None
    if isinstance(entities, DataFrame) or len(entities) > 0:
        vals = M.entity_values(select_entities(sl, entities), metric_id, wind,
                               available=available).withColumnRenamed("naic", "target")
        if isinstance(entities, DataFrame):
            targets = entities.select(F.col(entities.columns[0]).alias("target")).distinct()
        else:
            targets = spark.createDataFrame([(e,) for e in dict.fromkeys(entities)],
                                            "target string")
    else:
        vals = (M.slice_totals(sl, metric_id, wind, value="value", available=available)
                  .withColumn("target", F.lit(C.ALL_TARGET)))
        targets = spark.createDataFrame([(C.ALL_TARGET,)], "target string")
    return vals.select("target", "period", "value"), targets


def series(sl: DataFrame, metric_id: str, wind: str, periods, period_from: str,
           period_to: str, entities=(), transform: str = "abs", basis: str = "position",
           companies: DataFrame | None = None, available=None) -> DataFrame:
    """W8/W9 with W6/W7: columns target, name, period, value, display.

    ``periods`` is the catalogue: a table with a ``period`` column, or a list.
    ``basis='position'`` steps back by rows of the selected range (Q5 KEEP);
    ``basis='calendar'`` compares with the calendar quarter / year before, read
    before the range cut. A quarter without facts is 0 for the ALL target of a
    metric that is a sum (A7), null otherwise.
    """
    lo, hi = ordered_ends(period_from, period_to)
    step = {"abs": 0, "qoq": 1, "yoy": 4}[transform]
    back = step if basis == "calendar" else 0
    vals, targets = target_values(sl, metric_id, wind, calendar_shift(lo, back), hi, entities,
                                  available)
    grid = dense(vals, periods_between(periods, lo, hi), targets=targets, back=back)
    whole = not isinstance(entities, (str, DataFrame)) and not len(entities)
    if whole and not C.metric(metric_id).ratio:
        grid = grid.withColumns({f: F.coalesce(f, F.lit(0.0))
                                 for f in ("value", "base") if f in grid.columns})
    if not step:
        disp = F.col("value")
    elif not back:
        w = Window.partitionBy("target").orderBy("pos")
        disp = growth_pct(F.col("value"), F.lag("value", step).over(w))
    else:
        disp = growth_pct(F.col("value"), F.col("base"))
    out = grid.select("target", "period", "pos", "value", disp.alias("display"))
    if companies is not None:
        labels = companies.select(F.col("naic").alias("target"), F.col("name").alias("_n"))
        out = out.join(labels, "target", "left")
    else:
        out = out.withColumn("_n", F.lit(None).cast("string"))
    name = (F.when(F.col("target") == C.ALL_TARGET, F.lit(C.ALL_TARGET_NAME))
             .otherwise(F.coalesce(F.col("_n"), F.col("target"))))
    return out.select("target", name.alias("name"), "period", "value", "display")


def series_table(long: DataFrame, targets: list[str], value: str = "display") -> DataFrame:
    """W8 table: periods as rows, one column per series (explicit pivot values)."""
    return (long.groupBy("period").pivot("target", list(targets)).agg(F.first(value))
                .orderBy(period_key(F.col("period"))))


def shares(sl: DataFrame, metric_id: str, wind: str = "all", available=None) -> DataFrame:
    """Every entity's share of its period's slice total (null for ratio metrics)."""
    vals = M.entity_values(sl, metric_id, wind, available=available).filter(
        F.col("value").isNotNull())
    if C.metric(metric_id).ratio:
        return vals.select("period", "naic", "value", F.lit(None).cast("double").alias("share"))
    tot = vals.groupBy("period").agg(M.exact_sum("value").alias("total"))
    return vals.join(tot, "period").select(
        "period", "naic", "value", safe_ratio(F.col("value"), F.col("total")).alias("share"))


def share_delta(sl: DataFrame, metric_id: str, periods, period_from: str,
                period_to: str, wind: str = "all", available=None) -> DataFrame:
    """Share and its change against the previous period of the range.

    Dense per entity: an entity absent in a period has a null share there, and
    null change there and in the next period.
    """
    sh = shares(period_range(sl, period_from, period_to), metric_id, wind, available)
    grid = dense(sh, periods_between(periods, period_from, period_to), "naic",
                 ("value", "share"))
    w = Window.partitionBy("naic").orderBy("pos")
    prev = F.lag("share", 1).over(w)
    return grid.select("period", "naic", "value", "share",
                       (F.col("share") - prev).alias("share_delta"))


def growth_rank(sl: DataFrame, metric_id: str, period: str, transform: str = "qoq",
                n: int | None = 20, wind: str = "all", companies: DataFrame | None = None,
                available=None) -> DataFrame:
    """Growth of every entity at ``period`` against the calendar base, ranked.

    Both quarters come from one pass: a value per (entity, quarter), then one row per
    entity with the two beside each other.
    """
    base_p = calendar_shift(period, 1 if transform == "qoq" else 4)
    vals = M.entity_values(select_values(sl, "period", [period, base_p]), metric_id, wind,
                           available=available)
    is_now = F.col("period") == period
    pair = vals.groupBy("naic").agg(
        F.max(F.when(is_now, F.col("value"))).alias("now"),
        F.max(F.when(~is_now, F.col("value"))).alias("base"))
    g = pair.select(F.lit(period).alias("period"), "naic", "now", "base",
                    growth_pct(F.col("now"), F.col("base")).alias("value"))
    ranked = rank_top(g, n)
    return with_names(ranked, companies).select("period", "rank", "naic", "company", "now",
                                                "base", F.col("value").alias("growth"))


def new_and_dropped(sl: DataFrame, periods) -> DataFrame:
    """Entities new or dropped against the prior period of the catalogue.

    One distinct set of (entity, period); an entity's neighbouring periods are the
    rows before and after it, so nothing is joined to itself.
    """
    catalogue = periods_between(periods, "0000Q1", "9999Q4")
    held = sl.select("naic", "period").distinct().withColumn("_all", catalogue)
    held = held.withColumn("pos", F.array_position("_all", F.col("period"))).where("pos > 0")
    w = Window.partitionBy("naic").orderBy("pos")
    held = held.withColumns({"_before": F.lag("pos").over(w), "_after": F.lead("pos").over(w)})
    new = F.when((F.col("pos") > 1) & ~F.col("_before").eqNullSafe(F.col("pos") - 1),
                 F.struct(F.col("period").alias("period"), F.lit("new").alias("change")))
    gone = F.when((F.col("pos") < F.size("_all")) & ~F.col("_after").eqNullSafe(F.col("pos") + 1),
                  F.struct(F.try_element_at("_all", (F.col("pos") + 1).cast("int")).alias("period"),
                           F.lit("dropped").alias("change")))
    events = F.array_compact(F.array(new, gone))
    return held.select("naic", F.explode(events).alias("e")).select(
        F.col("e.period").alias("period"), "naic", F.col("e.change").alias("change"))
