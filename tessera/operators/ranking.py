"""Rankings, top-N, market share and the "All others" row.

Plan notes:
* top-N per period is ``row_number`` + ``rank <= n``: Catalyst plans a
  ``WindowGroupLimit`` on each map partition before the shuffle, so a period
  with any number of entities ships at most n rows per partition;
* a full ranking (no limit) of a period never goes through one task: the
  rows are range-partitioned on the sort key, numbered within each range and
  shifted by the counts of earlier ranges (``distributed_rank``);
* slice totals are a ``groupBy(period)`` joined back — one row per period,
  a bound that does not grow with entities — never a window over the period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..session import materialize
from ..functions.numbers import exact_sum0, safe_ratio
from ..functions.text import naic_sort_keys
from .metrics import parts_of

def _order(value: str, key: str):
    return [F.col(value).desc()] + naic_sort_keys(key)


def rank_top(values: DataFrame, n: int | None, part: str = "period", value: str = "value",
             key: str = "naic", rank: str = "rank") -> DataFrame:
    """Drop null values, order by value desc (ties: Q10 key order), rank 1..n.

    ``n=None`` ranks every row (distributed, see ``distributed_rank``); a number is
    what a report shows, and map partitions ship that many rows per period at most.
    """
    v = values.filter(F.col(value).isNotNull())
    if n is None:
        return distributed_rank(v, part, value, key, rank)
    w = Window.partitionBy(part).orderBy(*_order(value, key))
    return (v.withColumn(rank, F.row_number().over(w).cast("bigint"))
             .filter(F.col(rank) <= n))


def distributed_rank(df: DataFrame, part: str, value: str, key: str,
                     rank: str = "rank", partitions: int | None = None) -> DataFrame:
    """Exact row_number per ``part`` without putting a whole part in one task.

    1. range-partition on (part, value desc, key order) — Spark samples the
       bounds, so a hot part is spread over many ranges;
    2. number rows inside each (range, part) slice — each slice lives in one range;
    3. offsets = running count of the same part in earlier ranges (a table of
       ranges × parts rows, small), joined back.
    """
    order = [F.col(part).asc()] + _order(value, key)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The range id is written with the rows: the numbering branch and the count
    # branch must read one split (a partition id is not stable across plans).
    ranged = materialize(df.repartitionByRange(n, *order)
                           .withColumn("_range", F.spark_partition_id()), "rank")
    w_local = Window.partitionBy("_range", part).orderBy(*_order(value, key))
    local = ranged.withColumn("_local", F.row_number().over(w_local))
    counts = ranged.groupBy("_range", part).agg(F.count(F.lit(1)).alias("_n"))
    w_off = (Window.partitionBy(part).orderBy("_range")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_range", part,
                            F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    return (local.join(offsets, ["_range", part])
                 .withColumn(rank, (F.col("_local") + F.col("_off")).cast("bigint"))
                 .drop("_range", "_local", "_off"))


def with_names(df: DataFrame, companies: DataFrame | None, key: str = "naic",
               name: str = "company") -> DataFrame:
    """Display label from the companies dimension, falling back to the key.

    Joined after aggregation and top-N, so only the shown rows are labelled.
    """
    if companies is None:
        return df.withColumn(name, F.col(key))
    labels = companies.select(F.col("naic").alias(key), F.col("name").alias("_name"))
    return (df.join(labels, key, "left")
              .withColumn(name, F.coalesce(F.col("_name"), F.col(key)))
              .drop("_name"))


def period_totals(values: DataFrame, part: str = "period", value: str = "value") -> DataFrame:
    """The sum of the shown metric over all entities of the slice (0 when empty)."""
    return values.groupBy(part).agg(exact_sum0(value).alias("total"))


def snapshot(values: DataFrame, n: int | None, metric_id: str, share: bool = False,
             companies: DataFrame | None = None, part: str = "period",
             key: str = "naic") -> DataFrame:
    """Rank or share view of per-entity values for each period, ordered by period and rank.

    Columns: period, rank, naic, company, value[, share]. ``n=None`` shows all. With
    ``share`` an "All others" row (rank and naic null) carries the rest of the slice
    when it is > 0: the sum beyond rank n, or for a ratio metric the ratio of the
    rest's sums (the values then carry their parts, ``entity_values(keep_parts=True)``).
    For ratio metrics the share is null (Q3 fix).

    The values are written once: they are read for the top rows and for the rest.
    """
    ratio = C.metric(metric_id).ratio
    cols = [part, "rank", key, "company", "value"]
    if not share:
        top = with_names(rank_top(values, n, part, "value", key), companies, key)
        return top.select(*cols).orderBy(part, "rank")
    values = materialize(values, "values")
    top = rank_top(values, n, part, "value", key)
    shown = with_names(top, companies, key).select(*cols)
    if n is not None:
        rest = values.join(top.select(part, key), [part, key], "left_anti").groupBy(part)
        if ratio:
            num, den = (f"_sum_{k}" for k in parts_of(metric_id))
            rest = rest.agg(exact_sum0(num).alias("_n"), exact_sum0(den).alias("_d")).select(
                part, safe_ratio("_n", "_d").alias("value"))
        else:
            rest = rest.agg(exact_sum0("value").alias("value"))
        shown = shown.unionByName(rest.where("value > 0").select(
            part, F.lit(None).cast("bigint").alias("rank"),
            F.lit(None).cast("string").alias(key), F.lit(C.OTHERS_LABEL).alias("company"),
            "value"))
    if ratio:
        out = shown.withColumn("share", F.lit(None).cast("double"))
    else:
        out = shown.join(period_totals(values, part), part).select(
            *cols, safe_ratio(F.col("value"), F.col("total")).alias("share"))
    return out.orderBy(part, F.col("rank").asc_nulls_last())


def sort_key(df: DataFrame, col: str) -> F.Column:
    """W5's key: numbers with null → 0 (the others row reads rank 0), text in locale order
    (UNICODE collation) with null → ''."""
    if dict(df.dtypes)[col] == "string":
        return F.collate(F.coalesce(F.col(col), F.lit("")), "UNICODE")
    return F.coalesce(F.col(col).cast("double"), F.lit(0.0))


def resort(df: DataFrame, col: str, direction: int = -1, position: str | None = None) -> DataFrame:
    """Re-sort the rows already cut to n by any column, either way.

    Rows that are equal there keep the view's order (period, then rank, others last).
    ``position`` adds a column with each row's place, so the order survives a join or a file.
    The view is cut to a report's size, so its rows are numbered in one task.
    """
    k = sort_key(df, col)
    ties = [F.col(c).asc_nulls_last() for c in ("period", "rank") if c in df.columns and c != col]
    order = [k.asc() if direction > 0 else k.desc(), *ties]
    if position:
        place = F.row_number().over(Window.orderBy(*order)).cast("bigint")
        df = df.withColumn(position, place)
        return df.orderBy(position)
    return df.orderBy(*order)


def positions(df: DataFrame, *order, position: str = "position",
              partitions: int | None = None) -> DataFrame:
    """Rows of any number with their place in a global order, sorted by it.

    Ranges of the order are numbered side by side and shifted by the sizes of the ranges before
    them (one row per range); no task sees all rows."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *order)
                           .withColumn("_range", F.spark_partition_id()), "positions")
    local = ranged.withColumn("_local", F.row_number().over(
        Window.partitionBy("_range").orderBy(*order)))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (local.join(before, "_range")
                 .withColumn(position, (F.col("_local") + F.col("_off")).cast("bigint"))
                 .drop("_range", "_local", "_off").orderBy(position))


def suppressed_entities(sl: DataFrame, metric_col: str, part: str = "period",
                        key: str = "naic") -> DataFrame:
    """Q12: entities of the slice with no value for the metric, and how many of
    their cells were suppressed — shown unranked beside a ranking, never as 0."""
    sup = (F.array_contains(F.col("suppressed"), F.lit(metric_col)).cast("int")
           if "suppressed" in sl.columns else F.lit(0))
    g = sl.groupBy(part, key).agg(F.count(F.col(metric_col)).alias("_vals"),
                                  F.sum(sup).cast("bigint").alias("n_suppressed"))
    return g.filter((F.col("_vals") == 0) & (F.col("n_suppressed") > 0)).drop("_vals")


def append_unranked(view: DataFrame, unranked: DataFrame, companies: DataFrame | None = None,
                    part: str = "period", key: str = "naic") -> DataFrame:
    """Q12 flag: append fully suppressed entities with no rank and no value."""
    rows = with_names(unranked, companies, key).select(
        part, F.lit(None).cast("bigint").alias("rank"), key, "company",
        F.lit(None).cast("double").alias("value"), *(
            [F.lit(None).cast("double").alias("share")] if "share" in view.columns else []))
    return view.unionByName(rows)
