"""Metric aggregation.

Three null rules, written once in ``_plan`` (Q1):
* a base metric per entity is the sum of non-null values, null when none;
* derived metrics sum their parts with null → 0, then combine;
* a whole-slice total is 0 when empty.
Ratios are ratios of sums (Q2).

Every operator is a single ``groupBy`` (partial aggregation before the shuffle) that
sums each source column once, whatever the number of metrics built on it. ``available``
is the set of metric keys seen in the headers (N12): it decides the wind fallback
(P2). By default it is the panel's own columns — a bound panel carries only the metrics
it has, a parsed grid carries all keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.numbers import exact_sum, exact_sum0, safe_ratio  # noqa: F401  (users sum with these)
from .slicing import metric_column

# Derived metrics by metric key: signed terms, or numerator and denominator.
FLOWS = {"net_flow": {"new_written": 1, "received_in": 1, "cancelled": -1, "nonrenewed": -1,
                      "transferred_out": -1}}
RATIOS = {"avg_premium": ("dpw", "pif"), "rate_on_line": ("dpw", "tiv"),
          "wind_concentration": ("tiv_incl_wind", "tiv")}


def parts_of(metric_id: str) -> list[str]:
    """A2: the metric keys a derived metric is built from."""
    return list(FLOWS[metric_id]) if metric_id in FLOWS else list(RATIOS[metric_id])


def _sum_name(key: str) -> str:
    return f"_sum_{key}"


def _part(key: str) -> Column:
    return F.coalesce(F.col(_sum_name(key)), F.lit(0.0))


def derived_value(metric_id: str) -> Column:
    """A3-A6 on the summed parts."""
    if metric_id in FLOWS:
        value = None
        for key, sign in FLOWS[metric_id].items():
            term = _part(key)
            value = term if value is None else value + term if sign > 0 else value - term
        return value
    if metric_id in RATIOS:
        num, den = RATIOS[metric_id]
        return safe_ratio(_part(num), _part(den))
    raise ValueError(f"not a derived metric: {metric_id}")


def _plan(df: DataFrame, metric_ids, wind: str, available,
          empty_is_zero: bool) -> tuple[list[Column], list[Column]]:
    """(aggregates, output columns) of several metrics: one sum per source column."""
    available = df.columns if available is None else available
    sums: dict[str, Column] = {}
    out = []

    def add(key: str) -> None:
        # A part that the panel does not have contributes nothing.
        source = F.col(key) if key in df.columns else F.lit(None).cast("double")
        sums.setdefault(_sum_name(key), exact_sum(source).alias(_sum_name(key)))

    for metric_id in metric_ids:
        m = C.metric(metric_id)
        if m.derived:
            for key in parts_of(metric_id):
                add(key)
            value = derived_value(metric_id)
        else:
            key = metric_column(metric_id, wind, available)
            add(key)
            value = _part(key) if empty_is_zero else F.col(_sum_name(key))
        out.append(value.alias(metric_id))
    return list(sums.values()), out


def _aggregate(df: DataFrame, by, metric_ids, wind: str, available,
               empty_is_zero: bool = False, keep_parts: bool = False) -> DataFrame:
    by = list(by)
    sums, out = _plan(df, metric_ids, wind, available, empty_is_zero)
    g = df.groupBy(*by).agg(*sums)
    kept = [c for c in g.columns if c not in by] if keep_parts else []
    return g.select(*by, *out, *kept)


def entity_values(df: DataFrame, metric_id: str, wind: str = "all",
                  by=("period", "naic"), value: str = "value", available=None,
                  keep_parts: bool = False) -> DataFrame:
    """A1/A2: one value per group (default entity × period). ``keep_parts`` keeps the
    sums a derived metric is built from, for values of several entities together."""
    out = _aggregate(df, by, [metric_id], wind, available, keep_parts=keep_parts)
    return out.withColumnRenamed(metric_id, value)


def slice_totals(df: DataFrame, metric_id: str, wind: str = "all", by=("period",),
                 value: str = "total", available=None) -> DataFrame:
    """Whole-slice scalar per group: sum (0 when empty) or ratio of sums."""
    out = _aggregate(df, by, [metric_id], wind, available, empty_is_zero=True)
    return out.withColumnRenamed(metric_id, value)


def slice_totals_many(df: DataFrame, metric_ids, wind: str = "all", by=("period",),
                      available=None) -> DataFrame:
    """A7 for several metrics in one aggregation (one pass, one shuffle)."""
    return _aggregate(df, by, metric_ids, wind, available, empty_is_zero=True)


def multi_metric(df: DataFrame, metric_ids, wind: str = "all", by=("period", "naic"),
                 available=None) -> DataFrame:
    """Several metrics in one aggregation (one shuffle)."""
    return _aggregate(df, by, metric_ids, wind, available)


def entity_and_totals(df: DataFrame, metric_id: str, wind: str = "all",
                      part: str = "period", key: str = "naic", available=None) -> DataFrame:
    """Per-entity values and the whole-slice value in one pass.

    GROUPING SETS ((part, key), (part)); the total rows carry ``is_total`` and a
    null key. Base metrics keep A1's null rule per entity and A7's 0 for totals.
    """
    sums, out = _plan(df, [metric_id], wind, available, False)
    g = (df.groupingSets([[part, key], [part]], part, key)
           .agg(*sums, F.grouping(key).alias("_g"))
           .select(part, key, (F.col("_g") == 1).alias("is_total"), out[0].alias("value")))
    if C.metric(metric_id).derived:
        return g
    zero = F.when(F.col("is_total"), F.coalesce("value", F.lit(0.0))).otherwise(F.col("value"))
    return g.withColumn("value", zero)


def free_rollup(df: DataFrame, dims, metric_ids, kind: str = "groupby", wind: str = "all",
                available=None) -> DataFrame:
    """Any dimensions; ``kind`` = groupby | rollup | cube (subtotals get null keys
    and a ``grouping_id``)."""
    dims = list(dims)
    if kind == "groupby":
        return _aggregate(df, dims, metric_ids, wind, available)
    if kind not in ("rollup", "cube"):
        raise ValueError(f"kind must be groupby, rollup or cube, not {kind!r}")
    sums, out = _plan(df, metric_ids, wind, available, False)
    g = df.rollup(*dims) if kind == "rollup" else df.cube(*dims)
    return g.agg(*sums, F.grouping_id(*dims).alias("grouping_id")).select(
        *dims, "grouping_id", *out)


WIND_BASIS = "wind_basis"


def rollup_sets(df: DataFrame, sets, metric_ids, available=None) -> DataFrame:
    """Any list of grouping sets, over columns of the panel and the wind basis.

    ``sets`` is a list of lists of dimensions; ``wind_basis`` is one of them: ``incl`` and
    ``excl`` rows come from a metric's wind columns, ``wind_only`` and ``all`` from the whole
    metric of wind-only and other segments (N13's rule). A set without it counts the whole
    metric only, so nothing counts twice.

    A fact is copied once per set (and basis) inside one generator, folded map-side and
    shuffled once: facts are not unpivoted first. Columns: the dimensions (null where rolled
    up), ``grouping_id`` (SQL's, over the dimensions in order of first mention), the metrics.
    """
    dims = list(dict.fromkeys(d for s in sets for d in s))
    available = set(df.columns if available is None else available) & set(df.columns)
    keys = list(dict.fromkeys(
        k for m in metric_ids for k in (parts_of(m) if C.metric(m).derived else [m])))
    types = dict(df.dtypes) | {WIND_BASIS: "string"}

    def number(key: str) -> Column:
        return F.col(key) if key in available else F.lit(None).cast("double")

    def copy(chosen, basis: Column, suffix: str) -> Column:
        gid = sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in chosen)
        shown = [(basis if d == WIND_BASIS else F.col(d)) if d in chosen
                 else F.lit(None).cast(types[d]) for d in dims]
        return F.struct(F.lit(gid).cast("long").alias("grouping_id"),
                        *[c.cast(types[d]).alias(d) for c, d in zip(shown, dims, strict=True)],
                        *[number(k + suffix).cast("double").alias(k) for k in keys])

    whole = F.when(F.col("is_wind_only"), F.lit("wind_only")).otherwise(F.lit("all"))
    copies = []
    for chosen in sets:
        copies.append(copy(chosen, whole, ""))
        if WIND_BASIS in chosen:
            copies += [copy(chosen, F.lit(b), f"_{b}_wind") for b in ("incl", "excl")
                       if any(f"{k}_{b}_wind" in available for k in keys)]
    rows = df.select(F.explode(F.array(*copies)).alias("g")).select("g.*")
    return _aggregate(rows, ["grouping_id", *dims], metric_ids, "all", keys).select(
        *dims, "grouping_id", *metric_ids)


def breakdown(df: DataFrame, metric_id: str, by: str = "line", wind_split: bool = False,
              part: str = "period", available=None) -> DataFrame:
    """Data behind stacked bars — by line, or incl vs excl wind.

    ``wind_split`` unpivots the metric's wind columns that are available into
    (basis, value) rows; without any, the whole metric has basis ``all``.
    """
    if not wind_split:
        return entity_values(df, metric_id, "all", by=(part, by), available=available)
    seen = set(df.columns if available is None else available) & set(df.columns)
    cols = [c for c in (metric_id + "_incl_wind", metric_id + "_excl_wind") if c in seen]
    if not cols:
        return entity_values(df, metric_id, "all", by=(part,),
                             available=available).withColumn("basis", F.lit("all"))
    sums = df.groupBy(part).agg(*[exact_sum(c).alias(c) for c in cols])
    long = sums.unpivot([part], cols, "column", "value")
    basis = F.regexp_extract(F.col("column"), r"_(incl|excl)_wind$", 1)
    return long.select(part, basis.alias("basis"), "value")
