"""Slices of the filings panel.

Filters are plain Column predicates so Catalyst pushes them into the scan
(partition pruning on ``period`` when the panel is stored partitioned by it).
A selection is a list of values, which stays a pushed predicate whatever its length,
or a DataFrame, which becomes a left-semi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.text import period_key


def metric_column(metric_id: str, wind: str, available) -> str:
    """The panel column for a metric and wind basis.

    Falls back to the base metric when the split column exists in no period
    (``available`` is the set of metric columns present, N12).
    """
    m = C.metric(metric_id)
    if m.derived or not m.wind or wind == "all":
        return metric_id
    col = metric_id + ("_excl_wind" if wind == "excl" else "_incl_wind")
    return col if col in set(available) else metric_id


def present_metrics(df: DataFrame) -> set[str]:
    """N12 on a wide panel: metric columns that exist in its schema."""
    keys = set(C.layout_b_metric_keys()) | set(C.layout_a_metric_keys())
    return {c for c in df.columns if c in keys}


def _in(col: str, values) -> Column:
    return F.col(col).isin(list(values))


def select_values(df: DataFrame, col: str, values) -> DataFrame:
    """Keep rows whose ``col`` is in ``values`` (a list or a one-column DataFrame)."""
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias(col)).distinct()
        return df.join(keys, col, "left_semi")
    return df.filter(_in(col, values))


def slice_filings(df: DataFrame, period=None, periods=None, line: str = "all",
                  wind_only: bool = False, segments=()) -> DataFrame:
    """Period (one or a list) ∧ line ∧ wind-only flag ∧ segment set."""
    out = df
    if period is not None:
        out = out.filter(F.col("period") == F.lit(period))
    if periods is not None:
        out = select_values(out, "period", periods)
    if line != "all":
        out = out.filter(F.col("line") == F.lit(line))
    if wind_only:
        out = out.filter(F.col("is_wind_only"))
    if isinstance(segments, DataFrame) or len(segments) > 0:
        out = select_values(out, "policy_type", segments)
    return out


def period_range(df: DataFrame, a: str, b: str, col: str = "period") -> DataFrame:
    """Inclusive range, ends swapped when reversed.

    Written on the text itself (YYYYQn sorts as text), so the predicate is a
    pushable range on the partition column.
    """
    lo, hi = ordered_ends(a, b)
    return df.filter((F.col(col) >= F.lit(lo)) & (F.col(col) <= F.lit(hi)))


def ordered_ends(a: str, b: str) -> tuple[str, str]:
    """The two ends of a range, swapped when reversed (YYYYQn sorts as text)."""
    return (a, b) if a <= b else (b, a)


def periods_between(periods, a: str, b: str) -> Column:
    """The ordered periods of a range as an array column.

    ``periods`` is a list, a table with a ``period`` column, or an array column.
    """
    lo, hi = ordered_ends(a, b)
    if isinstance(periods, DataFrame):
        from .dims import period_array
        return period_array(periods, lo, hi)
    if not isinstance(periods, Column):
        periods = F.array_sort(F.array(*[F.lit(p) for p in dict.fromkeys(periods)])
                               .cast("array<string>"))
    return F.filter(periods, lambda p: (p >= F.lit(lo)) & (p <= F.lit(hi)))


def select_entities(df: DataFrame, entities) -> DataFrame:
    """P5: entity selection; empty means the whole slice."""
    if isinstance(entities, DataFrame) or len(entities) > 0:
        return select_values(df, "naic", entities)
    return df


def project(df: DataFrame, columns) -> DataFrame:
    """Show / hide columns."""
    return df.select(*columns)


def order_periods(df: DataFrame, col: str = "period") -> DataFrame:
    return df.orderBy(period_key(F.col(col)))


def metrics_on_offer(metrics_catalogue: DataFrame, present: DataFrame) -> DataFrame:
    """Catalogue metrics that are derived or whose column appears in the data.

    ``present`` is N12's one-column table of metric keys seen in the headers.
    """
    seen = present.select(F.col(present.columns[0]).alias("id")).distinct()
    derived = metrics_catalogue.filter(F.col("derived"))
    in_data = metrics_catalogue.join(seen, "id", "left_semi")
    return derived.unionByName(in_data)
