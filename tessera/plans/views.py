"""Views composed from operators: snapshot (rank / share) and series.

Each function turns a ``ViewSpec`` into one lazy DataFrame. Nothing is
collected; the only driver-side input is the resolved spec.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import series as S
from ..functions.numbers import exact_sum0, safe_ratio
from ..operators.slicing import metric_column, period_range, select_entities, slice_filings
from .viewspec import ViewSpec


def snapshot_view(filings: DataFrame, spec: ViewSpec, companies: DataFrame | None = None,
                  all_periods: bool = False, available=None) -> DataFrame:
    """Rank or share view (3.2). ``all_periods`` ranks every period at once;
    ``available`` is N12's set of metric keys for the wind fallback (P2)."""
    sl = slice_filings(filings, period=None if all_periods else spec.period, line=spec.line,
                       wind_only=spec.wind_only, segments=spec.segments)
    share = spec.mode == "share"
    values = M.entity_values(sl, spec.metric, spec.wind, available=available,
                             keep_parts=share and spec.metric_info.ratio)
    out = R.snapshot(values, spec.topn, spec.metric, share=share, companies=companies)
    if spec.sort_col:
        out = R.resort(out, spec.sort_col, spec.sort_dir)
    return out


def series_view(filings: DataFrame, spec: ViewSpec, periods, companies: DataFrame | None = None,
                available=None) -> DataFrame:
    """Series view (3.3): targets × range on a dense spine, optional QoQ/YoY, ordered by
    name, target and period. ``periods`` is the catalogue (a table or a list)."""
    sl = slice_filings(filings, line=spec.line, wind_only=spec.wind_only,
                       segments=spec.segments)
    return S.series(sl, spec.metric, spec.wind, periods, spec.period_from, spec.period_to,
                    entities=spec.entities, transform=spec.transform, basis=spec.basis,
                    companies=companies, available=available).orderBy("name", "target", "period")


def wind_applied(filings: DataFrame, spec: ViewSpec, available=None) -> str:
    """Q13: the column the wind choice resolved to."""
    return metric_column(spec.metric, spec.wind,
                         filings.columns if available is None else available)


def captions(filings: DataFrame, spec: ViewSpec, all_periods: bool = False,
             available=None) -> DataFrame:
    """P14 for a snapshot: per period, carriers with a value and the slice total.

    The slice total (Q4: named for what it is, not a published figure) is the
    sum over all entities, or the ratio of sums for a ratio metric (Q3).
    """
    sl = slice_filings(filings, period=None if all_periods else spec.period, line=spec.line,
                       wind_only=spec.wind_only, segments=spec.segments)
    return _captions(sl, spec, available)


def series_captions(filings: DataFrame, spec: ViewSpec, available=None) -> DataFrame:
    """P14 for a series: per period of the range, carriers with a value and the total of
    the chosen entities (all of the slice when none is chosen)."""
    sl = slice_filings(filings, line=spec.line, wind_only=spec.wind_only,
                       segments=spec.segments)
    sl = select_entities(period_range(sl, spec.period_from, spec.period_to), spec.entities)
    return _captions(sl, spec, available)


def _captions(sl: DataFrame, spec: ViewSpec, available) -> DataFrame:
    """One value per (period, entity) with its parts, then one row per period."""
    ratio = spec.metric_info.ratio
    values = M.entity_values(sl, spec.metric, spec.wind, available=available, keep_parts=ratio)
    carriers = F.count("value").alias("carriers")
    if not ratio:
        return values.groupBy("period").agg(carriers, exact_sum0("value").alias("slice_total"))
    num, den = (f"_sum_{k}" for k in M.parts_of(spec.metric))
    return (values.groupBy("period")
                  .agg(carriers, exact_sum0(num).alias("_n"), exact_sum0(den).alias("_d"))
                  .select("period", "carriers", safe_ratio("_n", "_d").alias("slice_total")))


def dataset_caption(filings: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """P14, the coverage line: first and last period, periods, facts and entities (one row).

    Distinct (period, entity) pairs with their number of facts come first, so the last
    step adds up small rows."""
    rows = filings.select("period", "naic")
    if summary is not None:
        rows = rows.unionByName(summary.select("period", "naic"))
    pairs = rows.groupBy("period", "naic").agg(F.count(F.lit(1)).alias("n"))
    per = pairs.groupBy("period").agg(F.sum("n").alias("n")).agg(
        F.min("period").alias("first"), F.max("period").alias("last"),
        F.count(F.lit(1)).alias("periods"), F.coalesce(F.sum("n"), F.lit(0)).alias("facts"))
    entities = pairs.select("naic").distinct().agg(F.count(F.lit(1)).alias("entities"))
    return per.withColumn("entities", entities.scalar())
