"""Wide ↔ long.

``unpivot`` keeps nulls, so "present but blank" (null value) stays apart from
"column absent that quarter" (no row) and "suppressed" (null + flag).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slicing import present_metrics

LONG_COLUMNS = ["period", "period_end_date", "naic_code", "company_name", "line",
                "policy_type", "wind_basis", "metric", "value", "is_suppressed",
                "source_file_type", "source_file"]

# Layout-A column → (metric, line); line 'All' is the entity total.
A_LINES = {
    "a_pif": ("pif", "All"), "a_pif_commercial": ("pif", "Commercial Residential"),
    "a_pif_personal": ("pif", "Personal Residential"), "a_dpw": ("dpw", "All"),
    "a_dpw_commercial": ("dpw", "Commercial Residential"),
    "a_dpw_personal": ("dpw", "Personal Residential"),
}


def _src(df: DataFrame) -> F.Column:
    return F.col("source_file") if "source_file" in df.columns else F.lit(None).cast("string")


def _sup(df: DataFrame) -> F.Column:
    if "suppressed" in df.columns:
        return F.coalesce(F.array_contains(F.col("suppressed"), F.col("_col")), F.lit(False))
    return F.lit(False)


def _split_metric(col: str) -> tuple[str, str | None]:
    """'tiv_incl_wind' → ('tiv', 'incl'); 'pif' → ('pif', None). Resolved on the driver."""
    for basis in ("incl", "excl"):
        suffix = f"_{basis}_wind"
        if col.endswith(suffix):
            return col[: -len(suffix)], basis
    return col, None


def observations(filings: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Layout-B wide facts → one row per fact × metric column (nulls kept).

    wind_basis: ``_incl_wind`` → incl, ``_excl_wind`` → excl, a wind-only
    segment → wind_only, otherwise all. Metric names and bases are literals
    fixed when the plan is built (one struct per metric column, exploded), so
    no text is parsed per output row. Facts of a parsed grid say in ``present`` which
    metrics their sheet has a column for: an absent column gives no row.
    """
    metrics = metrics or sorted(present_metrics(filings))
    sup = (F.col("suppressed") if "suppressed" in filings.columns
           else F.array().cast("array<string>"))
    cells = []
    for m in metrics:
        base, basis = _split_metric(m)
        b = (F.lit(basis) if basis else
             F.when(F.col("is_wind_only"), F.lit("wind_only")).otherwise(F.lit("all")))
        cell = F.struct(F.lit(base).alias("metric"), b.alias("wind_basis"),
                        F.col(m).cast("double").alias("value"),
                        F.coalesce(F.array_contains(sup, F.lit(m)), F.lit(False))
                        .alias("is_suppressed"))
        if "present" in filings.columns:
            cell = F.when(F.array_contains("present", m), cell)
        cells.append(cell)
    array = F.array(*cells)
    if "present" in filings.columns:
        array = F.array_compact(array)
    long = filings.select("*", F.explode(array).alias("_o"))
    return long.select(
        "period", F.col("period_end").alias("period_end_date"), F.col("naic").alias("naic_code"),
        F.col("company").alias("company_name"), "line", "policy_type",
        F.col("_o.wind_basis").alias("wind_basis"), F.col("_o.metric").alias("metric"),
        F.col("_o.value").alias("value"), F.col("_o.is_suppressed").alias("is_suppressed"),
        F.lit("B").alias("source_file_type"), _src(filings).alias("source_file"))


def observations_a(summary: DataFrame) -> DataFrame:
    """Layout-A facts → long rows with the line per column, null segment."""
    cols = [c for c in A_LINES if c in summary.columns]
    ids = [c for c in ["period", "period_end", "naic", "company", "suppressed", "present",
                       "source_file"] if c in summary.columns]
    long = summary.select(*ids, *cols).unpivot(ids, cols, "_col", "value")
    if "present" in ids:
        long = long.filter(F.array_contains("present", F.col("_col")))
    mapping = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(A_LINES[c][0]))])
    lines = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(A_LINES[c][1]))])
    pe = F.col("period_end") if "period_end" in ids else F.lit(None).cast("date")
    return long.select(
        "period", pe.alias("period_end_date"), F.col("naic").alias("naic_code"),
        F.col("company").alias("company_name"), lines[F.col("_col")].alias("line"),
        F.lit(None).cast("string").alias("policy_type"), F.lit("all").alias("wind_basis"),
        mapping[F.col("_col")].alias("metric"), "value", _sup(long).alias("is_suppressed"),
        F.lit("A").alias("source_file_type"), _src(long).alias("source_file"))


def to_wide(long: DataFrame, metrics: list[str]) -> DataFrame:
    """Inverse of N13 for Layout B (explicit pivot values: no extra job)."""
    col = (F.when(F.col("wind_basis") == "incl", F.concat(F.col("metric"), F.lit("_incl_wind")))
            .when(F.col("wind_basis") == "excl", F.concat(F.col("metric"), F.lit("_excl_wind")))
            .otherwise(F.col("metric")))
    keys = ["period", "naic_code", "company_name", "line", "policy_type"]
    return (long.withColumn("_col", col).groupBy(*keys).pivot("_col", metrics)
                .agg(F.first("value")))
