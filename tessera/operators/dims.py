"""Dimension tables (A11-A14, J5, Q-H, T1, T2).

Each dimension is one ``groupBy`` over the fact rows; per-entity arrays are
bounded by the number of distinct names an entity ever had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (clean_key, period_end, period_key, segment_family, segment_line,
                              segment_wind_only, title_period)


def stack_facts(filings: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """The rows both layouts contribute to the entity dimension.

    ``seq`` orders rows for "first seen": Layout B before A, then period, then
    the row number within the source sheet when there is one.
    """
    def part(df: DataFrame, layout: int) -> DataFrame:
        row = F.col("row_no").cast("bigint") if "row_no" in df.columns else F.lit(0).cast("bigint")
        # Layout, period key and row in one DECIMAL(38,0): a row number is a 64-bit integer
        # (under 10^19), so no part can run into another, and "first seen" is a plain
        # min() inside a hash aggregation.
        seq = (F.lit(layout).cast("decimal(38,0)") * F.lit("1" + "0" * 30).cast("decimal(31,0)")).cast(
            "decimal(38,0)") + (period_key(F.col("period")).cast("decimal(9,0)")
                                * F.lit("1" + "0" * 20).cast("decimal(21,0)")).cast("decimal(38,0)") + row
        seq = seq.cast("decimal(38,0)")
        return df.select("naic", "company", "period", seq.alias("seq"))

    out = part(filings, 0)
    if summary is not None:
        out = out.unionByName(part(summary, 1))
    return out


def companies(filings: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Naic, name, names ARRAY<STRING>, first, last, n_periods.

    Display name = most frequent non-empty name; ties → the one seen first, then the
    first in text order.
    Entities without any name show their key.

    One chain of two aggregations: (entity, name) with its count, first seen
    and periods, then per entity. The per-entity arrays hold names and periods,
    bounded by the calendar and the renames of one entity, not by data volume.
    """
    facts = stack_facts(filings, summary)
    pk = period_key(F.col("period"))
    per_name = (facts.groupBy("naic", "company")
                     .agg(F.count(F.lit(1)).alias("cnt"), F.min("seq").alias("first_seq"),
                          F.min_by("period", pk).alias("first"),
                          F.max_by("period", pk).alias("last"),
                          F.collect_set("period").alias("periods")))
    named = F.col("company") != ""
    # Most frequent, then first seen, then first in text order: the least of these.
    rank_key = F.struct((-F.col("cnt")).alias("n"), F.col("first_seq"), F.col("company"))
    out = (per_name.groupBy("naic")
                   .agg(F.min(F.when(named, rank_key))["company"]
                        .alias("name"),
                        F.array_sort(F.collect_set(F.when(named, F.col("company"))))
                        .alias("names"),
                        F.min_by("first", period_key(F.col("first"))).alias("first"),
                        F.max_by("last", period_key(F.col("last"))).alias("last"),
                        F.size(F.array_distinct(F.flatten(F.collect_list("periods"))))
                        .cast("bigint").alias("n_periods")))
    return out.select("naic", F.coalesce(F.col("name"), F.col("naic")).alias("name"), "names",
                      "first", "last", "n_periods")


def segments(filings: DataFrame, col: str = "policy_type") -> DataFrame:
    """A14 / Q-E: distinct non-blank segments with line, wind-only flag and product family."""
    pt = clean_key(F.col(col))
    return (filings.select(pt.alias("policy_type")).filter(F.col("policy_type") != "")
                   .distinct()
                   .select("policy_type", segment_line(F.col("policy_type")).alias("line"),
                           segment_wind_only(F.col("policy_type")).alias("is_wind_only"),
                           segment_family(F.col("policy_type")).alias("family")))


def periods(filings: DataFrame, summary: DataFrame | None = None,
            files: DataFrame | None = None) -> DataFrame:
    """SRC3 / J5 / Q-H: period, period_end, has_A, has_B[, title, pulled_at, title_period].

    Flags are set only where facts were parsed (Q17 fix). With ``files`` (one
    row per chosen workbook: period, layout, title, pulled) every period of a chosen
    workbook has a row, also one whose workbook was rejected. Title and pull
    date come from the first file of the period in layout order A, B; an empty
    pull date is filled by the next file. ``title_period`` is the period named in that
    title, if any (SRC10), to check the file name against.
    """
    parsed = filings.select("period", F.lit("B").alias("layout"))
    if summary is not None:
        parsed = parsed.unionByName(summary.select("period", F.lit("A").alias("layout")))
    flags = [F.bool_or(F.col("layout") == x).alias(f"has_{x}") for x in "AB"]
    out = parsed.distinct().groupBy("period").agg(*flags)
    extra = []
    if files is not None:
        meta = (files.groupBy("period")
                     .agg(F.min_by("title", F.col("layout")).alias("title"),
                          F.min_by("pulled", F.when(F.col("pulled") != "", F.col("layout")))
                           .alias("pulled_at")))
        out = out.join(meta, "period", "full").withColumn("title_period", title_period("title"))
        extra = ["title", "pulled_at", "title_period"]
    return out.select("period", period_end(F.col("period")).alias("period_end"),
                      *[F.coalesce(f"has_{x}", F.lit(False)).alias(f"has_{x}") for x in "AB"],
                      *extra)


def metrics_present(filings: DataFrame) -> list[str]:
    """N12 on a wide panel: the metric columns in its schema (no job)."""
    from .slicing import present_metrics
    return sorted(present_metrics(filings))


def period_array(periods_df: DataFrame, lo: str, hi: str) -> Column:
    """The catalogue's periods of a range as one ordered array, for use as a column of
    another plan (a scalar subquery: nothing reaches the driver). ``YYYYQn`` sorts as text."""
    return periods_df.where(F.col("period").between(lo, hi)).agg(F.array_sort(F.collect_set("period"))).scalar()
