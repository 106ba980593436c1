"""Data-quality reports (§2.9: Q-A … Q-H, A15, A16, J3, J6).

Every report is a small DataFrame (per file, per period or per entity × line);
``render_report`` writes them out as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.numbers import exact_sum0


def checksum(body: DataFrame, totals: DataFrame, metrics: list[str], keys=("period",),
             tolerance: float = C.CHECKSUM_TOLERANCE, files: DataFrame | None = None) -> DataFrame:
    """Q-A / J3 / A10: body sum (null → 0) against the published total, per metric.

    A total without a body has body sum 0 and 0 rows. With ``files`` (one row per
    chosen workbook, with the keys) every workbook has its rows, also a rejected one.

    status: ``ok``; ``mismatch`` when |diff| / |total| > tolerance, or the total
    is 0 and the body is not (Q8 fix); ``no_total`` when the total is null (Q15).
    """
    keys = list(keys)
    sums = body.groupBy(*keys).agg(*[exact_sum0(m).alias(m) for m in metrics],
                                   F.count(F.lit(1)).alias("rows"))
    b = sums.unpivot(keys + ["rows"], metrics, "metric", "body_sum")
    t = totals.select(*keys, *[F.col(m).cast("double") for m in metrics]).unpivot(
        keys, metrics, "metric", "total")
    j = b.join(t, keys + ["metric"], "full")
    if files is not None:
        every = files.select(*keys).distinct().withColumn(
            "metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
        j = every.join(j, keys + ["metric"], "full")
    j = j.withColumns({"body_sum": F.coalesce("body_sum", F.lit(0.0)),
                       "rows": F.coalesce("rows", F.lit(0))})
    diff = F.col("body_sum") - F.col("total")
    status = (F.when(F.col("total").isNull(), F.lit("no_total"))
               .when((F.col("total") == 0) & (F.col("body_sum") != 0), F.lit("mismatch"))
               .when((F.col("total") != 0) & (F.abs(diff) / F.abs(F.col("total")) > tolerance),
                     F.lit("mismatch"))
               .otherwise(F.lit("ok")))
    return j.select(*keys, "metric", "body_sum", "total", diff.alias("diff"), "rows",
                    status.alias("status"))


def unknown_segments(filings: DataFrame) -> DataFrame:
    """Q-C: unrecognised segment prefixes, one row per (period, segment) with a count."""
    return (filings.filter(F.col("line") == C.OTHER_LINE)
                   .groupBy("period", "policy_type").agg(F.count(F.lit(1)).alias("rows")))


def suppressed_counts(long: DataFrame) -> DataFrame:
    """Suppressed and null cells per period and metric (long form)."""
    return (long.groupBy("period", "metric")
                .agg(F.sum(F.col("is_suppressed").cast("int")).cast("bigint").alias("n_suppressed"),
                     F.count(F.when(F.col("value").isNull(), 1)).alias("n_null"),
                     F.count(F.lit(1)).alias("n_cells")))


def coverage(filings: DataFrame, summary: DataFrame | None = None,
             files: DataFrame | None = None) -> DataFrame:
    """Q-B: per period, which layouts have facts and how many. With ``files`` (period,
    layout, pulled) also the number of workbooks and the pull date, and a row for every
    period of a chosen workbook."""
    rows = filings.select("period", F.lit(1).alias("b"), F.lit(0).alias("a"))
    if summary is not None:
        rows = rows.unionByName(summary.select("period", F.lit(0).alias("b"), F.lit(1).alias("a")))
    out = rows.groupBy("period").agg(F.sum("b").alias("facts_b"), F.sum("a").alias("facts_a"))
    extra = []
    if files is not None:
        dated = F.when(F.col("pulled") != "", F.col("layout"))
        meta = files.groupBy("period").agg(F.count(F.lit(1)).alias("files"),
                                           F.min_by("pulled", dated).alias("pulled_at"))
        out = out.join(meta, "period", "full").withColumn("files", F.coalesce("files", F.lit(0)))
        extra = ["files", "pulled_at"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("facts_a", "facts_b")})
    return out.select("period", (F.col("facts_a") > 0).alias("has_A"),
                      (F.col("facts_b") > 0).alias("has_B"), "facts_a", "facts_b", *extra)


def summary_counts(filings: DataFrame, summary: DataFrame | None = None,
                   files: DataFrame | None = None) -> DataFrame:
    """A15 / Q-F: periods, facts by layout, entities, segments[, files]: exact counts.

    Each distinct count is a ``distinct`` of one narrow column set followed by a plain
    count, so no row is expanded and only one number per task reaches the end.
    """
    def tagged(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")

    both = filings.select("period", "naic")
    if summary is not None:
        both = both.unionByName(summary.select("period", "naic"))
    pairs = both.distinct()  # at most entities × quarters: both counts come from it
    parts = [tagged(pairs.select("period").distinct(), "periods"),
             tagged(pairs.select("naic").distinct(), "entities"),
             tagged(filings.select("policy_type").where("policy_type <> ''").distinct(),
                    "segments"),
             tagged(filings, "facts_b")]
    names = ["periods", "facts_b", "facts_a", "entities", "segments"]
    if summary is not None:
        parts.append(tagged(summary, "facts_a"))
    if files is not None:
        parts.append(tagged(files, "files"))
        names.append("files")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.agg(*[F.coalesce(F.sum(F.when(F.col("what") == n, F.col("n"))), F.lit(0)).alias(n)
                      for n in names])


def reconcile(filings: DataFrame, summary_long: DataFrame, metric: str = "pif",
              tolerance: float = C.CHECKSUM_TOLERANCE) -> DataFrame:
    """Layout A against Layout B rolled up to entity × line.

    Full outer join on (period, naic, line); status only_a / only_b / match / differ.
    """
    b = (filings.groupBy("period", "naic", "line")
                .agg(exact_sum0(metric).alias("b_value")))
    a = (summary_long.filter((F.col("metric") == metric) & (F.col("line") != "All"))
                     .groupBy(F.col("period"), F.col("naic_code").alias("naic"), "line")
                     .agg(exact_sum0("value").alias("a_value")))
    j = a.join(b, ["period", "naic", "line"], "full")
    diff = F.col("a_value") - F.col("b_value")
    status = (F.when(F.col("b_value").isNull(), F.lit("only_a"))
               .when(F.col("a_value").isNull(), F.lit("only_b"))
               .when((F.col("b_value") == 0) & (F.col("a_value") == 0), F.lit("match"))
               .when(F.abs(diff) <= F.abs(F.col("b_value")) * tolerance, F.lit("match"))
               .otherwise(F.lit("differ")))
    return j.select("period", "naic", "line", "a_value", "b_value", diff.alias("diff"),
                    status.alias("status"))


# The sections of the validation report and the columns each shows.
REPORT = {
    "totals": ("Dataset", ["periods", "files", "facts_b", "facts_a", "entities", "segments"]),
    "coverage": ("Periods", ["period", "has_A", "has_B", "files", "pulled_at"]),
    "checksums": ("Body sums and published totals",
                  ["period", "layout", "metric", "body_sum", "total", "rows", "status"]),
    "warnings": ("Rejected workbooks", ["layout", "path", "code", "detail"]),
    "conflicts": ("Names and contents that do not agree", ["path", "code", "detail"]),
    "collisions": ("Columns with the same key", ["path", "key", "n_columns"]),
    "suppressed": ("Suppressed and empty cells",
                   ["period", "metric", "n_suppressed", "n_null", "n_cells"]),
    "unknown_segments": ("Segments of no known line", ["period", "policy_type", "rows"]),
    "entity_changes": ("Entities new or dropped", ["period", "change", "entities"]),
    "segments": ("Segments", ["policy_type", "line", "is_wind_only", "family"]),
}


def report_tables(dataset: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """SNK3: the validation report as tables, one per section of ``REPORT`` that the
    dataset has, each ordered by its columns. Every table is small by kind: rows per
    period, workbook, metric or segment."""
    out = {}
    for name, (_, columns) in REPORT.items():
        if name in dataset:
            shown = [c for c in columns if c in dataset[name].columns]
            out[name] = dataset[name].select(*shown).orderBy(*shown)
    return out


def render_report(tables: dict[str, DataFrame]) -> str:
    """The report tables as Markdown text (collected: they are small by kind)."""
    def text(v) -> str:
        if isinstance(v, float):
            return f"{v:.4f}".rstrip("0").rstrip(".")
        return "" if v is None else str(v).replace("|", "\\|")

    lines = ["# Validation report"]
    for name, df in tables.items():
        rows = df.collect()
        lines += ["", f"## {REPORT[name][0]} ({len(rows)})", "", "| " + " | ".join(df.columns) + " |",
                  "|" + " --- |" * len(df.columns)]
        lines += ["| " + " | ".join(text(v) for v in r) + " |" for r in rows]
    return "\n".join(lines) + "\n"
