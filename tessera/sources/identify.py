"""What a workbook is: its layout from its headers, its period from its title (SRC2-SRC4, SRC10).

A file's name is a hint that people get wrong; its content is not. So:

* **Layout** (SRC2): the header row is classified by the rules of every layout. A layout's
  score is the share of the sheet's headers that its rules explain, each key once, times the
  share of its dimension columns that are there. The best layout decides if it reaches
  ``LEAST_SCORE`` and leads by ``MARGIN``; otherwise the name breaks the tie.
* **Period** (SRC10): the title's date range decides if it is exactly one quarter; the name's
  token is the fallback. Ranges may be written ``4/1/2022-6/30/2022``, ``2022-04-01 to
  2022-06-30``, ``April 1, 2022 through June 30, 2022`` or ``1 April 2022 - 30 June 2022``.
* What did not agree is reported, one row per file and finding (``conflicts``).

The work per file is on its head (the first ten rows), grouped by file; the result is a small
row per file, which ``files.newest_pulls`` takes like a listing described from names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.text import norm_header, period_end
from ..operators.grid import DIMS, cells_of, header_rows, rule_expr
from .files import base_name, describe_files, title_and_pulled

LEAST_SCORE, MARGIN = 0.3, 0.15
LAYOUTS = ("A", "B")

_MONTH = r"[A-Za-z]{3,9}\.?"
#: Ways to write a date: (pattern, formats to try).
DATE_FORMS = (
    (r"\d{1,2}/\d{1,2}/\d{4}", ("M/d/yyyy",)),
    (r"\d{4}-\d{1,2}-\d{1,2}", ("yyyy-M-d",)),
    (rf"{_MONTH} \d{{1,2}},? \d{{4}}", ("MMMM d yyyy", "MMM d yyyy")),
    (rf"\d{{1,2}} {_MONTH} \d{{4}}", ("d MMMM yyyy", "d MMM yyyy")),
)
BETWEEN = r"\s*(?:-|–|—|to|through|thru|until)\s*"


def _date(text: Column, formats: tuple[str, ...]) -> Column:
    """A date by the first format that fits, or null."""
    plain = F.regexp_replace(text, r"[.,]", "")
    plain = F.when(text.rlike("[A-Za-z]"), F.initcap(plain)).otherwise(text)
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)).cast("date") for f in formats])


def title_range(title: Column) -> tuple[Column, Column]:
    """(first day, last day) of the first date range in a title, nulls without one."""
    text = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", " "))
    starts, ends = [], []
    for form, formats in DATE_FORMS:
        pattern = rf"(?i)(?<![\d/-])({form}){BETWEEN}({form})(?![\d/-])"
        for k, out in ((1, starts), (2, ends)):
            out.append(_date(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")), formats))
    # Both dates from one way of writing.
    first = F.coalesce(*[F.when(s.isNotNull() & e.isNotNull(), s)
                         for s, e in zip(starts, ends, strict=True)])
    last = F.coalesce(*[F.when(s.isNotNull() & e.isNotNull(), e)
                        for s, e in zip(starts, ends, strict=True)])
    return first, last


def with_title_period(df: DataFrame, title: str = "title") -> DataFrame:
    """Adds title_from, title_to, title_period (null unless the range is exactly a quarter)
    and title_status: ``quarter``, ``not_a_quarter`` or ``none``."""
    first, last = title_range(F.col(title))
    out = df.withColumns({"title_from": first, "title_to": last})
    quarter = F.concat(F.year("title_to").cast("string"), F.lit("Q"),
                       F.quarter("title_to").cast("string"))
    exact = ((F.col("title_from") == F.trunc("title_to", "quarter"))
             & (F.col("title_to") == period_end(quarter)))
    return out.withColumns({
        "title_period": F.when(exact, quarter),
        "title_status": F.when(F.col("title_to").isNull(), "none").when(exact, "quarter")
                         .otherwise("not_a_quarter")})


def signatures(heads: DataFrame, max_scan: int = C.HEADER_SCAN_ROWS) -> DataFrame:
    """SRC2: one row per file with a header row: path, headers (their number), score_A,
    score_B, signature (the layout that the headers tell, or null)."""
    cells = cells_of(heads)
    header = cells.join(header_rows(cells, max_scan=max_scan), "path").where(
        F.col("row_no") == F.col("header_row")).select(
            "path", norm_header(F.col("raw")).alias("norm")).where("norm <> ''")
    keyed = header.select("path", *[rule_expr(F.col("norm"), x).alias(f"key_{x}") for x in LAYOUTS])
    told = keyed.groupBy("path").agg(
        F.count(F.lit(1)).alias("headers"),
        *[F.collect_set(f"key_{x}").alias(f"keys_{x}") for x in LAYOUTS])

    def score(x: str) -> Column:
        dims = F.array(*[F.lit(d) for d in DIMS[x]])
        there = F.size(F.array_intersect(f"keys_{x}", dims)) / F.size(dims)
        return F.round(F.size(f"keys_{x}") / F.col("headers") * there, 6)

    told = told.withColumns({f"score_{x}": score(x) for x in LAYOUTS})
    best, other = F.greatest("score_A", "score_B"), F.least("score_A", "score_B")
    sure = (best >= LEAST_SCORE) & (best - other >= MARGIN)
    return told.select("path", "headers", "score_A", "score_B", F.when(
        sure, F.when(F.col("score_A") > F.col("score_B"), "A").otherwise("B")).alias("signature"))


def identify(heads: DataFrame) -> DataFrame:
    """One row per file of ``heads`` (the first rows of each sheet, with a row 0 per file):
    path, name, layout, layout_by, period, period_by (``title`` or ``name``), period_end,
    pull_ts, title, pulled, name_layout, name_period, title_period, title_status, signature,
    score_A, score_B, error; length, where the heads have it."""
    kept = [c for c in ("length", "error") if c in heads.columns]
    files = (heads.groupBy("path").agg(*[F.max(c).alias(c) for c in kept]) if kept
             else heads.select("path").distinct())
    if "error" not in kept:
        files = files.withColumn("error", F.lit(None).cast("string"))
    rows = heads.where("row_no > 0").select("path", "row_no", "cells")
    named = describe_files(files).withColumnsRenamed({"layout": "name_layout", "period": "name_period"})
    told = (named.drop("period_end")
            .join(with_title_period(title_and_pulled(rows)), "path", "left")
            .join(signatures(rows), "path", "left"))
    out = told.withColumns({
        "layout": F.coalesce("signature", "name_layout"),
        "layout_by": F.when(F.col("signature").isNotNull(), "headers").when(
            F.col("name_layout").isNotNull(), "name"),
        "period": F.coalesce("title_period", "name_period"),
        "period_by": F.when(F.col("title_period").isNotNull(), "title").when(
            F.col("name_period").isNotNull(), "name"),
        "title_status": F.coalesce("title_status", F.lit("none")),
    })
    return out.withColumn("period_end", period_end(F.col("period"))).select(
        "path", base_name(F.col("path")).alias("name"), "layout", "layout_by", "period", "period_by",
        "period_end", "pull_ts", "title", "pulled", "name_layout", "name_period", "title_from",
        "title_to", "title_period", "title_status", "signature", "score_A", "score_B", *kept,
        *([] if "error" in kept else ["error"]))


def conflicts(identified: DataFrame) -> DataFrame:
    """What did not agree or is missing, one row per file and finding: path, code, detail.

    ``layout_conflict`` and ``period_conflict`` (content against name; the content counts),
    ``layout_unclear`` (the headers fit no layout clearly; the name counts),
    ``title_not_a_quarter``, ``no_layout``, ``no_period``, ``unreadable``."""
    def finding(when: Column, code: str, *detail: Column | str) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), F.concat(*[
            F.lit(d) if isinstance(d, str) else F.coalesce(d.cast("string"), F.lit("-"))
            for d in detail]).alias("detail")))

    c = F.col
    found = F.array_compact(F.array(
        finding(c("error").isNotNull(), "unreadable", c("error")),
        finding(c("signature") != c("name_layout"), "layout_conflict", "headers say ",
                c("signature"), ", the name says ", c("name_layout")),
        finding(c("error").isNull() & c("signature").isNull() & c("name_layout").isNotNull(),
                "layout_unclear", "scores ", c("score_A"), " and ", c("score_B")),
        finding(c("title_period") != c("name_period"), "period_conflict", "the title says ",
                c("title_period"), ", the name says ", c("name_period")),
        finding(c("title_status") == "not_a_quarter", "title_not_a_quarter", c("title_from"),
                " to ", c("title_to")),
        finding(c("error").isNull() & c("layout").isNull(), "no_layout", c("name")),
        finding(c("error").isNull() & c("period").isNull(), "no_period", c("name"))))
    return identified.select("path", F.explode(found).alias("f")).select("path", "f.code", "f.detail")
