"""Registered queries over files: workbooks written and read back, what a workbook is by
its content (SRC2, SRC6, SRC10), and the published panel (SNK1, SRC8, P1, J2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import period_end, period_of
from ..operators import dims as D
from ..operators import grid as G
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators.slicing import slice_filings
from ..session import materialize, shared_path
from ..sources import files as FS
from ..sources import sheet_fixtures as SF
from ..sources import sinks as SK
from ..sources.identify import conflicts, identify
from ..sources.tables import BOUND_METRICS, naic_text, read_table
from ..sources.workbook_sink import write_workbooks
from ..sources.workbook_source import read_workbooks
from . import oracle as O
from .registered import (METRIC_LIST, SNAP_PERIOD, _where, base_values_sql, filings, rank_sql,
                         register)
from .viewspec import ViewSpec
from .views import snapshot_view

#: Body rows of a generated workbook, at most about.
SHEET_ROWS = 50_000


@register("workbook_roundtrip", O.with_panel(f"""
SELECT period, naic, company, policy_type, line, is_wind_only, {METRIC_LIST},
       CASE WHEN is_sup THEN 'pif|tiv' ELSE '' END AS suppressed
FROM panel"""))
def workbook_roundtrip(spark, sf_dir):
    """SRC6: the panel written as .xlsx files by tasks and read back by the data source.

    A quarter's rows are dealt to as many workbooks as its size calls for."""
    panel = materialize(filings(spark, sf_dir), "panel")
    most = panel.groupBy("period").count().agg(F.max("count")).first()[0] or 0
    rows = SF.panel_to_rows(panel, BOUND_METRICS, folder="", parts=max(1, -(-most // SHEET_ROWS)))
    folder = shared_path(spark, f"workbooks-{uuid.uuid4().hex}")
    materialize(write_workbooks(rows, folder), "workbook-list")
    grid = read_workbooks(spark, folder, mode="failfast").where("row_no > 0").select(
        "path", "row_no", "cells")
    grid = materialize(grid, "grid")  # parsed once, read by the header steps and the body
    files = FS.describe_files(grid.where("row_no = 1").select("path"))
    facts = G.parse_grid(grid, files, "B")["facts"]
    return facts.select("period", "naic", "company", "policy_type", "line", "is_wind_only",
                        *BOUND_METRICS, F.array_join("suppressed", "|").alias("suppressed"))


# ---------------------------------------------------------------- the published panel
def stored_panel(spark, sf_dir, *columns):
    """Columns of the panel, published (partitioned by period) and loaded again."""
    out = shared_path(spark, f"published-{uuid.uuid4().hex}")
    SK.publish({"facts_b": filings(spark, sf_dir).select("period", *columns)}, out)
    return SK.load_dataset(spark, out, ("facts_b",))["facts_b"]


@register("stored_quarter_rank", rank_sql(base_values_sql("tiv", _where(
    "Commercial Residential", period=SNAP_PERIOD)), 20))
def stored_quarter_rank(spark, sf_dir):
    """P1 over the published panel: one quarter opens one partition."""
    stored = stored_panel(spark, sf_dir, "naic", "company", "line", "tiv")
    spec = ViewSpec(metric="tiv", topn=20, period=SNAP_PERIOD, line="Commercial Residential")
    top = materialize(snapshot_view(stored, spec), "view")
    names = D.companies(stored.join(top.select("naic"), "naic", "left_semi"))
    return R.with_names(top.drop("company"), names).select(*top.columns).orderBy("rank")


@register("stored_selection", O.with_panel(f"""
SELECT period, naic, {O.xsum('tiv')} AS value FROM panel
WHERE period IN (SELECT period FROM busy WHERE n > (SELECT avg(n) FROM busy))
  AND line = 'Personal Residential'
GROUP BY period, naic""", """
busy AS (SELECT CAST(year(l_shipdate) AS VARCHAR) || 'Q' || CAST(quarter(l_shipdate) AS VARCHAR)
                  AS period, count(*) AS n FROM lineitem GROUP BY 1)"""))
def stored_selection(spark, sf_dir):
    """J2 over the published panel: a table of quarters (those with more line items than the
    mean) chooses the partitions while the query runs."""
    stored = stored_panel(spark, sf_dir, "naic", "line", "tiv")
    li = read_table(spark, sf_dir, "lineitem").select(period_of(F.col("l_shipdate")).alias("period"))
    busy = materialize(li.groupBy("period").agg(F.count(F.lit(1)).alias("n")), "quarters")
    chosen = busy.where(F.col("n") > busy.agg(F.avg("n")).scalar()).select("period")
    return M.entity_values(slice_filings(stored, periods=chosen, line="Personal Residential"), "tiv")


# ---------------------------------------------------------------- layout and period of a file
# One workbook for every entity and quarter; k, from both, picks what is wrong with it.
K_SQL = """
k AS (
  SELECT period, yr, qtr, suppkey, lpad(CAST(suppkey AS VARCHAR),
           CAST(greatest(5, length(CAST(suppkey AS VARCHAR))) AS INTEGER), '0') AS naic,
         suppkey + yr * 4 + qtr AS k
  FROM (SELECT DISTINCT year(l_shipdate) AS yr, quarter(l_shipdate) AS qtr, l_suppkey AS suppkey,
               CAST(year(l_shipdate) AS VARCHAR) || 'Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS period
        FROM lineitem))"""
TOKENS = {"A": "by_company_and_commercial_personal", "B": "by_company_and_policy_type"}
HEADERS = {"A": [t.replace("{end}", "6/30/1998") for t in SF.HEADER_TEXT_A.values()],
           "B": [t.replace("{end}", "6/30/1998") for t in SF.HEADER_TEXT.values()],
           "?": ["Company Name", "Column 2", "Column 3", "Remarks"]}


def _sheets(spark, sf_dir):
    """period, naic and k of every entity and quarter with a line item."""
    li = read_table(spark, sf_dir, "lineitem").select("l_shipdate", "l_suppkey")
    found = li.select(F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q"),
                      period_of(F.col("l_shipdate")).alias("period"),
                      F.col("l_suppkey").alias("key")).distinct()
    return materialize(found.select(
        "period", "y", "q", naic_text(F.col("key")).alias("naic"),
        (F.col("key") + F.col("y") * 4 + F.col("q")).alias("k")), "sheets")


@register("layout_signature", f"""
WITH {K_SQL},
f AS (
  SELECT *, CASE WHEN k % 5 = 4 THEN NULL WHEN k % 2 = 1 THEN 'A' ELSE 'B' END AS content,
         CASE k % 3 WHEN 0 THEN CASE WHEN k % 2 = 1 THEN 'A' ELSE 'B' END
                    WHEN 1 THEN CASE WHEN k % 2 = 1 THEN 'B' ELSE 'A' END END AS named FROM k)
SELECT 'in/' || CASE named WHEN 'A' THEN '{TOKENS['A']}' WHEN 'B' THEN '{TOKENS['B']}'
                           ELSE 'report' END || '_' || naic || '_' || yr || 'q' || qtr || '.xlsx' AS path,
       coalesce(content, named) AS layout,
       CASE WHEN content IS NOT NULL THEN 'headers' WHEN named IS NOT NULL THEN 'name' END AS layout_by,
       named AS name_layout, content AS signature,
       CASE WHEN content <> named THEN 'layout_conflict'
            WHEN content IS NULL AND named IS NOT NULL THEN 'layout_unclear'
            WHEN content IS NULL THEN 'no_layout' ELSE '' END AS findings
FROM f""")
def layout_signature(spark, sf_dir):
    """SRC2: the layout of workbooks whose names are right, misleading or say nothing, and
    whose headers are clear or not."""
    k = F.col("k")
    own = F.when(k % 2 == 1, "A").otherwise("B")
    named = F.when(k % 3 == 0, own).when(k % 3 == 1, F.when(k % 2 == 1, "B").otherwise("A"))
    token = F.when(named == "A", TOKENS["A"]).when(named == "B", TOKENS["B"]).otherwise("report")
    files = _sheets(spark, sf_dir).select(
        F.concat(F.lit("in/"), token, F.lit("_"), "naic", F.lit("_"), F.col("y").cast("string"),
                 F.lit("q"), F.col("q").cast("string"), F.lit(".xlsx")).alias("path"),
        F.lit("Market share").alias("title"), F.when(k % 5 == 4, "?").otherwise(own).alias("kind"))
    found = materialize(identify(SF.sheet_heads(files, HEADERS)), "identified")
    return found.join(_findings(found), "path", "left").select(
        "path", "layout", "layout_by", "name_layout", "signature",
        F.coalesce("findings", F.lit("")).alias("findings"))


def _findings(found):
    return conflicts(found).groupBy("path").agg(
        F.array_join(F.array_sort(F.collect_set("code")), ",").alias("findings"))


TITLE_CASES = """
t AS (
  SELECT *, k % 7 AS kind, make_date(yr, qtr * 3 - 2, 1) AS a,
         last_day(make_date(yr, qtr * 3, 1)) AS b,
         CASE k % 7 WHEN 1 THEN CASE WHEN qtr = 1 THEN (yr - 1) || 'Q4' ELSE yr || 'Q' || (qtr - 1) END
                    WHEN 2 THEN NULL WHEN 6 THEN NULL ELSE period END AS named FROM k),
told AS (
  SELECT *, 'in/by_company_and_policy_type_' || naic || '_' || coalesce(lower(named), 'undated')
           || '_' || strftime(b + INTERVAL (1 + suppkey % 50) DAY, '%Y%m%d') || 't090000' AS stem,
         CASE WHEN kind IN (0, 1, 2) THEN period END AS titled,
         CASE WHEN kind IN (0, 1, 2) THEN 'quarter' WHEN kind IN (4, 5) THEN 'not_a_quarter'
              ELSE 'none' END AS title_status FROM t),
found AS (
  SELECT stem || '.xlsx' AS path, right(stem, 15) AS pull_ts, title_status,
         coalesce(titled, named) AS period,
         CASE WHEN titled IS NOT NULL THEN 'title' WHEN named IS NOT NULL THEN 'name' END AS period_by,
         CASE WHEN titled <> named THEN 'period_conflict' WHEN kind = 6 THEN 'no_period'
              WHEN title_status = 'not_a_quarter' THEN 'title_not_a_quarter' ELSE '' END AS findings
  FROM told)"""


def _titled(spark, sf_dir):
    """Heads of workbooks whose titles and names agree, contradict each other or are silent."""
    kind = F.col("k") % 7
    b = period_end(F.col("period"))
    a = F.trunc(b, "quarter")
    us, iso, word = "M/d/yyyy", "yyyy-MM-dd", "MMMM d, yyyy"

    def title(first, last, form, between):
        return F.concat(F.lit("Market share ("), F.date_format(first, form), F.lit(between),
                        F.date_format(last, form), F.lit(")"))

    previous = F.when(F.col("q") == 1, F.concat((F.col("y") - 1).cast("string"), F.lit("q4"))).otherwise(
        F.concat(F.col("y").cast("string"), F.lit("q"), (F.col("q") - 1).cast("string")))
    named = (F.when(kind == 1, previous).when(kind.isin(2, 6), "undated")
             .otherwise(F.lower("period")))
    pulled = F.date_format(F.date_add(b, (1 + F.col("naic").cast("long") % 50).cast("int")), "yyyyMMdd")
    files = _sheets(spark, sf_dir).select(
        F.concat(F.lit("in/by_company_and_policy_type_"), "naic", F.lit("_"), named, F.lit("_"),
                 pulled, F.lit("t090000.xlsx")).alias("path"),
        F.when(kind == 0, title(a, b, us, "-")).when(kind == 1, title(a, b, iso, " to "))
         .when(kind == 2, title(a, b, word, " through "))
         .when(kind == 4, title(F.add_months(a, -3), b, us, " - "))
         .when(kind == 5, title(b, a, us, "–")).otherwise("Market share").alias("title"),
        F.lit("B").alias("kind"))
    return materialize(identify(SF.sheet_heads(files, HEADERS)), "identified")


@register("title_periods", f"""
WITH {K_SQL}, {TITLE_CASES}
SELECT path, period, period_by, title_status, findings FROM found""")
def title_periods(spark, sf_dir):
    """SRC10: the period of every workbook, what decided it, and what did not agree."""
    found = _titled(spark, sf_dir)
    return found.join(_findings(found), "path", "left").select(
        "path", "period", "period_by", "title_status",
        F.coalesce("findings", F.lit("")).alias("findings"))


@register("newest_by_content", f"""
WITH {K_SQL}, {TITLE_CASES}
SELECT 'B' AS layout, period, path, pull_ts, period_by,
       count(*) OVER (PARTITION BY period) AS n_pulls
FROM found WHERE period IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY period ORDER BY pull_ts DESC, path) = 1""")
def newest_by_content(spark, sf_dir):
    """SRC5 after SRC2 and SRC10: the newest pull of each quarter that titles, then names, give."""
    found = _titled(spark, sf_dir)
    counts = found.where("layout IS NOT NULL AND period IS NOT NULL").groupBy(
        "layout", "period").agg(F.count(F.lit(1)).alias("n_pulls"))
    return FS.newest_pulls(found).join(counts, ["layout", "period"]).select(
        "layout", "period", "path", "pull_ts", "period_by", "n_pulls")


# ---------------------------------------------------------------- headers of a workbook
ALL_B = SF.HEADER_TEXT | SF.MORE_HEADERS
_RULES_SQL = ", ".join(
    f"('{layout}', {i + 1}, '{key}')" for layout, texts in (("B", ALL_B), ("A", SF.HEADER_TEXT_A))
    for i, key in enumerate(texts))


@register("header_rules", f"""
WITH {K_SQL}, r AS (SELECT * FROM (VALUES {_RULES_SQL}) t(layout, col_no, key))
SELECT 'in/' || naic || '_' || period || '.xlsx' AS path, CAST(col_no AS INTEGER) AS col_no, key,
       CASE WHEN key IN ('naic', 'company', 'policy_type') THEN 'dim' ELSE 'metric' END AS role
FROM k JOIN r ON r.layout = CASE WHEN k % 2 = 1 THEN 'A' ELSE 'B' END""")
def header_rules(spark, sf_dir):
    """Every header rule of both layouts, the claims, lawsuit, hurricane and wind
    columns included, on a workbook for each entity and quarter."""
    files = _sheets(spark, sf_dir).select(
        F.concat(F.lit("in/"), "naic", F.lit("_"), "period", F.lit(".xlsx")).alias("path"),
        F.lit("Market share").alias("title"), F.when(F.col("k") % 2 == 1, "A").otherwise("B").alias("kind"))
    texts = {"B": list(ALL_B.values()), "A": list(SF.HEADER_TEXT_A.values())}
    heads = materialize(SF.sheet_heads(files, texts), "heads")
    layouts = files.select("path", F.col("kind").alias("layout"))
    return G.classify_headers(heads, layouts).select("path", "col_no", "key", "role")


#: What is wrong with a workbook's headers: without a header row, without a dimension column,
#: with two columns of one key, with nothing.
BROKEN = {"none": ["No", "header", "here"],
          "dims": ["Company Name", "Policy Type", "Total Value of Exposure"],
          "twice": ["NAIC Code", "Company Name", "Policy Type", "Total Value of Exposure",
                    "Value of Exposure ($)", "Direct Premium Written", "Direct  Premium Written ($)"],
          "fine": ["NAIC Code", "Company Name", "Policy Type", "Total Value of Exposure"]}


@register("rejected_workbooks", f"""
WITH {K_SQL}
SELECT 'in/by_company_and_policy_type_' || naic || '_' || yr || 'q' || qtr || '.xlsx' AS path,
       CASE k % 4 WHEN 0 THEN 'no_header' WHEN 1 THEN 'missing_dims' ELSE 'collision' END AS code,
       CASE k % 4 WHEN 0 THEN 'no header row found; skipped'
                  WHEN 1 THEN 'missing dim columns: naic' ELSE c.detail END AS detail
FROM k LEFT JOIN (VALUES (2, 'dpw: 6,7'), (2, 'tiv: 4,5')) c(k4, detail) ON c.k4 = k % 4
WHERE k % 4 <> 3""")
def rejected_workbooks(spark, sf_dir):
    """N4, Q-D and N15: workbooks without a header row or a dimension column, and columns
    that share a key."""
    k = F.col("k") % 4
    files = _sheets(spark, sf_dir).select(
        F.concat(F.lit("in/by_company_and_policy_type_"), "naic", F.lit("_"), F.col("y").cast("string"),
                 F.lit("q"), F.col("q").cast("string"), F.lit(".xlsx")).alias("path"),
        F.lit("Market share").alias("title"),
        F.when(k == 0, "none").when(k == 1, "dims").when(k == 2, "twice").otherwise("fine").alias("kind"))
    heads = materialize(SF.sheet_heads(files, BROKEN).where("row_no > 0"), "heads")
    parsed = G.parse_grid(heads, FS.describe_files(files.select("path")), "B")
    twice = parsed["collisions"].select("path", F.lit("collision").alias("code"), F.concat(
        "key", F.lit(": "), F.array_join(F.col("col_nos").cast("array<string>"), ",")).alias("detail"))
    return parsed["warnings"].select("path", "code", "detail").unionByName(twice)


@register("titles_and_pulls", f"""
WITH {K_SQL}
SELECT 'in/' || naic || '_' || period || '.xlsx' AS path, 'Market share ' || period AS title,
       CASE k % 3 WHEN 0 THEN CAST(1 + k % 12 AS VARCHAR) || '/15/' || yr
                  WHEN 1 THEN 'as of ' || period ELSE '' END AS pulled
FROM k""")
def titles_and_pulls(spark, sf_dir):
    """SRC7: title and pull date of every workbook, with a date in the note, with other text
    there, and without a note."""
    k = F.col("k") % 3
    files = _sheets(spark, sf_dir).select(
        F.concat(F.lit("in/"), "naic", F.lit("_"), "period", F.lit(".xlsx")).alias("path"),
        F.concat(F.lit("Market share "), "period").alias("title"),
        F.when(k == 0, F.concat(F.lit("(DATA pulled on "), (1 + F.col("k") % 12).cast("string"),
                                F.lit("/15/"), F.col("y").cast("string"), F.lit(")")))
         .when(k == 1, F.concat(F.lit(" as of "), "period", F.lit(" "))).alias("note"))
    none = F.map_from_arrays(F.array(F.lit(1)), F.array(F.struct(
        F.lit("s").alias("kind"), F.col("title").alias("raw"))))
    note = F.map_from_arrays(F.array(F.lit(1)), F.array(F.struct(
        F.lit("s").alias("kind"), F.col("note").alias("raw"))))
    rows = files.select("path", F.explode(F.array(
        F.struct(F.lit(1).alias("row_no"), none.alias("cells")),
        F.struct(F.lit(2).alias("row_no"), F.when(F.col("note").isNotNull(), note).alias("cells"))))
        .alias("r")).select("path", "r.row_no", "r.cells").where("cells IS NOT NULL")
    return FS.title_and_pulled(rows)
