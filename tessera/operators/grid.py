"""Sheet grids → wide filings (N1-N12, N15, F1-F3, Q-D).

A grid has one row per sheet row: ``path, row_no, cells``, where ``cells`` maps the
physical 1-based column number to the cell's ``kind`` (``s`` text, ``n`` number,
``b`` boolean, ``d`` date) and ``raw`` text; empty cells and rows are left out. This is
what the workbook reader emits. Cells that come one per row (``path, row_no, col_no, kind,
raw``) are gathered by ``rows_of`` first.

Plan: header rows and header maps come from the first rows of each file. They end in one
row per file with a map from key to column number (duplicate keys are resolved there,
right-most column wins, Q6). The body meets that small table once, by path, and
every key is a look-up in the row's own cells: no sheet row is shuffled or pivoted. The
metric cells are cleaned as one array, by one expression whatever the number of keys: one
expression a key makes a method that is too long for the JVM to compile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..session import materialize
from ..functions.numbers import clean_number, is_suppressed
from ..functions.text import (clean_key, norm_header, period_end, segment_line,
                              segment_wind_only)

CELLS_SCHEMA = "path string, row_no int, col_no int, kind string, raw string"
ROWS_SCHEMA = "path string, row_no int, cells map<int, struct<kind: string, raw: string>>"

DIMS = {"B": ["naic", "company", "policy_type"], "A": ["naic", "company"]}


def table_schema(table: str, layout: str) -> str:
    """Columns of the ``facts`` or ``totals`` that ``parse_grid`` gives for a layout."""
    keys = C.layout_b_metric_keys() if layout == "B" else C.layout_a_metric_keys()
    metrics = ", ".join(f"{k} double" for k in keys)
    if table == "totals":
        return f"path string, period string, {metrics}"
    segment = "policy_type string, line string, is_wind_only boolean, " if layout == "B" else ""
    return (f"period string, period_end date, naic string, company string, {segment}{metrics}, "
            "suppressed array<string>, present array<string>, source_file string, row_no int")


def rows_of(grid: DataFrame) -> DataFrame:
    """A grid in its row form, from either form (one shuffle for single cells)."""
    if "cells" in grid.columns:
        return grid
    cell = F.struct("col_no", F.struct("kind", "raw").alias("c"))
    return grid.groupBy("path", "row_no").agg(
        F.map_from_entries(F.collect_list(cell)).alias("cells"))


def cells_of(grid: DataFrame) -> DataFrame:
    """One row per cell, from either form."""
    if "cells" not in grid.columns:
        return grid
    return (grid.select("path", "row_no", F.explode("cells").alias("col_no", "c"))
                .select("path", "row_no", "col_no", "c.kind", "c.raw"))


def rule_expr(hn: Column, layout: str) -> Column:
    """Compile the ordered header rules into one CASE expression (first match wins)."""
    expr = None
    for r in C.header_rules(layout):
        cond = F.lit(True)
        if r.equals is not None:
            cond = cond & (hn == F.lit(r.equals))
        if r.prefix is not None:
            cond = cond & hn.startswith(r.prefix)
        for t in r.contains:
            cond = cond & hn.contains(t)
        expr = F.when(cond, F.lit(r.key)) if expr is None else expr.when(cond, F.lit(r.key))
    return expr


def rule_role(key: Column, layout: str) -> Column:
    dims = [r.key for r in C.header_rules(layout) if r.role == "dim"]
    return F.when(key.isin(dims), F.lit("dim")).when(key.isNotNull(), F.lit("metric"))


def header_rows(cells: DataFrame, anchor: str = C.HEADER_ANCHOR,
                max_scan: int = C.HEADER_SCAN_ROWS) -> DataFrame:
    """Per path, the first of the first ``max_scan`` rows with a cell equal to the anchor."""
    return (cells_of(cells).filter((F.col("row_no") <= max_scan) & (norm_header(F.col("raw")) == anchor))
                 .groupBy("path").agg(F.min("row_no").alias("header_row")))


def classify_headers(cells: DataFrame, layout_of: DataFrame | str, hdr: DataFrame | None = None
                     ) -> DataFrame:
    """N1 + N3: (path, col_no, header, norm, key, role) for each header cell.

    ``layout_of`` is a layout letter for all paths or a DataFrame (path, layout).
    """
    cells = cells_of(cells)
    hdr = hdr if hdr is not None else header_rows(cells)
    h = (cells.join(hdr, "path")
              .filter(F.col("row_no") == F.col("header_row"))
              .select("path", "col_no", F.col("raw").alias("header"),
                      norm_header(F.col("raw")).alias("norm"))
              .filter(F.col("norm") != ""))
    if isinstance(layout_of, str):
        h = h.withColumn("layout", F.lit(layout_of))
    else:
        h = h.join(layout_of.select("path", "layout"), "path")
    key = (F.when(F.col("layout") == "B", rule_expr(F.col("norm"), "B"))
            .otherwise(rule_expr(F.col("norm"), "A")))
    role = (F.when(F.col("layout") == "B", rule_role(F.col("key"), "B"))
             .otherwise(rule_role(F.col("key"), "A")))
    return h.withColumn("key", key).withColumn("role", role)


def header_map(headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Winning column per (path, key) and the collision report.

    Returns (map(path, layout, key, role, col_no), collisions(path, key, n_columns, col_nos)).
    """
    keyed = headers.filter(F.col("key").isNotNull())
    win = (keyed.groupBy("path", "layout", "key", "role")
                .agg(F.max("col_no").alias("col_no"), F.count(F.lit(1)).alias("n_columns"),
                     F.array_sort(F.collect_list("col_no")).alias("col_nos")))
    collisions = win.filter(F.col("n_columns") > 1).select("path", "key", "n_columns", "col_nos")
    return win.select("path", "layout", "key", "role", "col_no"), collisions


def file_warnings(files: DataFrame, hdr: DataFrame, hmap: DataFrame) -> DataFrame:
    """N4 / Q-D: files without a header row, or without their dimension columns."""
    f = files.select("path", "layout")
    no_header = (f.join(hdr, "path", "left_anti")
                  .select("path", "layout", F.lit("no_header").alias("code"),
                          F.lit("no header row found; skipped").alias("detail")))
    keys = hmap.groupBy("path").agg(F.collect_set("key").alias("keys"))
    need_b = F.array(*[F.lit(k) for k in DIMS["B"]])
    need_a = F.array(*[F.lit(k) for k in DIMS["A"]])
    missing = (f.join(hdr, "path", "left_semi").join(keys, "path", "left")
                .withColumn("need", F.when(F.col("layout") == "B", need_b).otherwise(need_a))
                .withColumn("miss", F.array_except("need", F.coalesce("keys", F.array().cast("array<string>"))))
                .filter(F.size("miss") > 0)
                .select("path", "layout", F.lit("missing_dims").alias("code"),
                        F.concat(F.lit("missing dim columns: "), F.array_join("miss", ", "))
                        .alias("detail")))
    return no_header.unionByName(missing)


def parse_grid(grid: DataFrame, files: DataFrame, layout: str = "B",
               max_scan: int = C.HEADER_SCAN_ROWS) -> dict[str, DataFrame]:
    """A grid of one layout → facts, published totals, header report, warnings.

    ``files``: one row per workbook: path, layout, period (others ignored).
    Returns a dict with ``facts`` (wide, with ``suppressed`` and ``present``: the
    metric keys that the sheet has a column for), ``totals`` (path, period, metrics),
    ``headers``, ``collisions``, ``warnings``, ``metrics_seen``, ``header_rows``.
    """
    rows = rows_of(grid)
    files = files.filter(F.col("layout") == layout).select("path", "layout", "period")
    # The header region (files × max_scan rows) is written once: the per-file
    # steps below read it several times and must not rescan the grid.
    top = materialize(cells_of(rows.filter(F.col("row_no") <= max_scan)
                                   .join(files.select("path"), "path", "left_semi")), "top")
    files = materialize(files, "files")
    hdr = header_rows(top, max_scan=max_scan)
    headers = classify_headers(top, files, hdr)
    hmap, collisions = header_map(headers)
    warnings = file_warnings(files, hdr, hmap)
    good = files.join(warnings.select("path"), "path", "left_anti")
    metric = F.when(F.col("role") == "metric", F.col("key"))
    dims = DIMS[layout]
    keys = C.layout_b_metric_keys() if layout == "B" else C.layout_a_metric_keys()
    ordered = sorted(keys)
    cols = F.map_from_entries(F.collect_list(F.struct("key", "col_no")))
    # One row per good file. Spark broadcasts it if it measures small, else joins by path.
    colmap = materialize(
        hmap.join(good.select("path", "period"), "path").join(hdr, "path")
            .groupBy("path", "period", "header_row")
            .agg(cols.alias("cols"), F.array_sort(F.collect_set(metric)).alias("present"))
            .select("path", "period", "header_row", "present",
                    *[F.try_element_at("cols", F.lit(d)).alias(f"_at_{d}") for d in dims],
                    F.array(*[F.try_element_at("cols", F.lit(k)) for k in ordered]).alias("_at")),
        "colmap")
    body = rows.join(colmap, "path").filter(F.col("row_no") > F.col("header_row"))
    body = body.select(
        "path", "period", "row_no", "present",
        *[F.try_element_at("cells", F.col(f"_at_{d}"))["raw"].alias(f"_{d}") for d in dims],
        F.transform("_at", lambda at: F.try_element_at(F.col("cells"), at)).alias("_cells"))
    # Q11 fix: suppression is tracked for Layout A as well as B.
    names = F.array(*[F.lit(k) for k in ordered])
    sup = F.array_compact(F.zip_with("_cells", names, lambda c, k: F.when(
        c.isNotNull() & is_suppressed(c["raw"]), k)))
    numbers = F.transform("_cells", lambda c: F.when(
        c.isNotNull(), clean_number(c["raw"], c["kind"])))
    rows = body.select("path", "period", "row_no", "present", *[f"_{d}" for d in dims],
                       numbers.alias("_numbers"), sup.alias("suppressed"))
    rows = rows.select("path", "period", "row_no", "present", *[f"_{d}" for d in dims],
                       *[F.col("_numbers")[ordered.index(k)].alias(k) for k in keys], "suppressed")
    is_total = norm_header(F.col("_company")) == C.TOTAL_ROW_NAME
    rows = rows.withColumn("_is_total", is_total)
    # The footer; the last one of a file wins.
    totals = (rows.filter("_is_total")
                  .groupBy("path", "period")
                  .agg(F.max_by(F.struct(*keys), F.col("row_no")).alias("t"))
                  .select("path", "period", *[F.col(f"t.{k}").alias(k) for k in keys]))
    naic = clean_key(F.col("_naic"))
    company = clean_key(F.col("_company"))
    body_rows = rows.filter(~F.col("_is_total"))
    if layout == "B":
        pt = clean_key(F.col("_policy_type"))
        facts = (body_rows.withColumn("naic", naic).withColumn("policy_type", pt)
                 .filter((F.col("naic") != "") | (F.col("policy_type") != ""))
                 .select("period", period_end(F.col("period")).alias("period_end"), "naic",
                         company.alias("company"), "policy_type",
                         segment_line(F.col("policy_type")).alias("line"),
                         segment_wind_only(F.col("policy_type")).alias("is_wind_only"),
                         *keys, "suppressed", "present", F.col("path").alias("source_file"),
                         "row_no"))
    else:
        facts = (body_rows.withColumn("naic", naic).filter(F.col("naic") != "")
                 .select("period", period_end(F.col("period")).alias("period_end"), "naic",
                         company.alias("company"), *keys, "suppressed", "present",
                         F.col("path").alias("source_file"), "row_no"))
    metrics_seen = hmap.filter(F.col("role") == "metric").select("key").distinct()
    return {"facts": facts, "totals": totals, "headers": headers, "collisions": collisions,
            "warnings": warnings, "metrics_seen": metrics_seen, "header_rows": hdr}
