"""Generated sheets: a panel written out as filing grids (tests and round-trip queries).

The sheets have what real filings have: a title and a pull note, header texts that
match their rule only after normalisation, money as text, suppressed cells, columns in
another order every other quarter, and a footer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.numbers import exact_sum
from ..functions.text import period_end
from ..operators.grid import DIMS
from ..session import materialize

# Header text per key for generated Layout-B sheets. Each matches its rule
# after normalisation; the period's end date, line breaks and non-breaking
# spaces vary the raw text the way drifting filings do.
HEADER_TEXT = {
    "naic": "NAIC Code",
    "company": "Company Name",
    "policy_type": "Policy Type",
    "pif": "Total Number of Policies in Force\n(as of {end})",
    "tiv": "Total Value of Exposure ($)  as of {end}",
    "tiv_incl_wind": "Value of Exposure for Policies in Force that Include Wind",
    "dpw": "Direct Premium Written ($)\nfor quarter ending {end}",
    "new_written": "Number of New Policies Written",
    "received_in": "Number of Policies Received from Other Insurers",
    "cancelled": "Number of Policies Canceled",
    "nonrenewed": "Number of Policies Nonrenewed",
    "transferred_out": "Number of Policies Transferred to Other Insurers",
}
HEADER_TEXT_A = {
    "naic": "NAIC\nCode",
    "company": "COMPANY NAME",
    "a_pif": "Total Number of Policies in Force\n(as of {end})",
    "a_pif_commercial": "Number of Policies in Force that are Commercial",
    "a_pif_personal": "Number of  Policies in Force that are Personal",
    "a_dpw": "Total Direct Premium Written for Policies in Force ($)",
    "a_dpw_commercial": "Direct Premium Written for Policies in Force that are Commercial ($)",
    "a_dpw_personal": "Direct Premium Written for\nPolicies in Force that are Personal ($)",
}
# A header text for every further Layout-B key, each meeting its rule only after
# normalisation or only because rules are tried in order.
MORE_HEADERS = {
    "pif_excl_wind": "Number of Policies in Force that\nExclude Wind",
    "pif_incl_wind": "NUMBER OF POLICIES IN FORCE that Include  Wind",
    "cancelled_hurricane": "Policies Canceled due to Hurricane",
    "nonrenewed_hurricane": "Number of Policies Nonrenewed Due to Hurricane",
    "tiv_excl_wind": "Total Value of Exposure for Policies in Force that Exclude Wind ($)",
    "dpw_excl_wind": "Direct Premium Written for Policies in Force that Exclude Wind",
    "dpw_incl_wind": "Direct\u00a0Premium Written for Policies in Force that Include Wind",
    "claims_opened": "Total Number of Claims Opened",
    "claims_closed": "Total number of claims\n closed in the quarter",
    "claims_pending": "total number of claims pending",
    "lawsuits_closed_consumer": "Number of Lawsuits Closed with Consideration to the Consumer",
    "lawsuits_closed": "Number of Lawsuits Closed",
    "lawsuits_opened": "Number of Lawsuits Opened",
    "lawsuits_open_end": "Lawsuits Open at End of Quarter",
}
MONEY_DIGITS = {"tiv": 2, "tiv_incl_wind": 2, "dpw": 4, "a_dpw": 4, "a_dpw_commercial": 4,
                "a_dpw_personal": 4}
HEADER_ROW = 4


def sheet_path(period: Column, folder: str = "grid", layout: str = "B",
               part: Column | None = None) -> Column:
    y = F.substring(period, 1, 4)
    q = F.substring(period, -1, 1)
    token = C.LAYOUT_B_TOKEN if layout == "B" else C.LAYOUT_A_TOKEN
    tail = [] if part is None else [F.lit("_part"), part.cast("string")]
    return F.concat(F.lit(f"{folder}/filing_{token}_" if folder else f"filing_{token}_"), y,
                    F.lit("q"), q, *tail, F.lit(".xlsx"))


def number_rows(df: DataFrame, part: list[str], order: list[str], out: str = "n",
                buckets: int | None = None) -> DataFrame:
    """Dense 1..k numbering per ``part`` without one task per part.

    Rows are spread over ``buckets`` hash buckets of their (unique) order key,
    numbered inside each (part, bucket) and shifted by the sizes of the
    part's earlier buckets. The sheet order is (bucket, order): not sorted, but
    deterministic, so a recomputed partition gets the same numbers, and a hot
    key cannot pile up in one bucket because the hash covers the whole key.
    The offsets table has parts × buckets rows.
    """
    b = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(b)))
    local = keyed.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*part, "_bucket").orderBy(*order)))
    counts = keyed.groupBy(*part, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, "_bucket", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (local.join(offsets, [*part, "_bucket"])
                 .withColumn(out, (F.col("_local") + F.col("_off")).cast("int"))
                 .drop("_bucket", "_local", "_off"))


def _cell(col_no, kind, raw) -> Column:
    return F.struct(F.lit(col_no).cast("int").alias("col_no") if isinstance(col_no, int)
                    else col_no.cast("int").alias("col_no"),
                    F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
                             (F.lit(raw) if isinstance(raw, str) else raw).alias("raw")).alias("c"))


def _cells(cells: list[Column]) -> Column:
    """A row's map of cells, without the empty ones."""
    held = F.filter(F.array(*cells), lambda c: c["c"]["raw"].isNotNull())
    return F.map_from_entries(held).alias("cells")


def panel_to_rows(panel: DataFrame, metrics: list[str], folder: str = "grid",
                  layout: str = "B", parts: int = 1) -> DataFrame:
    """A panel as sheet rows (``grid.ROWS_SCHEMA``) of a layout, one sheet per period, or
    ``parts`` sheets that share the period's rows (a sheet's number of rows is bounded).

    Title in row 1, pull note in row 2, headers in row 4, body from row 5, a
    Total row last. Money as ``$1,234.50`` text, ``.`` where suppressed, counts
    as numeric cells; odd quarters list the metric columns in reverse order.
    """
    dims = DIMS[layout]
    text = HEADER_TEXT if layout == "B" else HEADER_TEXT_A
    if "suppressed" not in panel.columns:
        panel = panel.withColumn("suppressed", F.array().cast("array<string>"))
    # The panel is read by the numbering (two branches) and by the footer sums:
    # written once so none of them recomputes it.
    ids = [d for d in dims if d != "company"]
    sheet = ["period"] if parts == 1 else ["period", "part"]
    panel = panel.select("period", *dims, *metrics, "suppressed")
    if parts > 1:
        panel = panel.withColumn("part", F.pmod(F.xxhash64("period", *ids), F.lit(parts)))
    panel = materialize(panel, "panel")
    numbered = number_rows(panel, sheet, ids, "body_no")
    q_odd = (F.substring(F.col("period"), -1, 1).cast("int") % 2) == 1
    n_d, n_m = len(dims), len(metrics)

    def col_no_of(i: int) -> Column:
        return F.when(q_odd, F.lit(n_d + n_m - i)).otherwise(F.lit(n_d + 1 + i))

    def shown(m: str) -> tuple[str, Column]:
        if m in MONEY_DIGITS:
            return "s", F.concat(F.lit("$"), F.format_number(F.col(m), MONEY_DIGITS[m]))
        return "n", F.col(m).cast("string")

    def body_cell(i: int, m: str) -> Column:
        kind, raw = shown(m)
        sup = F.array_contains(F.col("suppressed"), m)
        return _cell(col_no_of(i), F.when(sup, F.lit("s")).otherwise(F.lit(kind)),
                     F.when(sup, F.lit(".")).otherwise(raw))

    path = sheet_path(F.col("period"), folder, layout,
                      None if parts == 1 else F.col("part")).alias("path")
    body = numbered.select(
        path, (F.col("body_no") + HEADER_ROW).cast("int").alias("row_no"),
        _cells([_cell(i + 1, "s", F.col(d).cast("string")) for i, d in enumerate(dims)]
               + [body_cell(i, m) for i, m in enumerate(metrics)]))
    periods = panel.groupBy(*sheet).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[exact_sum(F.when(~F.array_contains(F.col("suppressed"), m), F.col(m))).alias(m)
          for m in metrics])
    end = F.date_format(period_end(F.col("period")), "M/d/yyyy")

    def header(text: str) -> Column:
        parts = text.split("{end}")
        return F.lit(text) if len(parts) == 1 else F.concat(F.lit(parts[0]), end, F.lit(parts[1]))

    def row(number, cells: list[Column]) -> Column:
        return F.struct((F.lit(number) if isinstance(number, int) else number).cast("int")
                        .alias("row_no"), _cells(cells))

    frame = [
        row(1, [_cell(1, "s", F.concat(
            F.lit("Residential Market Share by Company and Policy Type ("), F.col("period"),
            F.lit(")")))]),
        row(2, [_cell(1, "s", F.concat(F.lit("(Data pulled on "), end, F.lit(")")))]),
        row(HEADER_ROW, [_cell(i + 1, "s", text[d]) for i, d in enumerate(dims)]
            + [_cell(col_no_of(i), "s", header(text[m])) for i, m in enumerate(metrics)]),
        row(F.col("n_rows") + HEADER_ROW + 1, [_cell(2, "s", " TOTAL ")]
            + [_cell(col_no_of(i), *shown(m)) for i, m in enumerate(metrics)]),
    ]
    frame = (periods.select(path, F.explode(F.array(*frame)).alias("r"))
                    .select("path", "r.row_no", "r.cells"))
    return body.unionByName(frame)


def panel_heads(periods: DataFrame, metrics: list[str], folder: str = "grid",
                layout: str = "B") -> DataFrame:
    """The heads alone of the sheets that ``panel_to_rows`` makes: title, pull note, headers.

    ``periods`` has one row per period; a boolean column named like a metric tells whether
    the period's sheet has a column for it (all of them without such a column)."""
    dims, text = DIMS[layout], HEADER_TEXT if layout == "B" else HEADER_TEXT_A
    q_odd = (F.substring(F.col("period"), -1, 1).cast("int") % 2) == 1
    n_d, n_m = len(dims), len(metrics)
    end = F.date_format(period_end(F.col("period")), "M/d/yyyy")

    def header(i: int, m: str) -> Column:
        parts = text[m].split("{end}")
        shown = F.lit(text[m]) if len(parts) == 1 else F.concat(F.lit(parts[0]), end, F.lit(parts[1]))
        if m in periods.columns:
            shown = F.when(F.col(m), shown)
        at = F.when(q_odd, F.lit(n_d + n_m - i)).otherwise(F.lit(n_d + 1 + i))
        return _cell(at, "s", shown)

    rows = [(1, [_cell(1, "s", F.concat(F.lit("Residential Market Share ("), F.col("period"),
                                         F.lit(")")))]),
            (2, [_cell(1, "s", F.concat(F.lit("(Data pulled on "), end, F.lit(")")))]),
            (HEADER_ROW, [_cell(i + 1, "s", text[d]) for i, d in enumerate(dims)]
             + [header(i, m) for i, m in enumerate(metrics)])]
    return periods.select(sheet_path(F.col("period"), folder, layout).alias("path"), F.explode(
        F.array(*[F.struct(F.lit(n).cast("int").alias("row_no"), _cells(c)) for n, c in rows]))
        .alias("r")).select("path", "r.row_no", "r.cells")


def sheet_heads(files: DataFrame, header_texts: dict[str, list[str]]) -> DataFrame:
    """Heads of sheets (``grid.ROWS_SCHEMA`` with a row 0 per file): ``files`` has path, title
    and kind; a file's header row 4 has the texts of its kind."""
    headers = F.coalesce(*[
        F.when(F.col("kind") == kind, _cells([_cell(i + 1, "s", t) for i, t in enumerate(texts)]))
        for kind, texts in header_texts.items()])
    none = F.map_from_arrays(F.array().cast("array<int>"),
                             F.array().cast("array<struct<kind: string, raw: string>>"))
    rows = [(0, none), (1, _cells([_cell(1, "s", F.col("title"))])), (HEADER_ROW, headers)]
    return files.select("path", F.explode(F.array(*[
        F.struct(F.lit(n).cast("int").alias("row_no"), c.alias("cells")) for n, c in rows]))
        .alias("r")).select("path", "r.row_no", "r.cells")
