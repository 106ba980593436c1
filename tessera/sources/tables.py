"""Bind the driver's star-schema tables to a filings panel.

Line items become filings: one row per (period, entity, segment) with the
Layout-B metric columns. The binding only renames and aggregates; every later
operator works on the panel and does not know where it came from.

Plan shape (checked with ``explain``): lineitem ⋈ part on the part key
(sort-merge at scale, AQE turns it into a broadcast when part is measured
small, and splits a skewed part key), partial aggregation before the shuffle on
(year, quarter, supplier, segment), and the supplier name joined *after*
aggregation, so the name join sees entity × segment × quarter rows, not line
items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import period_end, period_text, segment_line, segment_wind_only

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Metric columns the binding fills (a subset of Layout B's 23 keys).
BOUND_METRICS = ["pif", "tiv", "tiv_incl_wind", "dpw", "new_written", "received_in",
                 "cancelled", "nonrenewed", "transferred_out"]

PANEL_KEYS = ["period", "naic", "company", "policy_type"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def naic_text(key) -> F.Column:
    """Entity key text: left-padded with zeros to 5, never truncated."""
    s = key.cast("string")
    return F.lpad(s, F.greatest(F.lit(5), F.length(s)), "0")


def segment_text(p_type, p_size) -> F.Column:
    """Segment text from part attributes (see FIXTURES §5)."""
    prefix = (F.when(p_type.isin("STANDARD", "SMALL"), F.lit("Commercial Residential - "))
               .when(p_type == "PROMO", F.lit(""))
               .otherwise(F.lit("Personal Residential - ")))
    wind = F.when(p_size % 4 == 0, F.lit(" - WIND ONLY")).otherwise(F.lit(""))
    return F.concat(prefix, p_type, wind)


def _dec2(c) -> F.Column:
    return c.cast("decimal(18,2)")


def _units(c, digits: int) -> F.Column:
    """A value with ``digits`` decimals as an exact integer count of units."""
    return F.round(c * F.lit(10 ** digits)).cast("bigint")


def quarters(lo: str, hi: str, back: int = 0) -> list[str]:
    """The quarters from ``lo``, less ``back`` quarters, to ``hi`` (either may be the later)."""
    def number(p: str) -> int:
        return int(p[:4]) * 4 + int(p[-1]) - 1

    first, last = sorted((number(lo), number(hi)))
    return [f"{k // 4:04d}Q{k % 4 + 1}" for k in range(first - back, last + 1)]


def shipdate_window(periods) -> F.Column | None:
    """A scan predicate on ``l_shipdate`` covering the given periods.

    A period is derived from the ship date, so a filter on the period text is
    evaluated per row; these ranges, one per run of neighbouring quarters, are pushed into
    the Parquet scan and skip row groups whose dates fall outside.
    """
    keys = sorted({int(p[:4]) * 4 + int(p[-1]) - 1 for p in periods})
    ts, out = F.col("l_shipdate"), None

    def begin(k: int) -> F.Column:
        return F.to_timestamp_ntz(F.lit(f"{k // 4:04d}-{3 * (k % 4) + 1:02d}-01 00:00:00"))

    while keys:
        n = next((i for i in range(1, len(keys)) if keys[i] != keys[i - 1] + 1), len(keys))
        run = (ts >= begin(keys[0])) & (ts < begin(keys[n - 1] + 1))
        out, keys = run if out is None else out | run, keys[n:]
    return out


def period_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periods that have a line item: one column of the line items, one row a quarter."""
    li = read_table(spark, sf_dir, "lineitem").select("l_shipdate")
    found = li.groupBy(F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q")).agg(
        F.count(F.lit(1)))
    return found.where("y IS NOT NULL").select(period_text(F.col("y"), F.col("q")).alias("period"))


def filings_from_tables(spark: SparkSession, sf_dir: str, periods=None,
                        entities=None) -> DataFrame:
    """Layout-B filings panel from lineitem, part and supplier.

    Columns: period, period_end, naic, company, policy_type, line,
    is_wind_only, the BOUND_METRICS as DOUBLE, n_lines, suppressed ARRAY<STRING>.
    ``periods`` (optional) restricts the panel to those periods with ship-date
    ranges pushed into the lineitem scan; ``entities`` (a list of keys, pushed into the scan, or a
    table with a ``naic`` column, a semi join before the aggregation) to those entities.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    if periods is not None:
        window = shipdate_window(periods)
        li = li.filter(window) if window is not None else li.limit(0)
    if isinstance(entities, DataFrame):
        keys = entities.select(F.col("naic").cast("bigint").alias("_k"))
        li = li.join(keys, li.l_suppkey == keys._k, "left_semi")
    elif entities is not None:
        li = li.filter(F.col("l_suppkey").isin([int(e) for e in entities]))
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")

    j = li.join(part, li.l_partkey == part.p_partkey)
    # Money and quantities are exact two-decimal numbers: sum them as integer
    # hundredths (premium as ten-thousandths), which is exact like a DECIMAL sum
    # but runs on 64-bit longs inside generated code.
    price = _units(F.col("l_extendedprice"), 2)
    agg = (j.groupBy(F.year("l_shipdate").alias("year"),
                     F.quarter("l_shipdate").alias("quarter"),
                     F.col("l_suppkey").alias("suppkey"),
                     segment_text(F.col("p_type"), F.col("p_size")).alias("policy_type"))
            .agg(F.count(F.lit(1)).alias("n_lines"),
                 F.sum(_units(F.col("l_quantity"), 2)).alias("pif"),
                 F.sum(price).alias("tiv"),
                 F.sum(F.when(F.col("p_size") % 3 == 0, price)).alias("tiv_incl_wind"),
                 F.sum(price * _units(F.col("l_discount"), 2)).alias("dpw"),
                 F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("new_written"),
                 F.count(F.when(F.col("l_returnflag") == "N", 1)).alias("received_in"),
                 F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("cancelled"),
                 F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("nonrenewed"),
                 F.count(F.when(F.col("l_tax") == 0.08, 1)).alias("transferred_out")))
    scale = {"pif": 100.0, "tiv": 100.0, "tiv_incl_wind": 100.0, "dpw": 10000.0}

    named = agg.join(supplier, agg.suppkey == supplier.s_suppkey, "left")
    naic = naic_text(F.col("suppkey"))
    suppressed = (F.col("n_lines") == 1) & naic.endswith("5")
    company = F.when(F.col("year") < 1998, F.col("s_name")).otherwise(
        F.concat(F.col("s_name"), F.lit(" Mutual")))
    metrics = []
    for m in BOUND_METRICS:
        v = F.col(m).cast("double")
        if m in scale:
            v = v / F.lit(scale[m])
        if m in ("pif", "tiv"):
            v = F.when(~suppressed, v)
        metrics.append(v.alias(m))
    period = period_text(F.col("year"), F.col("quarter"))
    out = named.select(
        period.alias("period"),
        period_end(period).alias("period_end"),
        naic.alias("naic"),
        company.alias("company"),
        F.col("policy_type"),
        segment_line(F.col("policy_type")).alias("line"),
        segment_wind_only(F.col("policy_type")).alias("is_wind_only"),
        *metrics,
        F.col("n_lines"),
        F.when(suppressed, F.array(F.lit("pif"), F.lit("tiv")))
         .otherwise(F.array().cast("array<string>")).alias("suppressed"),
    )
    if periods is not None:
        out = out.filter(F.col("period").isin(sorted(set(periods))))
    return out


def summary_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second binding (Layout A): entity × period with a commercial / personal split.

    Same entities and periods as the Layout-B binding, but the split comes from
    the ordering customer's market segment (BUILDING, MACHINERY → commercial),
    not from the part, so A and B disagree by line where real filings would.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_shipdate")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    j = (li.join(orders, li.l_orderkey == orders.o_orderkey)
           .join(customer, F.col("o_custkey") == customer.c_custkey))
    commercial = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    qty = _units(F.col("l_quantity"), 2)
    prem = _units(F.col("l_extendedprice"), 2) * _units(F.col("l_discount"), 2)
    agg = (j.groupBy(F.year("l_shipdate").alias("year"),
                     F.quarter("l_shipdate").alias("quarter"),
                     F.col("l_suppkey").alias("suppkey"))
            .agg(F.sum(qty).alias("a_pif"),
                 F.sum(F.when(commercial, qty)).alias("a_pif_commercial"),
                 F.sum(F.when(~commercial, qty)).alias("a_pif_personal"),
                 F.sum(prem).alias("a_dpw"),
                 F.sum(F.when(commercial, prem)).alias("a_dpw_commercial"),
                 F.sum(F.when(~commercial, prem)).alias("a_dpw_personal")))
    named = agg.join(supplier, agg.suppkey == supplier.s_suppkey, "left")
    period = period_text(F.col("year"), F.col("quarter"))
    company = F.when(F.col("year") < 1998, F.col("s_name")).otherwise(
        F.concat(F.col("s_name"), F.lit(" Mutual")))
    cols = {"a_pif": 100.0, "a_pif_commercial": 100.0, "a_pif_personal": 100.0,
            "a_dpw": 10000.0, "a_dpw_commercial": 10000.0, "a_dpw_personal": 10000.0}
    return named.select(period.alias("period"), period_end(period).alias("period_end"),
                        naic_text(F.col("suppkey")).alias("naic"), company.alias("company"),
                        *[(F.col(c).cast("double") / F.lit(d)).alias(c) for c, d in cols.items()])
