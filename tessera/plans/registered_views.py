"""Registered queries: search through the index, grouping sets with the wind basis, mergeable
counts, and orders with their positions (P7-P9, A15, A17, W5, W13)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions.text import period_key
from ..operators import dims as D
from ..operators import metrics as M
from ..operators import name_index as NI
from ..operators import ranking as R
from ..operators import sketches as SK
from ..operators.slicing import period_range
from ..session import materialize, shared_path
from ..sources import sinks
from . import oracle as O
from .registered import (COMPANIES_SQL, RANGE, base_values_sql, filings, named, panel, register, tie)
from .viewspec import ViewSpec
from .views import snapshot_view

# ---------------------------------------------------------------- search
#: Names now and before, keys, short ones, and one that nothing has.
SEARCHES = ("Supplier#00000004", "MUTUAL", "0003", "#000000012 m", "7", "", "zzz", "ier#0000000")
_SEARCH_VALUES = ", ".join(f"('{q}')" for q in SEARCHES)


@register("entity_search_index", O.with_panel("""
SELECT q AS query, naic, name FROM queries JOIN companies
  ON contains(lower(name), lower(q)) OR contains(naic, lower(q))
  OR len(list_filter(names, lambda n: contains(lower(n), lower(q)))) > 0""", COMPANIES_SQL,
    f"queries AS (SELECT * FROM (VALUES {_SEARCH_VALUES}) t(q))"))
def entity_search_index(spark, sf_dir):
    """P7 through the published n-gram index, for several queries."""
    companies = materialize(D.companies(filings(spark, sf_dir)), "companies")
    out = shared_path(spark, f"search-{uuid.uuid4().hex}")
    sinks.publish({"companies": companies} | NI.index_tables(companies), out)
    stored = sinks.load_dataset(spark, out, ("companies", "name_grams", "gram_counts"))
    found = [NI.search_index(*stored.values(), q).select(F.lit(q).alias("query"), "naic", "name")
             for q in SEARCHES]
    return reduce(lambda a, b: a.unionByName(b), found)


# ---------------------------------------------------------------- grouping sets
SETS = (("period", "wind_basis"), ("line", "wind_basis"), ("period", "line"), ("policy_type",),
        ("naic", "wind_basis"), ())
SET_DIMS = ("period", "wind_basis", "line", "policy_type", "naic")


def _sets_sql() -> str:
    """Every set by itself: whole metrics, and for sets by wind basis its columns too."""
    parts = []
    for chosen in SETS:
        gid = sum(1 << (len(SET_DIMS) - 1 - i) for i, d in enumerate(SET_DIMS) if d not in chosen)
        sources = [("CASE WHEN is_wind_only THEN 'wind_only' ELSE 'all' END", "tiv", "dpw", "pif")]
        if "wind_basis" in chosen:
            sources.append(("'incl'", "tiv_incl_wind", "NULL", "NULL"))
        for basis, tiv, dpw, pif in sources:
            shown = ", ".join((f"{basis if d == 'wind_basis' else d} AS {d}") if d in chosen
                              else f"NULL::VARCHAR AS {d}" for d in SET_DIMS)
            parts.append(f"SELECT {shown}, {gid}::BIGINT AS grouping_id, {tiv} AS tiv, "
                         f"{dpw}::DOUBLE AS dpw, {pif}::DOUBLE AS pif FROM panel")
    keys = ", ".join((*SET_DIMS, "grouping_id"))
    rows = " UNION ALL ".join(parts)
    return O.with_panel(f"""
SELECT {keys}, {O.xsum('tiv')} AS tiv, {O.xsum('pif')} AS pif,
       CASE WHEN {O.xsum0('tiv')} <> 0 THEN {O.xsum0('dpw')} / {O.xsum0('tiv')} END AS rate_on_line
FROM ({rows}) GROUP BY {keys}""")


@register("rollup_wind_sets", _sets_sql())
def rollup_wind_sets(spark, sf_dir):
    """Six grouping sets, three of them by wind basis, in one pass."""
    return M.rollup_sets(filings(spark, sf_dir), SETS, ["tiv", "pif", "rate_on_line"])


# ---------------------------------------------------------------- mergeable counts
_COUNTS = """
count(DISTINCT period) AS periods, count(*) AS facts, count(DISTINCT naic) AS entities,
       count(DISTINCT policy_type) FILTER (policy_type <> '') AS segments,
       count(DISTINCT naic || '|' || policy_type) AS pairs, true AS within_bound"""


@register("sketch_counts", O.with_panel(f"""
SELECT 'all' AS span, {_COUNTS} FROM panel
UNION ALL SELECT 'range' AS span, {_COUNTS} FROM panel
  WHERE period BETWEEN '{RANGE[0]}' AND '{RANGE[1]}'
UNION ALL SELECT 'year ' || substr(period, 1, 4) AS span, {_COUNTS} FROM panel GROUP BY 1"""))
def sketch_counts(spark, sf_dir):
    """Exact counts beside estimates from merged sketches of the quarters, and whether
    every estimate keeps its stated error."""
    facts = panel(spark, sf_dir, "period", "naic", "policy_type")
    kept = materialize(SK.period_sketches(facts), "sketches")

    def spans(df):
        year = df.withColumn("span", F.concat(F.lit("year "), F.substring("period", 1, 4)))
        return [df.withColumn("span", F.lit("all")),
                period_range(df, *RANGE).withColumn("span", F.lit("range")), year]

    def union(parts):
        return reduce(lambda a, b: a.unionByName(b), parts)

    exact = union([df.groupBy("span").agg(
        F.countDistinct("period").alias("periods"), F.count(F.lit(1)).alias("facts"),
        *[F.countDistinct(F.expr(e)).alias(n) for n, e in SK.COUNTED.items()]) for df in spans(facts)])
    told = union([SK.estimates(df, ["span"]) for df in spans(kept)])
    near = [F.abs(F.col(f"told.{n}") - F.col(f"exact.{n}")) <= SK.BOUND * F.col(f"exact.{n}")
            for n in SK.COUNTED]
    near += [F.col(f"told.{n}") == F.col(f"exact.{n}") for n in ("periods", "facts")]
    return exact.alias("exact").join(told.alias("told"), "span").select(
        "span", *[F.col(f"exact.{n}") for n in ("periods", "facts", *SK.COUNTED)],
        reduce(lambda a, b: a & b, near).alias("within_bound"))


# ---------------------------------------------------------------- orders
@register("resorted_view", O.with_panel(f"""
SELECT row_number() OVER (ORDER BY value, rank NULLS LAST) AS position,
       CAST(rank AS DOUBLE) AS rank, naic, company, value
FROM (SELECT r.rank, r.naic, coalesce(c.name, r.naic) AS company, r.value
      FROM ranked r LEFT JOIN companies c ON c.naic = r.naic WHERE r.rank <= 15
      UNION ALL
      SELECT NULL, NULL, 'All others', {O.xsum0('value')} FROM ranked WHERE rank > 15
      HAVING {O.xsum0('value')} > 0)""", COMPANIES_SQL, f"""
ranked AS (SELECT naic, value, row_number() OVER (ORDER BY value DESC, {tie()}) AS rank
           FROM ({base_values_sql('dpw', "period = '1999Q1'")}) v WHERE value IS NOT NULL)"""))
def resorted_view(spark, sf_dir):
    """A share view cut to its top, turned to ascending values, with every row's place."""
    spec = ViewSpec(mode="share", metric="dpw", topn=15, period="1999Q1")
    view = named(snapshot_view(filings(spark, sf_dir), spec), sf_dir)
    out = R.resort(view, "value", 1, position="position")
    return out.select("position", F.col("rank").cast("double").alias("rank"), "naic", "company", "value")


@register("sorted_dimensions", O.with_panel("""
SELECT 'period' AS kind, row_number() OVER (ORDER BY p DESC) AS position, p AS value
FROM (SELECT DISTINCT period AS p FROM panel)
UNION ALL
SELECT 'segment', row_number() OVER (ORDER BY s), s
FROM (SELECT DISTINCT policy_type AS s FROM panel WHERE policy_type <> '')
UNION ALL
SELECT 'company', row_number() OVER (ORDER BY lower(name), naic), naic FROM companies""",
    COMPANIES_SQL))
def sorted_dimensions(spark, sf_dir):
    """Periods (newest first), segments and companies in their orders, with positions."""
    fl = panel(spark, sf_dir, "period", "naic", "company", "policy_type")
    lists = [("period", fl.select("period").distinct(), [period_key(F.col("period")).desc()], "period"),
             ("segment", D.segments(fl), [F.col("policy_type")], "policy_type"),
             ("company", D.companies(fl), [F.lower("name"), F.col("naic")], "naic")]
    parts = [R.positions(df, *order).select(F.lit(kind).alias("kind"), "position",
                                            F.col(value).alias("value"))
             for kind, df, order, value in lists]
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---------------------------------------------------------------- export
@register("csv_export", O.with_panel(f"""
SELECT period, rank, naic, coalesce(company, '') AS company, value FROM (
  SELECT v.period, CAST(row_number() OVER (PARTITION BY v.period ORDER BY v.value DESC, {tie('v.naic')})
                        AS BIGINT) AS rank,
         v.naic, coalesce(c.name, v.naic) || CASE WHEN v.naic LIKE '%5' THEN ', "Inc"' ELSE '' END
           AS company, v.value
  FROM ({base_values_sql('tiv')}) v LEFT JOIN companies c ON c.naic = v.naic
  WHERE v.value IS NOT NULL)""", COMPANIES_SQL))
def csv_export(spark, sf_dir):
    """SNK2: a full ranking, with names that need quoting, exported as CSV under label headers
    and read back by Spark's reader."""
    fl = panel(spark, sf_dir, "period", "naic", "company", "tiv")
    ranked = R.with_names(R.rank_top(M.entity_values(fl, "tiv"), None), D.companies(fl))
    hard = F.when(F.col("naic").endswith("5"), F.lit(', "Inc"')).otherwise("")
    view = ranked.select("period", "rank", "naic", F.concat("company", hard).alias("company"), "value")
    path = shared_path(spark, f"csv-{uuid.uuid4().hex}")
    labels = {"period": "Quarter", "rank": "Rank", "naic": "NAIC", "company": "Company", "value": "TIV ($)"}
    sinks.export_csv(view, path, labels)
    back = spark.read.option("header", True).option("escape", '"').schema(
        "`Quarter` string, `Rank` long, `NAIC` string, `Company` string, `TIV ($)` double").csv(path)
    return back.toDF(*labels)
