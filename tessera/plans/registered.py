"""Registered queries: each builds its view from the driver tables (via the
panel binding) and has an independent SQL twin in ``SQL`` for the oracle check.

Parameters are fixed per query so both sides compute the same thing at any
scale. Values come from a scan with the view's ship-date window, entities and metric columns;
the period catalogue and display names from passes over the columns they need, the names after
the cut, for the entities shown. Only a view of every entity writes (those columns of) the panel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import labels as L
from ..functions.numbers import clean_number, growth_pct, is_suppressed
from ..operators import dims as D
from ..operators import grid as G
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import ranking as R
from ..operators import reshape as RS
from ..operators import search as SE
from ..operators import series as S
from ..operators.slicing import select_entities, slice_filings
from ..session import materialize
from ..sources import files as FS
from ..sources import sheet_fixtures as SF
from ..sources.tables import (BOUND_METRICS, filings_from_tables, naic_text, period_catalogue,
                              quarters, read_table, summary_from_tables)
from . import oracle as O
from .viewspec import ViewSpec
from .views import captions, dataset_caption, series_captions, snapshot_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# Fixed parameters shared by both sides.
SNAP_PERIOD = "2000Q2"
GAP_SEGMENT = "Commercial Residential - SMALL - WIND ONLY"
WIND_SEGMENTS = (GAP_SEGMENT, "Personal Residential - LARGE - WIND ONLY")
SERIES_ENTITIES = ("00012", "00035", "00064", "00095")
RANGE = ("1998Q1", "2000Q4")

# ---------------------------------------------------------------- SQL pieces
PK = "(CAST(substr({p}, 1, 4) AS INTEGER) * 10 + CAST(right({p}, 1) AS INTEGER))"
TIE = ("CASE WHEN regexp_full_match({k}, '^(0|[1-9][0-9]*)$') THEN length({k}) END "
       "ASC NULLS LAST, {k} ASC")


def pk(p="period"):
    return PK.format(p=p)


def tie(k="naic"):
    return TIE.format(k=k)


COMPANIES_SQL = f"""
co_names AS (
  SELECT naic, company, count(*) AS cnt, min({pk()}) AS first_pk
  FROM panel WHERE company <> '' GROUP BY naic, company
),
co_best AS (
  SELECT naic, company AS name FROM (
    SELECT *, row_number() OVER (PARTITION BY naic ORDER BY cnt DESC, first_pk ASC, company ASC) AS rn
    FROM co_names) WHERE rn = 1
),
companies AS (
  SELECT s.naic, coalesce(b.name, s.naic) AS name, s.names, s.first, s.last, s.n_periods
  FROM (SELECT naic, arg_min(period, {pk()}) AS first, arg_max(period, {pk()}) AS last,
               count(DISTINCT period) AS n_periods,
               list_sort(list_distinct(list(company) FILTER (WHERE company <> ''))) AS names
        FROM panel GROUP BY naic) s
  LEFT JOIN co_best b ON s.naic = b.naic
)"""


def base_values_sql(metric_col: str, where: str = "TRUE") -> str:
    return (f"SELECT period, naic, {O.xsum(metric_col)} AS value FROM panel "
            f"WHERE {where} GROUP BY period, naic")


DERIVED_SQL = {
    "net_flow": ("s_new + s_received - s_cancelled - s_nonrenewed - s_moved"),
    "avg_premium": "CASE WHEN pif_s <> 0 THEN dpw_s / pif_s END",
    "rate_on_line": "CASE WHEN tiv_s <> 0 THEN dpw_s / tiv_s END",
    "wind_concentration": "CASE WHEN tiv_s <> 0 THEN tivw_s / tiv_s END",
}


DERIVED_PARTS = {"dpw_s": "dpw", "pif_s": "pif", "tiv_s": "tiv", "tivw_s": "tiv_incl_wind",
                 "s_new": "new_written", "s_received": "received_in", "s_cancelled": "cancelled",
                 "s_nonrenewed": "nonrenewed", "s_moved": "transferred_out"}


def derived_parts_sql() -> str:
    return ", ".join(f"{O.xsum0(col)} AS {name}" for name, col in DERIVED_PARTS.items())


def derived_values_sql(metric_id: str, where: str = "TRUE", by: str = "period, naic") -> str:
    return (f"SELECT {by}, {DERIVED_SQL[metric_id]} AS value FROM ("
            f"SELECT {by}, {derived_parts_sql()} FROM panel WHERE {where} GROUP BY {by})")


def rank_sql(values_sql: str, n: int | None) -> str:
    ranked = f"""
ranked AS (
  SELECT period, naic, value,
         CAST(row_number() OVER (PARTITION BY period ORDER BY value DESC, {tie()}) AS BIGINT) AS rank
  FROM ({values_sql}) ev WHERE value IS NOT NULL
)"""
    return O.with_panel(f"""
SELECT r.period, r.rank, r.naic, coalesce(c.name, r.naic) AS company, r.value
FROM ranked r LEFT JOIN companies c ON r.naic = c.naic
WHERE {'TRUE' if n is None else f'r.rank <= {n}'}""", COMPANIES_SQL, ranked)


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings_from_tables(spark, sf_dir)


def panel(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the panel, written once: for views that show every entity, and so read
    it for their values and for the names. Only what the columns need is scanned."""
    return materialize(filings(spark, sf_dir).select(*columns), "panel")


def names_of(spark: SparkSession, sf_dir: str, entities) -> DataFrame:
    """The companies dimension of some entities, from a pass over their line items' keys."""
    return D.companies(filings_from_tables(spark, sf_dir, entities=entities))


def named(view: DataFrame, sf_dir: str) -> DataFrame:
    """A view cut to a report's size, with display names in place of its keys.

    The view's rows are written, and the names come from the line items of the entities
    that it shows: what the view leaves out is never named, nor is a panel written."""
    spark, order = view.sparkSession, [c for c in ("period", "rank") if c in view.columns]
    shown = materialize(view, "view")
    names = names_of(spark, sf_dir, shown.select("naic").where("naic IS NOT NULL").distinct())
    labels = names.select("naic", F.col("name").alias("_name"))
    told = shown.join(labels, "naic", "left").withColumn("company", F.coalesce("_name", "company"))
    return told.select(*view.columns).orderBy(*[F.col(c).asc_nulls_last() for c in order])


# ---------------------------------------------------------------- rankings
def _rank_query(spec: ViewSpec, all_periods: bool):
    def run(spark, sf_dir):
        fl = filings_from_tables(spark, sf_dir, None if all_periods else [spec.period])
        return named(snapshot_view(fl, spec, all_periods=all_periods), sf_dir)
    return run


def _where(line="all", wind_only=False, segments=(), period=None) -> str:
    conds = []
    if period:
        conds.append(f"period = '{period}'")
    if line != "all":
        conds.append(f"line = '{line}'")
    if wind_only:
        conds.append("is_wind_only")
    if segments:
        conds.append("policy_type IN (" + ", ".join(f"'{s}'" for s in segments) + ")")
    return " AND ".join(conds) or "TRUE"


def _reg_rank(name, spec: ViewSpec, all_periods: bool, metric_col: str):
    where = _where(spec.line, spec.wind_only, spec.segments,
                   None if all_periods else spec.period)
    m = C.metric(spec.metric)
    vals = derived_values_sql(spec.metric, where) if m.derived else base_values_sql(metric_col, where)
    register(name, rank_sql(vals, spec.topn))(_rank_query(spec, all_periods))


_reg_rank("rank_topn", ViewSpec(metric="tiv", topn=20), True, "tiv")
_reg_rank("rank_commercial", ViewSpec(metric="tiv", topn=20, period=SNAP_PERIOD,
                                      line="Commercial Residential"), False, "tiv")
_reg_rank("rank_windonly_types", ViewSpec(metric="tiv", topn=10, wind_only=True,
                                          segments=WIND_SEGMENTS), True, "tiv")
_reg_rank("rank_wind_basis", ViewSpec(metric="tiv", wind="incl", topn=10), True, "tiv_incl_wind")
_reg_rank("rank_wind_fallback", ViewSpec(metric="pif", wind="excl", topn=10), True, "pif")
_reg_rank("net_flow", ViewSpec(metric="net_flow", topn=20, line="Commercial Residential"),
          True, "")
_reg_rank("avg_premium", ViewSpec(metric="avg_premium", topn=20), True, "")
_reg_rank("rate_on_line", ViewSpec(metric="rate_on_line", topn=20), True, "")
_reg_rank("wind_concentration", ViewSpec(metric="wind_concentration", topn=20), True, "")


# ---------------------------------------------------------------- share + others
SHARE_N = 10


@register("share_topn_others", O.with_panel(f"""
SELECT period, CAST(rank AS DOUBLE) AS rank, naic, company, value, share FROM top
UNION ALL
SELECT o.period, CAST(o.rank AS DOUBLE), o.naic, o.company, o.value,
       CASE WHEN t.total <> 0 THEN o.value / t.total END AS share
FROM others o JOIN tot t ON o.period = t.period WHERE o.value > 0""", COMPANIES_SQL, f"""
ev AS ({base_values_sql('tiv')}),
present AS (SELECT * FROM ev WHERE value IS NOT NULL),
tot AS (SELECT period, {O.xsum0('value')} AS total FROM present GROUP BY period),
ranked AS (
  SELECT period, naic, value,
         CAST(row_number() OVER (PARTITION BY period ORDER BY value DESC, {tie()}) AS BIGINT) AS rank
  FROM present
),
top AS (
  SELECT r.period, r.rank, r.naic, coalesce(c.name, r.naic) AS company, r.value,
         CASE WHEN t.total <> 0 THEN r.value / t.total END AS share
  FROM ranked r LEFT JOIN companies c ON r.naic = c.naic JOIN tot t ON r.period = t.period
  WHERE r.rank <= {SHARE_N}
),
others AS (
  SELECT r.period, CAST(NULL AS BIGINT) AS rank, CAST(NULL AS VARCHAR) AS naic,
         'All others' AS company, {O.xsum0('r.value')} AS value
  FROM ranked r WHERE r.rank > {SHARE_N} GROUP BY r.period
)"""))
def share_topn_others(spark, sf_dir):
    spec = ViewSpec(mode="share", metric="tiv", topn=SHARE_N)
    view = snapshot_view(filings(spark, sf_dir), spec, all_periods=True)
    return _rank_as_double(named(view, sf_dir))


def _rank_as_double(df):
    # The others row has no rank; a nullable integer converts differently per
    # engine client, so the checked output carries the rank as DOUBLE.
    return df.withColumn("rank", F.col("rank").cast("double"))


@register("share_ratio_metric", O.with_panel(f"""
SELECT r.period, CAST(r.rank AS DOUBLE) AS rank, r.naic, coalesce(c.name, r.naic) AS company,
       r.value, CAST(NULL AS DOUBLE) AS share
FROM ranked r LEFT JOIN companies c ON r.naic = c.naic WHERE r.rank <= {SHARE_N}
UNION ALL
SELECT period, CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR), 'All others', dpw / tiv,
       CAST(NULL AS DOUBLE)
FROM others WHERE tiv <> 0 AND dpw / tiv > 0""", COMPANIES_SQL, f"""
parts AS (
  SELECT period, naic, {O.xsum0('dpw')} AS dpw, {O.xsum0('tiv')} AS tiv FROM panel
  WHERE line = 'Personal Residential' GROUP BY period, naic
),
ranked AS (
  SELECT period, naic, dpw / tiv AS value,
         CAST(row_number() OVER (PARTITION BY period ORDER BY dpw / tiv DESC, {tie()}) AS BIGINT)
           AS rank
  FROM parts WHERE tiv <> 0
),
others AS (
  SELECT period, {O.xsum0('dpw')} AS dpw, {O.xsum0('tiv')} AS tiv FROM parts p
  WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.period = p.period AND r.naic = p.naic
                    AND r.rank <= {SHARE_N})
  GROUP BY period
)"""))
def share_ratio_metric(spark, sf_dir):
    """Q3 fix: a ratio metric in share mode has no share; the rest's value is the ratio
    of the rest's sums."""
    spec = ViewSpec(mode="share", metric="rate_on_line", topn=SHARE_N,
                    line="Personal Residential")
    view = snapshot_view(filings(spark, sf_dir), spec, all_periods=True)
    return _rank_as_double(named(view, sf_dir))


@register("share_all", O.with_panel(f"""
SELECT v.period, CAST(row_number() OVER (PARTITION BY v.period ORDER BY v.value DESC, {tie('v.naic')})
                      AS DOUBLE) AS rank,
       v.naic, coalesce(c.name, v.naic) AS company, v.value,
       CASE WHEN t.total <> 0 THEN v.value / t.total END AS share
FROM vals v JOIN (SELECT period, {O.xsum('value')} AS total FROM vals GROUP BY period) t
  ON v.period = t.period LEFT JOIN companies c ON c.naic = v.naic""", COMPANIES_SQL,
    f"vals AS ({base_values_sql('pif')} HAVING {O.xsum('pif')} IS NOT NULL)"))
def share_all(spark, sf_dir):
    """W2 without a cut: every entity with its share and no row of others."""
    fl = panel(spark, sf_dir, "period", "naic", "company", "pif")
    spec = ViewSpec(mode="share", metric="pif", topn=None)
    return _rank_as_double(snapshot_view(fl, spec, companies=D.companies(fl), all_periods=True))


# ---------------------------------------------------------------- totals
TOTAL_METRICS = ["tiv", "pif", "dpw", "net_flow", "avg_premium", "rate_on_line",
                 "wind_concentration"]


@register("slice_totals", O.with_panel(f"""
SELECT period, tiv, pif, dpw, s_new + s_received - s_cancelled - s_nonrenewed - s_moved AS net_flow,
       CASE WHEN pif_s <> 0 THEN dpw_s / pif_s END AS avg_premium,
       CASE WHEN tiv_s <> 0 THEN dpw_s / tiv_s END AS rate_on_line,
       CASE WHEN tiv_s <> 0 THEN tivw_s / tiv_s END AS wind_concentration
FROM (SELECT period, {O.xsum0('tiv')} AS tiv, {O.xsum0('pif')} AS pif, {O.xsum0('dpw')} AS dpw,
             {derived_parts_sql()}
      FROM panel WHERE line = 'Commercial Residential' GROUP BY period)"""))
def slice_totals(spark, sf_dir):
    """Whole-slice totals of seven metrics, one aggregation."""
    fl = slice_filings(filings(spark, sf_dir), line="Commercial Residential")
    return M.slice_totals_many(fl, TOTAL_METRICS)


@register("entity_and_total_groupingsets", O.with_panel(f"""
SELECT period, naic, grouping(naic) = 1 AS is_total,
       CASE WHEN grouping(naic) = 1 THEN coalesce({O.xsum('tiv')}, 0.0) ELSE {O.xsum('tiv')} END
         AS value
FROM panel WHERE line = 'Personal Residential'
GROUP BY GROUPING SETS ((period, naic), (period))"""))
def entity_and_total_groupingsets(spark, sf_dir):
    fl = slice_filings(filings(spark, sf_dir), line="Personal Residential")
    return M.entity_and_totals(fl, "tiv")


@register("multi_metric", O.with_panel(f"""
SELECT period, naic, {O.xsum('tiv')} AS tiv, {O.xsum('dpw')} AS dpw,
       {O.xsum0('new_written')} + {O.xsum0('received_in')} - {O.xsum0('cancelled')}
         - {O.xsum0('nonrenewed')} - {O.xsum0('transferred_out')} AS net_flow,
       CASE WHEN {O.xsum0('tiv')} <> 0 THEN {O.xsum0('dpw')} / {O.xsum0('tiv')} END AS rate_on_line
FROM panel GROUP BY period, naic"""))
def multi_metric(spark, sf_dir):
    fl = filings(spark, sf_dir)
    return M.multi_metric(fl, ["tiv", "dpw", "net_flow", "rate_on_line"])


# ---------------------------------------------------------------- dimensions
@register("dim_companies", O.with_panel("""
SELECT naic, name, array_to_string(names, '|') AS names, first, last, n_periods
FROM companies""", COMPANIES_SQL))
def dim_companies(spark, sf_dir):
    c = D.companies(filings(spark, sf_dir))
    return c.select("naic", "name", F.array_join("names", "|").alias("names"), "first", "last",
                    "n_periods")


@register("dim_segments", O.with_panel(r"""
SELECT DISTINCT policy_type, line, is_wind_only,
       trim(regexp_replace(regexp_replace(policy_type,
              '^(commercial residential|personal residential)\s*-?\s*', '', 'i'),
            '\s*-?\s*wind only.*$', '', 'i')) AS family
FROM panel WHERE policy_type <> ''"""))
def dim_segments(spark, sf_dir):
    return D.segments(filings(spark, sf_dir))


# ---------------------------------------------------------------- series / growth
def _series_query(metric_id, entities, rng, transform="abs", basis="position",
                  segments=(), line="all"):
    def run(spark, sf_dir):
        back = {"qoq": 1, "yoy": 4}.get(transform, 0) if basis == "calendar" else 0
        fl = filings_from_tables(spark, sf_dir, quarters(*rng, back), entities)
        sl = slice_filings(fl, line=line, segments=segments)
        return S.series(sl, metric_id, "all", period_catalogue(spark, sf_dir), rng[0], rng[1],
                        entities=entities, transform=transform, basis=basis,
                        companies=names_of(spark, sf_dir, entities))
    return run


def _targets_sql(entities) -> str:
    vals = ", ".join(f"('{e}')" for e in entities)
    return f"targets AS (SELECT * FROM (VALUES {vals}) t(target))"


def _rng_sql(rng) -> str:
    lo, hi = rng
    return (f"rng AS (SELECT period, row_number() OVER (ORDER BY {pk()}) AS pos "
            f"FROM (SELECT DISTINCT period FROM panel) "
            f"WHERE {pk()} BETWEEN {pk(repr(lo))} AND {pk(repr(hi))})")


def _prev_sql(p: str, step: int) -> str:
    k = f"(CAST(substr({p}, 1, 4) AS INTEGER) * 4 + CAST(right({p}, 1) AS INTEGER) - 1 - {step})"
    return f"(CAST({k} // 4 AS VARCHAR) || 'Q' || CAST({k} % 4 + 1 AS VARCHAR))"


GROWTH = ("CASE WHEN {v} IS NOT NULL AND {b} IS NOT NULL AND {b} <> 0 "
          "THEN ({v} - {b}) / {b} * 100.0 END")


def _series_sql(metric_id, entities, rng, transform="abs", basis="position", where="TRUE"):
    m = C.metric(metric_id)
    vals = (derived_values_sql(metric_id, where) if m.derived
            else base_values_sql(metric_id, where))
    ctes = [COMPANIES_SQL, _targets_sql(entities), _rng_sql(rng),
            f"vals AS (SELECT naic AS target, period, value FROM ({vals}))",
            "grid AS (SELECT t.target, r.period, r.pos, v.value FROM targets t CROSS JOIN rng r "
            "LEFT JOIN vals v ON v.target = t.target AND v.period = r.period)"]
    step = 1 if transform == "qoq" else 4
    if transform == "abs":
        disp = "g.value"
        src = "grid g"
    elif basis == "position":
        disp = GROWTH.format(v="g.value", b=f"lag(g.value, {step}) OVER (PARTITION BY g.target ORDER BY g.pos)")
        src = "grid g"
    else:
        disp = GROWTH.format(v="g.value", b="bv.value")
        src = (f"grid g LEFT JOIN vals bv ON bv.target = g.target "
               f"AND bv.period = {_prev_sql('g.period', step)}")
    body = f"""
SELECT g.target, coalesce(c.name, g.target) AS name, g.period, g.value, {disp} AS display
FROM {src} LEFT JOIN companies c ON c.naic = g.target"""
    return O.with_panel(body, *ctes)


def _reg_series(name, metric_id, entities, rng, transform="abs", basis="position",
                segments=(), line="all"):
    where = _where(line, False, segments)
    register(name, _series_sql(metric_id, entities, rng, transform, basis, where))(
        _series_query(metric_id, entities, rng, transform, basis, segments, line))


_reg_series("series_compare", "tiv", SERIES_ENTITIES, RANGE, segments=(GAP_SEGMENT,))
_reg_series("growth_qoq", "tiv", SERIES_ENTITIES, ("1997Q3", "2001Q2"), "qoq",
            segments=(GAP_SEGMENT,))
_reg_series("growth_yoy", "dpw", SERIES_ENTITIES, ("1997Q3", "2001Q2"), "yoy",
            segments=(GAP_SEGMENT,))
_reg_series("growth_calendar", "tiv", SERIES_ENTITIES, ("1997Q3", "2001Q2"), "yoy",
            basis="calendar", segments=(GAP_SEGMENT,))
_reg_series("growth_net_flow_qoq", "net_flow", SERIES_ENTITIES, ("1996Q1", "2001Q4"), "qoq",
            line="Commercial Residential")


def _all_sql(where: str, display: str, *ctes: str) -> str:
    return O.with_panel(f"""
SELECT '{C.ALL_TARGET}' AS target, '{C.ALL_TARGET_NAME}' AS name, period, value,
       {display} AS display FROM grid""", *ctes, f"""
grid AS (SELECT r.period, r.pos, coalesce(v.value, 0.0) AS value
         FROM rng r LEFT JOIN (SELECT period, {O.xsum0('dpw')} AS value FROM panel
                               WHERE {where} GROUP BY period) v ON v.period = r.period)""")


@register("series_all", _all_sql("line = 'Personal Residential'", "value",
                                 _rng_sql(("1996Q1", "2001Q4"))))
def series_all(spark, sf_dir):
    """No entity chosen → the slice total per period (0 when empty)."""
    fl = filings_from_tables(spark, sf_dir, quarters("1996Q1", "2001Q4"))
    sl = slice_filings(fl, line="Personal Residential")
    return S.series(sl, "dpw", "all", period_catalogue(spark, sf_dir), "1996Q1", "2001Q4")


GAP_ENTITY = "00012"


@register("series_all_gap_qoq", _all_sql(
    f"policy_type = '{GAP_SEGMENT}' AND naic = '{GAP_ENTITY}'",
    GROWTH.format(v="value", b="lag(value, 1) OVER (ORDER BY pos)"),
    _rng_sql(("1996Q1", "2001Q4"))))
def series_all_gap_qoq(spark, sf_dir):
    """W9 + W6 on a slice with empty quarters: 0 there, −100 % into the gap."""
    fl = filings_from_tables(spark, sf_dir, quarters("1996Q1", "2001Q4"), [GAP_ENTITY])
    sl = slice_filings(fl, segments=(GAP_SEGMENT,))
    return S.series(sl, "dpw", "all", period_catalogue(spark, sf_dir), "1996Q1", "2001Q4",
                    transform="qoq")


@register("share_over_time", O.with_panel(f"""
SELECT v.period, v.naic, v.value, CASE WHEN t.total <> 0 THEN v.value / t.total END AS share
FROM vals v JOIN (SELECT period, {O.xsum0('value')} AS total FROM vals GROUP BY period) t
  ON v.period = t.period""", f"vals AS ({base_values_sql('tiv')} HAVING {O.xsum('tiv')} IS NOT NULL)"))
def share_over_time(spark, sf_dir):
    """Every entity's share of the slice in every period."""
    return S.shares(filings(spark, sf_dir), "tiv")


@register("share_delta", O.with_panel("""
SELECT g.period, g.naic, s.value, s.share,
       CASE WHEN s.share IS NOT NULL AND lag(s.share) OVER (PARTITION BY g.naic ORDER BY g.pos) IS NOT NULL
            THEN s.share - lag(s.share) OVER (PARTITION BY g.naic ORDER BY g.pos) END AS share_delta
FROM (SELECT e.naic, r.period, r.pos FROM (SELECT DISTINCT naic FROM sh) e CROSS JOIN rng r) g
LEFT JOIN sh s ON s.naic = g.naic AND s.period = g.period""",
    _rng_sql(RANGE),
    f"vals AS (SELECT * FROM ({base_values_sql('tiv', _where(segments=(GAP_SEGMENT,)))}) "
    f"WHERE value IS NOT NULL AND period IN (SELECT period FROM rng))",
    f"""sh AS (SELECT v.period, v.naic, v.value,
                     CASE WHEN t.total <> 0 THEN v.value / t.total END AS share
              FROM vals v JOIN (SELECT period, {O.xsum0('value')} AS total FROM vals GROUP BY period) t
                ON v.period = t.period)"""))
def share_delta(spark, sf_dir):
    """Share change against the previous period of the range (gaps stay null)."""
    sl = slice_filings(filings_from_tables(spark, sf_dir, quarters(*RANGE)), segments=(GAP_SEGMENT,))
    return S.share_delta(sl, "tiv", period_catalogue(spark, sf_dir), RANGE[0], RANGE[1])


@register("growth_rank", O.with_panel(f"""
SELECT r.period, r.rank, r.naic, coalesce(c.name, r.naic) AS company, r.now, r.base,
       r.value AS growth
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY period ORDER BY value DESC, {tie()}) AS BIGINT) AS rank
      FROM g WHERE value IS NOT NULL) r
LEFT JOIN companies c ON c.naic = r.naic
WHERE r.rank <= 20""", COMPANIES_SQL,
    f"vals AS ({base_values_sql('tiv')})",
    f"""g AS (SELECT n.period, n.naic, n.value AS now, b.value AS base,
                    {GROWTH.format(v='n.value', b='b.value')} AS value
             FROM vals n LEFT JOIN vals b ON b.naic = n.naic AND b.period = '1999Q2'
             WHERE n.period = '{SNAP_PERIOD}')"""))
def growth_rank(spark, sf_dir):
    """Year-on-year TIV growth of every entity in one period, ranked."""
    fl = filings_from_tables(spark, sf_dir, [SNAP_PERIOD, S.calendar_shift(SNAP_PERIOD, 4)])
    return named(S.growth_rank(fl, "tiv", SNAP_PERIOD, "yoy", 20), sf_dir)


@register("new_dropped", O.with_panel(f"""
SELECT e.period, e.naic, 'new' AS change
FROM ents e JOIN pairs p ON e.period = p.period
WHERE NOT EXISTS (SELECT 1 FROM ents x WHERE x.period = p.prev AND x.naic = e.naic)
UNION ALL
SELECT p.period, e.naic, 'dropped' AS change
FROM ents e JOIN pairs p ON e.period = p.prev
WHERE NOT EXISTS (SELECT 1 FROM ents x WHERE x.period = p.period AND x.naic = e.naic)""",
    f"ents AS (SELECT DISTINCT period, naic FROM panel WHERE {_where(segments=(GAP_SEGMENT,))})",
    f"""pairs AS (SELECT period, lag(period) OVER (ORDER BY {pk()}) AS prev
                 FROM (SELECT DISTINCT period FROM panel) QUALIFY prev IS NOT NULL)"""))
def new_dropped(spark, sf_dir):
    """Entities new or dropped against the previous quarter."""
    sl = slice_filings(filings(spark, sf_dir), segments=(GAP_SEGMENT,))
    return S.new_and_dropped(sl, period_catalogue(spark, sf_dir))


# ---------------------------------------------------------------- grids and cells

METRIC_LIST = ", ".join(BOUND_METRICS)


def _grid(spark, sf_dir):
    # The grid is the persisted unit of the ingest (one pass over the source, read by
    # every later step), so it is materialised once.
    grid = materialize(SF.panel_to_rows(filings(spark, sf_dir), BOUND_METRICS), "grid")
    # One title row per sheet gives the workbook list.
    return grid, FS.describe_files(grid.filter(F.col("row_no") == 1).select("path"))


@register("grid_to_wide", O.with_panel(f"""
SELECT period, naic, company, policy_type, line, is_wind_only, {METRIC_LIST},
       CASE WHEN is_sup THEN 'pif|tiv' ELSE '' END AS suppressed
FROM panel"""))
def grid_to_wide(spark, sf_dir):
    """N1-N10 round trip: panel → sheet cells → header detection, rules, cleaning,
    footer split, pivot → the panel again."""
    grid, files = _grid(spark, sf_dir)
    facts = G.parse_grid(grid, files, "B")["facts"]
    return facts.select("period", "naic", "company", "policy_type", "line", "is_wind_only",
                        *BOUND_METRICS, F.array_join("suppressed", "|").alias("suppressed"))


A_METRICS = ["a_pif", "a_pif_commercial", "a_pif_personal", "a_dpw", "a_dpw_commercial",
             "a_dpw_personal"]


@register("grid_a_to_wide", O.with_panel(
    f"SELECT period, naic, company, {', '.join(A_METRICS)} FROM summary", summary=True))
def grid_a_to_wide(spark, sf_dir):
    """N3 (every Layout-A rule) and the parse of Layout-A sheets: summary → sheets → summary."""
    grid = materialize(SF.panel_to_rows(summary_from_tables(spark, sf_dir), A_METRICS,
                                        layout="A"), "grid")
    files = FS.describe_files(grid.filter(F.col("row_no") == 1).select("path"))
    return G.parse_grid(grid, files, "A")["facts"].select("period", "naic", "company", *A_METRICS)


def _header_layout_sql() -> str:
    n = len(BOUND_METRICS)
    rows = [f"({i + 1}, {i + 1}, '{d}', 'dim')" for i, d in enumerate(["naic", "company",
                                                                          "policy_type"])]
    rows += [f"({3 + n - i}, {4 + i}, '{m}', 'metric')" for i, m in enumerate(BOUND_METRICS)]
    return "cols AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(col_odd, col_even, key, role))"


@register("header_classify", O.with_panel("""
SELECT 'grid/filing_by_company_and_policy_type_' || substr(p.period, 1, 4) || 'q'
         || right(p.period, 1) || '.xlsx' AS path,
       CAST(CASE WHEN CAST(right(p.period, 1) AS INTEGER) % 2 = 1 THEN c.col_odd ELSE c.col_even END
            AS INTEGER) AS col_no,
       c.key, c.role
FROM (SELECT DISTINCT period FROM panel) p CROSS JOIN cols c""", _header_layout_sql()))
def header_classify(spark, sf_dir):
    """N1 + N3: every generated header text maps back to the key it was written for."""
    # Headers stand in the first rows: no body is made, and nothing else of the sheets is read.
    heads = materialize(SF.panel_heads(period_catalogue(spark, sf_dir), BOUND_METRICS), "heads")
    files = FS.describe_files(heads.filter(F.col("row_no") == 1).select("path"))
    return G.classify_headers(heads, files).select("path", "col_no", "key", "role")


@register("clean_money", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linenumber IN (1, 2, 6) THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE)
       END AS value,
       l_linenumber = 3 AS is_suppressed
FROM lineitem""")
def clean_money(spark, sf_dir):
    """F1/F2 over messy money text made from every line item's price.

    Line number → text: 1 '$1,234.50', 2 ' 1234.50' + NBSP, 3 '.', 4 '-',
    5 'n/a', 6 '123450e-2', 7 '(1234.50)'.
    """
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber",
                                                      "l_extendedprice")
    p = F.col("l_extendedprice")
    cents = F.round(p * 100).cast("bigint").cast("string")
    raw = (F.when(F.col("l_linenumber") == 1, F.concat(F.lit("$"), F.format_number(p, 2)))
            .when(F.col("l_linenumber") == 2,
                  F.concat(F.lit(" "), F.format_string("%.2f", p), F.lit(" ")))
            .when(F.col("l_linenumber") == 3, F.lit(" . "))
            .when(F.col("l_linenumber") == 4, F.lit("-"))
            .when(F.col("l_linenumber") == 5, F.lit("n/a"))
            .when(F.col("l_linenumber") == 6, F.concat(cents, F.lit("e-2")))
            .otherwise(F.concat(F.lit("("), F.format_string("%.2f", p), F.lit(")"))))
    return li.select("l_orderkey", "l_linenumber", clean_number(raw, F.lit("s")).alias("value"),
                     is_suppressed(raw).alias("is_suppressed"))


def _listing_sql() -> str:
    return """listing AS (
  SELECT DISTINCT
    'data/filing_' || CASE l_returnflag WHEN 'R' THEN 'by_company_and_commercial_personal'
                                       WHEN 'N' THEN 'by_company_and_policy_type'
                                       ELSE 'misc_report' END
    || '_' || CAST(year(l_shipdate) AS VARCHAR) || 'q' || CAST(quarter(l_shipdate) AS VARCHAR)
    || '_' || strftime(l_shipdate, '%Y%m%d') || 't'
    || CASE WHEN l_linestatus = 'O' THEN '120000' ELSE '090000' END || '.xlsx' AS path,
    CASE l_returnflag WHEN 'R' THEN 'A' WHEN 'N' THEN 'B' END AS layout,
    CAST(year(l_shipdate) AS VARCHAR) || 'Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS period,
    strftime(l_shipdate, '%Y%m%d') || 't'
    || CASE WHEN l_linestatus = 'O' THEN '120000' ELSE '090000' END AS pull_ts
  FROM lineitem
)"""


@register("newest_pull", f"""
WITH {_listing_sql()}
SELECT layout, period, arg_max(path, pull_ts) AS path, max(pull_ts) AS pull_ts,
       count(*) AS n_pulls
FROM listing WHERE layout IS NOT NULL GROUP BY layout, period""")
def newest_pull(spark, sf_dir):
    """SRC2-SRC5 over a file listing Spark derives from the ship dates: layout and
    period from the name, newest pull per (layout, period), other names ignored."""
    li = read_table(spark, sf_dir, "lineitem").select("l_shipdate", "l_returnflag",
                                                      "l_linestatus")
    token = (F.when(F.col("l_returnflag") == "R", F.lit("by_company_and_commercial_personal"))
              .when(F.col("l_returnflag") == "N", F.lit("by_company_and_policy_type"))
              .otherwise(F.lit("misc_report")))
    ts = F.concat(F.date_format("l_shipdate", "yyyyMMdd"), F.lit("t"),
                  F.when(F.col("l_linestatus") == "O", F.lit("120000")).otherwise(F.lit("090000")))
    names = li.select(F.concat(F.lit("data/filing_"), token, F.lit("_"),
                               F.year("l_shipdate").cast("string"), F.lit("q"),
                               F.quarter("l_shipdate").cast("string"), F.lit("_"), ts,
                               F.lit(".xlsx")).alias("path")).distinct()
    # A listing is a small table: written once, so the name parsing below runs
    # on its rows instead of being pushed under the distinct onto every line item.
    names = materialize(names)
    d = FS.describe_files(names)
    counts = (d.filter(F.col("layout").isNotNull() & F.col("period").isNotNull())
               .groupBy("layout", "period").agg(F.count(F.lit(1)).alias("n_pulls")))
    return (FS.newest_pulls(d).join(counts, ["layout", "period"])
              .select("layout", "period", "path", "pull_ts", "n_pulls"))


@register("observations_long", O.with_panel(f"""
SELECT period, naic AS naic_code, company AS company_name, line, policy_type,
       CASE WHEN col LIKE '%\\_incl\\_wind' ESCAPE '\\' THEN 'incl'
            WHEN col LIKE '%\\_excl\\_wind' ESCAPE '\\' THEN 'excl'
            WHEN is_wind_only THEN 'wind_only' ELSE 'all' END AS wind_basis,
       regexp_replace(col, '_(incl|excl)_wind$', '') AS metric, value,
       (is_sup AND col IN ('pif', 'tiv')) AS is_suppressed, 'B' AS source_file_type
FROM panel UNPIVOT INCLUDE NULLS (value FOR col IN ({METRIC_LIST}))"""))
def observations_long(spark, sf_dir):
    """Wide facts → long observations with the wind basis."""
    long = RS.observations(filings(spark, sf_dir), BOUND_METRICS)
    return long.drop("period_end_date", "source_file")


@register("suppressed_counts", O.with_panel(f"""
SELECT period, metric, CAST(sum(CAST(is_suppressed AS INTEGER)) AS BIGINT) AS n_suppressed,
       count(CASE WHEN value IS NULL THEN 1 END) AS n_null, count(*) AS n_cells
FROM (SELECT period, regexp_replace(col, '_(incl|excl)_wind$', '') AS metric, value,
             (is_sup AND col IN ('pif', 'tiv')) AS is_suppressed
      FROM panel UNPIVOT INCLUDE NULLS (value FOR col IN ({METRIC_LIST})))
GROUP BY period, metric"""))
def suppressed_counts(spark, sf_dir):
    """Suppressed and null cells per period and metric."""
    return Q.suppressed_counts(RS.observations(filings(spark, sf_dir), BOUND_METRICS))


@register("checksum_totals", O.with_panel(f"""
SELECT b.period, b.metric, b.body_sum, t.total, b.body_sum - t.total AS diff, b.rows,
       CASE WHEN t.total IS NULL THEN 'no_total'
            WHEN t.total = 0 AND b.body_sum <> 0 THEN 'mismatch'
            WHEN t.total <> 0 AND abs(b.body_sum - t.total) / abs(t.total) > 0.0001 THEN 'mismatch'
            ELSE 'ok' END AS status
FROM (SELECT period, 'pif' AS metric, {O.xsum0('pif')} AS body_sum, count(*) AS rows
      FROM panel GROUP BY period
      UNION ALL
      SELECT period, 'tiv', {O.xsum0('tiv')}, count(*) FROM panel GROUP BY period) b
LEFT JOIN (SELECT CAST(year(l_shipdate) AS VARCHAR) || 'Q' || CAST(quarter(l_shipdate) AS VARCHAR)
                    AS period,
                  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS pif,
                  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS tiv
           FROM lineitem GROUP BY 1) tt ON tt.period = b.period
CROSS JOIN LATERAL (SELECT CASE b.metric WHEN 'pif' THEN tt.pif ELSE tt.tiv END AS total) t"""))
def checksum_totals(spark, sf_dir):
    """Q-A: body sums (suppressed cells count 0) against the published totals
    (the unsuppressed sums straight from the line items), per period and metric."""
    fl = filings(spark, sf_dir)
    li = read_table(spark, sf_dir, "lineitem")
    from ..functions.text import period_text
    totals = (li.groupBy(F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q"))
                .agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("pif"),
                     F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
                     .alias("tiv"))
                .select(period_text(F.col("y"), F.col("q")).alias("period"), "pif", "tiv"))
    return Q.checksum(fl, totals, ["pif", "tiv"])


@register("unknown_segments", O.with_panel("""
SELECT period, policy_type, count(*) AS rows FROM panel WHERE line = 'Other'
GROUP BY period, policy_type"""))
def unknown_segments(spark, sf_dir):
    """Q-C: segments with no known line prefix, counted per period."""
    return Q.unknown_segments(filings(spark, sf_dir))


@register("coverage", O.with_panel("""
SELECT coalesce(b.period, a.period) AS period, coalesce(a.n, 0) > 0 AS has_A,
       coalesce(b.n, 0) > 0 AS has_B, coalesce(a.n, 0) AS facts_a, coalesce(b.n, 0) AS facts_b
FROM (SELECT period, count(*) AS n FROM panel GROUP BY period) b
FULL JOIN (SELECT period, count(*) AS n FROM summary GROUP BY period) a ON a.period = b.period""",
    summary=True))
def coverage(spark, sf_dir):
    """Q-B / J5: which layouts have facts in each period."""
    return Q.coverage(filings(spark, sf_dir), summary_from_tables(spark, sf_dir))


@register("summary_counts", O.with_panel("""
SELECT count(DISTINCT period) AS periods, count(CASE WHEN layout = 'B' THEN 1 END) AS facts_b,
       count(CASE WHEN layout = 'A' THEN 1 END) AS facts_a, count(DISTINCT naic) AS entities,
       count(DISTINCT CASE WHEN layout = 'B' AND policy_type <> '' THEN policy_type END) AS segments
FROM (SELECT period, naic, policy_type, 'B' AS layout FROM panel
      UNION ALL SELECT period, naic, NULL, 'A' FROM summary)""", summary=True))
def summary_counts(spark, sf_dir):
    """A15 / Q-F: dataset counts over both layouts."""
    return Q.summary_counts(
        panel(spark, sf_dir, "period", "naic", "policy_type"),
        materialize(summary_from_tables(spark, sf_dir).select("period", "naic"), "summary"))


@register("reconcile_summary", O.with_panel(f"""
SELECT coalesce(a.period, b.period) AS period, coalesce(a.naic, b.naic) AS naic,
       coalesce(a.line, b.line) AS line, a.a_value, b.b_value, a.a_value - b.b_value AS diff,
       CASE WHEN b.b_value IS NULL THEN 'only_a' WHEN a.a_value IS NULL THEN 'only_b'
            WHEN b.b_value = 0 AND a.a_value = 0 THEN 'match'
            WHEN abs(a.a_value - b.b_value) <= abs(b.b_value) * 0.0001 THEN 'match'
            ELSE 'differ' END AS status
FROM (SELECT period, naic, line, {O.xsum0('value')} AS a_value FROM (
        SELECT period, naic, 'Commercial Residential' AS line, a_pif_commercial AS value FROM summary
        UNION ALL
        SELECT period, naic, 'Personal Residential', a_pif_personal FROM summary)
      GROUP BY period, naic, line) a
FULL JOIN (SELECT period, naic, line, {O.xsum0('pif')} AS b_value FROM panel
           GROUP BY period, naic, line) b
  ON a.period = b.period AND a.naic = b.naic AND a.line = b.line""", summary=True))
def reconcile_summary(spark, sf_dir):
    """J6 + N14: Layout A (split by customer) against Layout B rolled up by line."""
    fl = filings(spark, sf_dir)
    a_long = RS.observations_a(summary_from_tables(spark, sf_dir))
    return Q.reconcile(fl, a_long, "pif")


@register("breakdown_line", O.with_panel(f"""
SELECT period, line, {O.xsum('tiv')} AS value FROM panel GROUP BY period, line"""))
def breakdown_line(spark, sf_dir):
    """TIV by line per period (the data behind stacked bars)."""
    return M.breakdown(filings(spark, sf_dir), "tiv", "line")


@register("breakdown_wind", O.with_panel(f"""
SELECT period, 'incl' AS basis, {O.xsum('tiv_incl_wind')} AS value FROM panel GROUP BY period"""))
def breakdown_wind(spark, sf_dir):
    """TIV split by wind basis (only the columns present in the data)."""
    return M.breakdown(filings(spark, sf_dir), "tiv", wind_split=True)


@register("rollup_cube", O.with_panel(f"""
SELECT period, line, CAST(grouping(period, line) AS INTEGER) AS grouping_id,
       {O.xsum('tiv')} AS tiv,
       {O.xsum0('new_written')} + {O.xsum0('received_in')} - {O.xsum0('cancelled')}
         - {O.xsum0('nonrenewed')} - {O.xsum0('transferred_out')} AS net_flow
FROM panel GROUP BY ROLLUP (period, line)"""))
def rollup_cube(spark, sf_dir):
    """Free rollup with subtotals (period → line → grand total)."""
    out = M.free_rollup(filings(spark, sf_dir), ["period", "line"], ["tiv", "net_flow"], "rollup")
    return out.withColumn("grouping_id", F.col("grouping_id").cast("int"))


@register("entity_search_history", O.with_panel(f"""
SELECT p.naic, p.period, p.company, {O.xsum('p.tiv')} AS tiv
FROM panel p
WHERE p.naic IN (SELECT naic FROM companies
                 WHERE contains(lower(name), 'supplier#00000004') OR contains(naic, 'supplier#00000004')
                    OR list_bool_or(list_transform(names, lambda n: contains(lower(n), 'supplier#00000004'))))
GROUP BY p.naic, p.period, p.company""", COMPANIES_SQL))
def entity_search_history(spark, sf_dir):
    """P7 + P9: search names (current or historic) and keys, then the full history."""
    hits = materialize(SE.search_entities(D.companies(filings(spark, sf_dir)),
                                          "Supplier#00000004"), "hits")
    # Only the line items of the entities found are aggregated.
    hist = SE.entity_history(filings_from_tables(spark, sf_dir, entities=hits), hits)
    return hist.groupBy("naic", "period", "company").agg(M.exact_sum("tiv").alias("tiv"))


@register("segment_search", O.with_panel("""
SELECT DISTINCT policy_type, line, is_wind_only,
       CASE WHEN is_wind_only THEN '〜 ' ELSE '' END
       || replace(replace(policy_type, 'Commercial Residential - ', 'C: '),
                  'Personal Residential - ', 'P: ') AS label
FROM panel WHERE line = 'Personal Residential' AND is_wind_only
  AND contains(lower(policy_type), 'la')"""))
def segment_search(spark, sf_dir):
    """P8 + F15/F16: wind-only personal segments whose text contains 'la'."""
    segs = D.segments(filings(spark, sf_dir))
    return SE.search_segments(segs, "La", "Personal Residential", True)


@register("labels_money_pct", O.with_panel(f"""
SELECT period, naic, value, share,
       '$' || CASE WHEN abs(value) >= 1e3
                   THEN regexp_replace(regexp_replace(
                          format('{{:,.2f}}', round(CAST(value / d AS DECIMAL(38,10)), 2)),
                          '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || suf
                   ELSE format('{{:,.0f}}', round(CAST(value AS DECIMAL(38,10)), 0)) END
         AS value_label,
       CASE WHEN share IS NULL THEN '—'
            ELSE format('{{:.1f}}', round(CAST(share * 100 AS DECIMAL(38,10)), 1)) || '%' END
         AS share_label,
       format('{{:,.0f}}', floor(value / 1000 + 0.5)) AS count_label
FROM (SELECT *, CASE WHEN abs(value) >= 1e12 THEN 1e12 WHEN abs(value) >= 1e9 THEN 1e9
                     WHEN abs(value) >= 1e6 THEN 1e6 ELSE 1e3 END AS d,
                CASE WHEN abs(value) >= 1e12 THEN 'T' WHEN abs(value) >= 1e9 THEN 'B'
                     WHEN abs(value) >= 1e6 THEN 'M' ELSE 'K' END AS suf
      FROM (SELECT v.period, v.naic, v.value,
                   CASE WHEN t.total <> 0 THEN v.value / t.total END AS share
            FROM vals v JOIN (SELECT period, {O.xsum0('value')} AS total FROM vals GROUP BY period) t
              ON v.period = t.period))""",
    f"vals AS ({base_values_sql('dpw')} HAVING {O.xsum('dpw')} IS NOT NULL)"))
def labels_money_pct(spark, sf_dir):
    """Money (auto T/B/M/K), percent and count labels on every entity's DPW share."""
    sh = S.shares(filings(spark, sf_dir), "dpw")
    return sh.select("period", "naic", "value", "share",
                     L.money_label(F.col("value")).alias("value_label"),
                     L.or_dash(L.pct_label(F.col("share"))).alias("share_label"),
                     L.count_label(F.col("value") / 1000).alias("count_label"))


@register("rank_all", O.with_panel(f"""
SELECT r.period, r.rank, r.naic, coalesce(c.name, r.naic) AS company, r.value
FROM (SELECT period, naic, value,
             CAST(row_number() OVER (PARTITION BY period ORDER BY value DESC, {tie()}) AS BIGINT)
               AS rank
      FROM ({base_values_sql('dpw')}) ev WHERE value IS NOT NULL) r
LEFT JOIN companies c ON r.naic = c.naic""", COMPANIES_SQL))
def rank_all(spark, sf_dir):
    """W1 without a cut: every entity of every period ranked, without sending a
    whole period through one task (range split + offsets)."""
    fl = panel(spark, sf_dir, "period", "naic", "company", "dpw")
    vals = M.entity_values(fl, "dpw")
    ranked = R.rank_top(vals, None)
    return R.with_names(ranked, D.companies(fl)).select("period", "rank", "naic", "company",
                                                       "value")


@register("dim_periods", O.with_panel("""
SELECT coalesce(b.period, a.period) AS period,
       strftime(last_day(make_date(CAST(substr(coalesce(b.period, a.period), 1, 4) AS INTEGER),
                                   CAST(right(coalesce(b.period, a.period), 1) AS INTEGER) * 3, 1)),
                '%Y-%m-%d') AS period_end,
       a.period IS NOT NULL AS has_A, b.period IS NOT NULL AS has_B
FROM (SELECT DISTINCT period FROM panel) b
FULL JOIN (SELECT DISTINCT period FROM summary) a ON a.period = b.period""", summary=True))
def dim_periods(spark, sf_dir):
    """SRC3 / J5: the period dimension with the layouts present."""
    p = D.periods(filings(spark, sf_dir), summary_from_tables(spark, sf_dir))
    return p.select("period", F.date_format("period_end", "yyyy-MM-dd").alias("period_end"),
                    "has_A", "has_B")


@register("metrics_seen", O.with_panel(f"""
SELECT col AS key, count(DISTINCT period) AS n_sheets
FROM (SELECT * FROM panel WHERE policy_type = '{GAP_SEGMENT}')
  UNPIVOT (value FOR col IN ({METRIC_LIST}))
GROUP BY col"""))
def metrics_seen(spark, sf_dir):
    """The metrics that sheets have a column for, and in how many. A quarter's sheet has
    a column for the metrics that its rows of one segment have a value for."""
    sl = slice_filings(filings(spark, sf_dir), segments=(GAP_SEGMENT,))
    held = sl.groupBy("period").agg(*[(F.count(m) > 0).alias(m) for m in BOUND_METRICS])
    heads = materialize(SF.panel_heads(held, BOUND_METRICS), "heads")
    parsed = G.parse_grid(heads, FS.describe_files(heads.where("row_no = 1").select("path")), "B")
    sheets = parsed["headers"].groupBy("key").agg(F.countDistinct("path").alias("n_sheets"))
    return parsed["metrics_seen"].join(sheets, "key")


@register("grid_totals", O.with_panel(f"""
SELECT 'grid/filing_by_company_and_policy_type_' || substr(period, 1, 4) || 'q' || right(period, 1)
         || '.xlsx' AS path, period,
       {", ".join(f"{O.xsum(m)} AS {m}" for m in BOUND_METRICS)}
FROM panel GROUP BY period"""))
def grid_totals(spark, sf_dir):
    """The published Total row of every sheet, split off from the body."""
    grid, files = _grid(spark, sf_dir)
    return G.parse_grid(grid, files, "B")["totals"].select("path", "period", *BOUND_METRICS)


@register("series_every_entity_yoy", O.with_panel(f"""
SELECT g.target, coalesce(c.name, g.target) AS name, g.period, g.value,
       {GROWTH.format(v='g.value', b='lag(g.value, 4) OVER (PARTITION BY g.target ORDER BY g.pos)')}
         AS display
FROM (SELECT t.target, r.period, r.pos, v.value
      FROM (SELECT DISTINCT target FROM vals) t CROSS JOIN rng r
      LEFT JOIN vals v ON v.target = t.target AND v.period = r.period) g
LEFT JOIN companies c ON c.naic = g.target""", COMPANIES_SQL, _rng_sql(("1995Q1", "2001Q4")),
    f"vals AS (SELECT naic AS target, period, value FROM ({base_values_sql('dpw')}) "
    f"WHERE period IN (SELECT period FROM rng))"))
def series_every_entity_yoy(spark, sf_dir):
    """W7 + W8 for every entity: dense entity × quarter spine, YoY by position."""
    fl = panel(spark, sf_dir, "period", "naic", "company", "dpw")
    return S.series(fl, "dpw", "all", fl.select("period"), "1995Q1", "2001Q4",
                    entities="all", transform="yoy", companies=D.companies(fl))


@register("suppressed_unranked", O.with_panel(f"""
SELECT s.period, s.naic, coalesce(c.name, s.naic) AS company, s.n_suppressed
FROM (SELECT period, naic, CAST(sum(CAST(is_sup AS INTEGER)) AS BIGINT) AS n_suppressed
      FROM panel WHERE {_where(segments=(GAP_SEGMENT,))}
      GROUP BY period, naic HAVING count(tiv) = 0) s
LEFT JOIN companies c ON c.naic = s.naic
WHERE s.n_suppressed > 0""", COMPANIES_SQL))
def suppressed_unranked(spark, sf_dir):
    """Q12: entities whose TIV is fully suppressed in the slice, listed without rank."""
    sl = slice_filings(filings(spark, sf_dir), segments=(GAP_SEGMENT,))
    un = R.with_names(R.suppressed_entities(sl, "tiv"), None)
    return named(un, sf_dir).select("period", "naic", "company", "n_suppressed")


@register("growth_labels", O.with_panel(f"""
SELECT target, period, growth,
       CASE WHEN growth IS NULL THEN '—'
            ELSE CASE WHEN growth >= 0 THEN '+' ELSE '' END
                 || format('{{:.1f}}', round(CAST(growth AS DECIMAL(38,10)), 1)) || '%' END AS growth_label,
       CASE WHEN growth IS NULL THEN '—'
            ELSE format('{{:.1f}}', round(CAST(growth * 100 AS DECIMAL(38,10)), 1)) || '%' END
         AS pct_label
FROM (SELECT naic AS target, period,
             {GROWTH.format(v='value', b='lag(value) OVER (PARTITION BY naic ORDER BY ' + pk() + ')')}
               AS growth
      FROM ({base_values_sql('tiv')}) v)"""))
def growth_labels(spark, sf_dir):
    """F10, F11, F13 on quarter-on-quarter growth over the quarters an entity filed in;
    far over 1000 % for small bases, and never grouped."""
    from pyspark.sql import Window
    vals = M.entity_values(filings(spark, sf_dir), "tiv")
    w = Window.partitionBy("naic").orderBy("period")
    growth = growth_pct(F.col("value"), F.lag("value").over(w))
    return vals.select(F.col("naic").alias("target"), "period", growth.alias("growth")).select(
        "*", L.or_dash(L.growth_label("growth")).alias("growth_label"),
        L.or_dash(L.pct_label("growth")).alias("pct_label"))


@register("fine_decimals", """
SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(6,2))
                           * CAST(l_tax AS DECIMAL(6,2)) * 0.00001) AS DOUBLE) AS total
FROM lineitem GROUP BY l_suppkey""")
def fine_decimals(spark, sf_dir):
    """F8 / A1: eleven decimals survive a sum."""
    li = read_table(spark, sf_dir, "lineitem")
    fine = (F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")
            * F.col("l_tax").cast("decimal(4,2)") * F.lit("0.00001").cast("decimal(5,5)"))
    return li.groupBy("l_suppkey").agg(M.exact_sum(fine.cast("double")).alias("total"))


@register("history_of_a_table", O.with_panel(f"""
SELECT period, naic, {O.xsum('dpw')} AS dpw FROM panel
WHERE naic IN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') FROM supplier WHERE s_suppkey % 3 = 1)
GROUP BY period, naic"""))
def history_of_a_table(spark, sf_dir):
    """Entities chosen by a table of keys (a semi join)."""
    keys = (read_table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 1")
            .select(naic_text(F.col("s_suppkey")).alias("naic")))
    return M.multi_metric(select_entities(filings(spark, sf_dir), keys), ["dpw"],
                          by=("period", "naic"))


@register("cube_line_wind", O.with_panel(f"""
SELECT line, is_wind_only, CAST(grouping(line, is_wind_only) AS INTEGER) AS grouping_id,
       {O.xsum('pif')} AS pif,
       CASE WHEN {O.xsum0('tiv')} <> 0 THEN {O.xsum0('tiv_incl_wind')} / {O.xsum0('tiv')} END
         AS wind_concentration
FROM panel GROUP BY CUBE (line, is_wind_only)"""))
def cube_line_wind(spark, sf_dir):
    """Cube over line and wind-only flag."""
    out = M.free_rollup(filings(spark, sf_dir), ["line", "is_wind_only"],
                        ["pif", "wind_concentration"], "cube")
    return out.withColumn("grouping_id", F.col("grouping_id").cast("int"))


@register("captions_snapshot", O.with_panel(f"""
SELECT period, count(value) AS carriers, {O.xsum0('value')} AS slice_total
FROM ({base_values_sql('tiv', "line = 'Personal Residential'")}) v GROUP BY period"""))
def captions_snapshot(spark, sf_dir):
    """Carriers with a value and the slice total of every period."""
    spec = ViewSpec(metric="tiv", line="Personal Residential")
    return captions(filings(spark, sf_dir), spec, all_periods=True)


@register("captions_series", O.with_panel(f"""
SELECT period, count(CASE WHEN tiv <> 0 THEN 1 END) AS carriers,
       CASE WHEN {O.xsum0('tiv')} <> 0 THEN {O.xsum0('dpw')} / {O.xsum0('tiv')} END AS slice_total
FROM (SELECT period, naic, {O.xsum0('dpw')} AS dpw, {O.xsum0('tiv')} AS tiv FROM panel
      WHERE period BETWEEN '{RANGE[0]}' AND '{RANGE[1]}' GROUP BY period, naic) v
GROUP BY period"""))
def captions_series(spark, sf_dir):
    """P14 of a series: a ratio metric's total is the ratio of sums."""
    spec = ViewSpec(mode="series", metric="rate_on_line", period_from=RANGE[1],
                    period_to=RANGE[0])
    return series_captions(filings(spark, sf_dir), spec)


@register("caption_dataset", O.with_panel("""
SELECT min(period) AS first, max(period) AS last, count(DISTINCT period) AS periods,
       CAST(count(*) AS BIGINT) AS facts, count(DISTINCT naic) AS entities
FROM (SELECT period, naic FROM panel UNION ALL SELECT period, naic FROM summary)""", summary=True))
def caption_dataset(spark, sf_dir):
    """The coverage line."""
    return dataset_caption(filings(spark, sf_dir), summary_from_tables(spark, sf_dir))


@register("entity_labels", O.with_panel("""
SELECT naic, name, CASE WHEN length(name) > 34 THEN substr(name, 1, 32) || '…' ELSE name END
                   || ' · ' || naic AS label
FROM companies""", COMPANIES_SQL))
def entity_labels(spark, sf_dir):
    """P7 + F14: every entity with its picker label."""
    return SE.search_entities(D.companies(filings(spark, sf_dir)))


@register("labelled_rank", O.with_panel(f"""
SELECT period, rank, naic, value, format('{{:,.0f}}', floor(value + 0.5)) AS value_label
FROM (SELECT period, naic, value,
             CAST(row_number() OVER (PARTITION BY period ORDER BY value DESC, {tie()}) AS BIGINT) AS rank
      FROM ({base_values_sql('pif')}) v WHERE value IS NOT NULL) r WHERE rank <= 5"""))
def labelled_rank(spark, sf_dir):
    """F17 + W5: a ranking with label columns, sorted again by entity."""
    spec = ViewSpec(metric="pif", topn=5, sort_col="naic", sort_dir=1)
    view = snapshot_view(filings(spark, sf_dir), spec, all_periods=True)
    return L.labelled(view, "pif").drop("company")


@register("summary_companies", O.with_panel("""
SELECT naic, arg_min(period, pk) AS first, arg_max(period, pk) AS last,
       count(DISTINCT period) AS n_periods,
       array_to_string(list_sort(list_distinct(list(company))), '|') AS names
FROM (SELECT naic, company, period, CAST(substr(period, 1, 4) AS INTEGER) * 10
             + CAST(right(period, 1) AS INTEGER) AS pk
      FROM (SELECT naic, company, period FROM panel UNION ALL
            SELECT naic, company, period FROM summary)) GROUP BY naic""", summary=True))
def summary_companies(spark, sf_dir):
    """T1 + A12, A13: the entity dimension over both layouts."""
    c = D.companies(filings(spark, sf_dir), summary_from_tables(spark, sf_dir))
    return c.select("naic", "first", "last", "n_periods", F.array_join("names", "|").alias("names"))


# Queries over files and stored tables register themselves in the same tables.
from . import registered_sources, registered_views  # noqa: E402, F401
