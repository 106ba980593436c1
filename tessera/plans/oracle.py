"""Independent SQL for the correctness gate (DuckDB dialect).

Each registered query has a twin here written from the specification, not from
the Spark code: the same panel binding as text, then plain SQL per operator.
Money and counts are summed as DECIMAL on both sides, so totals are exact.
"""

from __future__ import annotations

# The Layout-B panel from the driver tables (FIXTURES §5).
PANEL_CTE = """
panel_g AS (
  SELECT year(l.l_shipdate) AS yr, quarter(l.l_shipdate) AS qtr, l.l_suppkey AS suppkey,
         CASE WHEN p.p_type IN ('STANDARD', 'SMALL') THEN 'Commercial Residential - '
              WHEN p.p_type = 'PROMO' THEN ''
              ELSE 'Personal Residential - ' END
         || p.p_type
         || CASE WHEN p.p_size % 4 = 0 THEN ' - WIND ONLY' ELSE '' END AS policy_type,
         count(*) AS n_lines,
         sum(CAST(l.l_quantity AS DECIMAL(18,2))) AS pif,
         sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS tiv,
         sum(CASE WHEN p.p_size % 3 = 0 THEN CAST(l.l_extendedprice AS DECIMAL(18,2)) END)
           AS tiv_incl_wind,
         sum(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(6,2)))
           AS dpw,
         count(CASE WHEN l.l_linestatus = 'O' THEN 1 END) AS new_written,
         count(CASE WHEN l.l_returnflag = 'N' THEN 1 END) AS received_in,
         count(CASE WHEN l.l_returnflag = 'R' THEN 1 END) AS cancelled,
         count(CASE WHEN l.l_returnflag = 'A' THEN 1 END) AS nonrenewed,
         count(CASE WHEN l.l_tax = 0.08 THEN 1 END) AS transferred_out
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY 1, 2, 3, 4
),
panel_n AS (
  SELECT g.*,
         CAST(g.yr AS VARCHAR) || 'Q' || CAST(g.qtr AS VARCHAR) AS period,
         lpad(CAST(g.suppkey AS VARCHAR), CAST(greatest(5, length(CAST(g.suppkey AS VARCHAR))) AS INTEGER), '0')
           AS naic,
         CASE WHEN g.yr < 1998 THEN s.s_name ELSE s.s_name || ' Mutual' END AS company
  FROM panel_g g LEFT JOIN supplier s ON g.suppkey = s.s_suppkey
),
panel AS (
  SELECT period,
         last_day(make_date(CAST(substr(period, 1, 4) AS INTEGER),
                            CAST(right(period, 1) AS INTEGER) * 3, 1)) AS period_end,
         naic, company, policy_type,
         CASE WHEN lower(policy_type) LIKE 'commercial residential%' THEN 'Commercial Residential'
              WHEN lower(policy_type) LIKE 'personal residential%' THEN 'Personal Residential'
              ELSE 'Other' END AS line,
         contains(lower(policy_type), 'wind only') AS is_wind_only,
         CASE WHEN NOT (n_lines = 1 AND naic LIKE '%5') THEN CAST(pif AS DOUBLE) END AS pif,
         CASE WHEN NOT (n_lines = 1 AND naic LIKE '%5') THEN CAST(tiv AS DOUBLE) END AS tiv,
         CAST(tiv_incl_wind AS DOUBLE) AS tiv_incl_wind,
         CAST(dpw AS DOUBLE) AS dpw,
         CAST(new_written AS DOUBLE) AS new_written,
         CAST(received_in AS DOUBLE) AS received_in,
         CAST(cancelled AS DOUBLE) AS cancelled,
         CAST(nonrenewed AS DOUBLE) AS nonrenewed,
         CAST(transferred_out AS DOUBLE) AS transferred_out,
         n_lines,
         (n_lines = 1 AND naic LIKE '%5') AS is_sup
  FROM panel_n
)"""

# The Layout-A summary binding (entity × period, commercial / personal by customer).
SUMMARY_CTE = """
summary_g AS (
  SELECT year(l.l_shipdate) AS yr, quarter(l.l_shipdate) AS qtr, l.l_suppkey AS suppkey,
         sum(CAST(l.l_quantity AS DECIMAL(18,2))) AS a_pif,
         sum(CASE WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY')
                  THEN CAST(l.l_quantity AS DECIMAL(18,2)) END) AS a_pif_commercial,
         sum(CASE WHEN c.c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
                  THEN CAST(l.l_quantity AS DECIMAL(18,2)) END) AS a_pif_personal,
         sum(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(6,2)))
           AS a_dpw,
         sum(CASE WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY')
                  THEN CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(6,2))
             END) AS a_dpw_commercial,
         sum(CASE WHEN c.c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
                  THEN CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(6,2))
             END) AS a_dpw_personal
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2, 3
),
summary AS (
  SELECT CAST(g.yr AS VARCHAR) || 'Q' || CAST(g.qtr AS VARCHAR) AS period,
         lpad(CAST(g.suppkey AS VARCHAR), CAST(greatest(5, length(CAST(g.suppkey AS VARCHAR))) AS INTEGER), '0')
           AS naic,
         CASE WHEN g.yr < 1998 THEN s.s_name ELSE s.s_name || ' Mutual' END AS company,
         CAST(a_pif AS DOUBLE) AS a_pif, CAST(a_pif_commercial AS DOUBLE) AS a_pif_commercial,
         CAST(a_pif_personal AS DOUBLE) AS a_pif_personal, CAST(a_dpw AS DOUBLE) AS a_dpw,
         CAST(a_dpw_commercial AS DOUBLE) AS a_dpw_commercial,
         CAST(a_dpw_personal AS DOUBLE) AS a_dpw_personal
  FROM summary_g g LEFT JOIN supplier s ON g.suppkey = s.s_suppkey
)"""


def with_panel(body: str, *extra: str, summary: bool = False) -> str:
    """``WITH panel AS (...) [, summary ...] [, extra CTEs] <body>``."""
    ctes = [PANEL_CTE.strip()] + ([SUMMARY_CTE.strip()] if summary else [])
    ctes += [e.strip().strip(",") for e in extra if e.strip()]
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


def xsum(expr: str, scale: int = 4) -> str:
    """Exact null-skipping sum as DOUBLE (twin of ``exact_sum``)."""
    return f"CAST(sum(CAST({expr} AS DECIMAL(38,{scale}))) AS DOUBLE)"


def xsum0(expr: str, scale: int = 4) -> str:
    return f"coalesce({xsum(expr, scale)}, 0.0)"
