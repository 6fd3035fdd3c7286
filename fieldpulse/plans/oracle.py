"""DuckDB text of the star-schema adapter, used as a prefix by oracle SQL.

``with_adapter(body)`` returns ``WITH <adapter CTEs> <body>``; the body may use
``activity``, ``study``, ``receiver``, ``shotpoint`` and ``recording``. The
definitions mirror ``fieldpulse.sources.adapter`` clause by clause.
"""

from __future__ import annotations

from fieldpulse.functions.columns import as_of_micros
from fieldpulse.sources.adapter import DEFAULT_AS_OF

_AS_OF_US = as_of_micros(DEFAULT_AS_OF)

ADAPTER_CTES = f"""
line AS (
  SELECT l_orderkey,
         SUM(l_quantity) AS resource_p50,
         SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS realised_qty,
         SUM(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS resource_oil,
         SUM(CASE WHEN l_linestatus = 'F' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) AS realised_amount,
         COUNT(*) AS prospects,
         COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) AS leads
  FROM lineitem GROUP BY l_orderkey),
activity AS (
  SELECT o.o_orderkey AS activity_id,
         CONCAT('ACT-', CAST(o.o_orderkey AS VARCHAR)) AS activity_name,
         CAST(EXTRACT(YEAR FROM o.o_orderdate) AS INT) AS year,
         c.c_name AS work_area, n.n_name AS holding, r.r_name AS region, c.c_mktsegment AS kind,
         CASE WHEN c.c_custkey % 2 = 0 THEN 'Exploration' ELSE 'Exploitation' END AS block_status,
         CASE o.o_orderkey % 3 WHEN 0 THEN 'Offshore' WHEN 1 THEN 'Onshore' END AS area,
         CASE o.o_orderstatus WHEN 'O' THEN 'Not started' WHEN 'P' THEN 'Running (partial)' ELSE 'Done' END AS status,
         CASE o.o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'nan' ELSE CONCAT('Obstacle ', o.o_orderpriority) END AS obstacle,
         CASE o.o_orderkey % 7 WHEN 0 THEN 'Carbonate build-up' WHEN 1 THEN 'karbonat' ELSE 'Sandstone' END AS play,
         CASE WHEN o.o_orderkey % 10 < 7 THEN 'Yes' ELSE 'No' END AS technical_approval,
         o.o_totalprice AS planned_amount,
         COALESCE(l.realised_amount, 0) AS realised_amount,
         COALESCE(l.resource_p50, 0) AS planned_qty,
         COALESCE(l.realised_qty, 0) AS realised_qty,
         CASE WHEN l.resource_p50 > 0 THEN 100.0 * l.realised_qty / l.resource_p50 ELSE 0 END AS progress_pct,
         COALESCE(l.resource_p50, 0) AS resource_p50,
         COALESCE(l.resource_oil, 0) AS resource_oil,
         COALESCE(l.resource_p50 - l.resource_oil, 0) AS resource_gas,
         COALESCE(l.prospects, 0) AS prospects, COALESCE(l.leads, 0) AS leads,
         CASE WHEN o.o_orderkey % 11 = 0 THEN 0 ELSE LEAST(100, (o.o_orderkey * 37) % 151) END AS permit_a_pct,
         LEAST(100, (o.o_orderkey * 53) % 251) AS permit_b_pct,
         LEAST(100, (o.o_orderkey * 71) % 401) AS procurement_pct,
         o.o_orderdate AS planned_start,
         COALESCE(o.o_orderstatus = 'O' AND epoch_us(o.o_orderdate) < {_AS_OF_US}, false) AS is_delayed,
         COALESCE(GREATEST(0, CAST(FLOOR(({_AS_OF_US} - epoch_us(o.o_orderdate)) / 86400000000.0) AS BIGINT)), 0) AS days_since_planned_start
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN line l ON o.o_orderkey = l.l_orderkey),
receiver AS (SELECT l_orderkey AS activity_id, l_quantity AS n_receiver, l_extendedprice AS receiver_spacing FROM lineitem WHERE l_linenumber % 3 = 1),
shotpoint AS (SELECT l_orderkey AS activity_id, l_quantity AS n_shot, l_discount AS charge, l_tax AS charge_depth FROM lineitem WHERE l_linenumber % 3 = 2),
recording AS (SELECT l_orderkey AS activity_id, l_quantity AS fold, l_extendedprice AS far_offset FROM lineitem WHERE l_linenumber % 3 = 0),
study AS (
  SELECT p_partkey AS study_id, p_name AS study_name, p_type AS study_type, p_brand AS holding,
         CONCAT('WA-', CAST(p_partkey % 40 AS VARCHAR)) AS work_area,
         CASE WHEN p_partkey % 2 = 0 THEN 'Exploration' ELSE 'Exploitation' END AS block_status,
         CASE p_partkey % 5 WHEN 0 THEN 'New' WHEN 1 THEN 'Carry Over' WHEN 2 THEN 'Carry Forward' WHEN 3 THEN 'Unbundling' ELSE 'Additional' END AS proposal_status,
         CONCAT('AREA-', CAST(p_partkey % 6 AS VARCHAR)) AS study_area,
         CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'nan' ELSE CONCAT('V', CAST(p_partkey % 13 AS VARCHAR)) END AS validator,
         p_retailprice AS planned_budget, CAST(0 AS DOUBLE) AS realised_budget, CAST(p_size AS DOUBLE) AS area_km2,
         CASE WHEN p_size % 5 = 0 THEN 'Done' ELSE 'Not started' END AS status
  FROM part)
"""


def with_adapter(body: str, ctes: str = "") -> str:
    """``WITH <adapter>[, <ctes>] <body>``; ``ctes`` are extra ``name AS (...)`` items."""
    extra = (",\n" + ctes.strip().lstrip(",").strip()) if ctes.strip() else ""
    return "WITH " + ADAPTER_CTES.strip() + extra + "\n" + body.strip()
