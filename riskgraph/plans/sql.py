"""Shared DuckDB SQL building blocks for the oracles (same definitions as
``riskgraph.sources.fixtures`` and ``riskgraph.operators.graph``)."""

from __future__ import annotations

BASE = """base AS (
  SELECT o_orderkey AS inspection_id, o_custkey AS enty_id, n_name AS ctry_code,
         CAST(month(CAST(o_orderdate AS DATE)) AS INTEGER) AS month,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS insp_day,
         CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 1 ELSE 0 END AS target_proxy
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _frame(n: int) -> str:
    return f"(PARTITION BY enty_id ORDER BY insp_day RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"


INSPECTIONS = BASE + """,
inspections AS (
  SELECT inspection_id, enty_id, ctry_code, month, insp_day, target_proxy,
""" + ",\n".join(
    f"    CAST(count(*) OVER {_frame(n)} AS BIGINT) AS enty_exams_{name},\n"
    f"    CAST(coalesce(sum(target_proxy) OVER {_frame(n)}, 0) AS BIGINT) AS enty_pests_{name}"
    for name, n in (("30d", 30), ("90d", 90), ("1yr", 365))) + """
  FROM base)"""

DIM_NODES = """dim_nodes AS (
  SELECT DISTINCT 'E:' || CAST(enty_id AS VARCHAR) AS node_id, 'Entity' AS label, CAST(enty_id AS VARCHAR) AS key FROM base
  UNION ALL SELECT DISTINCT 'C:' || ctry_code, 'Country', ctry_code FROM base
  UNION ALL SELECT DISTINCT 'M:' || CAST(month AS VARCHAR), 'Month', CAST(month AS VARCHAR) FROM base
  UNION ALL SELECT DISTINCT 'CM:' || ctry_code || '_' || CAST(month AS VARCHAR), 'CountryMonth',
                   ctry_code || '_' || CAST(month AS VARCHAR) FROM base
  UNION ALL SELECT DISTINCT 'T:' || CAST(target_proxy AS VARCHAR), 'TargetProxy', CAST(target_proxy AS VARCHAR) FROM base)"""

NODES = DIM_NODES + """,
nodes AS (
  SELECT * FROM dim_nodes
  UNION ALL SELECT 'I:' || CAST(inspection_id AS VARCHAR), 'Inspection', CAST(inspection_id AS VARCHAR) FROM base)"""

MERGED_EDGES = """merged_edges AS (
  SELECT DISTINCT 'E:' || CAST(enty_id AS VARCHAR) AS src, 'M:' || CAST(month AS VARCHAR) AS dst, 'SHIPPED_IN' AS rel_type FROM base
  UNION ALL SELECT DISTINCT 'E:' || CAST(enty_id AS VARCHAR), 'C:' || ctry_code, 'IS_FROM' FROM base
  UNION ALL SELECT DISTINCT 'E:' || CAST(enty_id AS VARCHAR), 'CM:' || ctry_code || '_' || CAST(month AS VARCHAR), 'HAS_WEATHER' FROM base
  UNION ALL SELECT DISTINCT 'E:' || CAST(enty_id AS VARCHAR), 'T:' || CAST(target_proxy AS VARCHAR), 'HAS_INSPECTION_RESULT' FROM base)"""

EDGES = MERGED_EDGES + """,
edges AS (
  SELECT * FROM merged_edges
  UNION ALL SELECT 'I:' || CAST(inspection_id AS VARCHAR), 'C:' || ctry_code, 'IN_COUNTRY' FROM base
  UNION ALL SELECT 'I:' || CAST(inspection_id AS VARCHAR), 'M:' || CAST(month AS VARCHAR), 'IN_MONTH' FROM base
  UNION ALL SELECT 'I:' || CAST(inspection_id AS VARCHAR), 'E:' || CAST(enty_id AS VARCHAR), 'FOR_ENTITY' FROM base
  UNION ALL SELECT 'I:' || CAST(inspection_id AS VARCHAR), 'T:' || CAST(target_proxy AS VARCHAR), 'HAS_TARGET' FROM base)"""

# stored graph as undirected neighbour rows
ADJ = """adj AS (
  SELECT src AS node, dst AS nbr FROM edges UNION ALL SELECT dst, src FROM edges),
deg AS (SELECT node, count(*) AS deg FROM adj GROUP BY node)"""

# projection (5 labels, 4 entity-level types), undirected
PROJ = """proj_nodes AS (SELECT * FROM dim_nodes),
proj_edges AS (
  SELECT src, dst, rel_type FROM merged_edges UNION ALL SELECT dst, src, rel_type FROM merged_edges)"""

PROJ_NO_TARGET = """proj_nodes AS (SELECT * FROM dim_nodes),
proj_edges AS (
  SELECT src, dst, rel_type FROM merged_edges WHERE rel_type <> 'HAS_INSPECTION_RESULT'
  UNION ALL SELECT dst, src, rel_type FROM merged_edges WHERE rel_type <> 'HAS_INSPECTION_RESULT')"""

LINKS = """links AS (
  SELECT src AS entity_node_id, dst AS pest_node_id,
         TRY_CAST(split_part(src, ':', 2) AS BIGINT) AS entity_id,
         TRY_CAST(split_part(dst, ':', 2) AS INTEGER) AS target_value
  FROM merged_edges WHERE rel_type = 'HAS_INSPECTION_RESULT')"""

SCORES = """scores AS (
  SELECT event_id, user_id, ts,
         round(value / (SELECT max(value) FROM events), 2) AS score,
         CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS label
  FROM events),
scored AS (SELECT *, CASE WHEN score >= 0.1 THEN 1 ELSE 0 END AS predicted FROM scores)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
