"""Registered queries: fixture, graph build, projection, graph statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.operators import graph as G
from riskgraph.operators import relational as R
from riskgraph.plans import sql as S
from riskgraph.plans.registry import query
from riskgraph.sources import fixtures as FX
from riskgraph.sources import tables as TB
from riskgraph.functions import expr as X


def insp(spark, sf):
    return FX.inspections(spark, sf)


@query("trailing_counts", sql=S.with_(S.INSPECTIONS) + "SELECT * FROM inspections")
def q_trailing_counts(spark, sf):
    """C-W4: inspections with the six trailing 30/90/365-day counters."""
    return insp(spark, sf)


@query("read_inspections", sql=S.with_(S.BASE) +
       "SELECT count(*) AS n_rows, count(DISTINCT enty_id) AS n_entities FROM base")
def q_read_inspections(spark, sf):
    """A-S1: inspection rows and distinct entities."""
    return TB.inspection_summary(FX.inspections(spark, sf, with_counters=False))


@query("graph_nodes", sql=S.with_(S.BASE, S.NODES) + "SELECT * FROM nodes")
def q_graph_nodes(spark, sf):
    """G-B1 / C-D1 / C-D2: all nodes of the stored graph."""
    return G.build_nodes(FX.inspections(spark, sf, with_counters=False))


@query("graph_edges", sql=S.with_(S.BASE, S.EDGES) + "SELECT * FROM edges")
def q_graph_edges(spark, sf):
    """G-B2: all relationships of the stored graph."""
    return G.build_edges(FX.inspections(spark, sf, with_counters=False))


@query("node_counts", sql=S.with_(S.BASE, S.NODES) +
       "SELECT label, count(*) AS n_nodes FROM nodes GROUP BY label")
def q_node_counts(spark, sf):
    """C-A10: nodes per label."""
    return G.node_counts(G.stored_graph(FX.inspections(spark, sf, with_counters=False)))


@query("edge_counts", sql=S.with_(S.BASE, S.EDGES) +
       "SELECT rel_type, count(*) AS n_edges FROM edges GROUP BY rel_type ORDER BY n_edges DESC, rel_type")
def q_edge_counts(spark, sf):
    """C-A10: relationships per type, descending."""
    return G.edge_counts(G.stored_graph(FX.inspections(spark, sf, with_counters=False)))


@query("project_graph", sql=S.with_(S.BASE, S.DIM_NODES, S.MERGED_EDGES, S.PROJ) + "SELECT * FROM proj_edges")
def q_project_graph(spark, sf):
    """G-B3: the 5-label / 4-type projection, undirected (edges)."""
    return G.pest_projection(FX.inspections(spark, sf, with_counters=False)).edges


@query("graph_density", sql=S.with_(S.BASE, S.DIM_NODES, S.MERGED_EDGES, S.PROJ) + """
SELECT n AS n_nodes, m AS n_edges, m / (n * (n - 1.0)) AS density
FROM (SELECT (SELECT count(*) FROM proj_nodes) AS n, (SELECT count(*) FROM proj_edges) AS m)""")
def q_graph_density(spark, sf):
    """C-A11: node count, relationship count and density of the projection."""
    return G.density(G.pest_projection(FX.inspections(spark, sf, with_counters=False)))


_DEG = """pdeg AS (
  SELECT n.node_id, CAST(coalesce(d.degree, 0) AS BIGINT) AS degree
  FROM proj_nodes n LEFT JOIN (SELECT src AS node_id, count(*) AS degree FROM proj_edges GROUP BY src) d
  ON n.node_id = d.node_id)"""


@query("degree_centrality", sql=S.with_(S.BASE, S.DIM_NODES, S.MERGED_EDGES, S.PROJ, _DEG) + "SELECT * FROM pdeg")
def q_degree(spark, sf):
    """H-C1: degree of every projection node (undirected; isolated = 0)."""
    return G.degrees(G.pest_projection(FX.inspections(spark, sf, with_counters=False)), "out")


@query("degree_distribution", sql=S.with_(S.BASE, S.DIM_NODES, S.MERGED_EDGES, S.PROJ, _DEG) + """
SELECT min(degree) AS min, avg(degree) AS mean, max(degree) AS max,
       quantile_cont(degree, 0.5) AS p50, quantile_cont(degree, 0.75) AS p75,
       quantile_cont(degree, 0.9) AS p90, quantile_cont(degree, 0.95) AS p95,
       quantile_cont(degree, 0.99) AS p99
FROM pdeg""")
def q_degree_distribution(spark, sf):
    """C-A12: min, mean, max and percentiles of projection degree."""
    return G.degree_distribution(G.pest_projection(FX.inspections(spark, sf, with_counters=False)))


@query("node_degree_property", sql=S.with_(S.BASE, S.DIM_NODES, S.MERGED_EDGES, S.PROJ, _DEG) + """
SELECT n.node_id, n.label, n.key, d.degree,
       CASE WHEN n.label = 'TargetProxy' THEN CAST(n.key AS INTEGER) END AS pest_value
FROM proj_nodes n JOIN pdeg d ON n.node_id = d.node_id""")
def q_node_degree_property(spark, sf):
    """G-B4: degree on every node, pest value on outcome nodes."""
    return G.with_degree(G.pest_projection(FX.inspections(spark, sf, with_counters=False)))


@query("unique_key_violations", sql=S.with_(S.BASE, S.NODES) +
       "SELECT label, key, count(*) AS n FROM nodes GROUP BY label, key HAVING count(*) > 1")
def q_key_violations(spark, sf):
    """C-D16: (label, key) pairs present more than once (expected empty)."""
    return R.key_violations(G.build_nodes(FX.inspections(spark, sf, with_counters=False)))


@query("distinct_country_month", sql=S.with_(S.BASE, S.DIM_NODES) +
       "SELECT node_id, key FROM dim_nodes WHERE label = 'CountryMonth'")
def q_distinct_cm(spark, sf):
    """C-D2: distinct CountryMonth nodes."""
    g = G.stored_graph(FX.inspections(spark, sf, with_counters=False))
    return G.nodes_of(g, "CountryMonth").select("node_id", "key")


@query("filter_label", sql=S.with_(S.BASE, S.NODES) + "SELECT node_id, key FROM nodes WHERE label = 'Entity'")
def q_filter_label(spark, sf):
    """B-F3: nodes of one label (Entity)."""
    g = G.stored_graph(FX.inspections(spark, sf, with_counters=False))
    return G.nodes_of(g, "Entity").select("node_id", "key")


@query("typed_pairs", sql=S.with_(S.BASE, S.NODES, S.EDGES) + """
SELECT e.dst, e.src, s.key AS src_key, d.key AS dst_key
FROM edges e JOIN nodes s ON e.src = s.node_id AND s.label = 'Entity'
             JOIN nodes d ON e.dst = d.node_id AND d.label = 'Country'
WHERE e.rel_type = 'IS_FROM'""")
def q_typed_pairs(spark, sf):
    """B-F5: Entity -> Country pairs of one relationship type, with keys."""
    g = G.stored_graph(FX.inspections(spark, sf, with_counters=False))
    return G.typed_pairs(g, "IS_FROM", "Entity", "Country")


@query("country_month_key", sql=S.with_(S.BASE) +
       "SELECT inspection_id, ctry_code || '_' || CAST(month AS VARCHAR) AS ctry_month_id FROM base")
def q_cm_key(spark, sf):
    """B-P1: composite country-month id per inspection."""
    b = FX.inspections(spark, sf, with_counters=False)
    return b.select("inspection_id", X.country_month_key().alias("ctry_month_id"))


@query("target_label", sql=S.with_(S.BASE) + """
SELECT inspection_id, CASE WHEN target_proxy = 0 THEN 'no_pest' ELSE 'pest' END AS target_label,
       target_proxy = 1 AS has_pest FROM base""")
def q_target_label(spark, sf):
    """B-P2: outcome label and boolean per inspection."""
    b = FX.inspections(spark, sf, with_counters=False)
    return b.select("inspection_id", X.target_label().alias("target_label"), X.has_pest().alias("has_pest"))


@query("typed_counters", sql=S.with_(S.INSPECTIONS) + """
SELECT inspection_id, CAST(target_proxy AS INTEGER) AS target_proxy,
       CAST(enty_exams_30d AS INTEGER) AS enty_exams_30d, CAST(enty_pests_30d AS INTEGER) AS enty_pests_30d,
       CAST(enty_exams_90d AS INTEGER) AS enty_exams_90d, CAST(enty_pests_90d AS INTEGER) AS enty_pests_90d,
       CAST(enty_exams_1yr AS INTEGER) AS enty_exams_1yr, CAST(enty_pests_1yr AS INTEGER) AS enty_pests_1yr
FROM inspections""")
def q_typed_counters(spark, sf):
    """B-P3: outcome and six counters cast to int."""
    i = insp(spark, sf)
    cols = ["target_proxy", "enty_exams_30d", "enty_pests_30d", "enty_exams_90d", "enty_pests_90d",
            "enty_exams_1yr", "enty_pests_1yr"]
    return X.cast_counters(i.select("inspection_id", *cols), cols)


@query("write_graph_roundtrip", sql=S.with_(S.BASE, S.EDGES) +
       "SELECT rel_type, count(*) AS n_edges FROM edges GROUP BY rel_type")
def q_write_graph(spark, sf):
    """A-W3: write nodes / edges partitioned by label / type, read back one type count each."""
    from riskgraph.sources.sinks import write_graph
    from riskgraph.session import ensure_checkpoint_dir
    g = G.stored_graph(FX.inspections(spark, sf, with_counters=False))
    out = ensure_checkpoint_dir(spark).rstrip("/") + "/graph_tables"
    write_graph(g.nodes, g.edges, out)
    e = spark.read.parquet(f"{out}/edges")
    return e.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n_edges"))
