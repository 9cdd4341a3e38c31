"""Registered queries: link-prediction heuristics on the stored graph (§2.L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.functions import expr as X
from riskgraph.operators import graph as G
from riskgraph.operators import linkpred as L
from riskgraph.operators import relational as R
from riskgraph.plans import sql as S
from riskgraph.plans.registry import query
from riskgraph.session import cut_lineage
from riskgraph.sources import fixtures as FX


def stored(spark, sf):
    return G.stored_graph(FX.inspections(spark, sf, with_counters=False))


_PAIRS = """ents AS (SELECT DISTINCT entity_id, entity_node_id FROM links),
outs AS (SELECT node_id AS pest_node_id, CAST(key AS INTEGER) AS pest_value,
                CASE WHEN CAST(key AS INTEGER) = 0 THEN 'no_pest' ELSE 'pest' END AS pest_label
         FROM nodes WHERE label = 'TargetProxy'),
pairs AS (
  SELECT e.entity_id, e.entity_node_id, o.pest_node_id, o.pest_value, o.pest_label,
         EXISTS (SELECT 1 FROM links l WHERE l.entity_node_id = e.entity_node_id
                 AND l.pest_node_id = o.pest_node_id) AS has_existing_relationship
  FROM ents e CROSS JOIN outs o)"""

_SCORED = """tadj AS (SELECT node AS z, nbr AS pest_node_id FROM adj
               WHERE nbr IN (SELECT pest_node_id FROM outs)),
cn AS (
  SELECT p.entity_node_id, p.pest_node_id, count(*) AS cn,
         sum(CASE WHEN d.deg > 1 THEN 1.0 / ln(d.deg) ELSE 0.0 END) AS aa
  FROM pairs p JOIN adj a1 ON a1.node = p.entity_node_id
               JOIN tadj t ON t.z = a1.nbr AND t.pest_node_id = p.pest_node_id
               JOIN deg d ON d.node = a1.nbr
  GROUP BY p.entity_node_id, p.pest_node_id),
scored AS (
  SELECT p.*, CAST(coalesce(cn.cn, 0) AS BIGINT) AS common_neighbors_count,
         coalesce(cn.aa, 0.0) AS adamic_adar_score,
         CASE WHEN coalesce(da.deg, 0) + coalesce(db.deg, 0) - coalesce(cn.cn, 0) > 0
              THEN coalesce(cn.cn, 0) / (coalesce(da.deg, 0) + coalesce(db.deg, 0) - coalesce(cn.cn, 0))
              ELSE 0.0 END AS jaccard_score,
         CAST(coalesce(da.deg, 0) * coalesce(db.deg, 0) AS DOUBLE) AS preferential_attachment_score
  FROM pairs p LEFT JOIN cn ON cn.entity_node_id = p.entity_node_id AND cn.pest_node_id = p.pest_node_id
               LEFT JOIN deg da ON da.node = p.entity_node_id
               LEFT JOIN deg db ON db.node = p.pest_node_id)"""

_LINK_BASE = S.with_(S.BASE, S.NODES, S.EDGES, S.ADJ, S.LINKS, _PAIRS, _SCORED)

_HEUR = _LINK_BASE.rstrip() + """,
mx AS (SELECT max(adamic_adar_score) AS maa, max(jaccard_score) AS mj,
              max(common_neighbors_count) AS mcn, max(preferential_attachment_score) AS mpa FROM scored),
comp AS (
  SELECT s.*, (CASE WHEN maa > 0 THEN adamic_adar_score / maa ELSE 0.0 END) * 0.4
            + (CASE WHEN mj > 0 THEN jaccard_score / mj ELSE 0.0 END) * 0.3
            + (CASE WHEN mcn > 0 THEN common_neighbors_count / mcn ELSE 0.0 END) * 0.2
            + (CASE WHEN mpa > 0 THEN preferential_attachment_score / mpa ELSE 0.0 END) * 0.1 AS composite
  FROM scored s CROSS JOIN mx),
heur AS (
  SELECT entity_id, composite AS link_pred_pest_score,
         CASE WHEN composite >= 0.5 THEN 1 ELSE 0 END AS link_pred_pest_binary,
         adamic_adar_score AS max_adamic_adar_score, jaccard_score AS max_jaccard_score,
         common_neighbors_count AS max_common_neighbors,
         preferential_attachment_score AS max_preferential_attachment,
         CAST(has_existing_relationship AS INTEGER) AS has_actual_pest
  FROM comp WHERE pest_value = 1)
"""


@query("entity_outcome_links", sql=S.with_(S.BASE, S.MERGED_EDGES, S.LINKS) + """
SELECT *, CASE WHEN target_value = 0 THEN 'no_pest' ELSE 'pest' END AS target_label FROM links""")
def q_links(spark, sf):
    """C-J9: (Entity)-[HAS_INSPECTION_RESULT]->(TargetProxy) rows."""
    return G.entity_outcome_links(stored(spark, sf))


@query("entity_outcome_max", sql=S.with_(S.BASE, S.MERGED_EDGES, S.LINKS) + """
SELECT entity_id, target_value, max(target_value) AS has_pest_ever FROM links GROUP BY entity_id, target_value""")
def q_outcome_max(spark, sf):
    """C-A16: per (entity, outcome value) the max value."""
    return R.entity_outcome_max(G.entity_outcome_links(stored(spark, sf)))


@query("outcome_nodes", sql=S.with_(S.BASE, S.NODES, S.MERGED_EDGES, S.LINKS, _PAIRS) + "SELECT * FROM outs")
def q_outcome_nodes(spark, sf):
    """C-D4: outcome nodes with value and label."""
    return L.outcome_nodes(stored(spark, sf))


@query("candidate_pairs", sql=S.with_(S.BASE, S.NODES, S.MERGED_EDGES, S.LINKS, _PAIRS) + "SELECT * FROM pairs")
def q_candidate_pairs(spark, sf):
    """C-J5 + C-J6: entity x outcome pairs flagged when already linked."""
    return L.candidate_pairs(stored(spark, sf))


@query("distinct_entity_pairs", sql=S.with_(S.BASE, S.MERGED_EDGES, S.LINKS) +
       "SELECT DISTINCT entity_id, entity_node_id FROM links")
def q_distinct_entity_pairs(spark, sf):
    """C-D3: distinct (entity, node id) of linked entities."""
    return G.entity_outcome_links(stored(spark, sf)).select("entity_id", "entity_node_id") \
        .dropDuplicates(["entity_node_id"])


def _scores(spark, sf):
    return L.link_pair_scores(stored(spark, sf))


@query("adamic_adar", sql=_LINK_BASE + "SELECT entity_node_id, pest_node_id, adamic_adar_score FROM scored")
def q_aa(spark, sf):
    """L-1: Adamic-Adar of every entity-outcome pair."""
    return _scores(spark, sf).select("entity_node_id", "pest_node_id", "adamic_adar_score")


@query("jaccard", sql=_LINK_BASE + "SELECT entity_node_id, pest_node_id, jaccard_score FROM scored")
def q_jaccard(spark, sf):
    """L-2: Jaccard of every entity-outcome pair."""
    return _scores(spark, sf).select("entity_node_id", "pest_node_id", "jaccard_score")


@query("common_neighbors", sql=_LINK_BASE + "SELECT entity_node_id, pest_node_id, common_neighbors_count FROM scored")
def q_cn(spark, sf):
    """L-3: common neighbours of every entity-outcome pair."""
    return _scores(spark, sf).select("entity_node_id", "pest_node_id", "common_neighbors_count")


@query("preferential_attachment",
       sql=_LINK_BASE + "SELECT entity_node_id, pest_node_id, preferential_attachment_score FROM scored")
def q_pa(spark, sf):
    """L-4: preferential attachment of every entity-outcome pair."""
    return _scores(spark, sf).select("entity_node_id", "pest_node_id", "preferential_attachment_score")


@query("attach_pair_scores", sql=_LINK_BASE + "SELECT * FROM scored")
def q_attach_pair_scores(spark, sf):
    """C-J3: all four scores left-joined to the candidate pairs."""
    return _scores(spark, sf)


@query("link_heuristic_scores", sql=_HEUR + "SELECT * FROM heur")
def q_link_heuristics(spark, sf):
    """L-7: composite heuristic pest score per entity (flagship)."""
    return L.link_heuristics(stored(spark, sf), threshold=0.5)


@query("max_normalize", sql=_HEUR + """SELECT entity_node_id, pest_node_id,
  CASE WHEN maa > 0 THEN adamic_adar_score / maa ELSE 0.0 END AS adamic_adar_score_normalized,
  CASE WHEN mj > 0 THEN jaccard_score / mj ELSE 0.0 END AS jaccard_score_normalized,
  CASE WHEN mcn > 0 THEN common_neighbors_count / mcn ELSE 0.0 END AS common_neighbors_count_normalized,
  CASE WHEN mpa > 0 THEN preferential_attachment_score / mpa ELSE 0.0 END AS preferential_attachment_score_normalized
FROM scored CROSS JOIN mx""")
def q_max_normalize(spark, sf):
    """B-P17: each of the four scores / its max over all pairs."""
    cols = list(X.COMPOSITE_WEIGHTS)
    n = R.max_normalize(cut_lineage(_scores(spark, sf).select("entity_node_id", "pest_node_id", *cols)), cols)      # read by the maxima and by the rows
    return n.select("entity_node_id", "pest_node_id", *[f"{c}_normalized" for c in cols])


@query("filter_pest_candidates", sql=_LINK_BASE + "SELECT entity_id, pest_node_id FROM pairs WHERE pest_value = 1")
def q_filter_pest(spark, sf):
    """B-F1: keep the pairs whose outcome is the pest outcome."""
    return L.candidate_pairs(stored(spark, sf)).where(F.col("pest_value") == 1).select("entity_id", "pest_node_id")


@query("link_precision_recall", sql=_HEUR + """
SELECT count_if(link_pred_pest_binary = 1 AND has_actual_pest = 1) AS tp,
       count_if(link_pred_pest_binary = 1) AS predicted_positive,
       count_if(has_actual_pest = 1) AS actual_positive, count(*) AS total,
       coalesce(count_if(link_pred_pest_binary = 1 AND has_actual_pest = 1) / nullif(count_if(link_pred_pest_binary = 1), 0), 0.0) AS precision,
       coalesce(count_if(link_pred_pest_binary = 1 AND has_actual_pest = 1) / nullif(count_if(has_actual_pest = 1), 0), 0.0) AS recall
FROM heur""")
def q_link_pr(spark, sf):
    """C-A9: precision and recall of the heuristic link predictions."""
    h = L.link_heuristics(stored(spark, sf), threshold=0.5)
    return R.precision_recall(h, "link_pred_pest_binary", "has_actual_pest")


@query("entity_rollup_max", sql=_LINK_BASE + """
SELECT entity_id, max(adamic_adar_score) AS max_adamic_adar_score, max(jaccard_score) AS max_jaccard_score,
       max(common_neighbors_count) AS max_common_neighbors,
       max(CAST(has_existing_relationship AS INTEGER)) AS has_actual_pest
FROM scored GROUP BY entity_id""")
def q_rollup(spark, sf):
    """C-A7: per entity max of the pair scores over both outcomes."""
    s = _scores(spark, sf)
    return R.rollup_max(s, "entity_id", {"adamic_adar_score": "max_adamic_adar_score",
                                         "jaccard_score": "max_jaccard_score",
                                         "common_neighbors_count": "max_common_neighbors",
                                         "has_existing_relationship": "has_actual_pest"})


_PEST_AFF_CTES = """adj AS (
  SELECT src AS node, dst AS nbr FROM merged_edges WHERE rel_type <> 'HAS_INSPECTION_RESULT'
  UNION ALL SELECT dst, src FROM merged_edges WHERE rel_type <> 'HAS_INSPECTION_RESULT'),
pdeg2 AS (SELECT node, count(*) AS deg FROM adj GROUP BY node),
pest_set AS (SELECT DISTINCT entity_node_id AS p FROM links WHERE target_value = 1),
e_adj AS (SELECT a.node, a.nbr AS z FROM adj a JOIN dim_nodes n ON n.node_id = a.node AND n.label = 'Entity'),
pz AS (SELECT a.node AS z, count(*) AS pz FROM adj a JOIN pest_set ps ON ps.p = a.nbr GROUP BY a.node),
terms AS (
  SELECT e.node, pz.pz - CASE WHEN e.node IN (SELECT p FROM pest_set) THEN 1 ELSE 0 END AS t, d.deg AS dz
  FROM e_adj e JOIN pz ON pz.z = e.z JOIN pdeg2 d ON d.node = e.z),
agg AS (SELECT node, sum(t) AS cn, sum(CASE WHEN dz > 1 THEN t / ln(dz) ELSE 0.0 END) AS aa
        FROM terms GROUP BY node)"""

_PEST_AFF_SELECT = """
SELECT n.node_id, CAST(coalesce(agg.cn, 0) AS BIGINT) AS cn_pest, coalesce(agg.aa, 0.0) AS aa_pest
FROM dim_nodes n LEFT JOIN agg ON agg.node = n.node_id WHERE n.label = 'Entity'"""


@query("entity_similarity",
       sql=S.with_(S.BASE, S.DIM_NODES, S.MERGED_EDGES, S.LINKS, _PEST_AFF_CTES) + _PEST_AFF_SELECT)
def q_entity_similarity(spark, sf):
    """L-5 (re-aimed): each entity's summed common-neighbour and Adamic-Adar
    similarity to all pest-case entities over shared country / month /
    country-month nodes, computed per shared node without forming pairs."""
    i = FX.inspections(spark, sf, with_counters=False)
    g = G.pest_projection(i, exclude_target_edges=True)
    links = G.entity_outcome_links(G.Graph(G.build_nodes(i, False), G.build_edges(i, False)))
    pests = links.where(F.col("target_value") == 1).select(F.col("entity_node_id").alias("node_id"))
    return L.entity_pest_affinity(g, pests)
