"""Registered queries: centralities, structure, communities and embeddings
on the projection (§2.H).  Iterative algorithms are checked against SQL with
the iterations unrolled (same constants); learned / randomised ones by rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.operators import centrality as C
from riskgraph.operators import community as CO
from riskgraph.operators import embed as EM
from riskgraph.operators import graph as G
from riskgraph.operators import structure as ST
from riskgraph.plans import sql as S
from riskgraph.plans.registry import query
from riskgraph.sources import fixtures as FX


def proj(spark, sf, **kw):
    """The projection, built once: every algorithm reads it several times."""
    return G.frozen(G.pest_projection(FX.inspections(spark, sf, with_counters=False), **kw))


_P = [S.BASE, S.DIM_NODES, S.MERGED_EDGES, S.PROJ]


def _rank_sql(extra: str, iters: int, out: str) -> str:
    ctes = _P + ["od AS (SELECT src, count(*) AS od FROM proj_edges GROUP BY src)",
                 f"ew AS (SELECT e.src, e.dst, 1.0 / (od.od + {extra}) AS w FROM proj_edges e JOIN od ON od.src = e.src)",
                 "r0 AS (SELECT node_id, 1.0 - 0.85 AS r FROM proj_nodes)"]
    for i in range(1, iters + 1):
        ctes.append(f"r{i} AS (SELECT n.node_id, (1.0 - 0.85) + 0.85 * coalesce(c.s, 0.0) AS r FROM proj_nodes n "
                    f"LEFT JOIN (SELECT ew.dst, sum(p.r * ew.w) AS s FROM ew JOIN r{i - 1} p ON p.node_id = ew.src "
                    f"GROUP BY ew.dst) c ON c.dst = n.node_id)")
    return S.with_(*ctes) + f"SELECT node_id, r AS {out} FROM r{iters}"


@query("pagerank", sql=_rank_sql("0", 20, "pagerank"))
def q_pagerank(spark, sf):
    """H-C2: PageRank, d = .85, 20 iterations, on the undirected projection."""
    return C.pagerank(proj(spark, sf), 20, 0.85)


@query("article_rank", sql=_rank_sql("(SELECT count(*) FROM proj_edges) / (SELECT count(*) FROM proj_nodes)",
                                     20, "article_rank"))
def q_article_rank(spark, sf):
    """H-C3: ArticleRank, d = .85, 20 iterations."""
    return C.article_rank(proj(spark, sf), 20, 0.85)


def _eigen_sql(iters: int) -> str:
    ctes = _P + ["x0 AS (SELECT node_id, 1.0 AS x FROM proj_nodes)"]
    for i in range(1, iters + 1):
        ctes.append(f"y{i} AS (SELECT n.node_id, n.x + coalesce(c.s, 0.0) AS x FROM x{i - 1} n LEFT JOIN "
                    f"(SELECT e.dst, sum(p.x * 1.0) AS s FROM proj_edges e JOIN x{i - 1} p ON p.node_id = e.src "
                    f"GROUP BY e.dst) c ON c.dst = n.node_id)")
        ctes.append(f"x{i} AS (SELECT node_id, x / (SELECT sqrt(sum(x * x)) FROM y{i}) AS x FROM y{i})")
    return S.with_(*ctes) + f"SELECT node_id, x AS eigenvector FROM x{iters}"


@query("eigenvector", sql=_eigen_sql(20))
def q_eigenvector(spark, sf):
    """H-C4: eigenvector centrality, power iteration on A + I, 20 turns."""
    return C.eigenvector(proj(spark, sf), 20)


def _bfs_sql(levels: int) -> str:
    ctes = _P + ["adj AS (SELECT DISTINCT src AS node, dst AS nbr FROM proj_edges)",
                 "v0 AS (SELECT node_id AS source, node_id AS node, 0 AS dist FROM proj_nodes)",
                 "f0 AS (SELECT * FROM v0)"]
    for i in range(1, levels + 1):
        ctes.append(f"f{i} AS (SELECT DISTINCT f.source, a.nbr AS node, {i} AS dist FROM f{i - 1} f "
                    f"JOIN adj a ON a.node = f.node WHERE NOT EXISTS (SELECT 1 FROM v{i - 1} v "
                    f"WHERE v.source = f.source AND v.node = a.nbr))")
        ctes.append(f"v{i} AS (SELECT * FROM v{i - 1} UNION ALL SELECT * FROM f{i})")
    return S.with_(*ctes) + f"""SELECT n.node_id, coalesce(a.r / a.d, 0.0) AS closeness FROM proj_nodes n
LEFT JOIN (SELECT source, count(*) AS r, sum(dist) AS d FROM v{levels} WHERE dist > 0 GROUP BY source) a
ON a.source = n.node_id"""


@query("closeness", sql=_bfs_sql(8))
def q_closeness(spark, sf):
    """H-C5: closeness (reached / sum of distances), exact BFS from every node."""
    return C.closeness(proj(spark, sf), batch_size=4000)


@query("betweenness")
def q_betweenness(spark, sf):
    """H-C6: Brandes betweenness from every node (undirected, halved)."""
    return C.betweenness(proj(spark, sf), batch_size=4000)


_STORED_UND = """und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst),
sadj AS (SELECT a AS node, b AS nbr FROM und UNION ALL SELECT b, a FROM und),
sdeg AS (SELECT node, count(*) AS k FROM sadj GROUP BY node),
tri AS (SELECT x.a AS u, x.b AS v, y.b AS w FROM und x JOIN und y ON x.a = y.a AND x.b < y.b
        JOIN und z ON z.a = x.b AND z.b = y.b),
tper AS (SELECT node_id, count(*) AS t FROM (SELECT u AS node_id FROM tri UNION ALL SELECT v FROM tri
                                              UNION ALL SELECT w FROM tri) GROUP BY node_id),
tcc AS (SELECT n.node_id, CAST(coalesce(t.t, 0) AS BIGINT) AS triangle_count,
               CASE WHEN coalesce(d.k, 0) < 2 THEN 0.0 ELSE 2.0 * coalesce(t.t, 0) / (d.k * (d.k - 1)) END AS local_clustering
        FROM nodes n LEFT JOIN sdeg d ON d.node = n.node_id LEFT JOIN tper t ON t.node_id = n.node_id)"""


def _stored(spark, sf):
    return G.stored_graph(FX.inspections(spark, sf, with_counters=False))


@query("triangle_count", sql=S.with_(S.BASE, S.NODES, S.EDGES, _STORED_UND) + "SELECT * FROM tcc")
def q_triangles(spark, sf):
    """H-C7: triangles per node and local clustering on the stored graph."""
    return CO.triangles(_stored(spark, sf))


@query("triangle_summary", sql=S.with_(S.BASE, S.NODES, S.EDGES, _STORED_UND) +
       "SELECT CAST(sum(triangle_count) / 3 AS BIGINT) AS total_triangles, avg(local_clustering) AS mean_clustering FROM tcc")
def q_triangle_summary(spark, sf):
    """H-C7 global: total triangles and mean local clustering."""
    return CO.triangle_summary(CO.triangles(_stored(spark, sf)))


def _cc_graph(spark, sf):
    i = FX.inspections(spark, sf, with_counters=False)
    g = G.Graph(G.build_nodes(i, False), G.build_edges(i, False))
    return G.project(g, G.PROJECTION_LABELS, ["IS_FROM", "HAS_WEATHER"], "undirected")


def _wcc_sql(iters: int) -> str:
    ctes = [S.BASE, S.DIM_NODES, S.MERGED_EDGES,
            """cadj AS (SELECT src AS node, dst AS nbr FROM merged_edges WHERE rel_type IN ('IS_FROM', 'HAS_WEATHER')
                        UNION ALL SELECT dst, src FROM merged_edges WHERE rel_type IN ('IS_FROM', 'HAS_WEATHER'))""",
            "c0 AS (SELECT node_id, node_id AS c FROM dim_nodes)"]
    for i in range(1, iters + 1):
        ctes.append(f"c{i} AS (SELECT p.node_id, least(p.c, coalesce(m.mc, p.c)) AS c FROM c{i - 1} p LEFT JOIN "
                    f"(SELECT a.nbr AS node_id, min(q.c) AS mc FROM cadj a JOIN c{i - 1} q ON q.node_id = a.node "
                    f"GROUP BY a.nbr) m ON m.node_id = p.node_id)")
    return S.with_(*ctes) + f"SELECT node_id, c AS component_id FROM c{iters}"


@query("connected_components", sql=_wcc_sql(12))
def q_wcc(spark, sf):
    """H-C8: weak components of the entity-country / country-month projection."""
    return CO.connected_components(_cc_graph(spark, sf))


@query("component_count", sql="SELECT count(DISTINCT component_id) AS n_components FROM (" + _wcc_sql(12) + ")")
def q_wcc_count(spark, sf):
    """H-C8: number of weak components (isolated nodes count)."""
    return CO.component_count(CO.connected_components(_cc_graph(spark, sf)))


def _kcore_sql(iters: int) -> str:
    ctes = _P + ["kadj AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM proj_edges WHERE src <> dst)",
                 "sadj AS (SELECT a AS node, b AS nbr FROM kadj UNION ALL SELECT b, a FROM kadj)",
                 "k0 AS (SELECT n.node_id, CAST(coalesce(d.k, 0) AS BIGINT) AS core FROM proj_nodes n LEFT JOIN "
                 "(SELECT node, count(*) AS k FROM sadj GROUP BY node) d ON d.node = n.node_id)"]
    for i in range(1, iters + 1):
        ctes.append(f"""h{i} AS (SELECT node_id, max(least(v, cum)) AS h FROM (
    SELECT node_id, v, sum(n) OVER (PARTITION BY node_id ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
    FROM (SELECT s.node AS node_id, k.core AS v, count(*) AS n FROM sadj s JOIN k{i - 1} k ON k.node_id = s.nbr
          GROUP BY s.node, k.core)) GROUP BY node_id),
k{i} AS (SELECT k.node_id, CAST(least(k.core, coalesce(h.h, 0)) AS BIGINT) AS core FROM k{i - 1} k
         LEFT JOIN h{i} h ON h.node_id = k.node_id)""")
    return S.with_(*ctes) + f"SELECT node_id, core AS core_value FROM k{iters}"


@query("k_core", sql=_kcore_sql(12))
def q_kcore(spark, sf):
    """H-C11: core number of every projection node."""
    return CO.k_core(proj(spark, sf))


_COUNTRY_OF = """CASE WHEN n.label = 'Entity' THEN ef.country WHEN n.label = 'CountryMonth'
                 THEN 'C:' || regexp_replace(n.key, '_[0-9]+$', '') ELSE n.node_id END"""


@query("modularity", sql=S.with_(*_P, """ef AS (SELECT DISTINCT src AS node_id, dst AS country FROM merged_edges WHERE rel_type = 'IS_FROM'),
comm AS (SELECT n.node_id, """ + _COUNTRY_OF + """ AS community_id FROM proj_nodes n LEFT JOIN ef ON ef.node_id = n.node_id),
madj AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM proj_edges WHERE src <> dst),
sadj AS (SELECT a AS node, b AS nbr FROM madj UNION ALL SELECT b, a FROM madj),
per AS (SELECT c1.community_id AS c, sum(CASE WHEN c1.community_id = c2.community_id THEN 1 ELSE 0 END) AS l2, count(*) AS k
        FROM sadj s JOIN comm c1 ON c1.node_id = s.node JOIN comm c2 ON c2.node_id = s.nbr GROUP BY c1.community_id)""") +
       "SELECT sum(l2 / (SELECT count(*) FROM sadj) - power(k / (SELECT count(*) FROM sadj), 2)) AS modularity FROM per")
def q_modularity(spark, sf):
    """H-C10: modularity of the by-country partition of the projection."""
    g = proj(spark, sf)
    ef = g.edges.where(F.col("rel_type") == "IS_FROM").where(F.col("src").startswith("E:")) \
        .select(F.col("src").alias("node_id"), F.col("dst").alias("country")).distinct()
    n = g.nodes.join(ef, "node_id", "left")
    comm = n.select("node_id", F.when(F.col("label") == "Entity", F.col("country"))
                    .when(F.col("label") == "CountryMonth",
                          F.concat(F.lit("C:"), F.regexp_replace("key", "_[0-9]+$", "")))
                    .otherwise(F.col("node_id")).alias("community_id"))
    return CO.modularity(g, comm)


@query("louvain")
def q_louvain(spark, sf):
    """H-C9: Louvain community of every projection node, and its size."""
    c = CO.louvain(proj(spark, sf))
    return c.join(c.groupBy("community_id").agg(F.count(F.lit(1)).alias("community_size")), "community_id")


_PROJ_TRIANGLES = [s.replace("FROM edges WHERE", "FROM proj_edges WHERE").replace("FROM nodes n", "FROM proj_nodes n") for s in [_STORED_UND]]
_STRUCTURE = f"""
SELECT n.node_id, n.key, d.degree, p.pagerank, a.article_rank, x.eigenvector, t.triangle_count, t.local_clustering, k.core_value
FROM ({S.with_(*_P)}SELECT * FROM proj_nodes WHERE label = 'Entity') n
JOIN ({S.with_(*_P)}SELECT src AS node_id, count(*) AS degree FROM proj_edges GROUP BY src) d ON d.node_id = n.node_id
JOIN ({_rank_sql("0", 20, "pagerank")}) p ON p.node_id = n.node_id
JOIN ({_rank_sql("(SELECT count(*) FROM proj_edges) / (SELECT count(*) FROM proj_nodes)", 20, "article_rank")}) a ON a.node_id = n.node_id
JOIN ({_eigen_sql(20)}) x ON x.node_id = n.node_id
JOIN ({S.with_(*_P, *_PROJ_TRIANGLES)}SELECT * FROM tcc) t ON t.node_id = n.node_id
JOIN ({_kcore_sql(12)}) k ON k.node_id = n.node_id"""


@query("structural_features", sql=_STRUCTURE)
def q_structural_features(spark, sf):
    """H-C12: degree, PageRank, ArticleRank, eigenvector, triangles, clustering and core of every entity in one frame."""
    return ST.structural_features(proj(spark, sf))


@query("fastrp")
def q_fastrp(spark, sf):
    """H-E1: FastRP embeddings (dim 64, weights .8, 1, 1, 1) of entities."""
    g = proj(spark, sf, exclude_target_edges=True)
    e = EM.fastrp(g, 64, (0.8, 1.0, 1.0, 1.0))
    return e.join(G.nodes_of(g, "Entity").select("node_id"), "node_id")


def _walk_sql(length: int, per_node: int) -> str:
    ctes = [S.BASE, S.DIM_NODES, S.MERGED_EDGES, S.PROJ_NO_TARGET,
            """wadj AS (SELECT node, nbr, row_number() OVER (PARTITION BY node ORDER BY nbr) - 1 AS idx,
                        count(*) OVER (PARTITION BY node) AS deg
                        FROM (SELECT DISTINCT src AS node, dst AS nbr FROM proj_edges))""",
            f"""w0 AS (SELECT node_id || '#' || CAST(r AS VARCHAR) AS walk_id, 0 AS step, node_id
                       FROM proj_nodes, (SELECT unnest(range({per_node})) AS r))"""]
    for i in range(1, length):
        ctes.append(f"""w{i} AS (SELECT w.walk_id, {i} AS step, a.nbr AS node_id FROM w{i - 1} w JOIN wadj a ON a.node = w.node_id
            AND a.idx = CAST('0x' || substr(md5('42:' || w.walk_id || ':{i}'), 1, 12) AS BIGINT) % a.deg)""")
    return S.with_(*ctes) + " UNION ALL ".join(f"SELECT walk_id, CAST(step AS INTEGER) AS step, node_id FROM w{i}" for i in range(length))


@query("random_walks", sql=_walk_sql(10, 10))
def q_walks(spark, sf):
    """H-E2: 10 uniform walks of length 10 from every projection node."""
    return EM.random_walks(proj(spark, sf, exclude_target_edges=True), 10, 10)


@query("node2vec")
def q_node2vec(spark, sf):
    """H-E3 / H-E8: node2vec (walks + skip-gram) embeddings of entities."""
    return EM.extract_embeddings(proj(spark, sf, exclude_target_edges=True), "node2vec", 64)


@query("sample_neighbors", sql=S.with_(*_P) + """
SELECT node, nbr, CAST(sample_rank AS INTEGER) AS sample_rank FROM (
  SELECT src AS node, dst AS nbr,
         row_number() OVER (PARTITION BY src ORDER BY md5('42:1:' || src || ':' || dst)) AS sample_rank
  FROM (SELECT DISTINCT src, dst FROM proj_edges)) WHERE sample_rank <= 25""")
def q_sample(spark, sf):
    """H-E4: 25 neighbours per node in seeded md5 order."""
    return EM.sample_neighbors(proj(spark, sf), 25, 42, 1).select("node", "nbr", "sample_rank")


@query("graphsage_aggregate")
def q_sage_agg(spark, sf):
    """H-E5: two-hop sampled mean aggregation of [log1p degree] features."""
    g = proj(spark, sf, exclude_target_edges=True)
    return EM.sage_aggregate(g, EM.node_features(g), (25, 10), "mean")


@query("graphsage_embeddings")
def q_sage_emb(spark, sf):
    """H-E6 (untrained forward pass): aggregated features projected to 64 dims."""
    g = proj(spark, sf, exclude_target_edges=True)
    e = EM.graphsage_embeddings(g, EM.node_features(g), 64, (25, 10))
    return e.join(G.nodes_of(g, "Entity").select("node_id"), "node_id")


@query("full_graph_stats")
def q_graph_profile(spark, sf):
    """G-B5: nodes, edges, density and component count of the projection."""
    g = proj(spark, sf)
    d = G.density(g)
    n = CO.component_count(CO.connected_components(g)).first()[0]
    return d.withColumn("n_components", F.lit(int(n)))
