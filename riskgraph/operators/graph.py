"""Graph construction and projection.

A graph is two DataFrames: ``nodes(node_id, label, key)`` and
``edges(src, dst, rel_type)``.  Node ids are natural keys
``<prefix>:<key>``, so no dense id assignment (a global sort) is needed.

Building is two passes over the inspection rows: the per-row parts
(Inspection nodes and their four edges) are narrow projections, and the
de-duplicated parts (dimension nodes and the four MERGE edge types) are
one ``explode`` + one ``distinct`` each - a single shuffle with map-side
de-duplication, so a hub (a country holding a third of the rows) sends
one row per map task, not one per inspection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.functions import expr as X
from riskgraph.operators.quantiles import exact_quantiles
from riskgraph.session import cut_lineage

# ---------------------------------------------------------------------------
# Fixed values of the data model (labels, id prefixes, relationship types).
# ---------------------------------------------------------------------------
PREFIX = {"Entity": "E", "Country": "C", "Month": "M", "CountryMonth": "CM",
          "TargetProxy": "T", "Inspection": "I"}
PER_ROW_TYPES = ["IN_COUNTRY", "IN_MONTH", "FOR_ENTITY", "HAS_TARGET"]
MERGED_TYPES = ["SHIPPED_IN", "IS_FROM", "HAS_WEATHER", "HAS_INSPECTION_RESULT"]
PROJECTION_LABELS = ["Country", "Month", "Entity", "TargetProxy", "CountryMonth"]
PROJECTION_TYPES = ["SHIPPED_IN", "IS_FROM", "HAS_WEATHER", "HAS_INSPECTION_RESULT"]


@dataclass
class Graph:
    nodes: DataFrame   # node_id, label, key
    edges: DataFrame   # src, dst, rel_type (both directions present if undirected)
    undirected: bool = False


def node_id(label: str, key: Column) -> Column:
    return F.concat(F.lit(PREFIX[label] + ":"), key.cast("string"))


def _dim_keys() -> dict[str, Column]:
    return {
        "Entity": F.col("enty_id").cast("string"),
        "Country": F.col("ctry_code").cast("string"),
        "Month": F.col("month").cast("string"),
        "CountryMonth": X.country_month_key("ctry_code", "month"),
        "TargetProxy": F.col("target_proxy").cast("string"),
    }


def build_nodes(insp: DataFrame, with_inspections: bool = True) -> DataFrame:
    """G-B1 / C-D1 / C-D2: distinct Country, Month, Entity, TargetProxy and
    CountryMonth nodes (+ one Inspection node per row)."""
    keys = _dim_keys()
    pairs = F.explode(F.array(*[F.struct(F.lit(lbl).alias("label"), k.alias("key"))
                                for lbl, k in keys.items()])).alias("n")
    dims = insp.select(pairs).select("n.label", "n.key").where(F.col("key").isNotNull()).distinct()
    prefix = F.element_at(F.create_map(*[x for kv in PREFIX.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]),
                          F.col("label"))
    dims = dims.select(F.concat(prefix, F.lit(":"), F.col("key")).alias("node_id"), "label", "key")
    if not with_inspections:
        return dims
    ins = insp.select(node_id("Inspection", F.col("inspection_id")).alias("node_id"),
                      F.lit("Inspection").alias("label"),
                      F.col("inspection_id").cast("string").alias("key"))
    return dims.unionByName(ins)


def build_edges(insp: DataFrame, with_inspections: bool = True) -> DataFrame:
    """G-B2: four per-row edge types from each Inspection node and four
    de-duplicated (MERGE) types from each Entity."""
    keys = _dim_keys()
    ent = node_id("Entity", keys["Entity"])
    merged = F.explode(F.array(
        F.struct(F.lit("SHIPPED_IN").alias("rel_type"), node_id("Month", keys["Month"]).alias("dst")),
        F.struct(F.lit("IS_FROM").alias("rel_type"), node_id("Country", keys["Country"]).alias("dst")),
        F.struct(F.lit("HAS_WEATHER").alias("rel_type"), node_id("CountryMonth", keys["CountryMonth"]).alias("dst")),
        F.struct(F.lit("HAS_INSPECTION_RESULT").alias("rel_type"),
                 node_id("TargetProxy", keys["TargetProxy"]).alias("dst")),
    )).alias("e")
    m = insp.select(ent.alias("src"), merged).select("src", "e.dst", "e.rel_type").distinct()
    if not with_inspections:
        return m
    ins = node_id("Inspection", F.col("inspection_id"))
    per_row = F.explode(F.array(
        F.struct(F.lit("IN_COUNTRY").alias("rel_type"), node_id("Country", keys["Country"]).alias("dst")),
        F.struct(F.lit("IN_MONTH").alias("rel_type"), node_id("Month", keys["Month"]).alias("dst")),
        F.struct(F.lit("FOR_ENTITY").alias("rel_type"), ent.alias("dst")),
        F.struct(F.lit("HAS_TARGET").alias("rel_type"), node_id("TargetProxy", keys["TargetProxy"]).alias("dst")),
    )).alias("e")
    r = insp.select(ins.alias("src"), per_row).select("src", "e.dst", "e.rel_type")
    return r.unionByName(m)


def stored_graph(insp: DataFrame) -> Graph:
    """The whole stored graph (all 6 labels, all 8 types), directed as stored."""
    return Graph(build_nodes(insp), build_edges(insp), undirected=False)


def project(g: Graph, labels: Sequence[str] | None = None, rel_types: Sequence[str] | None = None,
            orientation: str | Mapping[str, str] = "undirected", check_endpoints: bool = False) -> Graph:
    """G-B3: keep node labels and relationship types; orientation per type
    (``natural`` / ``reverse`` / ``undirected``).  ``check_endpoints`` drops
    edges whose ends are outside the kept labels (two semi-joins); builders
    here never produce such edges, so it is off by default."""
    nodes = g.nodes if labels is None else g.nodes.where(F.col("label").isin(list(labels)))
    edges = g.edges if rel_types is None else g.edges.where(F.col("rel_type").isin(list(rel_types)))
    if check_endpoints and labels is not None:
        ids = nodes.select(F.col("node_id"))
        edges = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi") \
                     .join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    if isinstance(orientation, str):
        orient = {t: orientation for t in (rel_types or [])}
        default = orientation
    else:
        orient, default = dict(orientation), "natural"

    def oriented(kind: str, e: DataFrame) -> DataFrame:
        fwd = e.select("src", "dst", "rel_type")
        rev = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type")
        return {"natural": fwd, "reverse": rev, "undirected": fwd.unionByName(rev)}[kind]

    kinds = set(orient.values()) | ({default} if not orient else set())
    if len(kinds) == 1:
        out = oriented(kinds.pop(), edges)
    else:
        parts = []
        for kind in sorted(set(orient.values())):
            ts = [t for t, k in orient.items() if k == kind]
            parts.append(oriented(kind, edges.where(F.col("rel_type").isin(ts))))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
    und = isinstance(orientation, str) and orientation == "undirected"
    return Graph(nodes, out, undirected=und)


def pest_projection(insp: DataFrame, exclude_target_edges: bool = False,
                    orientation: str = "undirected") -> Graph:
    """The reference's projection: 5 labels, 4 entity-level types; optionally
    without the outcome edges (leakage guard, T7)."""
    types = [t for t in PROJECTION_TYPES if not (exclude_target_edges and t == "HAS_INSPECTION_RESULT")]
    g = Graph(build_nodes(insp, with_inspections=False), build_edges(insp, with_inspections=False))
    return project(g, PROJECTION_LABELS, types, orientation)


def frozen(g: Graph) -> Graph:
    """The same graph, built once for its many readers."""
    return Graph(cut_lineage(g.nodes), cut_lineage(g.edges), g.undirected)


def adjacency(g: Graph, dedupe: bool = False) -> DataFrame:
    """Undirected neighbour rows (node, nbr).  Graphs built here have no
    parallel edges, so ``dedupe`` (one more shuffle) is only for foreign
    edge tables."""
    e = g.edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr"))
    if not g.undirected:
        e = e.unionByName(g.edges.select(F.col("dst").alias("node"), F.col("src").alias("nbr")))
    e = e.where(F.col("node") != F.col("nbr"))
    return e.distinct() if dedupe else e


def degrees(g: Graph, direction: str = "out", with_isolated: bool = True) -> DataFrame:
    """H-C1 / G-B4: degree per node (``out``, ``in`` or ``both`` for the
    undirected neighbour count); isolated nodes get 0 by a left join.
    The count is a ``groupBy`` with partial aggregation (hub-safe)."""
    if direction == "both":
        a = adjacency(g).groupBy(F.col("node").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    else:
        end = "src" if direction == "out" else "dst"
        a = g.edges.groupBy(F.col(end).alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    if not with_isolated:
        return a
    return g.nodes.select("node_id").join(a, "node_id", "left") \
        .withColumn("degree", F.coalesce(F.col("degree"), F.lit(0)).cast("long"))


def with_degree(g: Graph, insp: DataFrame | None = None) -> DataFrame:
    """G-B4: degree on every node; pest value on outcome nodes."""
    d = degrees(g, "out")
    n = g.nodes.join(d, "node_id", "left")
    return n.withColumn("pest_value", F.when(F.col("label") == "TargetProxy", F.col("key").cast("int")))


def node_counts(g: Graph) -> DataFrame:
    """C-A10: nodes per label."""
    return g.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n_nodes"))


def edge_counts(g: Graph) -> DataFrame:
    """C-A10: relationships per type, descending."""
    return g.edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n_edges")) \
        .orderBy(F.col("n_edges").desc(), F.col("rel_type"))


def density(g: Graph) -> DataFrame:
    """C-A11: n, m and m / (n (n - 1)) (m counts stored relationships; an
    undirected projection counts each edge in both directions)."""
    n = g.nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    m = g.edges.agg(F.count(F.lit(1)).alias("n_edges"))
    nn, mm = n.first()[0], m.first()[0]
    spark = g.nodes.sparkSession
    d = (mm / (nn * (nn - 1))) if nn and nn > 1 else 0.0
    return spark.createDataFrame([(int(nn), int(mm), float(d))], "n_nodes long, n_edges long, density double")


def degree_distribution(g: Graph) -> DataFrame:
    """C-A12: min, mean, max and exact percentiles of out-degree (isolated = 0)."""
    qs = [0.5, 0.75, 0.9, 0.95, 0.99]
    d = cut_lineage(degrees(g, "out").groupBy("degree").agg(F.count(F.lit(1)).alias("nodes")))       # a row per different degree
    found = exact_quantiles(d.select(F.lit("degree").alias("dim"), F.col("degree").alias("x"), F.col("nodes").alias("n")), qs).first()
    pct = [F.lit(v).cast("double").alias(f"p{int(q * 100)}") for q, v in zip(qs, found["q"] if found else [None] * len(qs))]
    return d.agg(F.min("degree").alias("min"), (F.sum(F.col("degree") * F.col("nodes")) / F.sum("nodes")).alias("mean"),
                 F.max("degree").alias("max"), *pct)


def nodes_of(g: Graph, label: str) -> DataFrame:
    """B-F3 / C-D4."""
    return g.nodes.where(F.col("label") == label)


def typed_pairs(g: Graph, rel: str, src_label: str, dst_label: str) -> DataFrame:
    """B-F5 / C-J9: edges of one type between two labels, with node keys."""
    s = g.nodes.where(F.col("label") == src_label).select(F.col("node_id").alias("src"), F.col("key").alias("src_key"))
    d = g.nodes.where(F.col("label") == dst_label).select(F.col("node_id").alias("dst"), F.col("key").alias("dst_key"))
    e = g.edges.where(F.col("rel_type") == rel).select("src", "dst")
    return e.join(s, "src").join(d, "dst")


def entity_outcome_links(g: Graph) -> DataFrame:
    """C-J9: (Entity)-[HAS_INSPECTION_RESULT]->(TargetProxy) as a table.
    The node ids carry the keys (natural keys), so no join with the node
    table is needed."""
    e = g.edges.where(F.col("rel_type") == "HAS_INSPECTION_RESULT")
    return e.select(F.col("src").alias("entity_node_id"), F.col("dst").alias("pest_node_id"),
                    F.substring_index(F.col("src"), ":", -1).cast("long").alias("entity_id"),
                    F.substring_index(F.col("dst"), ":", -1).cast("int").alias("target_value")) \
            .withColumn("target_label", X.target_label("target_value"))
