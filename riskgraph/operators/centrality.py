"""Centralities as DataFrame iterations.

Message passing (:class:`Propagator`) is the core: values sit on nodes,
each turn every edge carries its source's value to its destination, and
the destination aggregates (sum / min / max).  Edges are laid out once,
bucketed by source with hot sources salted (``operators.spread``), so a
turn moves values and partial sums but no edge.  The receiving side is a
``groupBy`` with partial aggregation, so a hub destination costs one row
per map task.  State is checkpointed (reliable, in
``spark.checkpoint.dir``) every few turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.operators.graph import Graph
from riskgraph.operators.reach import distance_sums
from riskgraph.operators.spread import Layout
from riskgraph.session import Loop, cut_lineage

DAMPING = 0.85
ITERATIONS = 20


class Propagator:
    """Messages along edges (src, dst, w) that stay where they are (:class:`Layout`)."""

    def __init__(self, edges: DataFrame, rows: int | None = None):
        self.layout = Layout(edges, rows)
        self.n_hubs = self.layout.spread.n_hubs

    def push(self, values: DataFrame, cols: list[str], agg: str = "sum",
             weighted: bool = True, every_node: DataFrame | None = None) -> DataFrame:
        """Per destination: agg over incoming edges of (w *) source value.
        With ``every_node`` (node_id) each listed node also receives a
        neutral message (0 for sum), so nodes without in-edges get a row from
        the same aggregation instead of a separate left join."""
        fn = {"sum": F.sum, "min": F.min, "max": F.max}[agg]
        msgs = self.layout.join(values.select("node_id", *cols)).select(
            F.col("dst"), *[(F.col(c) * F.col("w") if weighted else F.col(c)).alias(c) for c in cols])
        if every_node is not None:
            if agg != "sum":
                raise ValueError("every_node needs agg='sum'")
            msgs = msgs.unionByName(every_node.select(F.col("node_id").alias("dst"), *[F.lit(0.0).alias(c) for c in cols]))
        return msgs.groupBy(F.col("dst").alias("node_id")).agg(*[fn(F.col(c)).alias(c) for c in cols])


def rank_scores(g: Graph, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """H-C2, H-C3 and H-C4 in one set of turns: ``node_id, degree, pagerank, article_rank, eigenvector``.

    All three push a value along each edge, so each turn pushes three columns over the kept edges.  A loop
    of weight 0 at each node hands on its degree and, as A + I asks, its eigenvector entry; so a turn is one
    join and one aggregation, without a second look at the state.
    The eigenvector is brought to length 1 at every cut and at the end; in between it only grows by a factor."""
    nodes = cut_lineage(g.nodes.select("node_id").join(out_degree(g), "node_id", "left")
                        .select("node_id", F.coalesce("out_degree", F.lit(0)).cast("long").alias("degree")))
    n, m = nodes.agg(F.count(F.lit(1)), F.sum("degree")).first()
    loops = nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(0.0).alias("w"))
    layout = Layout(g.edges.select("src", "dst", F.lit(1.0).alias("w")).unionByName(loops))
    base, mean = 1.0 - damping, m / n if n else 0.0
    state = nodes.select("node_id", "degree", F.lit(base).alias("p"), F.lit(base).alias("a"), F.lit(1.0).alias("x"))

    def unit(df):
        norm = df.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        return df.withColumn("x", F.col("x") / F.lit(norm))
    for turn in range(1, iterations + 1):
        share = F.greatest("degree", F.lit(1))          # a node without edges sends nothing
        sent = state.select("node_id", "degree", (F.col("p") / share).alias("p"), (F.col("a") / (share + F.lit(mean))).alias("a"), "x")
        heard = layout.join(sent).groupBy(F.col("dst").alias("node_id")).agg(
            F.sum(F.when(F.col("w") == 0, F.col("degree"))).alias("degree"), F.sum(F.col("p") * F.col("w")).alias("p"),
            F.sum(F.col("a") * F.col("w")).alias("a"), F.sum("x").alias("x"))
        state = heard.select("node_id", "degree", (F.lit(base) + F.lit(damping) * F.col("p")).alias("p"),
                             (F.lit(base) + F.lit(damping) * F.col("a")).alias("a"), "x")
        if turn % 4 == 0 or turn == iterations:
            state = unit(cut_lineage(state))
    return state.select("node_id", "degree", F.col("p").alias("pagerank"), F.col("a").alias("article_rank"), F.col("x").alias("eigenvector"))


def out_degree(g: Graph) -> DataFrame:
    return g.edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree"))


def _rank_iteration(g: Graph, denominator_extra: float, damping: float, iterations: int,
                    tol: float | None, out: str) -> DataFrame:
    od = out_degree(g)
    e = g.edges.join(od.withColumnRenamed("node_id", "src"), "src") \
        .select("src", "dst", (1.0 / (F.col("out_degree") + F.lit(denominator_extra))).alias("w"))
    prop = Propagator(e)
    nodes = cut_lineage(g.nodes.select("node_id"))
    base = 1.0 - damping
    ranks = nodes.withColumn("r", F.lit(base))
    loop = Loop(every=4)
    for _ in range(iterations):
        c = prop.push(ranks, ["r"], every_node=nodes)
        new = c.select("node_id", (F.lit(base) + F.lit(damping) * F.col("r")).alias("r"))
        if tol is not None:
            new = cut_lineage(new)
            delta = new.join(ranks.withColumnRenamed("r", "_o"), "node_id") \
                .agg(F.max(F.abs(F.col("r") - F.col("_o")))).first()[0]
            ranks = new
            if delta is not None and delta < tol:
                break
        else:
            ranks = loop.step(new)
    return ranks.withColumnRenamed("r", out)


def pagerank(g: Graph, iterations: int = ITERATIONS, damping: float = DAMPING,
             tol: float | None = None) -> DataFrame:
    """H-C2: r0 = 1 - d; r <- (1 - d) + d * sum over in-edges r(u) / out(u)."""
    return _rank_iteration(g, 0.0, damping, iterations, tol, "pagerank")


def article_rank(g: Graph, iterations: int = ITERATIONS, damping: float = DAMPING,
                 tol: float | None = None) -> DataFrame:
    """H-C3: as PageRank with out(u) + mean out-degree in the denominator."""
    n = g.nodes.count()
    m = g.edges.count()
    avg = m / n if n else 0.0
    return _rank_iteration(g, avg, damping, iterations, tol, "article_rank")


def eigenvector(g: Graph, iterations: int = ITERATIONS) -> DataFrame:
    """H-C4: power iteration on (A + I) (plain A oscillates on a bipartite
    graph), L2-normalised each turn; the norm is one scalar aggregate."""
    prop = Propagator(g.edges.select("src", "dst"))
    nodes = cut_lineage(g.nodes.select("node_id"))
    x = nodes.withColumn("x", F.lit(1.0))
    loop = Loop(every=4)
    for _ in range(iterations):
        c = prop.push(x, ["x"])
        y = x.join(c.withColumnRenamed("x", "_s"), "node_id", "left") \
            .select("node_id", (F.col("x") + F.coalesce(F.col("_s"), F.lit(0.0))).alias("x"))
        y = cut_lineage(y)
        norm = y.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        x = loop.step(y.select("node_id", (F.col("x") / F.lit(norm)).alias("x")))
    return x.withColumnRenamed("x", "eigenvector")


def _dense_index(nodes: DataFrame) -> DataFrame:
    """``node_id, _i``: nodes numbered from 0 in the order of their ids."""
    from riskgraph.operators.relational import class_rank
    return cut_lineage(class_rank(nodes.select("node_id").withColumn("_g", F.lit(0)), "_g", "node_id", out="_i").drop("_g"))


def _bfs_batches(g: Graph, batch_size: int):
    """Yield (sources frame) batches: every node is a source exactly once.
    Batches are contiguous ranges of a dense node index, so the BFS state of
    one batch is bounded by batch_size x n."""
    idx = _dense_index(g.nodes)
    n = idx.count()
    for start in range(0, n, batch_size):
        yield idx.where((F.col("_i") >= start) & (F.col("_i") < start + batch_size)).select(
            F.col("node_id").alias("source"))


def closeness(g: Graph, batch_size: int = 2000, max_depth: int | None = None) -> DataFrame:
    """H-C5: closeness = r / (sum of distances to the r nodes reached), 0
    for a node reaching nothing.  Exact BFS between all nodes in batches of
    targets (:func:`reach.distance_sums`).  Work is edges x nodes / 64 words -
    quadratic by the definition - but the state held at once is
    batch_size bits a node."""
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    nodes = g.nodes.select("node_id").unionByName(ends).where(F.col("node_id").isNotNull()).distinct()
    sums = distance_sums(_dense_index(nodes), g.edges, batch_size, max_depth)
    return g.nodes.select("node_id").join(sums, "node_id", "left").select(
        "node_id", F.when(F.col("d") > 0, F.col("r") / F.col("d")).otherwise(0.0).alias("closeness"))


def betweenness(g: Graph, batch_size: int = 1000, undirected: bool = True) -> DataFrame:
    """H-C6: Brandes.  Forward: BFS levels with shortest-path counts sigma
    per (source, node).  Backward: from the deepest level, dependency
    delta(v) = sum over children w of sigma(v)/sigma(w) * (1 + delta(w)).
    Sum of delta over sources; halved for an undirected graph."""
    adj = cut_lineage(g.edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr")).distinct())
    parts = []
    for src in _bfs_batches(g, batch_size):
        level = cut_lineage(src.select("source", F.col("source").alias("node"), F.lit(1.0).alias("sigma")))
        levels = [level]
        visited = level.select("source", "node")
        while True:
            nxt = levels[-1].join(adj, "node").groupBy("source", F.col("nbr").alias("node")) \
                .agg(F.sum("sigma").alias("sigma"))
            nxt = cut_lineage(nxt.join(visited, ["source", "node"], "left_anti"))
            if nxt.isEmpty():
                break
            levels.append(nxt)
            visited = cut_lineage(visited.unionByName(nxt.select("source", "node")))
        delta = None  # (source, node, delta) of the level below
        for d in range(len(levels) - 1, 0, -1):
            parent, child = levels[d - 1], levels[d]
            ch = child.withColumnRenamed("node", "w").withColumnRenamed("sigma", "sw")
            if delta is not None:
                ch = ch.join(delta.withColumnRenamed("node", "w"), ["source", "w"], "left")
            else:
                ch = ch.withColumn("delta", F.lit(0.0))
            edges_pc = parent.join(adj, "node").withColumnRenamed("nbr", "w")
            contrib = edges_pc.join(ch, ["source", "w"]).groupBy("source", "node").agg(
                F.sum(F.col("sigma") / F.col("sw") * (1.0 + F.coalesce(F.col("delta"), F.lit(0.0)))).alias("delta"))
            delta = cut_lineage(contrib)
            parts.append(delta.where(F.col("source") != F.col("node")).select("node", "delta"))
    if parts:
        tot = parts[0]
        for p in parts[1:]:
            tot = tot.unionByName(p)
        tot = tot.groupBy(F.col("node").alias("node_id")).agg(F.sum("delta").alias("_b"))
    else:
        tot = g.nodes.select("node_id").withColumn("_b", F.lit(0.0)).limit(0)
    scale = 0.5 if undirected else 1.0
    return g.nodes.select("node_id").join(tot, "node_id", "left").select(
        "node_id", (F.coalesce(F.col("_b"), F.lit(0.0)) * scale).alias("betweenness"))
