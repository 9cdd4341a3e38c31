"""Node embeddings.

Vectors stay whole as ``array<double>`` (ML ``Vector`` only inside the
aggregations); neighbour means are sums grouped by the receiving node
(partial aggregation).  Edges stay in place, the vectors of heavy sources are
broadcast (``MeanVectors``) and hot sources are salted (``Layout``).
"""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.operators import relational as R
from riskgraph.operators.graph import Graph
from riskgraph.operators.spread import MeanVectors, Spread
from riskgraph.session import cut_lineage, ensure_checkpoint_dir

SEED = 42
BLOCK_NODES = 250_000     # nodes whose vectors one task of node2vec holds


def l2_normalize(arr: Column) -> Column:
    norm = F.sqrt(F.aggregate(arr, F.lit(0.0), lambda s, x: s + x * x))
    # repeated, as a lambda would work out the norm for each element
    return F.when(norm > 0, F.zip_with(arr, F.array_repeat(norm, F.size(arr)), lambda x, n: x / n)).otherwise(arr)


def scale(arr: Column, w: float) -> Column:
    return F.transform(arr, lambda x: x * F.lit(w))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def random_sign_vector(node: Column, dim: int, seed: int = SEED) -> Column:
    """Very sparse random projection row: +sqrt(3) w.p. 1/6, -sqrt(3) w.p.
    1/6, else 0, drawn from md5(seed:node:i)."""
    s3 = math.sqrt(3.0)
    signs = F.array(*[F.lit(x) for x in (s3, -s3, 0.0, 0.0, 0.0, 0.0)])

    def entry(i):
        h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), node, F.lit(":"), i.cast("string"))), 1, 8), 16, 10)
        return F.coalesce(F.element_at(signs, (F.pmod(h.cast("long"), F.lit(6)) + 1).cast("int")), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), entry)


def fastrp(g: Graph, dim: int = 64, weights: tuple[float, ...] = (0.8, 1.0, 1.0, 1.0),
           self_influence: float = 0.0, seed: int = SEED) -> DataFrame:
    """H-E1: FastRP.  H_0 = sparse random vectors; H_i = L2-normalised mean
    of neighbours' H_(i-1); embedding = self_influence * H_0 + sum w_i H_i."""
    means = MeanVectors(g.edges, dim)
    # a node is a few bytes, so the planner would leave all of them, and the drawing of their vectors, to one or two tasks
    tasks = int(g.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = cut_lineage(g.nodes.select("node_id").repartition(tasks, "node_id"))
    zero = F.array_repeat(F.lit(0.0), dim)
    state = nodes.select("node_id", random_sign_vector(F.col("node_id"), dim, seed).alias("h"))
    state = cut_lineage(state.select("node_id", "h", scale(F.col("h"), self_influence).alias("emb")))
    for w in weights:                                       # vector and sum of a node stand in one row: one join a turn
        m = means.mean(state, "h")
        new = state.select("node_id", "emb").join(m, "node_id", "left").select(
            "node_id", "emb", l2_normalize(F.coalesce(F.col("h"), zero)).alias("h"))
        state = cut_lineage(new.select("node_id", "h", add(F.col("emb"), scale(F.col("h"), w)).alias("emb")))
    emb = state.select("node_id", "emb")
    return emb.withColumnRenamed("emb", "embedding")


def indexed_adjacency(g: Graph) -> DataFrame:
    """(node, idx, nbr) with idx = 0..deg-1 in neighbour-id order, plus deg;
    ranks come from the range-partitioned ``class_rank`` (hub-safe)."""
    adj = g.edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr")).distinct()
    ranked = R.class_rank(adj, "node", F.col("nbr"), out="idx")
    deg = adj.groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
    return cut_lineage(ranked.join(deg, "node"))


def random_walks(g: Graph, length: int = 10, per_node: int = 10, seed: int = SEED) -> DataFrame:
    """H-E2: ``per_node`` uniform walks of ``length`` nodes from every node.
    Next hop = neighbour number md5(seed:walk:step) mod deg; one equi-join
    per step on (node, idx), so walkers at a hub spread over its
    neighbours.  Rows: walk_id, step, node_id (a walk stops at a dead end)."""
    adj = indexed_adjacency(g)
    deg = cut_lineage(adj.select(F.col("node").alias("node_id"), "deg").distinct())
    spread = Spread(adj, "node_id", factor=per_node, counts=deg.withColumnRenamed("deg", "n"))     # walkers stand on nodes about as often as edges end there
    starts = g.nodes.select(F.col("node_id").alias("start")) \
        .withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))))
    cur = starts.select(F.concat_ws("#", "start", F.col("r").cast("string")).alias("walk_id"),
                        F.lit(0).alias("step"), F.col("start").alias("node_id"))
    cur = cut_lineage(cur)
    steps = [cur]
    for s in range(1, length):
        c = spread.join(cur, deg, "node_id", ["walk_id"])
        pick = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("walk_id"), F.lit(f":{s}"))), 1, 12),
                             16, 10).cast("long"), F.col("deg"))
        c = c.withColumn("idx", pick).join(adj.select(F.col("node").alias("node_id"), "idx", "nbr"),
                                           ["node_id", "idx"])
        cur = cut_lineage(c.select("walk_id", F.lit(s).alias("step"), F.col("nbr").alias("node_id")))
        steps.append(cur)
    out = steps[0]
    for st in steps[1:]:
        out = out.unionByName(st)
    return out


def walk_pairs(walks: DataFrame, window: int) -> DataFrame:
    """``centre, context, n``: how often two nodes stand within ``window`` steps of a walk.
    A walk is at most ``length`` nodes, so ``collect_list`` per walk is bounded."""
    seqs = walks.groupBy("walk_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step", "node_id"))), lambda s: s["node_id"]).alias("w"))
    at = seqs.select("w", F.posexplode("w").alias("i", "centre"))
    lo = F.greatest(F.col("i") - F.lit(window), F.lit(0))
    near = at.select("centre", "i", lo.alias("lo"), F.expr(f"slice(w, greatest(i - {window}, 0) + 1, least(i, {window}) + 1 + {window})").alias("near"))
    out = near.select("centre", "i", "lo", F.posexplode("near").alias("j", "context")).where("lo + j <> i")
    return out.groupBy("centre", "context").agg(F.count(F.lit(1)).alias("n"))


def _start_vectors(visits: DataFrame, dim: int, seed: int) -> DataFrame:
    """``kind, node, freq, block, vec``: kind 0 centre vectors, drawn from md5(seed:node), kind 1 context vectors, zero."""
    import numpy as np
    import pyarrow as pa
    schema = "kind int, node string, freq long, block int, vec array<float>"

    def run(batches):
        for b in batches:
            node, freq, block, salt = b.columns
            drawn = [((np.random.default_rng(int(s, 16)).random(dim) - 0.5) / dim).astype(np.float32) for s in salt.to_pylist()]
            for kind, vec in ((0, drawn), (1, [np.zeros(dim, np.float32)] * len(drawn))):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(drawn), pa.int32()), node, freq, block, pa.array(vec, pa.list_(pa.float32()))],
                                                 names=["kind", "node", "freq", "block", "vec"])
    salt = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("node"))), 1, 15)
    return visits.select("node", "freq", "block", salt.alias("salt")).mapInArrow(run, schema)


def _skip_gram(rate: float, negatives: int, seed: int, turn: int, batch: int, before: dict[int, int] | None = None, lot: int = 10_000):
    """Task of one turn: a block of centre vectors, a block of context vectors and the pairs between
    them arrive in this order; pairs update both, the vectors go out again.  Pairs are mixed in lots, which end where a
    task's rows, counted from ``before[task]``, are a multiple of ``lot``."""
    import numpy as np
    import pyarrow as pa

    def add_rows(table, at, rows):
        """``np.add.at(table, at, rows)``, cell by cell in the same order: numpy has a quick loop for flat arrays only."""
        dim = table.shape[1]
        np.add.at(table.reshape(-1), (at[..., None] * dim + np.arange(dim)).reshape(-1), rows.reshape(-1))

    def run(batches):
        task, state = None, None

        class Blocks:
            def __init__(self, number):
                self.number, self.rng = number, np.random.default_rng([seed, turn, number])
                self.nodes, self.freq, self.raw, self.block = ([], []), ([], []), ([], []), [None, None]
                self.ready = False
                self.row, self.lot = (before or {}).get(number, 0), ([], [], [])

            def pairs(self, *columns):
                """Keeps pairs until their lot is full."""
                n, at = len(columns[0]), 0
                while at < n:
                    stop = min(n, at + lot - self.row % lot)
                    for held, c in zip(self.lot, columns):
                        held.extend(c[at:stop])
                    self.row, at = self.row + stop - at, stop
                    if self.row % lot == 0:
                        self.end_lot()

            def end_lot(self):
                if self.lot[0]:
                    self.learn(*self.lot)
                    self.lot = ([], [], [])

            def get_ready(self):
                self.vec = [np.array(r, np.float32) for r in self.raw]
                self.at = [{n: i for i, n in enumerate(ns)} for ns in self.nodes]
                share = np.cumsum(np.array(self.freq[1], np.float64) ** 0.75)
                self.share = share / share[-1] if len(share) else share
                self.ready = True

            def learn(self, centre, context, n):
                if not self.ready:
                    self.get_ready()
                c = np.repeat([self.at[0][x] for x in centre], n)
                o = np.repeat([self.at[1][x] for x in context], n)
                mixed = self.rng.permutation(len(c))
                into, out = self.vec
                for k in range(0, len(c), batch):
                    i, j = c[mixed[k:k + batch]], o[mixed[k:k + batch]]
                    neg = np.searchsorted(self.share, self.rng.random((len(i), negatives)), "right")
                    js = np.concatenate([j[:, None], np.minimum(neg, len(out) - 1)], axis=1)
                    v, u = into[i], out[js]
                    pull = rate * (1.0 / (1.0 + np.exp(np.clip(-np.einsum("md,mkd->mk", v, u), -30, 30))))
                    pull[:, 0] -= rate
                    add_rows(into, i, -np.einsum("mk,mkd->md", pull, u))
                    add_rows(out, js, -pull[:, :, None] * v[:, None, :])

            def rows(self):
                self.end_lot()
                if not self.ready:
                    self.get_ready()
                for kind in (0, 1):
                    for at in range(0, len(self.nodes[kind]), 10_000):
                        part = slice(at, at + 10_000)
                        n = len(self.nodes[kind][part])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([kind] * n, pa.int32()), pa.array(self.nodes[kind][part]), pa.array(self.freq[kind][part], pa.int64()),
                             pa.array([self.block[kind]] * n, pa.int32()), pa.array(list(self.vec[kind][part]), pa.list_(pa.float32()))],
                            names=["kind", "node", "freq", "block", "vec"])

        for b in batches:
            key = np.asarray(b.column(0)).astype(np.int64) * 3 + np.asarray(b.column(1))
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else []
            for at, stop in zip(cuts[:-1], cuts[1:]):
                t, kind = divmod(int(key[at]), 3)
                if t != task:
                    if state is not None:
                        yield from state.rows()
                    task, state = t, Blocks(t)
                node, context, n, block, vec = b.slice(at, stop - at).columns[2:]
                if kind < 2:
                    state.nodes[kind].extend(node.to_pylist())
                    state.freq[kind].extend(n.to_pylist())
                    state.raw[kind].extend(vec.to_pylist())
                    state.block[kind] = block[0].as_py()
                    state.row += len(node)
                else:
                    state.pairs(node.to_pylist(), context.to_pylist(), n.to_pylist())
        if state is not None:
            yield from state.rows()
    return run


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """The rows of a turn, those of a task in a partition of their own (hashing tasks would put several into one)."""
    rows = rows.withColumn("_o", F.md5(F.concat_ws(":", "node", "context")))
    return rows.repartitionById(blocks, F.col("task")).sortWithinPartitions("task", "kind", "_o")


def node2vec(walks: DataFrame, dim: int = 64, window: int = 5, seed: int = SEED, blocks: int | None = None,
             epochs: int = 1, rate: float = 0.025, negatives: int = 5, batch: int = 256) -> DataFrame:
    """H-E3: skip-gram with negative sampling over the walks, ``node_id, embedding``.

    Nodes are dealt into ``blocks`` by hash, each with its centre and its context vectors.
    An epoch has a turn for each block: in turn r, task b holds the centre vectors of block b and the
    context vectors of block b + r and learns from the pairs between them, so all blocks learn
    at once, each in a task of its own, and no two tasks touch one block.  Negatives come from the context block at hand (by
    frequency ^ 0.75); over the turns each node meets all blocks.  A task holds two blocks
    (``BLOCK_NODES`` nodes each, unless ``blocks`` is given) and streams its pairs; nothing of the
    size of the nodes is on the driver.  Pairs are counted before they are shuffled, and a table by turn
    lets each turn read its own.  Reruns are equal up to the order of equal pairs' batches, which is fixed by sorting."""
    import uuid
    spark = walks.sparkSession
    visits = cut_lineage(walks.groupBy(F.col("node_id").alias("node")).agg(F.count(F.lit(1)).alias("freq")))
    blocks = blocks or max(8, -(-visits.count() // BLOCK_NODES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    parts = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    vectors = cut_lineage(_start_vectors(visits.withColumn("block", block("node")).repartition(parts, "node"), dim, seed))     # visits are few bytes, their vectors many
    pairs = walk_pairs(walks, window).withColumns({"task": block("centre"), "ob": block("context")})
    pairs = pairs.withColumn("turn", F.pmod(F.col("ob") - F.col("task"), F.lit(blocks)))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pairs-{uuid.uuid4().hex}"
    pairs.repartition("turn", "task").write.partitionBy("turn").parquet(path)
    pairs = spark.read.schema("centre string, context string, n long, task int, ob int, turn int").parquet(path)
    cols = ["task", "kind", "node", "context", "n", "block", "vec"]
    # lots are counted as if tasks were dealt by their hash, whatever partition a task is in; blocks x blocks counts
    lot = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    met_rows = {(x["turn"], x["task"]): x["count"] for x in pairs.groupBy("turn", "task").count().collect()}
    nodes = {x["b"]: x["count"] for x in visits.groupBy(block("node").alias("b")).count().collect()}
    place = [x[0] for x in spark.range(blocks).orderBy("id").select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(blocks))).collect()]
    for turn in range(epochs * blocks):
        r = turn % blocks
        task = F.when(F.col("kind") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - F.lit(r), F.lit(blocks)))
        held = vectors.select(task.cast("int").alias("task"), "kind", "node", F.lit("").alias("context"), F.col("freq").alias("n"), "block", "vec")
        met = pairs.where(F.col("turn") == r).select("task", F.lit(2).alias("kind"), F.col("centre").alias("node"), "context", "n",
                                                     F.lit(None).cast("int").alias("block"), F.lit(None).cast("array<float>").alias("vec"))
        rows = held.select(*cols).unionByName(met.select(*cols))
        rows = _dealt(rows, blocks)
        size = [nodes.get(t, 0) + nodes.get((t + r) % blocks, 0) + met_rows.get((r, t), 0) for t in range(blocks)]
        before = {t: sum(size[u] for u in range(t) if place[u] == place[t]) for t in range(blocks)}
        step = _skip_gram(rate * (1.0 - turn / (epochs * blocks + 1.0)), negatives, seed, turn, batch, before, lot if lot > 0 else 1 << 62)
        vectors = cut_lineage(rows.select(*cols).mapInArrow(step, "kind int, node string, freq long, block int, vec array<float>"))
    return vectors.where("kind = 0").select(F.col("node").alias("node_id"), F.col("vec").cast("array<double>").alias("embedding"))


def sample_neighbors(g: Graph, k: int, seed: int = SEED, hop: int = 1) -> DataFrame:
    """H-E4: per node the k neighbours first in md5(seed:hop:node:nbr) order."""
    adj = g.edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr")).distinct()
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(hop)), F.col("node"), F.col("nbr")))
    return R.top_k_per_key(adj, "node", order, k, out="sample_rank")


def samples(g: Graph, sizes: tuple[int, ...] = (25, 10), seed: int = SEED) -> dict[int, DataFrame]:
    """The sampled neighbours of each hop, drawn once for all that read them."""
    return {hop: cut_lineage(sample_neighbors(g, k, seed, hop)) for hop, k in enumerate(sizes, start=1)}


def sage_aggregate(g: Graph, features: DataFrame, sizes: tuple[int, ...] = (25, 10),
                   agg: str = "mean", seed: int = SEED, col: str = "features", drawn: dict[int, DataFrame] | None = None) -> DataFrame:
    """H-E5: per hop, h(v) <- concat(h(v), agg of h over v's sampled
    neighbours) with mean or max pooling; nodes without neighbours get
    zeros for the neighbour half.  ``drawn``: the :func:`samples` of the same sizes and seed, if there are some."""
    h = cut_lineage(features.select("node_id", F.col(col).alias("h")))
    for hop, k in enumerate(sizes, start=1):
        s = (drawn[hop] if drawn else sample_neighbors(g, k, seed, hop)).select(F.col("node").alias("node_id"), F.col("nbr").alias("src"))
        j = s.join(h.select(F.col("node_id").alias("src"), array_to_vector("h").alias("_v")), "src")
        fn = Summarizer.mean if agg == "mean" else Summarizer.max
        m = j.groupBy("node_id").agg(vector_to_array(fn(F.col("_v"))).alias("_m"))
        width = F.size(F.col("h"))
        h = cut_lineage(h.join(m, "node_id", "left").select(
            "node_id", F.concat(F.col("h"), F.coalesce(F.col("_m"), F.array_repeat(F.lit(0.0), width))).alias("h")))
    return h.withColumnRenamed("h", col)


def seeded_projection(dim_in: int, dim_out: int, seed: int = SEED) -> list[list[float]]:
    """A dim_in x dim_out Gaussian matrix from a seeded generator (model
    parameters, not data: size is fixed by the two dimensions)."""
    import numpy as np
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((dim_in, dim_out)) / math.sqrt(dim_in)).tolist()


def graphsage_embeddings(g: Graph, features: DataFrame, dim: int = 64, sizes: tuple[int, ...] = (25, 10),
                         seed: int = SEED, col: str = "features") -> DataFrame:
    """H-E6 step 1 (untrained forward pass): sampled mean aggregation per
    hop (H-E5), then a seeded linear projection to ``dim``, ReLU and L2
    normalisation.  No gradient training is done here."""
    h = sage_aggregate(g, features, sizes, "mean", seed, col)
    dim_in = h.select(F.size(col)).first()[0]
    W = seeded_projection(dim_in, dim, seed)
    long = h.select("node_id", F.posexplode(col).alias("i", "x"))
    wdf = h.sparkSession.createDataFrame([(i, W[i]) for i in range(dim_in)], "i int, w array<double>")
    proj = long.join(F.broadcast(wdf), "i").select("node_id", F.transform("w", lambda y: y * F.col("x")).alias("p"))
    summed = proj.groupBy("node_id").agg(vector_to_array(Summarizer.sum(array_to_vector("p"))).alias("e"))
    return summed.select("node_id", l2_normalize(F.transform("e", lambda x: F.greatest(x, F.lit(0.0))))
                         .alias("embedding"))


def node_features(g: Graph, extra: DataFrame | None = None) -> DataFrame:
    """Numeric feature vector per node: [log1p(degree)] (+ extra columns)."""
    from riskgraph.operators.graph import degrees
    d = degrees(g, "out").select("node_id", F.array(F.log1p(F.col("degree").cast("double"))).alias("features"))
    if extra is not None:
        cols = [c for c in extra.columns if c != "node_id"]
        d = d.join(extra, "node_id", "left").select(
            "node_id", F.concat("features", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                                                      for c in cols])).alias("features"))
    return d


def extract_embeddings(g: Graph, method: str, dim: int = 64, seed: int = SEED,
                       entity_label: str = "Entity") -> DataFrame:
    """H-E8: embeddings by method name for entity nodes; unknown -> error."""
    if method == "fastrp":
        e = fastrp(g, dim=dim, seed=seed)
    elif method == "node2vec":
        e = node2vec(random_walks(g, 10, 10, seed), dim=dim, seed=seed)
    else:
        raise ValueError(f"unknown embedding method {method!r}")
    ents = g.nodes.where(F.col("label") == entity_label).select("node_id", "key")
    return ents.join(e, "node_id", "left")


