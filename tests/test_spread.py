"""Salted joins and kept layouts: a star spreads, results stay, edges don't move."""
import random
import re

import pytest
from pyspark.sql import functions as F

from riskgraph.operators import centrality as C
from riskgraph.operators import community as CO
from riskgraph.operators import embed as EM
from riskgraph.operators import linkpred as L
from riskgraph.operators import spread as SP
from riskgraph.operators.graph import Graph

from conftest import make_graph

LEAVES = 100_000


@pytest.fixture(scope="module")
def star(spark):
    """A hub with 100,000 leaves, both directions."""
    leaf = F.concat(F.lit("l"), F.col("id").cast("string"))
    out = spark.range(LEAVES).select(F.lit("hub").alias("src"), leaf.alias("dst"))
    return out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("rel_type", F.lit("R"))


def parts(df, keys, n=8):
    """Rows of each task if ``df`` is dealt by ``keys``."""
    return [r["n"] for r in df.repartition(n, *keys).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


def test_a_star_spreads(star):
    sp = SP.Spread(star, "src")
    assert sp.n_hubs == 1
    dealt = parts(sp.many(star, "src", ["dst"]), ["src", SP.SALT])
    assert len(dealt) == 8 and max(dealt) < 0.35 * 2 * LEAVES and sum(dealt) == 2 * LEAVES
    assert max(parts(star, ["src"])) > 0.5 * 2 * LEAVES                      # without salts
    one = sp.one(star.select("src").distinct(), "src")
    assert one.where("src = 'hub'").count() >= 8 and one.count() == LEAVES + one.where("src = 'hub'").count()


def test_joins_of_a_star_are_whole(spark, star):
    sp = SP.Spread(star, "src")
    values = spark.createDataFrame([("hub", 1), ("l5", 2), ("none", 3)], "src string, v int")
    for how in ("inner", "left"):
        got = sp.join(star, values, "src", ["dst"], how=how).groupBy("src", "v").count().where("v is not null").collect()
        assert {(r.src, r.v, r["count"]) for r in got} == {("hub", 1, LEAVES), ("l5", 2, 1)}
    assert sp.join(star, values, "src", ["dst"], how="left").count() == 2 * LEAVES


def test_edges_stay_in_place(spark, star):
    """A turn exchanges values and messages; the edge table is read where it lies."""
    e = star.select("src", "dst")
    nodes = e.select(F.col("src").alias("node_id")).distinct().withColumn("x", F.lit(1.0))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows, hubs in ((None, 1), (10 ** 9, 0)):
            prop = C.Propagator(e, rows=rows)
            assert prop.n_hubs == hubs
            turn = prop.push(nodes, ["x"])
            plan = turn._jdf.queryExecution().executedPlan().toString()
            above = plan[:plan.index("FileScan parquet")].splitlines()
            depth = len(re.match(r"[ :+|*-]*", above[-1]).group(0)) if above else 0
            # climb from the scan to the join: no exchange on the way
            path = []
            for line in reversed(above):
                d = len(re.match(r"[ :+|*-]*", line).group(0))
                if d <= depth:
                    path.append(line)
                    depth = d
                if "Join" in line:
                    break
            assert "Join" in path[-1] and not any("Exchange" in x for x in path), plan
            got = {r.node_id: r.x for r in turn.where("node_id in ('hub', 'l7')").collect()}
            assert got == {"hub": LEAVES, "l7": 1.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def hub_graph(spark):
    rng = random.Random(5)
    names = [f"n{i:02d}" for i in range(60)]
    edges = {("n00", n) for n in names[1:]} | {("n01", n) for n in names[2:40]}
    edges |= {tuple(sorted(rng.sample(names, 2))) for _ in range(150)}
    return make_graph(spark, sorted(edges), names)


def results(spark, g):
    comm = g.nodes.select("node_id", (F.substring("node_id", 2, 2).cast("int") % 4).alias("community_id"))
    adj = g.edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr")).distinct()
    pairs = adj.where("node < nbr").select(F.col("node").alias("a"), F.col("nbr").alias("b"))
    ents = g.nodes.withColumn("label", F.lit("Entity"))
    frames = {
        "pagerank": C.pagerank(g, 5), "eigenvector": C.eigenvector(g, 5), "triangles": CO.triangles(g), "core": CO.k_core(g),
        "modularity": CO.modularity(g, comm), "pairs": L.pair_scores(adj, pairs), "fastrp": EM.fastrp(g, 4, (1.0, 1.0)),
        "walks": EM.random_walks(g, 4, 2), "affinity": L.entity_pest_affinity(Graph(ents, g.edges, True), ents.where("node_id < 'n10'")),
    }

    def flat(v):
        return tuple(round(x, 8) for x in v) if isinstance(v, list) else round(v, 8) if isinstance(v, float) else v
    return {k: sorted(tuple(flat(v) for v in r) for r in df.select(*sorted(df.columns)).collect()) for k, df in frames.items()}


def test_salted_operators_equal_plain_ones(spark, monkeypatch):
    plain = results(spark, hub_graph(spark))

    # every key with more than 5 rows is a hub now
    init = SP.Spread.__init__
    monkeypatch.setattr(SP.Spread, "__init__", lambda self, many, key, rows=None, factor=1, counts=None: init(self, many, key, 5, factor, counts))
    seen = []
    join = SP.Spread.join
    monkeypatch.setattr(SP.Spread, "join", lambda self, *a, **k: seen.append(self.n_hubs) or join(self, *a, **k))
    salted = results(spark, hub_graph(spark))
    assert seen and all(n > 0 for n in seen)
    for k in plain:
        assert plain[k] == salted[k], k
