"""Closeness by bits: distances of a directed graph in several batches and blocks, and rows held."""

import random

from riskgraph.operators import centrality as C
from riskgraph.operators import reach
from riskgraph.operators.graph import Graph


def _graph(spark, n, edges):
    return Graph(spark.createDataFrame([(f"N:{i}", "X", str(i)) for i in range(n)], "node_id string, label string, key string"),
                 spark.createDataFrame([(f"N:{a}", f"N:{b}", "R") for a, b in edges], "src string, dst string, rel_type string"))


def _closeness(n, edges, max_depth=None):
    out = {}
    for s in range(n):
        dist, level = {s: 0}, [s]
        while level and (max_depth is None or dist[level[0]] < max_depth):
            level = sorted({b for a, b in edges if a in set(level)} - set(dist))
            dist.update({v: max(dist.values()) + 1 for v in level})
        total = sum(dist.values())
        out[f"N:{s}"] = (len(dist) - 1) / total if total else 0.0
    return out


def test_directed_closeness_in_batches(spark, monkeypatch):
    rng = random.Random(7)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(120)] + [(0, i) for i in range(30, 50)] + [(i, 1) for i in range(40)]
    edges += edges[:20] + [(5, 5)]
    monkeypatch.setattr(reach, "BLOCK_NODES", 3)             # many blocks: several of them in a task
    for batch, depth in ((35, None), (1000, 2)):
        got = {r["node_id"]: r["closeness"] for r in C.closeness(_graph(spark, n, edges), batch, depth).collect()}
        want = _closeness(n, edges, depth)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want), (batch, depth)


def test_rows_held_follow_the_edges_not_the_pairs(spark, monkeypatch):
    n, hubs = 400, 4
    edges = [e for i in range(hubs, n) for h in range(hubs) for e in ((i, h), (h, i)) if (i + h) % 3]
    held = []
    for module in (C, reach):
        def cut(df, cut_lineage=module.cut_lineage):
            done = cut_lineage(df)
            held.append(done.count())
            return done
        monkeypatch.setattr(module, "cut_lineage", cut)
    C.closeness(_graph(spark, n, edges), n).collect()
    assert max(held) < 2 * len(edges) < n * n / 10


def test_null_neighbours_count_once_a_distance(spark):
    g = _graph(spark, 4, [(0, 1), (1, 2), (2, 3)])
    nowhere = spark.createDataFrame([("N:0", None, "R"), ("N:2", None, "R"), (None, "N:3", "R")], g.edges.schema)
    got = {r["node_id"]: r["closeness"] for r in C.closeness(Graph(g.nodes, g.edges.unionByName(nowhere)), 3).collect()}
    assert got == {"N:0": 5 / (1 + 2 + 3 + 1 + 3), "N:1": 3 / (1 + 2 + 2), "N:2": 2 / (1 + 1), "N:3": 0.0}
