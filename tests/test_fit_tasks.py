"""Fits that use all tasks; states and inputs without needless steps."""
import hashlib
import math

from pyspark.sql import functions as F

from riskgraph.operators import embed as EM
from riskgraph.operators import models as MD
from riskgraph.operators.graph import Graph
from riskgraph.plans import q_models
from conftest import make_graph
from test_pair_scores import counted, insp


def test_fits_use_more_than_one_task(spark):
    df = spark.range(9_000).select(F.col("id").alias("entity_id")).coalesce(1)
    out = MD.dealt(df)
    tasks = min(3, spark.sparkContext.defaultParallelism)
    assert out.rdd.getNumPartitions() == tasks and out.distinct().count() == 9_000
    assert out.rdd.glom().collect() == MD.dealt(df).rdd.glom().collect()
    small = df.limit(4_000)
    assert MD.dealt(small) is small


def test_fastrp_writes_one_state_a_turn(spark, monkeypatch):
    g = make_graph(spark, [("a", "b"), ("b", "c"), ("c", "d")], ["z"])
    calls = counted(monkeypatch, EM, "cut_lineage")
    got = {r.node_id: r.embedding for r in EM.fastrp(g, 8, (0.5, 1.0), self_influence=0.25).collect()}
    assert len(calls) == 2 + 2                                                # nodes, first state, a state for each weight
    h0 = {r.node_id: r.h for r in g.nodes.select("node_id", EM.random_sign_vector(F.col("node_id"), 8).alias("h")).collect()}
    near = {"a": "b", "b": "ac", "c": "bd", "d": "c", "z": ""}

    def turn(h):
        out = {}
        for n, ns in near.items():
            m = [sum(h[x][i] for x in ns) / max(len(ns), 1) for i in range(8)]
            size = sum(x * x for x in m) ** 0.5
            out[n] = [x / size for x in m] if size else m
        return out
    h1 = turn(h0)
    h2 = turn(h1)
    for n in near:
        assert all(abs(g_ - (0.25 * a + 0.5 * b + c)) < 1e-9 for g_, a, b, c in zip(got[n], h0[n], h1[n], h2[n]))


def test_fastrp_draws_vectors_in_all_tasks(spark, monkeypatch):
    g = make_graph(spark, [(f"n{i}", f"n{i + 1}") for i in range(60)])
    calls = counted(monkeypatch, EM, "cut_lineage")
    EM.fastrp(Graph(g.nodes.coalesce(1), g.edges), 4, (1.0,))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks > 1 and all(args[0].rdd.getNumPartitions() == tasks for args, _ in calls[:2])


def test_random_sign_vectors_stay_as_they_are(spark):
    drawn = spark.createDataFrame([(f"E:{i}",) for i in range(50)] + [(None,)], "node_id string").select("node_id", EM.random_sign_vector(F.col("node_id"), 6).alias("h")).collect()
    for node, h in drawn:
        for i, x in enumerate(h):
            r = 2 if node is None else int(hashlib.md5(f"42:{node}:{i}".encode()).hexdigest()[:8], 16) % 6
            assert x == {0: math.sqrt(3.0), 1: -math.sqrt(3.0)}.get(r, 0.0)


def test_graphsage_inputs_take_no_counters(spark, monkeypatch):
    asked = []

    def inspections(spark_, sf, with_counters=True):
        asked.append(with_counters)
        base = insp(spark, [(k, k % 6, "AB"[k % 2], k % 3 + 1, k, int(k % 4 == 0)) for k in range(40)] + [(99, 50, "A", None, None, 0)])
        return base
    monkeypatch.setattr(q_models.FX, "inspections", inspections)
    _, _, d = q_models._sage_inputs(spark, "")
    assert asked == [False]
    assert sorted(r.entity_id for r in d.collect()) == list(range(6))        # a row without a day is left out, as before
