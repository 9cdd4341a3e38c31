"""Louvain, structural features and the choice of a model."""
import random

from pyspark.sql import functions as F

from riskgraph.operators import centrality as C
from riskgraph.operators import community as CO
from riskgraph.operators import models as MD
from riskgraph.operators import structure as ST

from conftest import make_graph


def grouped(spark, groups=5, size=12, seed=4):
    rng = random.Random(seed)
    names = [f"g{c}_{i:02d}" for c in range(groups) for i in range(size)]
    edges = {tuple(sorted(rng.sample([n for n in names if n.startswith(f"g{c}_")], 2))) for c in range(groups) for _ in range(5 * size)}
    edges |= {(f"g{c}_00", f"g{c + 1}_01") for c in range(groups - 1)}
    return make_graph(spark, sorted(edges), names + ["alone"]), names


def test_louvain(spark):
    """A valid partition, well above the start, the planted groups, the same on a rerun."""
    g, names = grouped(spark)
    got = {r.node_id: r.community_id for r in CO.louvain(g).collect()}
    assert set(got) == set(names) | {"alone"} and got["alone"] == "alone"
    for c in set(got.values()):
        assert c == min(n for n in got if got[n] == c)
    assert len({got[n] for n in names}) == 5 and all(got[n] == got[n[:2] + "_00"] for n in names)
    frame = lambda d: spark.createDataFrame(list(d.items()), "node_id string, community_id string")
    q = lambda d: CO.modularity(g, frame(d)).first()[0]
    assert q(got) > q({n: n for n in got}) + 0.5
    assert {r.node_id: r.community_id for r in CO.louvain(g).collect()} == got
    empty = make_graph(spark, [("a", "b")], ["a", "b"])
    assert {r.community_id for r in CO.louvain(type(g)(g.nodes.limit(3), g.edges.where("false"), True)).collect()} == {r.node_id for r in g.nodes.limit(3).collect()}
    assert len({r.community_id for r in CO.louvain(empty).collect()}) == 1


def test_structural_features(spark):
    g, names = grouped(spark)
    f = {r.node_id: r for r in ST.structural_features(g, "N", communities=True).collect()}
    assert set(f) == set(names) | {"alone"}
    pr = {r.node_id: r.pagerank for r in C.pagerank(g, 20).collect()}
    ar = {r.node_id: r.article_rank for r in C.article_rank(g, 20).collect()}
    ev = {r.node_id: r.eigenvector for r in C.eigenvector(g, 20).collect()}
    for n, r in f.items():
        assert abs(r.pagerank - pr[n]) < 1e-9 and abs(r.article_rank - ar[n]) < 1e-9 and abs(r.eigenvector - ev[n]) < 1e-9
    assert f["alone"].degree == 0 and f["alone"].community_size == 1 and f["alone"].core_value == 0


def test_choose_model_keeps_test_rows_out(spark):
    """The better model by folds is taken; other labels or features of test rows change neither the choice nor the folds."""
    rng = random.Random(6)
    rows = []
    for i in range(240):
        x = [rng.gauss(0, 1), rng.gauss(0, 1)]
        y = int(x[0] * x[1] > 0)                     # no line tells it, trees do
        rows.append((i, x, y, i % 5 == 0, y))
    schema = "entity_id long, features array<double>, label int, is_test boolean, stratum int"
    models = {"lr": MD.classifier("lr"), "dt": MD.classifier("dt", maxDepth=6)}
    pred, report = MD.choose_model(spark.createDataFrame(rows, schema), models, 3)
    r = {x.model: x for x in report.collect()}
    assert r["dt"].chosen and not r["lr"].chosen and r["dt"].held_out > 0.8 and pred.count() == 240
    twisted = [(i, x, 1 - y if t else y, t, s) for i, x, y, t, s in rows]
    pred2, report2 = MD.choose_model(spark.createDataFrame(twisted, schema), models, 3)
    r2 = {x.model: x for x in report2.collect()}
    assert r2["dt"].cv_mean == r["dt"].cv_mean and r2["lr"].cv_mean == r["lr"].cv_mean and r2["dt"].held_out < 0.2
    a, b = ({x.entity_id: x.score for x in p.select("entity_id", "score").collect()} for p in (pred, pred2))
    assert a == b


def test_default_penalty():
    assert MD.with_penalty(MD.classifier("lr"), 50).getRegParam() == 1 / 50
    assert MD.with_penalty(MD.classifier("lr", regParam=0.1), 50).getRegParam() == 0.1
    assert not MD.with_penalty(MD.classifier("rf"), 50).hasParam("regParam")
