"""FastRP's means: heavy sources broadcast, others joined; sums added up before they are moved."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgraph.operators import embed as EM
from riskgraph.operators import spread as SP

from conftest import make_graph


@pytest.mark.parametrize("heavy", [0, 8, 4096])
def test_means(spark, monkeypatch, heavy):
    """The same means with no, some and all sources heavy; parallel edges count twice; no aggregate sorts vectors."""
    monkeypatch.setattr(SP, "HEAVY", heavy)
    rng = random.Random(3)
    names = [f"n{i:02d}" for i in range(40)]
    edges = [("n00", n) for n in names[1:]] + [tuple(rng.sample(names[1:30], 2)) for _ in range(60)]
    g = make_graph(spark, edges + edges[:3], names)
    x = {n: [rng.gauss(0, 1) for _ in range(3)] for n in names}
    means = SP.MeanVectors(g.edges, 3)
    assert (means.n_heavy == 0) == (heavy == 0) and (means.n_heavy < 40 or heavy > 8)
    out = means.mean(spark.createDataFrame(list(x.items()), "node_id string, h array<double>"), "h")
    got = {r.node_id: r.h for r in out.collect()}
    near = {n: [r.src for r in g.edges.collect() if r.dst == n] for n in names}
    assert set(got) == {n for n in names if near[n]}
    for n, v in got.items():
        assert np.allclose(v, np.mean([x[m] for m in near[n]], axis=0), atol=1e-12)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan and "HashAggregate" in plan


def test_unit_length(spark):
    """The norm is worked out once a vector, not in the lambda for each element; zeros and nulls stay."""
    df = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("c", None)], "k string, v array<double>")
    out = df.select("k", EM.l2_normalize(F.col("v")).alias("u"))
    assert {r.k: r.u for r in out.collect()} == {"a": [0.6, 0.8], "b": [0.0, 0.0], "c": None}
    plan = df.select(EM.l2_normalize(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat(" in plan
