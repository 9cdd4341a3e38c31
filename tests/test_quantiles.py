"""Quantiles of many columns against numpy."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgraph.functions import expr as X
from riskgraph.operators import models as MD
from riskgraph.operators import quantiles as Q


@pytest.fixture(scope="module")
def frame(spark):
    random.seed(9)
    rows = [(i, random.gauss(0, 1), float(random.randint(0, 3)), None if i % 3 else random.random(), None, 7.0) for i in range(997)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double"), rows


def test_column_quantiles(frame):
    df, rows = frame
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = Q.column_quantiles(df, ["a", "b", "c", "d", "e"], ps)
    assert set(got) == {"a", "b", "c", "e"}
    for i, name in ((1, "a"), (2, "b"), (3, "c"), (5, "e")):
        assert np.allclose(got[name], np.quantile([r[i] for r in rows if r[i] is not None], ps))


def test_hot_value_and_partitions(spark):
    """One column of one hot value beside a column of different ones, over many partitions; counted input gives the same."""
    x = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.lit("all")).alias("dim"),
                                 F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("x"))
    rows = {r.dim: (r.n, r.q) for r in Q.exact_quantiles(x, [0.5, 0.9], partitions=7).collect()}
    others = [i for i in range(3000) if i % 3]
    assert rows["hot"] == (1000, [5.0, 5.0]) and rows["all"][0] == 2000 and np.allclose(rows["all"][1], np.quantile(others, [0.5, 0.9]))
    counted = x.groupBy("dim", "x").agg(F.count("*").alias("n"))
    assert {r.dim: (r.n, r.q) for r in Q.exact_quantiles(counted, [0.5, 0.9]).collect()} == rows
    assert Q.exact_quantiles(x.where("false"), [0.5]).collect() == []


def test_fill_median_and_scalers(spark, frame):
    df, rows = frame
    filled = X.fill_median(df, ["a", "c", "d"]).collect()
    mid = np.median([r[3] for r in rows if r[3] is not None])
    assert all(abs(r.c - (mid if o[3] is None else o[3])) < 1e-12 and r.d is None for r, o in zip(sorted(filled), sorted(rows)))
    v = df.select(F.array("a", "b", "e").alias("features"))
    m, s = MD.fit_robust_scaler(v)
    a, b = (np.array([r[i] for r in rows]) for i in (1, 2))
    assert np.allclose(m, [np.median(a), np.median(b), 7.0])
    assert np.allclose(s, [np.subtract(*np.quantile(a, [0.75, 0.25])), np.subtract(*np.quantile(b, [0.75, 0.25])), 1.0])
    m, s = MD.fit_standard_scaler(v)
    assert np.allclose(m, [a.mean(), b.mean(), 7.0]) and np.allclose(s, [a.std(), b.std(), 1.0])
