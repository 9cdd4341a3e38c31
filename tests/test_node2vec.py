"""Skip-gram in rotating blocks."""
import random

import numpy as np
from pyspark.sql import functions as F

from riskgraph.operators import embed as EM

from conftest import make_graph


def test_walk_pairs(spark):
    walks = spark.createDataFrame([("w", i, n) for i, n in enumerate("abcab")] + [("v", 0, "z")], "walk_id string, step int, node_id string")
    got = {(r.centre, r.context): r.n for r in EM.walk_pairs(walks, 2).collect()}
    w, expected = "abcab", {}
    for i, c in enumerate(w):
        for j in range(max(0, i - 2), min(len(w), i + 3)):
            if i != j:
                expected[c, w[j]] = expected.get((c, w[j]), 0) + 1
    assert got == expected


def test_node2vec(spark):
    """Nodes of a group come closer than nodes of different groups; every walked node has a vector; reruns and blocks."""
    rng = random.Random(3)
    names = [f"n{c}_{i}" for c in range(4) for i in range(15)]
    edges = sorted({tuple(sorted(rng.sample([n for n in names if n.startswith(f"n{c}_")], 2))) for c in range(4) for _ in range(60)})
    edges += [(f"n{c}_0", f"n{(c + 1) % 4}_1") for c in range(4)]
    walks = EM.random_walks(make_graph(spark, edges, names + ["alone"]), 10, 10, 42)
    got = EM.node2vec(walks, dim=16, blocks=3, epochs=8, rate=0.05, batch=32)
    z = {r.node_id: np.array(r.embedding) for r in got.collect()}
    assert set(z) == set(names) | {"alone"} and all(v.shape == (16,) and np.isfinite(v).all() for v in z.values())
    unit = {k: v / np.linalg.norm(v) for k, v in z.items()}
    inside = [unit[a] @ unit[b] for a in names for b in names if a < b and a[1] == b[1]]
    outside = [unit[a] @ unit[b] for a in names for b in names if a < b and a[1] != b[1]]
    assert np.mean(inside) > np.mean(outside) + 0.3
    again = EM.node2vec(walks, dim=16, blocks=3, epochs=8, rate=0.05, batch=32)
    assert all(np.array_equal(z[r.node_id], np.array(r.embedding)) for r in again.collect())
    assert EM.node2vec(walks.where("false"), dim=4, blocks=2).count() == 0
    assert got.select(F.countDistinct("node_id")).first()[0] == len(names) + 1


def test_turn_is_dealt_to_all_tasks(spark):
    """Each task of a turn has a partition of its own, in the order blocks, then pairs."""
    rows = spark.range(600).selectExpr("cast(id % 12 as int) as task", "cast(id % 5 % 3 as int) as kind", "concat('n', id) as node", "'' as context")
    got = EM._dealt(rows, 12).select("task", "kind", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("o")).collect()
    assert len({(r.task, r.p) for r in got}) == len({r.p for r in got}) == 12
    for t in range(12):
        kinds = [r.kind for r in sorted(got, key=lambda r: r.o) if r.task == t]
        assert kinds == sorted(kinds) and len(kinds) == 50


def test_skip_gram_sums_repeated_nodes():
    """A turn's moves of a node that comes repeatedly in a mini-batch all count, as ``np.add.at`` has them."""
    import pyarrow as pa
    names = ["task", "kind", "node", "context", "n", "block", "vec"]
    vecs = np.random.default_rng(5).random((2, 3, 4)).astype(np.float32)

    def rows(kind, node, context, n, block, vec):
        m = len(node)
        return pa.RecordBatch.from_arrays([pa.array([7] * m, pa.int32()), pa.array([kind] * m, pa.int32()), pa.array(node), pa.array(context), pa.array(n, pa.int64()),
                                           pa.array([block] * m, pa.int32()), pa.array(vec, pa.list_(pa.float32()))], names=names)
    none = [None] * 3
    batches = [rows(k, list("abc"), [""] * 3, [2, 3, 1], 0, list(vecs[k])) for k in (0, 1)] + [rows(2, list("aab"), list("bca"), [3, 1, 2], None, none)]
    got = {k: np.array(b.column(4).to_pylist(), np.float32) for b in EM._skip_gram(0.1, 2, 42, 1, 4)(iter(batches)) for k in (b.column(0)[0].as_py(),)}
    into, out = vecs[0].copy(), vecs[1].copy()
    rng = np.random.default_rng([42, 1, 7])
    c, o = np.repeat([0, 0, 1], [3, 1, 2]), np.repeat([1, 2, 0], [3, 1, 2])
    share = np.cumsum(np.array([2.0, 3, 1]) ** 0.75)
    mixed = rng.permutation(6)
    for k in (0, 4):
        i, j = c[mixed[k:k + 4]], o[mixed[k:k + 4]]
        js = np.concatenate([j[:, None], np.searchsorted(share / share[-1], rng.random((len(i), 2)), "right")], axis=1)
        v, u = into[i].copy(), out[js].copy()
        pull = 0.1 / (1.0 + np.exp(-np.einsum("md,mkd->mk", v, u)))
        pull[:, 0] -= 0.1
        np.add.at(into, i, -np.einsum("mk,mkd->md", pull, u))
        np.add.at(out, js, -pull[:, :, None] * v[:, None, :])
    assert np.allclose(got[0], into, atol=1e-6) and np.allclose(got[1], out, atol=1e-6)
