"""Known answers on small hand-made graphs (FIXTURES §8)."""
import pytest

from conftest import make_graph
from riskgraph.operators import centrality as C
from riskgraph.operators import community as CO

TRIANGLE = [("a", "b"), ("b", "c"), ("c", "a")]
STAR = [("h", "a"), ("h", "b"), ("h", "c"), ("h", "d")]
PATH = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]
CLIQ = [(x, y) for i, x in enumerate("abcd") for y in "abcd"[i + 1:]] + \
       [(x, y) for i, x in enumerate("efgh") for y in "efgh"[i + 1:]] + [("d", "e")]
K23 = [(x, y) for x in "ab" for y in "cde"]


def as_dict(df, key, col):
    return {r[key]: r[col] for r in df.collect()}


def test_triangle(spark):
    g = make_graph(spark, TRIANGLE)
    t = CO.triangles(g)
    assert as_dict(t, "node_id", "triangle_count") == {"a": 1, "b": 1, "c": 1}
    assert as_dict(t, "node_id", "local_clustering") == {"a": 1.0, "b": 1.0, "c": 1.0}
    assert as_dict(CO.k_core(g), "node_id", "core_value") == {"a": 2, "b": 2, "c": 2}


def test_star_betweenness_closeness(spark):
    g = make_graph(spark, STAR)
    b = as_dict(C.betweenness(g), "node_id", "betweenness")
    assert b["h"] == pytest.approx(6.0) and all(b[x] == 0 for x in "abcd")
    c = as_dict(C.closeness(g), "node_id", "closeness")
    assert c["h"] == pytest.approx(1.0) and c["a"] == pytest.approx(4 / 7)


def test_path(spark):
    g = make_graph(spark, PATH)
    b = as_dict(C.betweenness(g), "node_id", "betweenness")
    assert [b[x] for x in "abcde"] == pytest.approx([0, 3, 4, 3, 0])
    assert set(as_dict(CO.k_core(g), "node_id", "core_value").values()) == {1}


def test_two_cliques(spark):
    g = make_graph(spark, CLIQ)
    core = as_dict(CO.k_core(g), "node_id", "core_value")
    assert set(core.values()) == {3}
    comp = CO.connected_components(g)
    assert CO.component_count(comp).first()[0] == 1
    lv = as_dict(CO.louvain(g), "node_id", "community_id")
    assert len(set(lv.values())) == 2
    assert lv["a"] == lv["b"] == lv["c"] == lv["d"] and lv["e"] == lv["f"] == lv["g"] == lv["h"]
    q = CO.modularity(g, spark.createDataFrame(list(lv.items()), "node_id string, community_id string")).first()[0]
    singletons = spark.createDataFrame([(x, x) for x in "abcdefgh"], "node_id string, community_id string")
    assert q > CO.modularity(g, singletons).first()[0]


def test_bipartite(spark):
    g = make_graph(spark, K23)
    assert set(as_dict(CO.triangles(g), "node_id", "triangle_count").values()) == {0}
    e = as_dict(C.eigenvector(g, 50), "node_id", "eigenvector")
    # A + I iteration converges; both sides keep their symmetry
    assert e["a"] == pytest.approx(e["b"]) and e["c"] == pytest.approx(e["d"]) == pytest.approx(e["e"])


def test_components_isolated(spark):
    g = make_graph(spark, [("a", "b"), ("c", "d")], nodes=["z"])
    comp = CO.connected_components(g)
    assert CO.component_count(comp).first()[0] == 3
    assert as_dict(C.closeness(g), "node_id", "closeness")["z"] == 0.0


def test_pagerank_sums(spark):
    g = make_graph(spark, CLIQ)
    pr = as_dict(C.pagerank(g, 20), "node_id", "pagerank")
    # no dangling nodes: the sum moves from n(1 - d) towards n by a factor d per turn
    assert sum(pr.values()) == pytest.approx(8 - (8 - 8 * 0.15) * 0.85 ** 20, rel=1e-9)
    assert pr["d"] == pytest.approx(pr["e"])


def test_long_path_components_and_core(spark):
    """A path as wide as it is long: components and core numbers have no turn limit."""
    names = [f"n{i:04d}" for i in range(500)]
    g = make_graph(spark, list(zip(names, names[1:])), nodes=["alone"])
    comp = as_dict(CO.connected_components(g), "node_id", "component_id")
    assert comp == {n: "n0000" for n in names} | {"alone": "alone"}
    short = make_graph(spark, list(zip(names[:40], names[1:40])), nodes=["alone"])
    core = as_dict(CO.k_core(short), "node_id", "core_value")
    assert core == {n: 1 for n in names[:40]} | {"alone": 0}


def test_louvain_never_below_start(spark):
    """Two cliques joined by an edge are two communities; modularity is that of the split."""
    a, b = [f"a{i}" for i in range(6)], [f"b{i}" for i in range(6)]
    edges = [(x, y) for grp in (a, b) for i, x in enumerate(grp) for y in grp[i + 1:]] + [("a0", "b0")]
    g = make_graph(spark, edges)
    com = as_dict(CO.louvain(g), "node_id", "community_id")
    assert com == {x: "a0" for x in a} | {x: "b0" for x in b}
