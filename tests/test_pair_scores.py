"""Scores of pairs with few second ends, and their maxima."""
import datetime as dt

from pyspark.sql import functions as F

from riskgraph.operators import graph as G
from riskgraph.operators import linkpred as L
from riskgraph.plans import q_link


def counted(monkeypatch, module, name):
    """The calls of ``module.name`` from here on."""
    calls, plain = [], getattr(module, name)

    def run(*args, **kw):
        calls.append((args, kw))
        return plain(*args, **kw)
    monkeypatch.setattr(module, name, run)
    return calls


def insp(spark, rows):
    return spark.createDataFrame(rows, "inspection_id long, enty_id long, ctry_code string, month int, insp_day int, target_proxy int")


def test_scores_for_few_second_ends_equal_the_plain_ones(spark, monkeypatch):
    rows = [(k, k % 6, "AB"[k % 2], k % 3 + 1, k, int(k % 4 == 0)) for k in range(40)]
    g = G.stored_graph(insp(spark, rows + rows[:5]))                          # repeated rows: parallel edges
    adj, pairs = G.adjacency(g), L.candidate_pairs(g).select("entity_node_id", "pest_node_id")
    outs = L.outcome_nodes(g).select("pest_node_id").distinct()
    calls = counted(monkeypatch, L, "node_degrees")
    few = L.pair_scores(adj, pairs, "entity_node_id", "pest_node_id", b_nodes=outs).orderBy("entity_node_id", "pest_node_id").collect()
    assert not calls                                                          # degrees and ends come from one look
    plain = L.pair_scores(adj, pairs, "entity_node_id", "pest_node_id").orderBy("entity_node_id", "pest_node_id").collect()
    assert len(few) == len(plain) == 12
    for x, y in zip(few, plain):
        assert x[:3] == y[:3] and all(abs(a - b) < 1e-9 for a, b in zip(x[2:], y[2:]))
    assert any(x.common_neighbors_count > 1 for x in few)


def test_link_features_look_at_edges_into_outcomes_only(spark, monkeypatch):
    rows = [(k, k % 6, "AB"[k % 2], k % 3 + 1, k, int(k % 4 == 0)) for k in range(40)]
    g = G.stored_graph(insp(spark, rows))
    calls = counted(monkeypatch, L, "pair_scores")
    L.link_features(g, L.candidate_pairs(g).select("entity_node_id", "pest_node_id")).collect()
    assert calls[0][1]["b_nodes"].count() == 2


def test_normalised_scores_read_kept_scores(spark, monkeypatch, tmp_path):
    calls = counted(monkeypatch, q_link.R, "max_normalize")
    orders = [(k, k % 6, dt.date(2024, k % 3 + 1, k % 27 + 1), "1-URGENT" if k % 4 == 0 else "5-LOW", "F") for k in range(40)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(6)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "A"), (1, "B")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    out = q_link.q_max_normalize(spark, str(tmp_path))
    assert "Scan parquet" not in calls[0][0][0]._jdf.queryExecution().toString()
    best = out.agg(*[F.max(c) for c in out.columns[2:]]).first()
    assert list(best) == [1.0] * 4
