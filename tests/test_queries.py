"""Registered queries against their DuckDB oracle on sf0.001 (a fast subset;
tools/oracle_check.py runs them all), and invariants of learned ones."""
import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
import __spark_entry__ as E

ORACLE_SUBSET = ["trailing_counts", "graph_nodes", "graph_edges", "edge_counts", "entity_targets",
                 "link_heuristic_scores", "candidate_pairs", "entity_similarity", "risk_distribution",
                 "stratified_split", "roc_auc", "pr_curve", "classification_report", "confusion_matrix",
                 "triangle_count", "k_core", "connected_components", "modularity", "mean_embedding",
                 "standard_scale", "link_train_set", "best_row_per_entity", "missing_counts",
                 "stream_trailing_counts", "link_precision_recall", "sample_neighbors", "pagerank"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def _rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", ORACLE_SUBSET)
def test_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "entity_id"


def test_node_classification_probabilities(spark):
    df = E.queries()["node_classification"](spark, SF_SMALL)
    bad = df.where((F.col("prob_pest") < 0) | (F.col("prob_pest") > 1) |
                   (F.abs(F.col("prob_pest") + F.col("prob_no_pest") - 1) > 1e-9)).count()
    assert bad == 0 and df.count() == df.select("entity_id").distinct().count()


def test_fastrp_shape(spark):
    df = E.queries()["fastrp"](spark, SF_SMALL)
    sizes = {r[0] for r in df.select(F.size("embedding")).distinct().collect()}
    assert sizes == {64}
    assert df.where(F.exists("embedding", lambda x: x.isNull())).count() == 0


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
