"""The link model: its vectors, folds and test split have an effect."""
from pyspark.sql import functions as F

from riskgraph.operators import graph as G
from riskgraph.operators import linkpred as L


def stored(spark, n=40):
    rows = [(i, i % n, "ABC"[i % n % 3], i % 5 + 1, i // n, int(i % n % 4 == 0 and i >= n)) for i in range(2 * n)]
    insp = spark.createDataFrame(rows, "inspection_id long, enty_id long, ctry_code string, month int, insp_day int, target_proxy int")
    return G.frozen(G.stored_graph(insp))


def test_vectors_of_linked_nodes(spark):
    """Entities and outcomes of the directed stored graph have vectors, so the cosine tells pairs apart."""
    g = stored(spark)
    vec = L.link_vectors(g)
    assert vec.where("node_id like 'E:%'").where(~F.exists("embedding", lambda x: x != 0)).count() == 0
    f = L.link_features(g, L.link_train_set(g), vec)
    assert f.select("cosine_similarity").distinct().count() > 2


def test_folds_and_test_split_are_scored(spark):
    """The figures come from the folds and the test rows; other labels of test rows change the latter alone."""
    g = stored(spark)
    out = L.link_model_predictions(g, L.link_train_set(g))
    r = out.first()
    assert 0.0 <= r.validation_roc_auc <= 1.0 and 0.0 <= r.test_roc_auc <= 1.0
    assert out.count() == 30 and out.select("entity_id").distinct().count() == 30      # each entity without a pest link
    rows = [(i, [float(i % 2), float(i % 7)], i % 2 if s != "test" else 1 - i % 2, s, i % 3) for i, s in
            ((i, ("train", "test", "feature")[i % 4 % 3]) for i in range(80))]
    schema = "entity_node_id long, features array<double>, label int, split string, fold int"
    _, _, validated, tested = L.fit_link_model(spark.createDataFrame(rows, schema))
    assert validated == 1.0 and tested == 0.0
    few = spark.createDataFrame([r for r in rows if r[3] == "train" and r[4] != 1], schema)
    assert L.fit_link_model(few)[2:] == (None, None)
