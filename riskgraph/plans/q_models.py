"""Registered queries: scalers, model jobs, link model, scoring, cold start
(§2.M, §2.L L-8..L-11).  Learned results are checked by rows and invariants
(tests/); scalers and the link training set have exact SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.functions import expr as X
from riskgraph.operators import centrality as C
from riskgraph.operators import graph as G
from riskgraph.operators import linkpred as L
from riskgraph.operators import metrics as M
from riskgraph.operators import models as MD
from riskgraph.operators import sage as SG
from riskgraph.operators import structure as ST
from riskgraph.operators import relational as R
from riskgraph.plans import sql as S
from riskgraph.plans.registry import query
from riskgraph.session import cut_lineage, ensure_checkpoint_dir
from riskgraph.sources import fixtures as FX

_SPLIT = """ranked AS (
  SELECT vec_id AS entity_id, embedding, CAST(label >= 5 AS INTEGER) AS y,
         row_number() OVER (PARTITION BY CAST(label >= 5 AS INTEGER)
                            ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)) || ':' || CAST(vec_id AS VARCHAR)) - 1 AS rk,
         count(*) OVER (PARTITION BY CAST(label >= 5 AS INTEGER)) AS n
  FROM embeddings),
split AS (SELECT *, rk < ceil(n * 0.2) AS is_test FROM ranked)"""


def _split(spark, sf):
    v = FX.embedding_vectors(spark, sf)
    return R.stratified_split(v, "label", "entity_id", 0.2, 42)


def _scale_sql(kind: str) -> str:
    if kind == "standard":
        stats = ", ".join(f"avg(CAST(embedding[{i + 1}] AS DOUBLE)) AS m{i}, "
                          f"CASE WHEN stddev_pop(CAST(embedding[{i + 1}] AS DOUBLE)) > 0 "
                          f"THEN stddev_pop(CAST(embedding[{i + 1}] AS DOUBLE)) ELSE 1.0 END AS s{i}" for i in range(64))
    else:
        stats = ", ".join(f"quantile_cont(CAST(embedding[{i + 1}] AS DOUBLE), 0.5) AS m{i}, "
                          f"CASE WHEN quantile_cont(CAST(embedding[{i + 1}] AS DOUBLE), 0.75) - "
                          f"quantile_cont(CAST(embedding[{i + 1}] AS DOUBLE), 0.25) <> 0 THEN "
                          f"quantile_cont(CAST(embedding[{i + 1}] AS DOUBLE), 0.75) - "
                          f"quantile_cont(CAST(embedding[{i + 1}] AS DOUBLE), 0.25) ELSE 1.0 END AS s{i}"
                          for i in range(64))
    arr = ", ".join(f"(CAST(embedding[{i + 1}] AS DOUBLE) - m{i}) / s{i}" for i in range(64))
    return S.with_(_SPLIT, f"st AS (SELECT {stats} FROM split WHERE NOT is_test)") + \
        f"SELECT entity_id, [{arr}] AS features FROM split CROSS JOIN st"


@query("standard_scale", sql=_scale_sql("standard"))
def q_standard_scale(spark, sf):
    """M-F1: (x - mean) / population std, fitted on the training rows."""
    s = _split(spark, sf)
    m, sd = MD.fit_standard_scaler(s.where(~F.col("is_test")))
    return MD.apply_scaler(s, m, sd).select("entity_id", "features")


@query("robust_scale", sql=_scale_sql("robust"))
def q_robust_scale(spark, sf):
    """M-F2: (x - median) / IQR, fitted on the training rows (exact percentiles)."""
    s = _split(spark, sf)
    m, sd = MD.fit_robust_scaler(s.where(~F.col("is_test")))
    return MD.apply_scaler(s, m, sd).select("entity_id", "features")


def _scaled_split(spark, sf):
    s = _split(spark, sf)
    m, sd = MD.fit_standard_scaler(s.where(~F.col("is_test")))
    s = cut_lineage(MD.dealt(MD.apply_scaler(s, m, sd)))
    return s.where(~F.col("is_test")), s.where(F.col("is_test"))


@query("model_comparison")
def q_model_comparison(spark, sf):
    """M-V10 / M-T1..T4, T6, T7, T10: every model on one split, one metrics row each."""
    train, test = _scaled_split(spark, sf)
    return MD.compare_models(train, test)


@query("leaderboard")
def q_leaderboard(spark, sf):
    """C-O4: top 5 models by ROC AUC from the comparison."""
    train, test = _scaled_split(spark, sf)
    return R.leaderboard(MD.compare_models(train, test).where(F.col("error").isNull()), "roc_auc", "model", 5)


@query("cross_validate")
def q_cross_validate(spark, sf):
    """M-V1: 5-fold ROC AUC mean and std of logistic regression."""
    train, _ = _scaled_split(spark, sf)
    return MD.cross_validate(MD.classifier("lr"), train, 5, "areaUnderROC")


@query("grid_search")
def q_grid_search(spark, sf):
    """M-V2: logistic-regression grid (16 settings) x 5 folds, F1 per setting."""
    train, _ = _scaled_split(spark, sf)
    grid = {"regParam": [0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.25, 0.5, 1.0]}
    return MD.grid_search("lr", grid, train, 5)


@query("feature_importance")
def q_feature_importance(spark, sf):
    """M-V8: random-forest importances with names and groups, sorted."""
    train, _ = _scaled_split(spark, sf)
    model = MD.classifier("rf", 64).fit(MD.with_vector(train))
    names = [f"embed_{i:02d}" for i in range(64)]
    return M.feature_importance(spark, model.featureImportances.toArray().tolist(), names,
                                M.feature_groups(names))


def _holdout(spark, sf):
    v = FX.embedding_vectors(spark, sf)
    ranked = R.class_rank(v.withColumn("_g", F.lit(0)), "_g",
                          F.concat(X.seeded_order("entity_id"), F.lit(":"), F.col("entity_id").cast("string")))
    n = v.count()
    return cut_lineage(ranked.withColumn("is_holdout", F.col("class_rank") >= F.lit(int(n * 0.8))).drop("_g"))


@query("holdout_evaluation")
def q_holdout(spark, sf):
    """M-V11: fit on the non-holdout rows, score the md5-holdout fifth;
    metrics on both and the train-minus-holdout AUC gap."""
    h = _holdout(spark, sf)
    train, hold = h.where(~F.col("is_holdout")), h.where(F.col("is_holdout"))
    est = MD.classifier("rf", 64, numTrees=100, maxDepth=10)
    p_train = MD.fit_score(est, train, train)
    p_hold = MD.fit_score(est, train, hold)
    a_tr = M.roc_auc(p_train, "label", "score").first()["roc_auc"]
    a_ho = M.roc_auc(p_hold, "label", "score").first()["roc_auc"]
    m = M.binary_metrics(p_hold, "label", "prediction").first()
    return spark.createDataFrame([(float(m["accuracy"]), float(m["f1"]), float(a_tr), float(a_ho),
                                   float(a_tr - a_ho))],
                                 "accuracy double, f1 double, train_auc double, holdout_auc double, auc_gap double")


@query("classification_report_model")
def q_class_report_model(spark, sf):
    """M-V6 / M-V9 on model output: report and confusion of the RF holdout predictions."""
    h = _holdout(spark, sf)
    p = MD.fit_score(MD.classifier("rf", 64), h.where(~F.col("is_holdout")), h.where(F.col("is_holdout")))
    return M.classification_report(p, "label", "prediction")


@query("flatten_report")
def q_flatten_report(spark, sf):
    """B-P19 / A-W2: model metrics flattened to (section, metric, value), 4 places, written as JSON."""
    train, test = _scaled_split(spark, sf)
    p = MD.fit_score(MD.classifier("lr"), train, test)
    bm = M.binary_metrics(p, "label", "prediction")
    long = bm.unpivot([], bm.columns, "metric", "value").select(
        F.lit("test_metrics").alias("section"), "metric", F.round("value", 4).alias("value"))
    from riskgraph.sources.sinks import write_report
    write_report(long, ensure_checkpoint_dir(spark).rstrip("/") + "/training_report")
    return long


_COUNTERS = ["total_inspections", "exams_90d", "exams_1yr", "pests_1yr"]


def _entity_features(spark, sf, communities=False, fastrp_dim=0):
    """Per entity: structural features of the projection (target edges excluded, T7), inspection counters and,
    on request, Louvain community size and FastRP; label and rate from C-A2; the test fifth of each class marked."""
    from riskgraph.operators import embed as EM
    base = FX.inspections(spark, sf, with_counters=False)
    g = G.pest_projection(base, exclude_target_edges=True)
    g = G.Graph(cut_lineage(g.nodes), cut_lineage(g.edges), g.undirected)
    f = ST.structural_features(g, communities=communities)
    names = ST.COLUMNS + (["community_size"] if communities else []) + _COUNTERS
    stats = FX.inspections(spark, sf).groupBy(F.col("enty_id").alias("entity_id")).agg(
        F.count(F.lit(1)).alias("total_inspections"), F.avg("enty_exams_90d").alias("exams_90d"),
        F.avg("enty_exams_1yr").alias("exams_1yr"), F.avg("enty_pests_1yr").alias("pests_1yr"))
    tgt = R.entity_targets_by_inspection(base).select("entity_id", "has_pest", "pest_rate")
    f = f.withColumn("entity_id", F.col("key").cast("long")).join(stats, "entity_id").join(tgt, "entity_id")
    feats = F.array(*[F.col(c).cast("double") for c in names])
    if fastrp_dim:
        f = f.join(EM.fastrp(g, fastrp_dim, (1.0, 1.0, 1.0)), "node_id")
        feats = F.concat(feats, "embedding")
    f = f.select("entity_id", feats.alias("features"), F.col("has_pest").alias("label"), "pest_rate", F.col("has_pest").alias("stratum"))
    return cut_lineage(R.stratified_split(cut_lineage(f), "label", "entity_id", 0.2, 42))


def _classify(f):
    nf = len(f.select("features").first()[0])
    return MD.choose_model(f, {"logistic_regression": MD.classifier("lr"), "random_forest": MD.classifier("rf", nf)}, 3)


def _regress(f):
    return MD.choose_model(f.withColumn("label", F.col("pest_rate")), {"linear_regression": MD.regressor("lin"), "random_forest": MD.regressor("rf")},
                           3, regression=True)


@query("node_classification")
def q_node_classification(spark, sf):
    """M-P1: structural features and counters -> stratified split .2 -> logistic regression and random
    forest in 3 folds, the better one refitted -> class, both probabilities, three-band risk, actual class."""
    p, _ = _classify(_entity_features(spark, sf))
    return p.select("entity_id", F.col("prediction").alias("predicted_pest_class"),
                    (1.0 - F.col("score")).alias("prob_no_pest"), F.col("score").alias("prob_pest"),
                    F.col("label").alias("actual_pest_class"),
                    X.risk_band("score", "three").alias("pest_risk_category"), "is_test")


@query("node_regression")
def q_node_regression(spark, sf):
    """M-P2: the same features -> split .2 -> linear regression (penalty 1) and random forest in 3 folds of the
    pest rate -> clip -> thresholds .5/.3/.2 -> five-band risk."""
    p, _ = _regress(_entity_features(spark, sf))
    sc = X.clip("prediction")
    return p.select("entity_id", sc.alias("predicted_pest_score"), F.col("pest_rate").alias("actual_pest_score"),
                    X.threshold(sc, 0.5).alias("predicted_pest_binary_05"),
                    X.threshold(sc, 0.3).alias("predicted_pest_binary_03"),
                    X.threshold(sc, 0.2).alias("predicted_pest_binary_02"),
                    X.risk_band(sc, "five").alias("pest_risk_category"),
                    X.threshold("pest_rate", 0.0, strict=True).alias("actual_pest_binary"), "is_test")


@query("ml_combined")
def q_ml_combined(spark, sf):
    """M-P3: 12 features (with Louvain) and FastRP (32) -> classification and regression, each the better of two
    models by 3 folds, merged by a full outer join, with actuals, bands and thresholds."""
    f = _entity_features(spark, sf, communities=True, fastrp_dim=32)
    c = _classify(f)[0].select("entity_id", F.col("prediction").alias("ml_predicted_class"),
                               (1.0 - F.col("score")).alias("ml_prob_no_pest"), F.col("score").alias("ml_prob_pest"))
    r = _regress(f)[0].select("entity_id", X.clip("prediction").alias("ml_predicted_score"))
    merged = R.merge_predictions(c, r, "entity_id")
    act = f.select("entity_id", F.col("label").alias("actual_pest_binary"), F.col("pest_rate").alias("actual_pest_rate"), "is_test")
    out = R.attach_actuals(merged, act, "entity_id")
    return out.withColumns({"ml_pest_risk_category": X.risk_band("ml_predicted_score", "five"),
                            "ml_score_binary_05": X.threshold("ml_predicted_score", 0.5),
                            "ml_score_binary_03": X.threshold("ml_predicted_score", 0.3)})


@query("entity_model_report")
def q_entity_model_report(spark, sf):
    """M-P1, M-P2 / M-V1: per task and model the 3-fold mean and deviation, which one was taken, and its metric on the held-out fifth."""
    f = _entity_features(spark, sf)
    return _classify(f)[1].withColumn("task", F.lit("classification")).unionByName(_regress(f)[1].withColumn("task", F.lit("regression")))


_LINK_SAMPLES = S.with_(S.BASE, S.NODES, S.MERGED_EDGES, S.LINKS) + """,
ents AS (SELECT DISTINCT entity_node_id FROM links),
outs AS (SELECT node_id AS pest_node_id FROM nodes WHERE label = 'TargetProxy'),
neg AS (SELECT e.entity_node_id, o.pest_node_id FROM ents e CROSS JOIN outs o
        WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.entity_node_id = e.entity_node_id AND l.pest_node_id = o.pest_node_id)),
negr AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || entity_node_id || '|' || pest_node_id)) - 1 AS rk FROM neg),
samples AS (SELECT entity_node_id, pest_node_id, 1 AS label FROM links
            UNION ALL SELECT entity_node_id, pest_node_id, 0 FROM negr WHERE rk < (SELECT count(*) FROM links)),
sr AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || entity_node_id || '|' || pest_node_id)) - 1 AS rk,
              count(*) OVER (PARTITION BY label) AS n FROM samples)
SELECT entity_node_id, pest_node_id, label,
       CASE WHEN rk < ceil(n * 0.2) THEN 'test' WHEN rk < ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.6) THEN 'train'
            ELSE 'feature' END AS split,
       CAST(rk % 3 AS INTEGER) AS fold
FROM sr"""


def link_samples(spark, sf):
    g = G.stored_graph(FX.inspections(spark, sf, with_counters=False))
    g = G.Graph(g.nodes, cut_lineage(g.edges), g.undirected)  # many readers; built once
    return g, L.link_train_set(g)


@query("link_train_set", sql=_LINK_SAMPLES)
def q_link_train_set(spark, sf):
    """L-8: linked pairs + as many unlinked pairs (md5 order); per class .2
    test, .6 of the rest train, the remainder for features; 3 folds."""
    return link_samples(spark, sf)[1]


@query("link_predictions")
def q_link_predictions(spark, sf):
    """L-9..L-11: pair features (four heuristics + cosine of FastRP vectors)
    -> logistic regression, validated in 3 folds and on the test split -> top
    10,000 pest-outcome pairs -> threshold -> actuals -> best row per entity."""
    g, samples = link_samples(spark, sf)
    return L.link_model_predictions(g, samples, top_n=10_000, threshold=0.5)


@query("fill_missing_embeddings")
def q_fill_missing(spark, sf):
    """M-C1..M-C3 / B-P12 / B-P16 / C-U1: train 64 random forests (100 trees)
    on complete rows, predict the embedding of rows missing one, stack both."""
    c = FX.cold_start_table(spark, sf)
    c = X.columns_to_embedding(c, "fastrp_", "embedding")
    known = c.where(~X.has_missing("embedding"))
    new = c.where(X.has_missing("embedding"))
    cats = {col: X.one_hot_categories(known, col) for col in ("category", "feature_3")}
    enc = lambda df: X.one_hot_drop_first(X.one_hot_drop_first(df, "category", cats["category"]),
                                          "feature_3", cats["feature_3"])
    feats = ["feature_1", "feature_2"] + [f"category_{v}" for v in cats["category"][1:]] + \
        [f"feature_3_{v}" for v in cats["feature_3"][1:]]
    fitted = MD.cold_start_fit(enc(known), feats, "embedding", num_trees=100)
    filled = MD.cold_start_predict(fitted, enc(new), feats, "enty_id")
    out = known.select("enty_id", "embedding", F.lit(False).alias("imputed")) \
        .unionByName(filled.withColumn("imputed", F.lit(True)))
    return out


@query("score_new_entities")
def q_score_new(spark, sf):
    """M-S1 / A-S5: save the trained model, load it and score the test rows as new entities."""
    from pyspark.ml import Pipeline, PipelineModel
    train, test = _scaled_split(spark, sf)
    path = ensure_checkpoint_dir(spark).rstrip("/") + "/models/best_model"
    Pipeline(stages=[MD.classifier("rf", 64)]).fit(MD.with_vector(train)).write().overwrite().save(path)
    model = PipelineModel.load(path)
    p = model.transform(MD.with_vector(test))
    return p.select(F.col("entity_id"), F.col("prediction").cast("int").alias("pest_prediction"),
                    MD.vector_to_array("probability")[1].alias("pest_probability"))


def _rf_lr_gbt(train, test):
    return {n: MD.fit_score(MD.classifier(k, 64, **kw), train, test).select("entity_id", "score", "prediction")
            for n, (k, kw) in {"rf": ("rf", {}), "gb": ("gbt", {}), "lr": ("lr", {})}.items()}


@query("voting")
def q_voting(spark, sf):
    """M-T11: soft (mean probability) and hard (vote share) voting of RF, GBT and LR."""
    train, test = _scaled_split(spark, sf)
    preds = _rf_lr_gbt(train, test)
    soft = MD.vote(preds, how="soft").select("entity_id", F.col("score").alias("soft_score"),
                                            F.col("prediction").alias("soft_prediction"))
    hard = MD.vote(preds, how="hard").select("entity_id", F.col("score").alias("hard_share"),
                                            F.col("prediction").alias("hard_prediction"))
    return soft.join(hard, "entity_id").join(test.select("entity_id", "label"), "entity_id")


@query("stacking")
def q_stacking(spark, sf):
    """M-T12: 3-fold out-of-fold RF / GBT / LR probabilities feed a logistic regression."""
    train, test = _scaled_split(spark, sf)
    return MD.stack(train, test, {"rf": ("rf", {}), "gb": ("gbt", {}), "lr": ("lr", {})}, k=3)


@query("adaboost")
def q_adaboost(spark, sf):
    """M-T5: SAMME AdaBoost with 50 depth-1 trees."""
    train, test = _scaled_split(spark, sf)
    return MD.adaboost(train, test, rounds=50)


@query("linear_discriminant")
def q_lda(spark, sf):
    """M-T8: linear discriminant analysis (pooled covariance)."""
    train, test = _scaled_split(spark, sf)
    return MD.discriminant(train, test, "lda")


@query("quadratic_discriminant")
def q_qda(spark, sf):
    """M-T8: quadratic discriminant analysis (per-class covariance)."""
    train, test = _scaled_split(spark, sf)
    return MD.discriminant(train, test, "qda")


def _sage_parts(spark, sf):
    from riskgraph.operators import embed as EM
    # no counter is read here; a row that has no day has none, and is left out
    i = FX.inspections(spark, sf, with_counters=False).where("enty_id IS NOT NULL AND insp_day IS NOT NULL")
    g = G.frozen(G.pest_projection(i, exclude_target_edges=True))
    feats = cut_lineage(EM.node_features(g, C.pagerank(g, 20)))       # many readers, built once; so are the samples
    drawn = EM.samples(g, (25, 10))
    agg = EM.sage_aggregate(g, feats, (25, 10), "mean", drawn=drawn)
    tgt = R.entity_targets_by_inspection(i).select(
        F.concat(F.lit("E:"), F.col("entity_id").cast("string")).alias("node_id"), "entity_id",
        F.col("has_pest").alias("label"), "pest_rate", "total_inspections")
    return g, feats, cut_lineage(agg.join(tgt, "node_id")), drawn


def _sage_inputs(spark, sf):
    return _sage_parts(spark, sf)[:3]


def _sage_split(spark, sf):
    g, feats, d, drawn = _sage_parts(spark, sf)
    s = R.stratified_split(d, "label", "entity_id", 0.2, 42)
    return g, feats, cut_lineage(s.select("node_id", "entity_id", "label", "is_test", "pest_rate", "total_inspections")), drawn


def _sage_classes(p):
    return p.select("entity_id", F.col("prediction").alias("graphsage_predicted_class"),
                    (1.0 - F.col("score")).alias("graphsage_prob_no_pest"),
                    F.col("score").alias("graphsage_prob_pest"), F.col("label").alias("actual_pest_class"),
                    X.risk_band("score", "five").alias("graphsage_risk_category"))


@query("graphsage_classify")
def q_sage_classify(spark, sf):
    """H-E7 small: mean aggregation, 64 dimensions, 50 epochs, trained through both aggregations on a
    stratified split of [degree, PageRank] features; class and both probabilities for every entity."""
    g, feats, s, drawn = _sage_split(spark, sf)
    return _sage_classes(SG.train_classifier(g, feats, s, SG.SMALL, keep=("entity_id",), fields=SG.prepare(g, feats, SG.SMALL, drawn))[1])


@query("graphsage_classify_pool")
def q_sage_classify_pool(spark, sf):
    """H-E7 medium: max-pooling over a learned layer, 128 dimensions, 100 epochs."""
    g, feats, s, drawn = _sage_split(spark, sf)
    return _sage_classes(SG.train_classifier(g, feats, s, SG.MEDIUM, keep=("entity_id",), fields=SG.prepare(g, feats, SG.MEDIUM, drawn))[1])


@query("graphsage_classify_simple")
def q_sage_classify_simple(spark, sf):
    """H-E7 simple: mean aggregation, 32 dimensions, 20 epochs."""
    g, feats, s, drawn = _sage_split(spark, sf)
    return _sage_classes(SG.train_classifier(g, feats, s, SG.SIMPLE, keep=("entity_id",), fields=SG.prepare(g, feats, SG.SIMPLE, drawn))[1])


@query("graphsage_aggregate_then_learn")
def q_sage_aggregate_then_learn(spark, sf):
    """H-E5 + an MLP head: 2-hop sampled mean features first, then 64 hidden units for 50
    iterations; the untrained-aggregation counterpart of ``graphsage_classify``."""
    _, _, d = _sage_inputs(spark, sf)
    s = R.stratified_split(d, "label", "entity_id", 0.2, 42)
    m, sd = MD.fit_standard_scaler(s.where(~F.col("is_test")))
    s = cut_lineage(MD.dealt(MD.apply_scaler(s, m, sd)))
    nf = s.select(F.size("features")).first()[0]
    return _sage_classes(MD.fit_score(MD.classifier("mlp", nf, layers=[64], maxIter=50), s.where(~F.col("is_test")), s))


@query("graphsage_trained_embeddings")
def q_sage_trained_embeddings(spark, sf):
    """H-E6: unsupervised training (co-occurrence loss, 64 dimensions, 20 epochs); an embedding per node."""
    g, feats, _, drawn = _sage_parts(spark, sf)
    return SG.train_embeddings(g, feats, fields=SG.prepare(g, feats, SG.EMBEDDING, drawn))[1]


@query("graphsage_feature_table")
def q_sage_features(spark, sf):
    """M-P5: trained GraphSAGE embedding (64 dims) per entity with
    has_pest_ever and pest_rate, in the wide graphsage_dim_i layout."""
    g, feats, d, drawn = _sage_parts(spark, sf)
    e = SG.train_embeddings(g, feats, fields=SG.prepare(g, feats, SG.EMBEDDING, drawn))[1]
    t = d.select("node_id", "entity_id", F.col("label").alias("has_pest_ever"), "pest_rate")
    return X.embedding_to_columns(t.join(e, "node_id"), "embedding", "graphsage_dim_", 64) \
        .withColumnRenamed("node_id", "nodeId")


_DIMS = [f"graphsage_dim_{i}" for i in range(64)]
_ENTITY_FEATURES = """
WITH wide AS (
  SELECT vec_id AS entity_id, CASE WHEN vec_id % 23 = 0 THEN NULL ELSE CAST(label >= 5 AS INTEGER) END AS y, """ + ", ".join(
    f"CASE WHEN (vec_id + {i}) % 17 = 0 THEN NULL ELSE CAST(embedding[{i + 1}] AS DOUBLE) END AS {c}" for i, c in enumerate(_DIMS)) + """
  FROM embeddings),
known AS (SELECT * FROM wide WHERE y IS NOT NULL),
med AS (SELECT """ + ", ".join(f"median({c}) AS m_{c}" for c in _DIMS) + """ FROM known)
SELECT entity_id, """ + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in _DIMS) + ", y AS label FROM known CROSS JOIN med"


@query("read_entity_features", sql=_ENTITY_FEATURES)
def q_read_entity_features(spark, sf):
    """A-S3 + B-P10 + B-P11: wide feature table in which every 23rd target and, in each of the 64 columns,
    every 17th feature is missing; rows without a target dropped, binary
    target, metadata columns excluded, missing features median-filled."""
    from riskgraph.sources import tables as TB
    v = FX.embedding_vectors(spark, sf)
    wide = X.embedding_to_columns(v, "features", "graphsage_dim_", 64)
    wide = wide.withColumns({
        "has_pest_ever": F.when(F.col("entity_id") % 23 == 0, F.lit(None)).otherwise(F.col("label")),
        "nodeId": F.concat(F.lit("E:"), F.col("entity_id").cast("string")), "pest_rate": F.col("label").cast("double"),
        **{c: F.when((F.col("entity_id") + i) % 17 == 0, F.lit(None)).otherwise(F.col(c)) for i, c in enumerate(_DIMS)},
    }).drop("label")
    return X.fill_median(TB.read_entity_features(wide, "has_pest_ever"), _DIMS)


@query("graphsage_scoring")
def q_sage_scoring(spark, sf):
    """M-P4: targets -> trained classifier (H-E7 small) and trained
    embeddings (H-E6) merged per entity with actuals,
    inspection count, wide embedding columns and the five-band risk."""
    g, feats, s, drawn = _sage_split(spark, sf)
    fields = SG.prepare(g, feats, SG.SMALL, drawn)                     # both trainings have the same sizes and seed
    _, p = SG.train_classifier(g, feats, s, SG.SMALL, keep=("entity_id", "pest_rate", "total_inspections"), fields=fields)
    _, e = SG.train_embeddings(g, feats, fields=fields)
    out = p.select("node_id", "entity_id", F.col("prediction").alias("graphsage_predicted_class"),
                   (1.0 - F.col("score")).alias("graphsage_prob_no_pest"), F.col("score").alias("graphsage_prob_pest"),
                   F.col("label").alias("actual_pest_class"), F.col("pest_rate").alias("actual_pest_rate"),
                   F.col("total_inspections").alias("inspection_count"),
                   X.risk_band("score", "five").alias("graphsage_risk_category"))
    out = R.attach_actuals(out, e, "node_id")
    return X.embedding_to_columns(out, "embedding", "graphsage_emb_", 64).drop("node_id")
