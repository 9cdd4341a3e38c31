"""Training sets, estimators, scoring and cold start on Spark ML (SURVEY
§2.M).  Features travel as one ``array<double>`` column and become an ML
vector only at the estimator edge.  Scaler statistics are one aggregate
pass (d scalars); every fit is a distributed Spark ML job."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.functions import expr as X
from riskgraph.operators import metrics as M
from riskgraph.operators import relational as R
from riskgraph.operators.quantiles import position_quantiles
from riskgraph.session import cut_lineage

SEED = 42
TASK_ROWS = 4_000         # rows that are worth a task of a fit
MOST_ROWS = 200_000       # rows that a task of a fit gets at most, about


def dealt(df: DataFrame, key: str = "entity_id", rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt to all tasks of the session by ``key``, each part sorted, so reruns are equal.

    The planner merges partitions by their bytes, which leaves a fit of a small table to one or two tasks,
    though a fit costs far more a byte than a scan.  Tables of up to ``rows`` rows are left as they are."""
    n = df.count()
    if n <= rows:
        return df
    tasks = max(min(df.sparkSession.sparkContext.defaultParallelism, -(-n // rows)), -(-n // MOST_ROWS))
    return df.repartition(tasks, key).sortWithinPartitions(key)


# ---------------------------------------------------------------------------
# M-F scalers (exact, fitted on training rows only)
# ---------------------------------------------------------------------------
def fit_standard_scaler(train: DataFrame, col: str = "features") -> tuple[list[float], list[float]]:
    """M-F1: per-position mean and population std (sklearn semantics); vectors stay whole."""
    found = train.select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(col)).alias("s")).select("s.*").first()
    if not found or not found["count"]:
        return [], []
    n = found["count"]
    return found["mean"].tolist(), [math.sqrt(v * (n - 1) / n) or 1.0 for v in found["variance"]]


def fit_robust_scaler(train: DataFrame, col: str = "features") -> tuple[list[float], list[float]]:
    """M-F2: per-position median and inter-quartile range (exact, all positions in one distributed job)."""
    q = [x for _, x in sorted(position_quantiles(train, col, [0.25, 0.5, 0.75]).items())]
    return [m for _, m, _ in q], [(hi - lo) or 1.0 for lo, _, hi in q]


def apply_scaler(df: DataFrame, center: Sequence[float], scale: Sequence[float], col: str = "features",
                 out: str | None = None) -> DataFrame:
    c = F.array(*[F.lit(float(v)) for v in center])
    s = F.array(*[F.lit(float(v)) for v in scale])
    z = F.zip_with(F.zip_with(F.col(col), c, lambda x, m: x - m), s, lambda d, sd: d / sd)
    return df.withColumn(out or col, z)


# ---------------------------------------------------------------------------
# M-T estimators
# ---------------------------------------------------------------------------
def classifier(name: str, n_features: int | None = None, **kw):
    """M-T1..M-T10: estimator by name with the reference's settings."""
    common = dict(featuresCol="vec", labelCol="label")
    if name == "lr":
        return LogisticRegression(maxIter=1000, elasticNetParam=kw.get("elasticNetParam", 0.0), **_penalty(kw), **common)
    if name == "rf":
        return RandomForestClassifier(numTrees=kw.get("numTrees", 100), maxDepth=kw.get("maxDepth", 10),
                                      seed=SEED, featureSubsetStrategy=kw.get("featureSubsetStrategy", "auto"), **common)
    if name == "dt":
        return DecisionTreeClassifier(maxDepth=kw.get("maxDepth", 10), seed=SEED, **common)
    if name == "gbt":
        return GBTClassifier(maxIter=kw.get("maxIter", 100), maxDepth=kw.get("maxDepth", 3),
                             stepSize=kw.get("stepSize", 0.1), subsamplingRate=kw.get("subsamplingRate", 1.0),
                             seed=SEED, **common)
    if name == "svc":
        return LinearSVC(maxIter=kw.get("maxIter", 1000), **_penalty(kw), **common)
    if name == "nb":
        return NaiveBayes(modelType=kw.get("modelType", "gaussian"), **common)
    if name == "mlp":
        hidden = list(kw.get("layers", [50]))
        return MultilayerPerceptronClassifier(layers=[n_features, *hidden, 2], maxIter=kw.get("maxIter", 200),
                                              seed=SEED, **common)
    raise ValueError(f"unknown classifier {name!r}")


def _penalty(kw: dict) -> dict:
    return {"regParam": kw["regParam"]} if "regParam" in kw else {}


def with_penalty(est, n: int, c: float = 1.0):
    """An estimator whose penalty isn't set gets 1 / (C n) for n training rows."""
    if est.hasParam("regParam") and not est.isSet("regParam"):
        return est.copy({est.getParam("regParam"): 1.0 / (c * max(n, 1))})
    return est


def with_vector(df: DataFrame, col: str = "features") -> DataFrame:
    return df.withColumn("vec", array_to_vector(F.col(col)))


def fit_score(est, train: DataFrame, test: DataFrame, col: str = "features") -> DataFrame:
    """Fit on train, score test: prediction (0/1) and score = P(class 1)
    (for margin-only models the sigmoid of the raw margin; T13)."""
    model = with_penalty(est, train.count()).fit(with_vector(train, col))
    pred = model.transform(with_vector(test, col))
    if "probability" in pred.columns:
        score = vector_to_array(F.col("probability"))[1]
    else:
        score = 1.0 / (1.0 + F.exp(-vector_to_array(F.col("rawPrediction"))[1]))
    return pred.withColumn("score", score).withColumn("prediction", F.col("prediction").cast("int")) \
        .drop("vec", "rawPrediction", "probability")


def model_specs() -> dict[str, tuple[str, dict]]:
    """The comparison set (names and settings; unbuilt ones are listed in the README)."""
    return {
        "logistic_regression": ("lr", {}),
        "ridge_logistic": ("lr", {"regParam": 0.1}),
        "elastic_net_logistic": ("lr", {"regParam": 0.1, "elasticNetParam": 0.5}),
        "random_forest": ("rf", {"numTrees": 100, "maxDepth": 10}),
        "bagged_trees": ("rf", {"numTrees": 100, "maxDepth": 10, "featureSubsetStrategy": "all"}),
        "decision_tree": ("dt", {"maxDepth": 10}),
        "gradient_boosting": ("gbt", {"maxIter": 100, "maxDepth": 3}),
        "linear_svc": ("svc", {}),
        "gaussian_nb": ("nb", {"modelType": "gaussian"}),
        "mlp_50": ("mlp", {"layers": [50]}),
        "mlp_100_50": ("mlp", {"layers": [100, 50]}),
    }


def compare_models(train: DataFrame, test: DataFrame, specs: dict[str, tuple[str, dict]] | None = None,
                   col: str = "features", parallelism: int = 4) -> DataFrame:
    """M-V10: every model on the same cached split; one metrics row each
    (accuracy, precision, recall, F1, ROC AUC); a failure is an ``error``
    value, never a silent 0 (T14)."""
    specs = specs or model_specs()
    train, test = cut_lineage(train), cut_lineage(test)
    nf = train.select(F.size(col)).first()[0]
    spark = train.sparkSession

    def run(item):
        name, (kind, kw) = item
        try:
            p = fit_score(classifier(kind, nf, **kw), train, test, col)
            m = M.binary_metrics(p, "label", "prediction").first()
            auc = M.roc_auc(p, "label", "score").first()["roc_auc"]
            return (name, float(m["accuracy"]), float(m["precision"]), float(m["recall"]), float(m["f1"]),
                    float(auc) if auc is not None else None, None)
        except Exception as e:  # noqa: BLE001 - recorded in the table
            return (name, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        rows = list(ex.map(run, specs.items()))
    return spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, "
                                       "f1 double, roc_auc double, error string")


def cross_validate(est, df: DataFrame, k: int = 5, metric: str = "areaUnderROC", col: str = "features",
                   key: str = "entity_id") -> DataFrame:
    """M-V1: k class-balanced folds (C-W3) fed to ``CrossValidator(foldCol)``;
    mean and std of the metric, with the metric's name in the row."""
    folded = R.kfold_assign(df, "label", key, k)
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", metricName=metric) \
        if metric in ("areaUnderROC", "areaUnderPR") else \
        MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName=metric)
    est = with_penalty(est, df.count() * (k - 1) // k)
    cv = CrossValidator(estimator=est, estimatorParamMaps=[{}], evaluator=ev, foldCol="fold", numFolds=k, seed=SEED)
    model = cv.fit(with_vector(folded, col))
    spark = df.sparkSession
    return spark.createDataFrame([(metric, float(model.avgMetrics[0]), float(model.stdMetrics[0]), k)],
                                 "metric string, mean double, std double, folds int")


def grid_search(kind: str, grid: dict, df: DataFrame, k: int = 5, col: str = "features",
                key: str = "entity_id", parallelism: int = 4) -> DataFrame:
    """M-V2: parameter grid x k folds, best by F1; one row per setting."""
    folded = R.kfold_assign(df, "label", key, k)
    nf = df.select(F.size(col)).first()[0]
    est = classifier(kind, nf)
    b = ParamGridBuilder()
    for pname, values in grid.items():
        b = b.addGrid(est.getParam(pname), values)
    maps = b.build()
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="f1")
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=ev, foldCol="fold", numFolds=k,
                        parallelism=parallelism, seed=SEED)
    model = cv.fit(with_vector(folded, col))
    rows = [(str({p.name: v for p, v in m.items()}), float(a), float(s))
            for m, a, s in zip(maps, model.avgMetrics, model.stdMetrics)]
    return df.sparkSession.createDataFrame(rows, "params string, f1_mean double, f1_std double")


# ---------------------------------------------------------------------------
# Regression
# ---------------------------------------------------------------------------
def regressor(name: str, **kw):
    """M-T13 / M-T14."""
    common = dict(featuresCol="vec", labelCol="label")
    if name == "lin":
        return LinearRegression(regParam=kw.get("regParam", 1.0), maxIter=kw.get("maxIter", 1000), **common)
    if name == "rf":
        return RandomForestRegressor(numTrees=kw.get("numTrees", 100), maxDepth=kw.get("maxDepth", 10),
                                     seed=SEED, **common)
    raise ValueError(f"unknown regressor {name!r}")


def choose_model(data: DataFrame, estimators: dict, k: int = 3, regression: bool = False, col: str = "features",
                 key: str = "entity_id", stratum: str = "stratum") -> tuple[DataFrame, DataFrame]:
    """M-P1..M-P3: fit each estimator in k folds of the rows that are no test rows, take the best by mean
    ROC AUC (regression: RMSE), refit it on all of them, and score every row.

    ``data(key, features, label, is_test, stratum)``; the scaler is fitted on training rows too, and the folds are
    balanced by ``stratum``.  Returns the scored rows (prediction, and score = P(class 1) for classes) and
    a row for each estimator: model, metric, cv_mean, cv_std, chosen, held_out (the metric on test rows)."""
    train = data.where(~F.col("is_test"))
    m, s = fit_standard_scaler(train, col)
    scaled = cut_lineage(dealt(apply_scaler(data, m, s, col), key))
    folded = cut_lineage(with_vector(dealt(cut_lineage(R.kfold_assign(scaled.where(~F.col("is_test")), stratum, key, k)), key), col))
    ev = RegressionEvaluator(labelCol="label", metricName="rmse") if regression else BinaryClassificationEvaluator(labelCol="label")
    every, rows, best, n = with_vector(scaled, col), [], None, folded.count()
    for name, est in estimators.items():
        est = with_penalty(est, n)
        cv = CrossValidator(estimator=est, estimatorParamMaps=[{}], evaluator=ev, foldCol="fold", numFolds=k, seed=SEED, parallelism=k)
        found = cv.fit(folded)
        mean = float(found.avgMetrics[0])
        held = float(ev.evaluate(found.bestModel.transform(every.where("is_test"))))
        rows.append([name, ev.getMetricName(), mean, float(found.stdMetrics[0]), False, held])
        if best is None or (mean < best[0] if regression else mean > best[0]):
            best = (mean, found.bestModel, len(rows) - 1)
    rows[best[2]][4] = True
    pred = best[1].transform(every)
    if not regression:
        pred = pred.withColumn("score", vector_to_array(F.col("probability"))[1]).withColumn("prediction", F.col("prediction").cast("int"))
    report = data.sparkSession.createDataFrame([tuple(r) for r in rows], "model string, metric string, cv_mean double, cv_std double, chosen boolean, held_out double")
    return pred.drop("vec", "rawPrediction", "probability"), report


def fit_predict_regression(est, train: DataFrame, test: DataFrame, col: str = "features") -> DataFrame:
    model = est.fit(with_vector(train, col))
    return model.transform(with_vector(test, col)).drop("vec")


# ---------------------------------------------------------------------------
# M-C cold start
# ---------------------------------------------------------------------------
def cold_start_fit(train: DataFrame, feature_cols: Sequence[str], emb_col: str = "embedding",
                   num_trees: int = 100, parallelism: int = 8) -> tuple[list, list[float], list[float]]:
    """M-C1: one random-forest regressor per embedding dimension on the
    (encoded, scaled) features; the d fits share one checkpointed frame and
    run as concurrent Spark jobs."""
    base = cut_lineage(train.select(F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("features"),
                                    emb_col))
    dim = base.select(F.size(emb_col)).first()[0]
    mean, std = fit_standard_scaler(base, "features")
    scaled = cut_lineage(with_vector(apply_scaler(base, mean, std, "features"), "features"))

    def fit(i: int):
        d = scaled.select("vec", F.col(emb_col)[i].alias("label"))
        return RandomForestRegressor(numTrees=num_trees, seed=SEED, featuresCol="vec", labelCol="label").fit(d)
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        models = list(ex.map(fit, range(dim)))
    return models, mean, std


def cold_start_predict(fitted, df: DataFrame, feature_cols: Sequence[str], key: str,
                       out: str = "embedding") -> DataFrame:
    """M-C2: all d predictions for a batch of new rows, assembled into one array."""
    models, mean, std = fitted
    base = df.select(key, F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("features"))
    cur = cut_lineage(with_vector(apply_scaler(base, mean, std, "features"), "features").select(key, "vec"))
    preds = cur
    for i, m in enumerate(models):
        preds = m.transform(preds).withColumnRenamed("prediction", f"_p{i}")
    return preds.select(key, F.array(*[F.col(f"_p{i}") for i in range(len(models))]).alias(out))


# ---------------------------------------------------------------------------
# M-T11 voting, M-T12 stacking, M-T5 AdaBoost, M-T8 discriminant analysis
# ---------------------------------------------------------------------------
def vote(preds: dict[str, DataFrame], key: str = "entity_id", how: str = "soft") -> DataFrame:
    """M-T11: combine per-model (key, score, prediction) rows.  Soft: mean
    probability; hard: share of models voting 1 (the score, T12), class =
    share > 1/2."""
    names = list(preds)
    j = None
    for n in names:
        p = preds[n].select(key, F.col("score").alias(f"s_{n}"), F.col("prediction").alias(f"p_{n}"))
        j = p if j is None else j.join(p, key)
    k = float(len(names))
    if how == "soft":
        score = sum((F.col(f"s_{n}") for n in names), F.lit(0.0)) / k
        return j.select(key, score.alias("score"), (score >= 0.5).cast("int").alias("prediction"))
    share = sum((F.col(f"p_{n}").cast("double") for n in names), F.lit(0.0)) / k
    return j.select(key, share.alias("score"), (share > 0.5).cast("int").alias("prediction"))


def stack(train: DataFrame, test: DataFrame, bases: dict[str, tuple[str, dict]], k: int = 3,
          key: str = "entity_id", col: str = "features") -> DataFrame:
    """M-T12: out-of-fold base probabilities (k class-balanced folds) train a
    logistic regression; test rows get the bases refitted on all training rows."""
    nf = train.select(F.size(col)).first()[0]
    folded = cut_lineage(R.kfold_assign(train, "label", key, k))
    oof_parts = []
    for f in range(k):
        fit_on, held = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
        cols = []
        for n, (kind, kw) in bases.items():
            p = fit_score(classifier(kind, nf, **kw), fit_on, held, col).select(key, F.col("score").alias(n))
            cols.append(p)
        j = cols[0]
        for p in cols[1:]:
            j = j.join(p, key)
        oof_parts.append(cut_lineage(j))
    oof = oof_parts[0]
    for p in oof_parts[1:]:
        oof = oof.unionByName(p)
    meta_train = oof.join(train.select(key, "label"), key).select(
        key, F.array(*[F.col(n) for n in bases]).alias("meta"), "label")
    test_cols = []
    for n, (kind, kw) in bases.items():
        test_cols.append(fit_score(classifier(kind, nf, **kw), train, test, col).select(key, F.col("score").alias(n)))
    tj = test_cols[0]
    for p in test_cols[1:]:
        tj = tj.join(p, key)
    meta_test = tj.join(test.select(key, "label"), key).select(
        key, F.array(*[F.col(n) for n in bases]).alias("meta"), "label")
    return fit_score(classifier("lr"), meta_train, meta_test, "meta").select(key, "label", "score", "prediction")


def adaboost(train: DataFrame, test: DataFrame, rounds: int = 50, col: str = "features",
             key: str = "entity_id") -> DataFrame:
    """M-T5: discrete AdaBoost (SAMME, two classes) with depth-1 trees.  Row
    weights live in a column; each round is one weighted Spark ML fit plus
    one aggregate for the weighted error."""
    import math
    n = train.count()
    cur = cut_lineage(with_vector(train, col).withColumn("w", F.lit(1.0 / n)))
    te = cut_lineage(with_vector(test, col).withColumn("margin", F.lit(0.0)))
    for _ in range(rounds):
        stump = DecisionTreeClassifier(maxDepth=1, featuresCol="vec", labelCol="label", weightCol="w", seed=SEED)
        m = stump.fit(cur)
        p = m.transform(cur).withColumn("miss", (F.col("prediction") != F.col("label")).cast("double"))
        err = p.agg(F.sum(F.col("w") * F.col("miss")) / F.sum("w")).first()[0]
        if err is None or err >= 0.5:
            break
        err = max(err, 1e-10)
        alpha = math.log((1 - err) / err)
        cur = cut_lineage(p.withColumn("w", F.col("w") * F.exp(F.lit(alpha) * F.col("miss")))
                          .select(*[c for c in cur.columns]))
        tot = cur.agg(F.sum("w")).first()[0]
        cur = cur.withColumn("w", F.col("w") / F.lit(tot))
        te = cut_lineage(m.transform(te).withColumn(
            "margin", F.col("margin") + F.lit(alpha) * (2 * F.col("prediction") - 1))
            .drop("prediction", "rawPrediction", "probability"))
        if err <= 1e-10:
            break
    return te.select(key, "label", (1.0 / (1.0 + F.exp(-F.col("margin")))).alias("score"),
                     (F.col("margin") > 0).cast("int").alias("prediction"))


def _class_moments(train: DataFrame, col: str = "features"):
    """Per class: count, sum vector and X^T X from one Arrow pass per
    partition plus a groupBy over (partitions x classes) partial rows."""
    import numpy as np
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("s", T.ArrayType(T.DoubleType())),
                           T.StructField("xx", T.ArrayType(T.DoubleType()))])

    def partial(it):
        import pandas as pd
        acc: dict = {}
        for pdf in it:
            for y, grp in pdf.groupby("label"):
                x = np.vstack(grp[col].to_numpy()).astype(float)
                a = acc.setdefault(int(y), [0, 0.0, 0.0])
                a[0] += len(x)
                a[1] = a[1] + x.sum(axis=0)
                a[2] = a[2] + x.T @ x
        yield pd.DataFrame([(y, a[0], list(np.ravel(a[1])), list(np.ravel(a[2]))) for y, a in acc.items()],
                           columns=["label", "n", "s", "xx"])
    parts = train.select(F.col("label").cast("int").alias("label"), col).mapInPandas(partial, schema)
    from pyspark.ml.functions import array_to_vector as a2v
    agg = parts.groupBy("label").agg(F.sum("n").alias("n"),
                                     vector_to_array(Summarizer.sum(a2v("s"))).alias("s"),
                                     vector_to_array(Summarizer.sum(a2v("xx"))).alias("xx")).collect()
    out = {}
    for r in agg:
        d = len(r["s"])
        s, xx = np.array(r["s"]), np.array(r["xx"]).reshape(d, d)
        mu = s / r["n"]
        cov = xx / r["n"] - np.outer(mu, mu)
        out[r["label"]] = (r["n"], mu, cov)
    return out


def discriminant(train: DataFrame, test: DataFrame, kind: str = "lda", col: str = "features",
                 key: str = "entity_id", reg: float = 1e-6) -> DataFrame:
    """M-T8: linear (pooled covariance) or quadratic (per-class covariance)
    discriminant analysis.  Moments are d-sized model parameters; scoring is
    a native array expression, P(class 1) by the logistic of the
    log-likelihood ratio."""
    import numpy as np
    mom = _class_moments(train, col)
    (n0, mu0, c0), (n1, mu1, c1) = mom[0], mom[1]
    d = len(mu0)
    prior = np.log(n1 / n0)
    x = F.col(col)

    def dot(vec):
        return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in vec]), lambda a, b: a * b),
                           F.lit(0.0), lambda s, v: s + v)
    if kind == "lda":
        pooled = (n0 * c0 + n1 * c1) / (n0 + n1 - 2) + reg * np.eye(d)  # within-class scatter / (N - 2)
        w = np.linalg.solve(pooled, mu1 - mu0)
        b = -0.5 * (mu1 + mu0) @ w + prior
        logit = dot(w) + F.lit(float(b))
    else:
        terms = []
        for mu, cov in ((mu1, c1), (mu0, c0)):
            cov = cov + reg * np.eye(d)
            inv = np.linalg.inv(cov)
            _, logdet = np.linalg.slogdet(cov)
            # -(x-mu)' inv (x-mu)/2 = -x'inv x/2 + mu'inv x - mu'inv mu/2
            quad_rows = [dot(inv[i]) for i in range(d)]
            xq = F.aggregate(F.zip_with(x, F.array(*quad_rows), lambda a, b: a * b), F.lit(0.0),
                             lambda s, v: s + v)
            lin = dot(inv @ mu)
            const = -0.5 * mu @ inv @ mu - 0.5 * logdet
            terms.append(-0.5 * xq + lin + F.lit(float(const)))
        logit = terms[0] - terms[1] + F.lit(float(prior))
    score = 1.0 / (1.0 + F.exp(-logit))
    return test.select(key, "label", score.alias("score"), (score >= 0.5).cast("int").alias("prediction"))
