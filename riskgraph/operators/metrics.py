"""Model metrics as aggregates over prediction
rows.  Curves and AUC group by distinct score first, then take running
sums with :func:`relational.running_sums` (range partitions, no global
window), so the work is one shuffle of the (much smaller) score table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.operators import relational as R


def _div(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def binary_metrics(preds: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """M-V3: accuracy, precision, recall, F1 (0 where undefined)."""
    yy, pp = F.col(y).cast("int"), F.col(yhat).cast("int")
    c = preds.agg(F.count_if((yy == 1) & (pp == 1)).alias("tp"), F.count_if((yy == 0) & (pp == 1)).alias("fp"),
                  F.count_if((yy == 1) & (pp == 0)).alias("fn"), F.count_if((yy == 0) & (pp == 0)).alias("tn"))
    prec = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _div(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(
        _div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"))


def score_counts(preds: DataFrame, y: str = "label", score: str = "score") -> DataFrame:
    """(score, pos, neg) per distinct score."""
    return preds.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"),
        (F.count(F.lit(1)) - F.sum(F.col(y).cast("long"))).alias("neg"))


def roc_auc(preds: DataFrame, y: str = "label", score: str = "score") -> DataFrame:
    """M-V4: exact ROC AUC (Mann-Whitney; ties count one half).  NULL when
    one class is absent."""
    g = score_counts(preds, y, score)
    c = R.running_sums(g, "score", ["neg"], inclusive=False)
    return c.agg(F.try_divide(F.sum(F.col("pos") * (F.col("cum_neg") + 0.5 * F.col("neg"))),
                              (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"),
                 F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def pr_curve(preds: DataFrame, y: str = "label", score: str = "score") -> DataFrame:
    """M-V5: at every distinct threshold t (predict 1 when score >= t):
    tp, fp, precision, recall and false-positive rate (ROC points)."""
    g = score_counts(preds, y, score)
    c = R.running_sums(g, "score", ["pos", "neg"], descending=True, inclusive=True)
    tot = g.agg(F.sum("pos"), F.sum("neg")).first()
    P, N = (tot[0] or 0), (tot[1] or 0)
    return c.select(
        F.col("score").alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        _div(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        (F.col("cum_pos") / F.lit(P) if P else F.lit(0.0)).alias("recall"),
        (F.col("cum_neg") / F.lit(N) if N else F.lit(0.0)).alias("fpr"))


def classification_report(preds: DataFrame, y: str = "label", yhat: str = "prediction",
                          classes: Sequence[int] = (0, 1)) -> DataFrame:
    """M-V6: per class precision, recall, F1, support; macro and weighted."""
    yy, pp = F.col(y).cast("int"), F.col(yhat).cast("int")
    aggs = []
    for k in classes:
        aggs += [F.count_if((yy == k) & (pp == k)).alias(f"tp{k}"), F.count_if(pp == k).alias(f"pp{k}"),
                 F.count_if(yy == k).alias(f"s{k}")]
    c = preds.agg(*aggs)
    rows = []
    for k in classes:
        p = _div(F.col(f"tp{k}"), F.col(f"pp{k}"))
        r = _div(F.col(f"tp{k}"), F.col(f"s{k}"))
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
        rows.append(F.struct(F.lit(str(k)).alias("class"), p.alias("precision"), r.alias("recall"),
                             f.alias("f1_score"), F.col(f"s{k}").alias("support")))
    per = c.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    tot = per.agg(
        F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1_score").alias("f1_score"), F.sum("support").alias("support"))
    w = per.agg(
        F.lit("weighted avg").alias("class"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("f1_score"),
        F.sum("support").alias("support"))
    return per.unionByName(tot).unionByName(w)


def score_histogram(preds: DataFrame, bins: int = 20, y: str = "label", score: str = "score") -> DataFrame:
    """M-V7: equal-width bins over [min, max] of the score, per class (the
    last bin is closed, as a histogram's is)."""
    mm = preds.agg(F.min(score), F.max(score)).first()
    lo, hi = float(mm[0]), float(mm[1])
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(score) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return preds.groupBy(F.col(y).cast("int").alias("class"), b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n")).withColumns({
            "bin_start": F.lit(lo) + F.col("bin") * F.lit(width),
            "bin_end": F.lit(lo) + (F.col("bin") + 1) * F.lit(width)})


def feature_importance(spark, importances: Sequence[float], names: Sequence[str],
                       groups: dict[str, str] | None = None) -> DataFrame:
    """M-V8: importances with names, sorted; the group of each feature."""
    rows = [(n, float(v), (groups or {}).get(n, "other")) for n, v in zip(names, importances)]
    df = spark.createDataFrame(rows, "feature string, importance double, feature_group string")
    return df.orderBy(F.col("importance").desc(), "feature")


def feature_groups(columns: Sequence[str]) -> dict[str, str]:
    """B-P15: GraphSAGE / FastRP dimensions, structural features, other."""
    structural = {"pageRank", "betweenness", "closeness", "eigenvector", "degree", "triangleCount",
                  "localClusteringCoefficient", "communityId", "articleRank", "coreValue",
                  "entity_degree", "pagerank", "article_rank", "core_value", "triangle_count",
                  "local_clustering", "community_id"}
    out = {}
    for c in columns:
        if c.startswith("graphsage_") or c.startswith("fastrp_") or c.startswith("embed_"):
            out[c] = "embedding"
        elif c in structural:
            out[c] = "structural"
        else:
            out[c] = "other"
    return out
