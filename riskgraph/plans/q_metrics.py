"""Registered queries: model metrics over the fixed score table (§2.M, M-V3..V7)."""

from __future__ import annotations

from riskgraph.operators import metrics as M
from riskgraph.operators import relational as R
from riskgraph.plans import sql as S
from riskgraph.plans.registry import query
from riskgraph.sources import fixtures as FX

_SC = S.with_(S.SCORES)


@query("binary_metrics", sql=_SC + """,
c AS (SELECT count_if(label = 1 AND predicted = 1) AS tp, count_if(label = 0 AND predicted = 1) AS fp,
             count_if(label = 1 AND predicted = 0) AS fn, count_if(label = 0 AND predicted = 0) AS tn FROM scored),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM c)
SELECT coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0.0) AS accuracy, p AS precision, r AS recall,
       CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pr""")
def q_binary_metrics(spark, sf):
    """M-V3: accuracy, precision, recall, F1 of fixed predictions."""
    return M.binary_metrics(FX.score_table(spark, sf), "label", "predicted")


@query("confusion_matrix", sql=_SC + """
SELECT a.actual, p.predicted, count_if(s.label = a.actual AND s.predicted = p.predicted) AS n
FROM (VALUES (0), (1)) a(actual) CROSS JOIN (VALUES (0), (1)) p(predicted) CROSS JOIN scored s
GROUP BY a.actual, p.predicted""")
def q_confusion(spark, sf):
    """C-A15: 2x2 confusion counts."""
    return R.confusion_matrix(FX.score_table(spark, sf), "label", "predicted")


_G = _SC + """,
g AS (SELECT CAST(score AS DOUBLE) AS score, CAST(sum(label) AS BIGINT) AS pos,
             CAST(count(*) - sum(label) AS BIGINT) AS neg FROM scored GROUP BY score)"""


@query("roc_auc", sql=_G + """,
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS roc_auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c""")
def q_roc_auc(spark, sf):
    """M-V4: exact ROC AUC with tied scores counted one half."""
    return M.roc_auc(FX.score_table(spark, sf), "label", "score")


@query("pr_curve", sql=_G + """,
c AS (SELECT score, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
             CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM g)
SELECT score AS threshold, tp, fp, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
       tp / (SELECT sum(pos) FROM g) AS recall, fp / (SELECT sum(neg) FROM g) AS fpr FROM c""")
def q_pr_curve(spark, sf):
    """M-V5: precision / recall / FPR at each distinct threshold."""
    return M.pr_curve(FX.score_table(spark, sf), "label", "score")


@query("classification_report", sql=_SC + """,
per AS (
  SELECT CAST(k AS VARCHAR) AS class,
         coalesce(count_if(label = k AND predicted = k) / nullif(count_if(predicted = k), 0), 0.0) AS precision,
         coalesce(count_if(label = k AND predicted = k) / nullif(count_if(label = k), 0), 0.0) AS recall,
         count_if(label = k) AS support
  FROM scored CROSS JOIN (VALUES (0), (1)) t(k) GROUP BY k),
per2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score FROM per)
SELECT class, precision, recall, f1_score, support FROM per2
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), CAST(sum(support) AS BIGINT) FROM per2
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1_score * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per2""")
def q_class_report(spark, sf):
    """M-V6: per class precision / recall / F1 / support, macro and weighted averages."""
    return M.classification_report(FX.score_table(spark, sf), "label", "predicted")


@query("score_histogram", sql=_SC + """,
mm AS (SELECT min(score) AS lo, max(score) AS hi FROM scored),
b AS (SELECT label AS class, CAST(least(floor((score - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, lo, hi
      FROM scored CROSS JOIN mm)
SELECT class, bin, count(*) AS n, any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 20) AS bin_start,
       any_value(lo) + (bin + 1) * ((any_value(hi) - any_value(lo)) / 20) AS bin_end
FROM b GROUP BY class, bin""")
def q_histogram(spark, sf):
    """M-V7: 20 equal-width score bins per class."""
    return M.score_histogram(FX.score_table(spark, sf), 20, "label", "score")
