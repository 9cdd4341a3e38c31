"""Registered queries: targets, distributions, expressions, joins, windows,
sorts and set operations (SURVEY §2.B, §2.C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.functions import expr as X
from riskgraph.operators import graph as G
from riskgraph.operators import linkpred as L
from riskgraph.operators import relational as R
from riskgraph.plans import sql as S
from riskgraph.plans.registry import query
from riskgraph.sources import fixtures as FX
from riskgraph.sources import tables as TB


def _base(spark, sf):
    return FX.inspections(spark, sf, with_counters=False)


def _links(spark, sf):
    return G.entity_outcome_links(G.Graph(G.build_nodes(_base(spark, sf), False),
                                          G.build_edges(_base(spark, sf), False)))


_TGT = """tgt AS (
  SELECT entity_id, count(*) AS total_inspections, CAST(sum(target_value) AS BIGINT) AS pest_inspections,
         max(target_value) AS has_pest, avg(CAST(target_value AS DOUBLE)) AS pest_rate
  FROM (SELECT DISTINCT entity_id, target_value FROM links) GROUP BY entity_id)"""

_TGT_ROW = """tgt_row AS (
  SELECT enty_id AS entity_id, count(*) AS total_inspections, CAST(sum(target_proxy) AS BIGINT) AS pest_inspections,
         max(target_proxy) AS has_pest, avg(CAST(target_proxy AS DOUBLE)) AS pest_rate
  FROM base GROUP BY enty_id)"""

_T = S.with_(S.BASE, S.MERGED_EDGES, S.LINKS, _TGT, _TGT_ROW)


def _band_sql(col: str, scale: str) -> str:
    if scale == "five":
        return (f"CASE WHEN {col} >= 0.8 THEN 'Very High Risk' WHEN {col} >= 0.6 THEN 'High Risk' "
                f"WHEN {col} >= 0.4 THEN 'Medium Risk' WHEN {col} >= 0.2 THEN 'Low Risk' ELSE 'Very Low Risk' END")
    if scale == "three":
        return f"CASE WHEN {col} >= 0.7 THEN 'High Risk' WHEN {col} >= 0.4 THEN 'Medium Risk' ELSE 'Low Risk' END"
    return (f"CASE WHEN {col} = 0 THEN 'No Risk (0.0)' WHEN {col} > 0 AND {col} <= 0.2 THEN 'Low Risk (0.0-0.2)' "
            f"WHEN {col} > 0.2 AND {col} <= 0.5 THEN 'Medium Risk (0.2-0.5)' "
            f"WHEN {col} > 0.5 AND {col} <= 0.8 THEN 'High Risk (0.5-0.8)' ELSE 'Very High Risk (0.8-1.0)' END")


@query("entity_targets", sql=_T + "SELECT * FROM tgt")
def q_entity_targets(spark, sf):
    """C-A1: per entity count / sum / max / mean over distinct outcome links (T1)."""
    return R.entity_targets(_links(spark, sf))


@query("entity_targets_by_inspection", sql=_T + "SELECT * FROM tgt_row")
def q_entity_targets_row(spark, sf):
    """C-A2: per entity count / sum / max / mean over inspection rows."""
    return R.entity_targets_by_inspection(_base(spark, sf))


@query("target_summary", sql=_T + """
SELECT count(*) AS entities, avg(pest_rate) AS avg_pest_rate, min(pest_rate) AS min_pest_rate,
       max(pest_rate) AS max_pest_rate, count_if(has_pest = 1) AS entities_with_pest FROM tgt_row""")
def q_target_summary(spark, sf):
    """C-A3: entities, mean / min / max pest rate, entities with a pest."""
    return R.target_summary(R.entity_targets_by_inspection(_base(spark, sf)))


@query("risk_distribution", sql=_T + f"""
SELECT {_band_sql('pest_rate', 'rate')} AS risk_category, count(*) AS entity_count
FROM tgt_row WHERE pest_rate IS NOT NULL GROUP BY 1""")
def q_risk_distribution(spark, sf):
    """C-A4 / B-P6 / B-F2: entities per pest-rate band."""
    return R.risk_distribution(R.entity_targets_by_inspection(_base(spark, sf)), "pest_rate", "rate")


@query("class_distribution", sql=_T + """
SELECT has_pest AS class, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM tgt_row) AS percent
FROM tgt_row GROUP BY has_pest""")
def q_class_distribution(spark, sf):
    """C-A5: count and percent per class."""
    return R.class_distribution(R.entity_targets_by_inspection(_base(spark, sf)), "has_pest")


@query("risk_band5", sql=_T + f"SELECT entity_id, pest_rate, {_band_sql('pest_rate', 'five')} AS band FROM tgt_row")
def q_band5(spark, sf):
    """B-P4: five-band risk category of a score."""
    t = R.entity_targets_by_inspection(_base(spark, sf))
    return t.select("entity_id", "pest_rate", X.risk_band("pest_rate", "five").alias("band"))


@query("risk_band3", sql=_T + f"SELECT entity_id, pest_rate, {_band_sql('pest_rate', 'three')} AS band FROM tgt_row")
def q_band3(spark, sf):
    """B-P5: three-band risk category of a probability."""
    t = R.entity_targets_by_inspection(_base(spark, sf))
    return t.select("entity_id", "pest_rate", X.risk_band("pest_rate", "three").alias("band"))


@query("high_risk_entities", sql=_T + f"SELECT entity_id FROM tgt_row WHERE {_band_sql('pest_rate', 'five')} = 'Low Risk'")
def q_high_risk(spark, sf):
    """B-F4: entities in one band (five-band 'Low Risk', the highest band present in the data)."""
    t = R.entity_targets_by_inspection(_base(spark, sf))
    return t.where(X.risk_band("pest_rate", "five") == "Low Risk").select("entity_id")


@query("threshold_binary", sql=_T + """
SELECT entity_id, CASE WHEN pest_rate >= 0.5 THEN 1 ELSE 0 END AS binary_05,
       CASE WHEN pest_rate >= 0.3 THEN 1 ELSE 0 END AS binary_03,
       CASE WHEN pest_rate >= 0.2 THEN 1 ELSE 0 END AS binary_02,
       CASE WHEN pest_rate > 0 THEN 1 ELSE 0 END AS actual_binary FROM tgt_row""")
def q_threshold(spark, sf):
    """B-P7: score >= .5 / .3 / .2 and actual > 0 as 0/1."""
    t = R.entity_targets_by_inspection(_base(spark, sf))
    return t.select("entity_id", X.threshold("pest_rate", 0.5).alias("binary_05"),
                    X.threshold("pest_rate", 0.3).alias("binary_03"),
                    X.threshold("pest_rate", 0.2).alias("binary_02"),
                    X.threshold("pest_rate", 0.0, strict=True).alias("actual_binary"))


@query("clip_score", sql=_T + """
SELECT entity_id, least(greatest(pest_rate * 3.0 - 0.5, 0.0), 1.0) AS clipped FROM tgt_row""")
def q_clip(spark, sf):
    """B-P8: an affine score clamped to [0, 1]."""
    t = R.entity_targets_by_inspection(_base(spark, sf))
    return t.select("entity_id", X.clip(F.col("pest_rate") * 3.0 - 0.5).alias("clipped"))


@query("fill_constant", sql=S.with_(S.BASE, S.MERGED_EDGES, S.LINKS, _TGT, _TGT_ROW) + """
SELECT c_custkey AS entity_id, coalesce(t.has_pest, 0) AS has_pest, coalesce(t.pest_rate, 0.5) AS pest_rate
FROM customer c LEFT JOIN tgt_row t ON t.entity_id = c.c_custkey""")
def q_fill_constant(spark, sf):
    """B-P9: every customer; class 0 and rate .5 where no inspection exists."""
    cust = TB.table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"))
    t = R.entity_targets_by_inspection(_base(spark, sf)).select("entity_id", "has_pest", "pest_rate")
    j = R.attach_actuals(cust, t, "entity_id")
    return X.fill_constant(j, {"has_pest": 0, "pest_rate": 0.5})


_COLD = """cold AS (
  SELECT CASE WHEN vec_id % 5 = 0 THEN 'new_entity_' || CAST(vec_id AS VARCHAR) ELSE 'entity_' || CAST(vec_id AS VARCHAR) END AS enty_id,
         CASE WHEN vec_id = (SELECT min(vec_id) FROM embeddings WHERE vec_id % 5 = 0) THEN 'D' ELSE chr(CAST(65 + label % 3 AS INTEGER)) END AS category,
         CAST(embedding[1] AS DOUBLE) AS feature_1, CAST(embedding[2] AS DOUBLE) * 100 AS feature_2,
         ['X', 'Y', 'Z'][label % 3 + 1] AS feature_3,
""" + ",\n".join(f"         CASE WHEN vec_id % 5 = 0 THEN NULL ELSE CAST(embedding[{i + 1}] AS DOUBLE) END AS fastrp_{i}"
                 for i in range(64)) + """
  FROM embeddings)"""


@query("missing_counts", sql=S.with_(_COLD) + "\nUNION ALL\n".join(
    [f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS missing FROM cold"
     for c in ["enty_id", "category", "feature_1", "feature_2", "feature_3"] + [f"fastrp_{i}" for i in range(64)]]
    + ["SELECT '__total__', CAST(" + " + ".join(
        f"count_if({c} IS NULL)" for c in ["enty_id", "category", "feature_1", "feature_2", "feature_3"]
        + [f"fastrp_{i}" for i in range(64)]) + " AS BIGINT) FROM cold"]))
def q_missing_counts(spark, sf):
    """C-A6: NULL count per column and in total (cold-start table)."""
    return R.missing_counts(FX.cold_start_table(spark, sf))


_FASTRP = [f"fastrp_{i}" for i in range(64)]
_FILLABLE = ["feature_1", "feature_2", *_FASTRP]


@query("fill_median", sql=S.with_(_COLD) + ",\nmed AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in _FILLABLE) + " FROM cold)\nSELECT enty_id, "
       + ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in _FILLABLE) + " FROM cold CROSS JOIN med")
def q_fill_median(spark, sf):
    """B-P10: missing values of all numeric columns replaced by the exact column median."""
    c = FX.cold_start_table(spark, sf).select("enty_id", *[F.col(c).cast("double").alias(c) for c in _FILLABLE])
    return X.fill_median(c, _FILLABLE)


_COLD_COLS = ["enty_id", "category", "feature_1", "feature_2", "feature_3", *_FASTRP]


@query("drop_null_rows", sql=S.with_(_COLD) + f"SELECT {', '.join(_COLD_COLS)} FROM cold WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _COLD_COLS))
def q_drop_null(spark, sf):
    """B-P11: rows with a NULL in any column dropped."""
    c = FX.cold_start_table(spark, sf).select(*_COLD_COLS)
    return X.drop_null_rows(c, _COLD_COLS)


@query("split_by_missing", sql=S.with_(_COLD) + """
SELECT fastrp_0 IS NULL AS missing_embedding, count(*) AS n FROM cold GROUP BY 1""")
def q_split_missing(spark, sf):
    """B-P12: rows with / without a complete embedding."""
    c = FX.cold_start_table(spark, sf)
    c = X.columns_to_embedding(c, "fastrp_", "embedding")
    return c.groupBy(X.has_missing("embedding").alias("missing_embedding")).agg(F.count(F.lit(1)).alias("n"))


@query("one_hot_drop_first", sql=S.with_(_COLD) + """,
cats AS (SELECT DISTINCT category FROM cold WHERE fastrp_0 IS NOT NULL)
SELECT enty_id, category,
       CASE WHEN category = 'B' THEN 1.0 ELSE 0.0 END AS category_B,
       CASE WHEN category = 'C' THEN 1.0 ELSE 0.0 END AS category_C
FROM cold""")
def q_one_hot(spark, sf):
    """B-P16: dummies fitted on training rows (first category dropped);
    unseen categories encode as all zeros."""
    c = FX.cold_start_table(spark, sf)
    train = X.drop_null_rows(c, ["fastrp_0"])
    cats = X.one_hot_categories(train, "category")
    return X.one_hot_drop_first(c.select("enty_id", "category"), "category", cats)


_EMB_ARR = "[" + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(64)) + "]"


@query("embedding_to_columns", sql="SELECT vec_id AS entity_id, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS embed_{i:02d}" for i in range(64)) +
    ", CAST(label >= 5 AS INTEGER) AS target_proxy FROM embeddings")
def q_emb_cols(spark, sf):
    """B-P13: embedding array -> embed_00..embed_63 columns."""
    v = FX.embedding_vectors(spark, sf)
    w = X.embedding_to_columns(v, "features", "embed_", 64, width=2)
    return w.withColumnRenamed("label", "target_proxy")


@query("read_embeddings", sql=f"SELECT vec_id AS entity_id, {_EMB_ARR} AS features, "
       "CAST(label >= 5 AS INTEGER) AS target_proxy FROM embeddings")
def q_read_embeddings(spark, sf):
    """A-S2 / B-P13: wide embed_ columns found by prefix -> one vector."""
    return TB.read_embeddings(FX.embedding_wide(spark, sf))


@query("mean_embedding", sql="SELECT [" + ", ".join(
    f"avg(CAST(embedding[{i + 1}] AS DOUBLE))" for i in range(64)) + "] AS embedding FROM embeddings")
def q_mean_embedding(spark, sf):
    """C-A13: element-wise mean embedding."""
    v = FX.embedding_vectors(spark, sf).withColumnRenamed("features", "embedding")
    return R.mean_embedding(v, "embedding")


_CAT_MEAN = S.with_(_COLD) + """,
known AS (SELECT * FROM cold WHERE fastrp_0 IS NOT NULL),
cm AS (SELECT category, [""" + ", ".join(f"avg(fastrp_{i})" for i in range(64)) + """] AS m FROM known GROUP BY category),
gm AS (SELECT [""" + ", ".join(f"avg(fastrp_{i})" for i in range(64)) + """] AS g FROM known)
SELECT c.enty_id, c.category, coalesce(cm.m, gm.g) AS embedding
FROM cold c LEFT JOIN cm ON cm.category = c.category CROSS JOIN gm WHERE c.fastrp_0 IS NULL"""


@query("category_mean_embedding", sql=_CAT_MEAN)
def q_cat_mean(spark, sf):
    """C-A14: default embedding per category for new entities; unseen -> global mean."""
    c = X.columns_to_embedding(FX.cold_start_table(spark, sf), "fastrp_", "embedding")
    known = c.where(~X.has_missing("embedding"))
    keys = c.where(X.has_missing("embedding")).select("enty_id", "category")
    return R.category_mean_embedding(known, keys, "category", "embedding")


@query("assemble_features", sql=S.with_(S.BASE, S.DIM_NODES, S.MERGED_EDGES, S.PROJ, S.LINKS, _TGT, _TGT_ROW) + """
SELECT 'E:' || CAST(t.entity_id AS VARCHAR) AS node_id, d.degree, t.total_inspections, t.pest_rate
FROM tgt_row t JOIN (SELECT src AS node_id, count(*) AS degree FROM proj_edges GROUP BY src) d
  ON d.node_id = 'E:' || CAST(t.entity_id AS VARCHAR)""")
def q_assemble(spark, sf):
    """C-J1: per-node feature frames joined on the node id."""
    b = _base(spark, sf)
    deg = G.degrees(G.pest_projection(b), "out", with_isolated=False)
    t = R.entity_targets_by_inspection(b).select(
        F.concat(F.lit("E:"), F.col("entity_id").cast("string")).alias("node_id"), "total_inspections", "pest_rate")
    return R.assemble_features(deg, [t], "node_id")


@query("resolve_nodes", sql=S.with_(S.BASE, S.DIM_NODES, S.MERGED_EDGES, S.PROJ) + """
SELECT d.node_id, d.degree, n.label, n.key
FROM (SELECT src AS node_id, count(*) AS degree FROM proj_edges GROUP BY src) d JOIN dim_nodes n ON n.node_id = d.node_id""")
def q_resolve(spark, sf):
    """C-J7: node scores joined to their label and key."""
    g = G.pest_projection(_base(spark, sf))
    return G.degrees(g, "out", with_isolated=False).join(g.nodes, "node_id")


@query("link_inspections", sql=S.with_(S.BASE) + """
SELECT 'I:' || CAST(inspection_id AS VARCHAR) AS node_id, 'C:' || ctry_code AS country_node,
       'M:' || CAST(month AS VARCHAR) AS month_node, 'E:' || CAST(enty_id AS VARCHAR) AS entity_node,
       'T:' || CAST(target_proxy AS VARCHAR) AS target_node,
       'CM:' || ctry_code || '_' || CAST(month AS VARCHAR) AS country_month_node FROM base""")
def q_link_inspections(spark, sf):
    """C-J8: each inspection matched to its five dimension nodes."""
    b = _base(spark, sf)
    e = G.build_edges(b)
    ins = e.where(F.col("src").startswith("I:")).groupBy("src").pivot(
        "rel_type", ["IN_COUNTRY", "IN_MONTH", "FOR_ENTITY", "HAS_TARGET"]).agg(F.first("dst"))
    out = ins.select(F.col("src").alias("node_id"), F.col("IN_COUNTRY").alias("country_node"),
                     F.col("IN_MONTH").alias("month_node"), F.col("FOR_ENTITY").alias("entity_node"),
                     F.col("HAS_TARGET").alias("target_node"))
    cm = b.select(G.node_id("Inspection", F.col("inspection_id")).alias("node_id"),
                  G.node_id("CountryMonth", X.country_month_key()).alias("country_month_node"))
    return out.join(cm, "node_id")


@query("merge_class_and_regression", sql=_T + """
SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, a.has_pest AS class_pred, b.pest_rate AS reg_pred
FROM (SELECT entity_id, has_pest FROM tgt WHERE has_pest = 1) a
FULL OUTER JOIN (SELECT entity_id, pest_rate FROM tgt_row WHERE pest_rate > 0.2) b ON a.entity_id = b.entity_id""")
def q_merge(spark, sf):
    """C-J4: full outer join of two prediction sets, key from whichever side exists."""
    a = R.entity_targets(_links(spark, sf)).where(F.col("has_pest") == 1).select(
        "entity_id", F.col("has_pest").alias("class_pred"))
    b = R.entity_targets_by_inspection(_base(spark, sf)).where(F.col("pest_rate") > 0.2).select(
        "entity_id", F.col("pest_rate").alias("reg_pred"))
    return R.merge_predictions(a, b, "entity_id")


@query("best_row_per_entity", sql=S.with_(S.INSPECTIONS) + """
SELECT enty_id, inspection_id, enty_pests_1yr FROM (
  SELECT enty_id, inspection_id, enty_pests_1yr,
         row_number() OVER (PARTITION BY enty_id ORDER BY enty_pests_1yr DESC, inspection_id) AS rn
  FROM inspections) WHERE rn = 1""")
def q_best_row(spark, sf):
    """C-W1: first row per entity by score desc, then key."""
    i = FX.inspections(spark, sf).select("enty_id", "inspection_id", "enty_pests_1yr")
    return R.best_per_key(i, "enty_id", "enty_pests_1yr", "inspection_id")


_SPLIT = """ranked AS (
  SELECT vec_id AS entity_id, CAST(label >= 5 AS INTEGER) AS y,
         row_number() OVER (PARTITION BY CAST(label >= 5 AS INTEGER)
                            ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)) || ':' || CAST(vec_id AS VARCHAR)) - 1 AS rk,
         count(*) OVER (PARTITION BY CAST(label >= 5 AS INTEGER)) AS n
  FROM embeddings)"""


@query("stratified_split", sql=S.with_(_SPLIT) + "SELECT entity_id, y, rk < ceil(n * 0.2) AS is_test FROM ranked")
def q_split(spark, sf):
    """C-W2: seeded stratified 80/20 split, exact class proportions."""
    v = FX.embedding_vectors(spark, sf).select("entity_id", F.col("label").alias("y"))
    return R.stratified_split(v, "y", "entity_id", 0.2, 42)


@query("kfold_assign", sql=S.with_(_SPLIT) + "SELECT entity_id, y, CAST(rk % 5 AS INTEGER) AS fold FROM ranked")
def q_kfold(spark, sf):
    """C-W3: class-balanced 5 folds (rank in class mod k)."""
    v = FX.embedding_vectors(spark, sf).select("entity_id", F.col("label").alias("y"))
    return R.kfold_assign(v, "y", "entity_id", 5, 42)


@query("top_n_links", sql=S.with_(S.INSPECTIONS) + """
SELECT inspection_id, enty_pests_1yr FROM inspections ORDER BY enty_pests_1yr DESC, inspection_id LIMIT 10000""")
def q_top_n(spark, sf):
    """C-O2 / C-O1: best 10,000 rows by score (ties on key)."""
    i = FX.inspections(spark, sf).select("inspection_id", "enty_pests_1yr")
    return R.top_n(i, 10000, "enty_pests_1yr", "inspection_id")


@query("sample_rows", sql="SELECT vec_id AS entity_id, CAST(embedding[1] AS DOUBLE) AS embed_00, "
       "CAST(label >= 5 AS INTEGER) AS target_proxy FROM embeddings ORDER BY vec_id LIMIT 10")
def q_sample_rows(spark, sf):
    """C-O5: first rows of chosen columns by key."""
    w = FX.embedding_wide(spark, sf).select("entity_id", "embed_00", "target_proxy")
    return w.orderBy("entity_id").limit(10)


@query("union_rows", sql=S.with_(_COLD) + """
SELECT enty_id, category, fastrp_0 FROM cold WHERE fastrp_0 IS NOT NULL
UNION ALL SELECT enty_id, category, NULL FROM cold WHERE fastrp_0 IS NULL""")
def q_union(spark, sf):
    """C-U1: known and new entities stacked by column name."""
    c = FX.cold_start_table(spark, sf)
    known = c.where(F.col("fastrp_0").isNotNull()).select("enty_id", "category", "fastrp_0")
    new = c.where(F.col("fastrp_0").isNull()).select("enty_id", "category")
    return R.union_rows(known, new)


@query("unlinked_entities", sql="""
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def q_unlinked(spark, sf):
    """C-U3 / C-J6 (left anti): customers without any inspection."""
    cust = TB.table(spark, sf, "customer").select("c_custkey")
    b = _base(spark, sf).select(F.col("enty_id").alias("c_custkey"))
    return R.unlinked(cust, b, ["c_custkey"])


@query("rename_select", sql=_T + """
SELECT entity_id, pest_rate AS actual_pest_score, has_pest AS actual_pest_class FROM tgt""")
def q_rename(spark, sf):
    """B-P14: rename and choose the final columns."""
    return X.rename_select(R.entity_targets(_links(spark, sf)),
                           {"entity_id": "entity_id", "pest_rate": "actual_pest_score", "has_pest": "actual_pest_class"})


@query("lookup_line_features", sql="""
WITH f AS (SELECT l_suppkey AS filer, l_orderkey AS entry_nbr, l_linenumber AS line_nbr,
                  sum(l_quantity) AS quantity, sum(l_extendedprice) AS extendedprice,
                  sum(l_discount) AS discount, sum(l_tax) AS tax
           FROM lineitem GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT l_suppkey AS filer, l_orderkey AS entry_nbr, l_linenumber AS line_nbr
      FROM lineitem WHERE l_returnflag = 'R')
SELECT f.* FROM f JOIN k USING (filer, entry_nbr, line_nbr)""")
def q_lookup(spark, sf):
    """A-S4: features for a batch of requested (filer, entry, line) keys."""
    return TB.lookup_features(FX.line_features(spark, sf), FX.line_keys(spark, sf),
                              ["filer", "entry_nbr", "line_nbr"])


@query("prediction_summary", sql=_T + """
SELECT count(*) AS total, count_if(has_pest = 1) AS actual_positive, avg(pest_rate) AS mean_score,
       min(pest_rate) AS min_score, max(pest_rate) AS max_score,
       count_if(pest_rate >= 0.5) AS n_ge_05, count_if(pest_rate >= 0.3) AS n_ge_03,
       count_if(pest_rate >= 0.2) AS n_ge_02 FROM tgt_row""")
def q_pred_summary(spark, sf):
    """C-A8: totals, mean / min / max score and counts per threshold."""
    t = R.entity_targets_by_inspection(_base(spark, sf))
    return R.prediction_summary(t, "pest_rate", "has_pest")
