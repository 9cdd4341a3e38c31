"""Link prediction.

Neighbour sets are undirected and distinct.  For a pair (a, b) the common
neighbours are found by expanding the *low-degree* side ``a`` into
(a, b, z) rows and keeping those where (z, b) is an edge (a semi-join on
the composite key (z, b), which spreads a hub z over its many b's).  The
cost is sum over pairs of deg(a), never deg(a) x deg(b), and no pair is
generated that was not asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.functions import expr as X
from riskgraph.operators import graph as G
from riskgraph.operators import relational as R
from riskgraph.operators.spread import Spread
from riskgraph.session import cut_lineage

OUTCOMES = (0, 1)  # fixed by the data model: without and with a pest case

SCORE_COLS = ["adamic_adar_score", "jaccard_score", "common_neighbors_count",
              "preferential_attachment_score"]


def node_degrees(adj: DataFrame) -> DataFrame:
    return adj.groupBy("node").agg(F.count(F.lit(1)).alias("deg"))


def pair_scores(adj: DataFrame, pairs: DataFrame, a: str = "a", b: str = "b",
                deg: DataFrame | None = None, b_nodes: DataFrame | None = None) -> DataFrame:
    """L-1..L-4 for the given pairs (``a`` should be the low-degree side).

    adamic_adar = sum over shared z of 1 / ln deg(z) (deg 1 skipped);
    jaccard = CN / (deg a + deg b - CN); common_neighbors = CN;
    preferential_attachment = deg a * deg b.

    ``b_nodes`` (column ``b``): all values of ``b`` if they are a few known nodes.
    Then only edges into them are looked at, and their degrees are a table of as many rows.
    """
    if b_nodes is not None:
        # one look at the edges tells a node's degree and which of the few ``b`` it touches
        few = [r[0] for r in b_nodes.select(b).distinct().collect() if r[0] is not None]
        seen = cut_lineage(adj.groupBy("node").agg(F.count(F.lit(1)).alias("deg"), *[F.max(F.col("nbr") == F.lit(v)).alias(f"_b{i}") for i, v in enumerate(few)]))
        deg = deg if deg is not None else seen.select("node", "deg")
        touched = F.array_compact(F.array(*[F.when(F.col(f"_b{i}"), F.lit(v)) for i, v in enumerate(few)]).cast("array<string>"))
        expand = pairs.select(a).distinct().join(adj.select(F.col("node").alias(a), F.col("nbr").alias("_z")), on=a)
        into = seen.select(F.col("node").alias("_z"), F.col("deg").alias("_dz"), touched.alias("_bs")).where(F.size("_bs") > 0)
        shared = Spread(adj, "node", counts=deg.withColumnRenamed("deg", "n")).join(expand, into, "_z", [a]) \
            .select(a, "_dz", F.explode("_bs").alias(b))
    else:
        deg = deg if deg is not None else cut_lineage(node_degrees(adj))      # read four times
        expand = pairs.select(a, b).join(adj.select(F.col("node").alias(a), F.col("nbr").alias("_z")), on=a)
        into = adj.select(F.col("node").alias("_z"), F.col("nbr").alias(b))
        # degrees go to the few rows of ``into``; a shared node may be a hub, so its rows are salted
        into = into.distinct().join(deg.select(F.col("node").alias("_z"), F.col("deg").alias("_dz")), "_z")
        shared = Spread(adj, "node", counts=deg.withColumnRenamed("deg", "n")).join(expand, into, "_z", [a], on=[b])
    agg = shared.groupBy(a, b).agg(
        F.count(F.lit(1)).alias("common_neighbors_count"),
        F.sum(F.when(F.col("_dz") > 1, 1.0 / F.log(F.col("_dz"))).otherwise(0.0)).alias("adamic_adar_score"))
    da = deg.select(F.col("node").alias(a), F.col("deg").alias("_da"))
    db = deg.select(F.col("node").alias(b), F.col("deg").alias("_db"))
    if b_nodes is not None:
        db = F.broadcast(db.join(F.broadcast(b_nodes), b))
    out = pairs.join(agg, [a, b], "left") \
        .join(da, a, "left").join(db, b, "left") \
        .withColumns({"common_neighbors_count": F.coalesce("common_neighbors_count", F.lit(0)).cast("long"),
                      "adamic_adar_score": F.coalesce("adamic_adar_score", F.lit(0.0)),
                      "_da": F.coalesce("_da", F.lit(0)), "_db": F.coalesce("_db", F.lit(0))})
    union = F.col("_da") + F.col("_db") - F.col("common_neighbors_count")
    return out.withColumns({
        "jaccard_score": F.when(union > 0, F.col("common_neighbors_count") / union).otherwise(0.0),
        "preferential_attachment_score": (F.col("_da") * F.col("_db")).cast("double"),
    }).drop("_da", "_db")


def outcome_nodes(g: G.Graph) -> DataFrame:
    """C-D4: outcome nodes with value and label."""
    return g.nodes.where(F.col("label") == "TargetProxy").select(
        F.col("node_id").alias("pest_node_id"), F.col("key").cast("int").alias("pest_value"),
        X.target_label(F.col("key").cast("int")).alias("pest_label"))


def outcome_domain(g: G.Graph) -> list[int]:
    """The outcome values of the data model; any other value is a data error."""
    odd = outcome_nodes(g).where(F.col("pest_value").isNull() | ~F.col("pest_value").isin(*OUTCOMES)).select("pest_node_id").first()
    if odd is not None:
        raise ValueError(f"outcome node {odd[0]!r}: the value must be one of {OUTCOMES}")
    return list(OUTCOMES)


def candidate_pairs(g: G.Graph) -> DataFrame:
    """C-J5 + C-J6: every linked entity paired with every outcome node,
    flagged when the link already exists.  The outcome side is a bounded
    literal domain exploded per entity, so there is no Cartesian join."""
    links = G.entity_outcome_links(g)
    ents = links.select("entity_id", "entity_node_id").dropDuplicates(["entity_node_id"])
    dom = outcome_domain(g)
    outs = outcome_nodes(g)
    pairs = ents.withColumn("pest_value", F.explode(F.array(*[F.lit(v) for v in dom]))) \
        .join(F.broadcast(outs), "pest_value")  # a row for each of OUTCOMES, checked above
    return R.mark_existing(pairs, links, on=["entity_node_id", "pest_node_id"])


def link_pair_scores(g: G.Graph) -> DataFrame:
    """All four heuristics for every candidate pair (T2: every pair scored).
    The edge table is materialised once (reliable checkpoint): adjacency,
    degrees and outcome links all read it instead of rebuilding the graph
    from the source tables for each use."""
    g = G.Graph(g.nodes, cut_lineage(g.edges), g.undirected)
    adj = G.adjacency(g)
    pairs = candidate_pairs(g)
    outs = outcome_nodes(g).select("pest_node_id").distinct()      # at most len(OUTCOMES) rows, checked in candidate_pairs
    return pair_scores(adj, pairs, a="entity_node_id", b="pest_node_id", b_nodes=outs)


def link_heuristics(g: G.Graph, threshold: float = 0.5) -> DataFrame:
    """L-7: pairs -> four scores -> max-normalise over all pairs -> weighted
    composite -> keep the pest outcome -> threshold -> one row per entity.

    The scored pairs are checkpointed once: the maxima (four scalars) and
    the final rows both read the checkpoint instead of re-running the joins.
    One outcome node has value 1, so each entity has exactly one pest pair
    and the per-entity roll-up needs no aggregation."""
    scored = cut_lineage(link_pair_scores(g))
    norm = R.max_normalize(scored, SCORE_COLS)
    comp = R.weighted_sum({f"{c}_normalized": w for c, w in X.COMPOSITE_WEIGHTS.items()})
    pest = norm.withColumn("composite", comp).where(F.col("pest_value") == 1)
    return pest.select(
        F.col("entity_id"),
        F.col("composite").alias("link_pred_pest_score"),
        X.threshold("composite", threshold).alias("link_pred_pest_binary"),
        F.col("adamic_adar_score").alias("max_adamic_adar_score"),
        F.col("jaccard_score").alias("max_jaccard_score"),
        F.col("common_neighbors_count").alias("max_common_neighbors"),
        F.col("preferential_attachment_score").alias("max_preferential_attachment"),
        F.col("has_existing_relationship").cast("int").alias("has_actual_pest"))


def cosine_similarity(pairs: DataFrame, vectors: DataFrame, a: str = "a", b: str = "b",
                      key: str = "node_id", vec: str = "embedding") -> DataFrame:
    """L-6: cosine of the two nodes' vectors (NULL if a norm is 0)."""
    va = vectors.select(F.col(key).alias(a), F.col(vec).alias("_va"))
    vb = vectors.select(F.col(key).alias(b), F.col(vec).alias("_vb"))
    j = pairs.join(va, a, "left").join(vb, b, "left")
    dot = F.aggregate(F.zip_with("_va", "_vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(F.transform("_va", lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    nb = F.sqrt(F.aggregate(F.transform("_vb", lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return j.withColumn("cosine_similarity", F.when((na > 0) & (nb > 0), dot / (na * nb))).drop("_va", "_vb")


def entity_pest_affinity(g: G.Graph, pest_entities: DataFrame, entity_label: str = "Entity") -> DataFrame:
    """L-5 (re-aimed, exact and linear): for every entity e, common-neighbour
    and Adamic-Adar sums against the *set* of pest-case entities P:

        cn_pest(e) = sum_{p in P, p != e} |N(e) & N(p)|
                   = sum_{z in N(e)} (#P-neighbours of z - [e in P])
        aa_pest(e) = same terms weighted 1 / ln deg(z)

    Per shared node z the number of pest neighbours is one ``groupBy``; it is
    sent back along e's own edges.  No entity pair is ever formed, so a hub
    shared by a third of all entities costs one row per edge, not the square
    of its degree."""
    adj = cut_lineage(G.adjacency(g))  # read three times below; built once
    ents = g.nodes.where(F.col("label") == entity_label).select(F.col("node_id").alias("node"))
    pset = pest_entities.select(F.col("node_id").alias("nbr")).distinct().withColumn("_p", F.lit(1))
    deg = node_degrees(adj)
    per_z = adj.join(pset, "nbr").groupBy(F.col("node").alias("z")).agg(F.count(F.lit(1)).alias("_pz"))
    per_z = per_z.join(deg.select(F.col("node").alias("z"), F.col("deg").alias("_dz")), "z")
    e_adj = adj.join(ents, "node", "left_semi").withColumnRenamed("nbr", "z")
    is_p = pset.select(F.col("nbr").alias("node"), F.col("_p").alias("_self"))
    j = Spread(adj, "node", counts=deg.withColumnRenamed("deg", "n")).join(e_adj, per_z, "z", ["node"]).join(is_p, "node", "left") \
        .withColumn("_terms", F.col("_pz") - F.coalesce(F.col("_self"), F.lit(0)))
    agg = j.groupBy("node").agg(
        F.sum("_terms").cast("long").alias("cn_pest"),
        F.sum(F.when(F.col("_dz") > 1, F.col("_terms") / F.log("_dz")).otherwise(0.0)).alias("aa_pest"))
    return ents.join(agg, "node", "left").select(
        F.col("node").alias("node_id"),
        F.coalesce("cn_pest", F.lit(0)).cast("long").alias("cn_pest"),
        F.coalesce("aa_pest", F.lit(0.0)).alias("aa_pest"))


def _pair_order(seed: int = X.DEFAULT_SEED):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("entity_node_id"), F.lit("|"), F.col("pest_node_id")))


def link_train_set(g: G.Graph, test: float = 0.2, train: float = 0.6, folds: int = 3,
                   seed: int = X.DEFAULT_SEED) -> DataFrame:
    """L-8: every existing entity-outcome link (label 1) and as many unlinked
    pairs (label 0, md5 order); per class the first ceil(.2 n) rows are
    test, the next ceil(.6 of the rest) train, the remainder are kept for
    feature computation; fold = rank mod 3."""
    links = G.entity_outcome_links(g).select("entity_node_id", "pest_node_id")
    pairs = candidate_pairs(g)
    neg = pairs.where(~F.col("has_existing_relationship")).select("entity_node_id", "pest_node_id")
    n_pos = links.count()
    neg = R.class_rank(neg.withColumn("_g", F.lit(0)), "_g", _pair_order(seed), out="_rk") \
        .where(F.col("_rk") < n_pos).drop("_g", "_rk")
    samples = links.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))
    ranked = R.class_rank(samples, "label", _pair_order(seed), out="_rk")
    sizes = ranked.groupBy(F.col("label").alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = F.broadcast(sizes.withColumn("_t", F.ceil(F.col("_n") * test))
                        .withColumn("_tr", F.col("_t") + F.ceil((F.col("_n") - F.col("_t")) * train)))
    j = ranked.join(sizes, ranked["label"] == sizes["_l"])
    return j.select("entity_node_id", "pest_node_id", "label",
                    F.when(F.col("_rk") < F.col("_t"), "test").when(F.col("_rk") < F.col("_tr"), "train")
                    .otherwise("feature").alias("split"),
                    F.pmod(F.col("_rk"), F.lit(folds)).cast("int").alias("fold"))


def link_features(g: G.Graph, pairs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """L-9: the four heuristics and the cosine of the two nodes' vectors as
    one feature array (cosine 0 where a vector is missing or zero)."""
    outs = outcome_nodes(g).select("pest_node_id").distinct()      # at most len(OUTCOMES) rows, checked in candidate_pairs
    s = pair_scores(G.adjacency(g), pairs, a="entity_node_id", b="pest_node_id", b_nodes=outs)
    cols = ["adamic_adar_score", "jaccard_score", "common_neighbors_count", "preferential_attachment_score"]
    if vectors is not None:
        s = cosine_similarity(s, vectors, a="entity_node_id", b="pest_node_id")
        s = s.withColumn("cosine_similarity", F.coalesce("cosine_similarity", F.lit(0.0)))
        cols.append("cosine_similarity")
    return s.withColumn("features", F.array(*[F.col(c).cast("double") for c in cols]))


def link_vectors(g: G.Graph, dim: int = 32) -> DataFrame:
    """FastRP vectors for L-6, over the edges in both directions: in the directed graph nothing but inspections
    points at an entity and nothing points at those, so all entities would have zero vectors."""
    from riskgraph.operators import embed as EM
    both = g if g.undirected else G.project(g, orientation="undirected")
    return EM.fastrp(both, dim=dim, weights=(0.0, 1.0, 1.0))


def fit_link_model(feats: DataFrame, folds: int = 3):
    """L-10: logistic regression (penalty 1 as regParam 1 / n, 1000 iterations) on the train split of
    ``feats(features, label, split, fold)``: the model, the scaler's figures, the mean ROC AUC of the
    folds and that of the test split (None where a fold or the test split has no rows)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator
    from riskgraph.operators import models as MD
    train = feats.where(F.col("split") == "train")
    sizes = {r["fold"]: r["count"] for r in train.groupBy("fold").count().collect()}
    lr = MD.LogisticRegression(maxIter=1000, regParam=1.0 / max(sum(sizes.values()), 1), featuresCol="vec", labelCol="label")
    m, sd = MD.fit_standard_scaler(train)
    ev = BinaryClassificationEvaluator(labelCol="label")
    rows = MD.with_vector(MD.apply_scaler(train, m, sd))
    validated = None
    if len(sizes) == folds:
        found = CrossValidator(estimator=lr, estimatorParamMaps=[{}], evaluator=ev, foldCol="fold", numFolds=folds, parallelism=folds).fit(rows)
        model, validated = found.bestModel, float(found.avgMetrics[0])
    else:
        model = lr.fit(rows)
    test = feats.where(F.col("split") == "test")
    tested = float(ev.evaluate(model.transform(MD.with_vector(MD.apply_scaler(test, m, sd))))) if test.first() is not None else None
    return model, (m, sd), validated, tested


def link_model_predictions(g: G.Graph, samples: DataFrame, top_n: int = 10_000, threshold: float = 0.5,
                           dim: int = 32) -> DataFrame:
    """L-10 + L-11: the link model with its figures from the folds and the test split; every
    unlinked pest-outcome pair scored; the outcome filter runs before the top-N cut; best row per entity."""
    from riskgraph.operators import models as MD
    cand = candidate_pairs(g).where(~F.col("has_existing_relationship") & (F.col("pest_value") == 1))
    # samples and candidates get their features in one go; a candidate has no label
    pairs = samples.unionByName(cand.select("entity_id", "entity_node_id", "pest_node_id"), allowMissingColumns=True)
    feats = cut_lineage(link_features(g, pairs, link_vectors(g, dim)))
    model, (m, sd), validated, tested = fit_link_model(feats.where("label is not null"))
    cf = MD.apply_scaler(feats.where("label is null").select("entity_id", "features"), m, sd)
    scored = model.transform(MD.with_vector(cf)).withColumn(
        "pipeline_pest_score", MD.vector_to_array(F.col("probability"))[1])
    top = R.top_n(scored.select("entity_id", "pipeline_pest_score"), top_n, "pipeline_pest_score", "entity_id")
    top = top.withColumn("pipeline_pest_binary", X.threshold("pipeline_pest_score", threshold))
    links = G.entity_outcome_links(g)
    actual = R.entity_targets(links).select("entity_id", F.col("has_pest").alias("has_actual_pest"))
    best = R.best_per_key(top, "entity_id", "pipeline_pest_score", "entity_id")
    return R.attach_actuals(best, actual, "entity_id").withColumns({
        "validation_roc_auc": F.lit(validated).cast("double"), "test_roc_auc": F.lit(tested).cast("double")})
