"""Joins, aggregations, windows, sorts and set operations.

Scale rules followed throughout:
* no window is partitioned by a low-cardinality key (a class, a hub):
  per-key "best row" is a ``groupBy`` with a struct ``min`` (map-side
  combine), per-class ranks come from :func:`class_rank` (range partitions);
* global scalars (maxima, totals) are one-row aggregates brought to the
  driver as literals, never an unpartitioned window or a cross join;
* trailing counters aggregate per (entity, day) before windowing, so a hot
  entity holds at most one row per calendar day in its window partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.functions import expr as X
from riskgraph.session import cut_lineage

# ---------------------------------------------------------------------------
# C-W4 trailing counters
# ---------------------------------------------------------------------------
TRAILING_FRAMES = {"30d": 30, "90d": 90, "1yr": 365}


def trailing_counts(insp: DataFrame, entity: str = "enty_id", day: str = "insp_day",
                    target: str = "target_proxy",
                    frames: Mapping[str, int] = TRAILING_FRAMES) -> DataFrame:
    """C-W4: for every row, the entity's rows and outcome sum in the previous
    n days (this day excluded).  Rows are first reduced to one per
    (entity, day), the window runs over that, and the counters are joined
    back on (entity, day)."""
    daily = insp.groupBy(entity, day).agg(F.count(F.lit(1)).alias("_n"),
                                          F.sum(F.col(target).cast("long")).alias("_p"))
    w = Window.partitionBy(entity).orderBy(day)
    cols = {}
    for name, n in frames.items():
        frame = w.rangeBetween(-n, -1)
        cols[f"enty_exams_{name}"] = F.coalesce(F.sum("_n").over(frame), F.lit(0)).cast("long")
        cols[f"enty_pests_{name}"] = F.coalesce(F.sum("_p").over(frame), F.lit(0)).cast("long")
    daily = daily.withColumns(cols).drop("_n", "_p")
    return insp.join(daily, on=[entity, day], how="inner")


# ---------------------------------------------------------------------------
# C-A aggregates
# ---------------------------------------------------------------------------
def entity_targets(links: DataFrame, entity: str = "entity_id", value: str = "target_value") -> DataFrame:
    """C-A1: per entity over its *distinct* outcome links (reference result,
    T1): count, sum, max, avg of the outcome value."""
    d = links.select(entity, value).dropDuplicates([entity, value])
    return d.groupBy(entity).agg(
        F.count(F.lit(1)).alias("total_inspections"),
        F.sum(F.col(value).cast("long")).alias("pest_inspections"),
        F.max(F.col(value)).cast("int").alias("has_pest"),
        F.avg(F.col(value).cast("double")).alias("pest_rate"))


def entity_targets_by_inspection(insp: DataFrame, entity: str = "enty_id",
                                 target: str = "target_proxy") -> DataFrame:
    """C-A2: the same four figures per inspection row (intent of T1)."""
    return insp.groupBy(F.col(entity).alias("entity_id")).agg(
        F.count(F.lit(1)).alias("total_inspections"),
        F.sum(F.col(target).cast("long")).alias("pest_inspections"),
        F.max(F.col(target)).cast("int").alias("has_pest"),
        F.avg(F.col(target).cast("double")).alias("pest_rate"))


def target_summary(t: DataFrame, rate: str = "pest_rate", flag: str = "has_pest") -> DataFrame:
    """C-A3: entities, mean/min/max rate, entities with a pest."""
    return t.agg(F.count(F.lit(1)).alias("entities"),
                 F.avg(rate).alias("avg_pest_rate"), F.min(rate).alias("min_pest_rate"),
                 F.max(rate).alias("max_pest_rate"),
                 F.count_if(F.col(flag) == 1).alias("entities_with_pest"))


def risk_distribution(t: DataFrame, col: str = "pest_rate", scale: str = "rate") -> DataFrame:
    """C-A4: entities per band, ordered by band name."""
    return t.where(F.col(col).isNotNull()) \
        .groupBy(X.risk_band(col, scale).alias("risk_category")) \
        .agg(F.count(F.lit(1)).alias("entity_count")).orderBy("risk_category")


def class_distribution(df: DataFrame, col: str) -> DataFrame:
    """C-A5: count and percent per class.  The total is the sum over the
    grouped rows (one per class), never a pass over the raw rows."""
    g = df.groupBy(F.col(col).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n")).first()[0] or 0
    return g.withColumn("percent", F.col("n") * 100.0 / F.lit(total if total else None))


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """C-A6: NULL (and NaN) count per column in one pass, unpivoted, plus total."""
    cols = list(cols or df.columns)
    types = dict(df.dtypes)

    def miss(c: str) -> Column:
        x = F.col(c).isNull()
        if types[c] in ("double", "float"):
            x = x | F.isnan(F.col(c))
        return F.sum(x.cast("long")).alias(c)
    wide = df.agg(*[miss(c) for c in cols])
    long = wide.unpivot([], cols, "column_name", "missing")
    tot = wide.select(F.lit("__total__").alias("column_name"),
                      reduce(lambda a, b: a + b, [F.col(c) for c in cols]).alias("missing"))
    return long.unionByName(tot)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def entity_outcome_max(links: DataFrame, entity: str = "entity_id", value: str = "target_value") -> DataFrame:
    """C-A16: grouped by (entity, value), ``max(value)``: equals the value."""
    return links.groupBy(entity, value).agg(F.max(value).alias("has_pest_ever"))


def rollup_max(df: DataFrame, key: str, cols: Mapping[str, str]) -> DataFrame:
    """C-A7: per key, max of each column (booleans via int)."""
    types = dict(df.dtypes)
    aggs = [F.max(F.col(c).cast("int") if types[c] == "boolean" else F.col(c)).alias(out)
            for c, out in cols.items()]
    return df.groupBy(key).agg(*aggs)


def prediction_summary(pred: DataFrame, score: str, actual: str, binary: str | None = None,
                       thresholds: Sequence[float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """C-A8: totals, predicted, actual, mean/min/max score, count per threshold."""
    aggs = [F.count(F.lit(1)).alias("total"),
            F.count_if(F.col(actual) == 1).alias("actual_positive"),
            F.avg(score).alias("mean_score"), F.min(score).alias("min_score"),
            F.max(score).alias("max_score")]
    if binary:
        aggs.append(F.count_if(F.col(binary) == 1).alias("predicted_positive"))
    for t in thresholds:
        aggs.append(F.count_if(F.col(score) >= t).alias(f"n_ge_{str(t).replace('.', '')}"))
    return pred.agg(*aggs)


def precision_recall(pred: DataFrame, predicted: str, actual: str) -> DataFrame:
    """C-A9: TP / predicted and TP / actual, 0 when the divisor is 0."""
    a = pred.agg(F.count_if((F.col(predicted) == 1) & (F.col(actual) == 1)).alias("tp"),
                 F.count_if(F.col(predicted) == 1).alias("predicted_positive"),
                 F.count_if(F.col(actual) == 1).alias("actual_positive"),
                 F.count(F.lit(1)).alias("total"))
    return a.withColumns({
        "precision": F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted_positive")), F.lit(0.0)),
        "recall": F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("actual_positive")), F.lit(0.0)),
    })


def confusion_matrix(df: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """C-A15: counts of the 2x2 (actual, predicted) cells, zeros included."""
    return df.agg(*[F.count_if((F.col(y).cast("int") == a) & (F.col(yhat).cast("int") == p))
                    .alias(f"n_{a}{p}") for a in (0, 1) for p in (0, 1)]) \
        .select(F.explode(F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                                             F.col(f"n_{a}{p}").alias("n"))
                                    for a in (0, 1) for p in (0, 1)])).alias("c")).select("c.*")


def mean_embedding(df: DataFrame, col: str = "embedding", by: Sequence[str] = ()) -> DataFrame:
    """C-A13: element-wise mean of complete vectors (optionally per group).

    Vectors stay whole: one partial sum vector per group and map task.
    Rows with a missing element are skipped; without rows there is no mean vector."""
    ok = df.where(~X.has_missing(col))
    per = ok.groupBy(*by).agg(Summarizer.mean(array_to_vector(F.col(col).cast("array<double>"))).alias("m"), F.count(F.lit(1)).alias("n"))
    return per.where("n > 0").select(*by, vector_to_array("m").alias(col))


def category_mean_embedding(df: DataFrame, keys: DataFrame, cat: str, col: str = "embedding") -> DataFrame:
    """C-A14: default embedding per category; unknown category -> global mean."""
    per_cat = mean_embedding(df, col, by=[cat]).withColumnRenamed(col, "_cat_mean")
    glob = mean_embedding(df, col).first()
    gvec = glob[col] if glob else None
    out = keys.join(per_cat, on=cat, how="left")
    return out.withColumn(col, F.coalesce(F.col("_cat_mean"),
                                          F.lit(gvec).cast("array<double>") if gvec is not None
                                          else F.lit(None).cast("array<double>"))).drop("_cat_mean")


# ---------------------------------------------------------------------------
# C-J joins
# ---------------------------------------------------------------------------
def assemble_features(base: DataFrame, frames: Iterable[DataFrame], key: str = "node_id") -> DataFrame:
    """C-J1: inner-join a chain of per-node feature frames on one key.  All
    sides are hash-partitioned on ``key``, so one exchange per side and the
    joins chain without re-shuffling."""
    return reduce(lambda a, b: a.join(b, on=key, how="inner"), frames, base)


def attach_actuals(pred: DataFrame, actual: DataFrame, key: str = "entity_id") -> DataFrame:
    """C-J2: left join predictions to actual outcomes."""
    return pred.join(actual, on=key, how="left")


def merge_predictions(c: DataFrame, r: DataFrame, key: str = "entity_id") -> DataFrame:
    """C-J4: full outer join of two prediction sets on the key."""
    return c.join(r, on=key, how="full")


def mark_existing(pairs: DataFrame, links: DataFrame, on: Sequence[str],
                  flag: str = "has_existing_relationship") -> DataFrame:
    """C-J6: flag pairs already linked (left join on the distinct links)."""
    l = links.select(*on).dropDuplicates(list(on)).withColumn(flag, F.lit(True))
    return pairs.join(l, on=list(on), how="left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def linked(pairs: DataFrame, links: DataFrame, on: Sequence[str]) -> DataFrame:
    return pairs.join(links.select(*on), on=list(on), how="left_semi")


def unlinked(pairs: DataFrame, links: DataFrame, on: Sequence[str]) -> DataFrame:
    return pairs.join(links.select(*on), on=list(on), how="left_anti")


# ---------------------------------------------------------------------------
# C-W windows / ranks
# ---------------------------------------------------------------------------
def best_per_key(df: DataFrame, key: str | Sequence[str], score: str, tie: str,
                 descending: bool = True) -> DataFrame:
    """C-W1: the first row per key after ordering by score (desc), tie (asc).

    A ``groupBy`` with a struct ``min`` instead of ``row_number`` over a
    window: partial aggregation keeps a hot key to one row per map task."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    s = F.col(score)
    order = [s.isNull().alias("_null"), (-s if descending else s).alias("_ord"), F.col(tie).alias("_tie")]
    packed = F.struct(*order, *[F.col(c) for c in rest])
    best = df.groupBy(*keys).agg(F.min(packed).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def top_k_per_key(df: DataFrame, key: str, order: str | Column, k: int, out: str = "rank") -> DataFrame:
    """The k first rows per key by ``order`` (unique per key), exact.

    Two phases so a hot key never lands whole in one task: rows are first
    ranked inside (key, salt) groups, where salt spreads a key over 64
    buckets, and only each bucket's k first survive; the final window then
    sees at most 64 k rows per key."""
    o = order if isinstance(order, Column) else F.col(order)
    d = df.withColumn("_o", o).withColumn("_salt", F.pmod(F.hash(F.col("_o")), F.lit(64)))
    w1 = Window.partitionBy(key, "_salt").orderBy("_o")
    pre = d.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(key).orderBy("_o")
    return pre.withColumn(out, F.row_number().over(w2)).where(F.col(out) <= k).drop("_o")


def class_rank(df: DataFrame, by: str, order: str | Column, out: str = "class_rank",
               partitions: int | None = None) -> DataFrame:
    """0-based rank of every row inside its ``by`` group, ordered by ``order``
    (ties: whatever order range partitioning yields; use unique orders).

    Exact and skew-safe: rows are range-partitioned on (by, order), which
    splits even a single huge group over many tasks, and frozen; rows are numbered
    inside (partition, group), and a group's counts in earlier partitions (a
    DataFrame with at most one row per partition for each group) are added.
    A NULL group is a group of its own.  Nothing reaches the driver."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.withColumn("_rank_ord", order if isinstance(order, Column) else F.col(order)) \
        .repartitionByRange(n, F.col(by), F.col("_rank_ord")).withColumn("_rank_pid", F.spark_partition_id())
    ordered = cut_lineage(ordered)  # freeze partition contents before numbering
    sizes = ordered.groupBy(F.col("_rank_pid").alias("_rank_p"), F.col(by).alias("_rank_g")).agg(F.count(F.lit(1)).alias("_rank_n"))
    before = sizes.select("_rank_p", "_rank_g", (F.sum("_rank_n").over(Window.partitionBy("_rank_g").orderBy("_rank_p")) - F.col("_rank_n")).alias("_rank_before"))
    local = F.row_number().over(Window.partitionBy("_rank_pid", by).orderBy("_rank_ord"))
    ranked = ordered.withColumn("_rank_r", local).join(
        before, (F.col("_rank_pid") == F.col("_rank_p")) & F.col(by).eqNullSafe(F.col("_rank_g")))
    return ranked.withColumn(out, (F.col("_rank_before") + F.col("_rank_r") - 1).cast("long")) \
        .drop("_rank_ord", "_rank_pid", "_rank_p", "_rank_g", "_rank_n", "_rank_before", "_rank_r")


def running_sums(df: DataFrame, order: str, cols: Sequence[str], descending: bool = False,
                 inclusive: bool = True, partitions: int | None = None) -> DataFrame:
    """Running totals of ``cols`` along a global order (``cum_<col>``),
    without an unpartitioned window: range partitions, per-partition totals
    (one scalar per partition and column) as offsets, local ``cumsum``.
    ``order`` values must be unique (e.g. one row per distinct score)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = F.col(order).desc() if descending else F.col(order).asc()
    ordered = cut_lineage(df.repartitionByRange(n, o).sortWithinPartitions(o))
    tots = ordered.groupBy(F.spark_partition_id().alias("pid")).agg(
        *[F.sum(c).alias(c) for c in cols]).collect()
    offsets, run = {}, {c: 0 for c in cols}
    for r in sorted(tots, key=lambda r: r["pid"]):
        offsets[r["pid"]] = dict(run)
        for c in cols:
            run[c] += r[c] or 0
    bc = spark.sparkContext.broadcast(offsets)
    types = dict(ordered.dtypes)
    fields = list(ordered.schema.fields) + [
        T.StructField(f"cum_{c}", T.DoubleType() if types[c] in ("double", "float") else T.LongType(), False)
        for c in cols]

    def accumulate(it):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        carry = dict(bc.value.get(pid, {c: 0 for c in cols}))
        for pdf in it:
            if pdf.empty:
                continue
            add = {}
            for c in cols:
                cs = pdf[c].fillna(0).cumsum()
                add[f"cum_{c}"] = (cs if inclusive else cs - pdf[c].fillna(0)) + carry[c]
                carry[c] = carry[c] + pdf[c].fillna(0).sum()
            yield pdf.assign(**add)
    return ordered.mapInPandas(accumulate, T.StructType(fields))


def stratified_split(df: DataFrame, y: str, key: str, test: float = 0.2, seed: int = X.DEFAULT_SEED,
                     out: str = "is_test") -> DataFrame:
    """C-W2: per class, the first ceil(n_c * test) rows in md5(seed:key) order
    are the test rows; class proportions are exact."""
    ranked = class_rank(df, y, F.concat(X.seeded_order(key, seed), F.lit(":"), F.col(key).cast("string")))
    sizes = ranked.groupBy(F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per class; Catalyst broadcasts it if it is small
    sizes = sizes.withColumn("_k", F.ceil(F.col("_n") * F.lit(test)))
    res = ranked.join(sizes, ranked[y].eqNullSafe(sizes["_y"]), "inner")
    return res.withColumn(out, F.col("class_rank") < F.col("_k")).drop("_y", "_n", "_k", "class_rank")


def kfold_assign(df: DataFrame, y: str, key: str, k: int = 5, seed: int = X.DEFAULT_SEED,
                 out: str = "fold") -> DataFrame:
    """C-W3: class-balanced folds: fold = rank-in-class mod k."""
    ranked = class_rank(df, y, F.concat(X.seeded_order(key, seed), F.lit(":"), F.col(key).cast("string")))
    return ranked.withColumn(out, F.pmod(F.col("class_rank"), F.lit(k)).cast("int")).drop("class_rank")


# ---------------------------------------------------------------------------
# C-O sorts / limits
# ---------------------------------------------------------------------------
def order_by_score(df: DataFrame, score: str, tie: str) -> DataFrame:
    """C-O1."""
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(tie).asc())


def top_n(df: DataFrame, n: int, score: str, tie: str) -> DataFrame:
    """C-O2/C-O3/C-O5: ``orderBy.limit`` (TakeOrderedAndProject: each task
    keeps its own top n, one task merges n x tasks rows)."""
    return order_by_score(df, score, tie).limit(n)


def leaderboard(metrics: DataFrame, by: str, name: str = "model", n: int = 5) -> DataFrame:
    """C-O4: models ordered by a metric, top n."""
    return top_n(metrics, n, by, name)


def best_model(metrics: DataFrame, by: str, name: str = "model") -> DataFrame:
    return metrics.agg(F.max_by(F.col(name), F.struct(F.col(by), F.col(name))).alias("best_model"),
                       F.max(by).alias(f"best_{by}"))


# ---------------------------------------------------------------------------
# C-U set operations, C-D16 key violations
# ---------------------------------------------------------------------------
def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """C-U1."""
    return a.unionByName(b, allowMissingColumns=True)


def missing_columns(expected: Sequence[str], present: Sequence[str]) -> list[str]:
    """C-U3 over names (a schema, not data)."""
    have = set(present)
    return [c for c in expected if c not in have]


def key_violations(nodes: DataFrame, label: str = "label", key: str = "key") -> DataFrame:
    """C-D16: (label, key) occurring more than once."""
    return nodes.groupBy(label, key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def max_normalize(df: DataFrame, cols: Sequence[str], suffix: str = "_normalized") -> DataFrame:
    """B-P17: x / max(x), 0 when max <= 0.  One aggregate pass gives the
    maxima as scalars (driver literals); no window over all rows."""
    row = df.agg(*[F.max(c).alias(c) for c in cols]).first()
    out = {}
    for c in cols:
        m = row[c]
        out[f"{c}{suffix}"] = (F.col(c) / F.lit(float(m))) if m is not None and m > 0 else F.lit(0.0)
    return df.withColumns(out)


def weighted_sum(cols: Mapping[str, float]) -> Column:
    """B-P18: sum of weight x column."""
    return reduce(lambda a, b: a + b, [F.col(c) * F.lit(w) for c, w in cols.items()])

