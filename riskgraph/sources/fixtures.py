"""Stand-in inputs built from the driver tables (FIXTURES.md).

These only put rows into the schemas the jobs expect; none of the jobs'
work happens here.  Each builder is lazy and scales with its tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.operators import relational as R
from riskgraph.sources.tables import table

EMBED_DIM = 64


def inspections(spark: SparkSession, sf_dir: str, with_counters: bool = True) -> DataFrame:
    """FIXTURES §1: one inspection per order; entity = customer, country =
    the customer's nation, month and day of the order date; outcome =
    urgent and fulfilled.  The six trailing counters come from C-W4."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                              "o_orderpriority", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    day = F.col("o_orderdate").cast("date")
    base = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .select(F.col("o_orderkey").alias("inspection_id"),
                    F.col("o_custkey").alias("enty_id"),
                    F.col("n_name").alias("ctry_code"),
                    F.month(day).alias("month"),
                    F.unix_date(day).alias("insp_day"),
                    F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"), 1)
                     .otherwise(0).alias("target_proxy")))
    if not with_counters:
        return base
    return R.trailing_counts(base).select(
        "inspection_id", "enty_id", "ctry_code", "month", "insp_day", "target_proxy",
        "enty_exams_30d", "enty_pests_30d", "enty_exams_90d", "enty_pests_90d",
        "enty_exams_1yr", "enty_pests_1yr")


def embedding_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES §3: entity_id, embed_00..embed_63 (double), target_proxy."""
    e = table(spark, sf_dir, "embeddings")
    cols = [F.col("embedding")[i].cast("double").alias(f"embed_{i:02d}") for i in range(EMBED_DIM)]
    return e.select(F.col("vec_id").alias("entity_id"), *cols,
                    (F.col("label") >= 5).cast("int").alias("target_proxy"))


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with the vector kept whole: entity_id, features, label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("entity_id"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("features"),
                    (F.col("label") >= 5).cast("int").alias("label"))


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES §7: fixed scores for the metric operators.  score =
    value / max(value) rounded to 2 places (the maximum is one scalar)."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    mx = ev.agg(F.max("value")).first()[0]
    score = F.round(F.col("value") / F.lit(float(mx)), 2)
    return ev.select("event_id", "user_id", "ts", score.alias("score"),
                     F.col("event_type").isin("error", "purchase").cast("int").alias("label")) \
             .withColumn("predicted", (F.col("score") >= 0.1).cast("int"))


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES §6: features keyed by (filer, entry_nbr, line_nbr)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("filer"), F.col("l_orderkey").alias("entry_nbr"),
                      F.col("l_linenumber").alias("line_nbr")).agg(
        F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("extendedprice"),
        F.sum("l_discount").alias("discount"), F.sum("l_tax").alias("tax"))


def line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested keys for the batch lookup: every returned line (``R``)."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return li.select(F.col("l_suppkey").alias("filer"), F.col("l_orderkey").alias("entry_nbr"),
                     F.col("l_linenumber").alias("line_nbr"))


def cold_start_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES §5: numeric + categorical features and 64 ``fastrp_i``
    columns, blanked where vec_id % 5 = 0 (the reference's 800 : 200 split
    of known and new entities); the first blanked row carries an unseen
    category 'D'."""
    e = table(spark, sf_dir, "embeddings")
    blank = (F.col("vec_id") % 5) == 0
    first_blank = e.where(blank).agg(F.min("vec_id")).first()[0]
    cat = F.when(F.col("vec_id") == F.lit(first_blank), F.lit("D")) \
        .otherwise(F.expr("char(65 + label % 3)"))
    f3 = F.element_at(F.array(F.lit("X"), F.lit("Y"), F.lit("Z")), (F.col("label") % 3 + 1).cast("int"))
    fr = [F.when(blank, F.lit(None).cast("double")).otherwise(F.col("embedding")[i].cast("double"))
          .alias(f"fastrp_{i}") for i in range(EMBED_DIM)]
    return e.select(F.when(blank, F.concat(F.lit("new_entity_"), F.col("vec_id")))
                    .otherwise(F.concat(F.lit("entity_"), F.col("vec_id"))).alias("enty_id"),
                    cat.alias("category"),
                    F.col("embedding")[0].cast("double").alias("feature_1"),
                    (F.col("embedding")[1].cast("double") * 100).alias("feature_2"),
                    f3.alias("feature_3"), *fr)
