"""Exact quantiles of many columns in one distributed job.

Values are counted as (column, value) with partial aggregation, range-partitioned on
both, so that one column spreads over all tasks; counts ahead of a partition come from a
small table of counts by partition and column, positions inside it from a running sum.  The one or two
values at each wanted position are picked out and interpolated.  No task holds a column's values
and the driver gets one row per column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.session import cut_lineage


def exact_quantiles(values: DataFrame, probabilities: Sequence[float], partitions: int | None = None) -> DataFrame:
    """``dim, n, q`` for ``values(dim, x)`` or counted ``values(dim, x, n)``: q holds the quantile (linear interpolation between neighbours) for each
    probability.  Null values don't count; NaN is larger than all numbers; a column without values has no row."""
    spark = values.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    times = F.col("n") if "n" in values.columns else F.lit(1)
    counted = values.select("dim", F.col("x").cast("double").alias("x"), times.cast("long").alias("n")).where("x is not null").groupBy("dim", "x").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted.repartitionByRange(parts, "dim", "x").withColumn("_pid", F.spark_partition_id()))
    sizes = counted.groupBy("_pid", "dim").agg(F.sum("n").alias("_size"))               # a row per partition and column in it
    by_dim = Window.partitionBy("dim")
    ahead = sizes.select("_pid", "dim", (F.sum("_size").over(by_dim.orderBy("_pid")) - F.col("_size")).alias("_ahead"), F.sum("_size").over(by_dim).alias("_total"))
    inside = F.sum("n").over(Window.partitionBy("_pid", "dim").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("_end", inside).join(ahead, ["_pid", "dim"])
    last = F.col("_ahead") + F.col("_end") - 1                                         # position of the value's last copy
    first = last - F.col("n") + 1
    for i, p in enumerate(probabilities):
        at = (F.col("_total") - 1) * F.lit(float(p))
        for name, pos in ((f"_lo{i}", F.floor(at)), (f"_hi{i}", F.ceil(at))):
            ranked = ranked.withColumn(name, F.when((first <= pos) & (last >= pos), F.col("x")))
    picked = ranked.groupBy("dim").agg(F.max("_total").alias("n"), *[F.max(f"_{s}{i}").alias(f"_{s}{i}") for i in range(len(probabilities)) for s in ("lo", "hi")])
    out = []
    for i, p in enumerate(probabilities):
        at = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append(F.when(lo == hi, lo).otherwise(lo * (F.ceil(at) - at) + hi * (at - F.floor(at))))
    return picked.select("dim", "n", F.array(*out).alias("q"))


def column_quantiles(df: DataFrame, cols: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles of each of ``cols`` (a column without values is left out); one row per column reaches the driver."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("double").alias("x")) for c in cols]))
    return {r["dim"]: list(r["q"]) for r in exact_quantiles(df.select(pairs.alias("v")).select("v.dim", "v.x"), probabilities).collect()}


def position_quantiles(df: DataFrame, col: str, probabilities: Sequence[float]) -> Mapping[int, list[float]]:
    """Quantiles of each position of an array column."""
    long = df.select(F.posexplode(col).alias("dim", "x"))
    return {r["dim"]: list(r["q"]) for r in exact_quantiles(long, probabilities).collect()}
