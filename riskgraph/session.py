"""Spark session set-up, checkpoint directory and the iterative-loop helper."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "riskgraph") -> SparkSession:
    """Session with AQE (coalesce + skew join), UTC and Arrow; no UI server."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("RISKGRAPH_SHUFFLE_PARTITIONS", cpus))
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RISKGRAPH_DRIVER_MEMORY", "4g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only when it is unset (local tests) is a scratch folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="riskgraph-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written to the shared checkpoint folder, so the
    result survives the loss of an executor (never ``localCheckpoint``).

    The size that the planner takes for the result is that of the written
    files.  ``checkpoint()`` alone hands on the estimate of the plan that it
    cuts; joins multiply estimates, so a loop's would grow without end."""
    ensure_checkpoint_dir(df.sparkSession)
    return _with_size(df.checkpoint(eager=True))


def _with_size(done: DataFrame) -> DataFrame:
    """A checkpointed frame whose estimated size is the size of its files."""
    spark = done.sparkSession
    jvm = spark._jvm
    plan = done._jdf.queryExecution().analyzed()
    none = getattr(jvm.scala, "None$").__getattr__("MODULE$")
    # py4j can't pass the planner's big integers, so a range of as many bytes lends its estimate
    longs = -(-max(1, _checkpoint_bytes(spark, plan.rdd())) // 8)
    stats = spark.range(longs)._jdf.queryExecution().analyzed().stats()
    sized = jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none,
        spark._jsparkSession, jvm.scala.Some(stats), none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, sized), spark)


def _checkpoint_bytes(spark: SparkSession, rdd) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def estimated_bits(df: DataFrame) -> int:
    """Length in bits of the planner's size estimate for ``df``."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


class Loop:
    """Bookkeeping for DataFrame iterations: cut lineage every ``every`` turns
    and keep the partition count fixed so AQE does not merge a growing state
    into a few large partitions."""

    def __init__(self, every: int = 4, partitions: int | None = None):
        self.every = max(1, every)
        self.partitions = partitions
        self.turn = 0

    def step(self, df: DataFrame, key: str | None = None) -> DataFrame:
        self.turn += 1
        if self.turn % self.every == 0:
            if self.partitions and key:
                df = df.repartition(self.partitions, key)
            df = cut_lineage(df)
        return df
