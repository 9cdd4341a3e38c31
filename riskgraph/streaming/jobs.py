"""Structured Streaming re-aims.

K-1: arriving line keys are joined to the static feature table and scored
with a saved model (stream-static join, ``availableNow`` trigger).
K-2: per-entity sliding 30-day exam / pest counts over event time: the stream
keeps day panes, which the watermark drops, and windows are put together from
the written panes; the result equals the batch aggregation over the same files.
Stream state and output tables go to the session's checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.session import ensure_checkpoint_dir


def run_to_table(df: DataFrame, mode: str, keys: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Run a stream to the end of its input (``availableNow``) into Parquet
    under the checkpoint folder; the written table, and how many rows came too late and
    how many rows of state were left.  Each
    micro-batch is written by the executors (``foreachBatch``) to a folder of its
    epoch.  Nothing is collected in the driver.  In update mode a row replaces
    the row of an earlier epoch with the same ``keys``."""
    spark = df.sparkSession
    name = f"rg_stream_{uuid.uuid4().hex[:10]}"
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/streams/{name}"
    out = f"{base}/table"
    q = (df.writeStream.outputMode(mode).foreachBatch(epoch_sink(out))
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    if q.lastProgress is None:
        return spark.createDataFrame([], df.schema), {"late": 0, "state": 0}
    state = [op for p in q.recentProgress for op in p["stateOperators"]]
    seen = {"late": sum(op["numRowsDroppedByWatermark"] for op in state), "state": state[-1]["numRowsTotal"] if state else 0}
    table = spark.read.schema(df.schema.add("epoch", "long")).parquet(out)
    if mode == "update":
        rest = [c for c in df.columns if c not in keys]
        last = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r"))
        table = last.select(*keys, "r.*").select(*df.columns)
    return table.select(*df.columns), seen


def epoch_sink(out: str):
    """Sink that writes each micro-batch to a folder of its own and replaces it
    when the batch is run again, so a retried batch leaves no row twice."""
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    return sink


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """File-stream source over one table: a folder, or one file of a folder
    (selected with ``pathGlobFilter``, since stream sources take folders; a path that names a
    Parquet table is looked up by Spark's own file system)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))
    return reader.parquet(path)


def stream_score(keys: DataFrame, features: DataFrame, model: PipelineModel, on: list[str]) -> DataFrame:
    """K-1: score every arriving key against the feature table (stream-static join)."""
    scored = model.transform(keys.join(features, on=on, how="inner"))
    out = scored.select(*on, vector_to_array("probability")[1].alias("score"))
    return run_to_table(out, "append")[0]


def stream_panes(events: DataFrame, entity: str, ts: str, watermark: str) -> tuple[DataFrame, dict]:
    """Exams and pests per entity and day from a stream of events: ``day, entity_id, exams, pests``.

    An event adds to one row of state.  A day's rows leave the state once the watermark has passed the day;
    events of such a day come too late and are dropped.  Update mode writes the changed days only."""
    ev = events.withColumn("_ts", F.col(ts).cast("timestamp")).withColumn("_pest", F.col("event_type").isin("error", "purchase").cast("int"))
    agg = ev.withWatermark("_ts", watermark).groupBy(F.window("_ts", "1 day").alias("w"), F.col(entity).alias("entity_id")) \
        .agg(F.count(F.lit(1)).alias("exams"), F.sum("_pest").cast("long").alias("pests"))
    out = agg.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "entity_id", "exams", "pests")
    return run_to_table(out, "update", ["day", "entity_id"])


def windows_of_panes(panes: DataFrame, days: int = 30) -> DataFrame:
    """Every ``days``-day window (one starting each day) of the day panes."""
    spread = panes.withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    start = F.expr("day - make_dt_interval(_back)")
    return (spread.groupBy(start.alias("window_start"), "entity_id").agg(F.sum("exams").alias("exams"), F.sum("pests").alias("pests"))
            .select("window_start", F.expr(f"window_start + make_dt_interval({days})").alias("window_end"), "entity_id", "exams", "pests"))


def stream_trailing_counts(spark: SparkSession, events_path: str, schema: str, entity: str = "user_id",
                           ts: str = "ts", days: int = 30, watermark: str = "30 days", files_per_batch: int | None = None) -> DataFrame:
    """K-2: sliding-window exam and pest counts per entity, event time with a watermark.

    Event times are wall-clock ``timestamp_ntz``; watermarks need
    ``timestamp``, so the stream runs with the session zone pinned to UTC
    (restored afterwards) and casts the days back to
    ``timestamp_ntz`` before the sink."""
    old_tz = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        panes, _ = stream_panes(read_stream(spark, events_path, schema, files_per_batch), entity, ts, watermark)
        return windows_of_panes(panes, days)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old_tz)
