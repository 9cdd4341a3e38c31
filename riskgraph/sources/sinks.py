"""Sinks: predictions, reports, graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _flatten_arrays(df: DataFrame) -> DataFrame:
    """CSV cannot hold arrays: ``array<double>`` columns go wide first."""
    cols = []
    for name, dtype in df.dtypes:
        if dtype.startswith("array<"):
            n = df.select(F.max(F.size(name))).first()[0] or 0
            cols += [F.col(name)[i].alias(f"{name}_{i}") for i in range(n)]
        elif dtype.startswith("vector"):
            from pyspark.ml.functions import vector_to_array
            cols.append(F.to_json(vector_to_array(F.col(name))).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A-W1: one writer for every scored table; CSV gets a header."""
    if fmt == "csv":
        _flatten_arrays(df).write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def read_predictions(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A table that ``write_predictions`` has written; CSV columns are checked against the header."""
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return spark.read.schema(schema).format(fmt).load(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report that ``write_report`` has written."""
    return spark.read.schema("section string, metric string, value double, text string").json(path)


def write_report(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A-W2: metrics rows (section, metric, value) as JSON lines."""
    metrics.write.mode(mode).json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A-W3: node and edge tables, partitioned by label / relationship type so
    a projection reads only the partitions it names."""
    nodes.dropDuplicates(["node_id"]).write.mode(mode).partitionBy("label").parquet(f"{path}/nodes")
    edges.dropDuplicates(["src", "dst", "rel_type"]).write.mode(mode).partitionBy("rel_type") \
        .parquet(f"{path}/edges")
