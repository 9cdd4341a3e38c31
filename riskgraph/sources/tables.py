"""Readers: explicit schemas in, feature discovery over
``df.columns``.  Every reader is lazy; Catalyst prunes columns and pushes
filters into the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.functions import expr as X

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")

# inspection rows as the reference's CSV carries them (§1.2)
INSPECTION_SCHEMA = T.StructType([
    T.StructField("ENTY_ID", T.StringType(), False),
    T.StructField("CTRY_CODE", T.StringType(), True),
    T.StructField("MONTH", T.StringType(), True),
    T.StructField("TARGET_PROXY", T.IntegerType(), True),
    T.StructField("ENTY_EXAMS_30D", T.IntegerType(), True),
    T.StructField("ENTY_PESTS_30D", T.IntegerType(), True),
    T.StructField("ENTY_EXAMS_90D", T.IntegerType(), True),
    T.StructField("ENTY_PESTS_90D", T.IntegerType(), True),
    T.StructField("ENTY_EXAMS_1YR", T.IntegerType(), True),
    T.StructField("ENTY_PESTS_1YR", T.IntegerType(), True),
])

INSPECTION_RENAMES = {
    "ENTY_ID": "enty_id", "CTRY_CODE": "ctry_code", "MONTH": "month",
    "TARGET_PROXY": "target_proxy",
    "ENTY_EXAMS_30D": "enty_exams_30d", "ENTY_PESTS_30D": "enty_pests_30d",
    "ENTY_EXAMS_90D": "enty_exams_90d", "ENTY_PESTS_90D": "enty_pests_90d",
    "ENTY_EXAMS_1YR": "enty_exams_1yr", "ENTY_PESTS_1YR": "enty_pests_1yr",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in DRIVER_TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


BAD_ROW = "_bad_row"


def read_inspections(spark: SparkSession, path: str, fmt: str = "csv", keep_bad: bool = False) -> DataFrame:
    """A-S1: inspection rows with the §1.2 schema (never ``inferSchema``);
    upper-case source names are mapped to lower case.

    A CSV line that doesn't fit the schema (a word where a number stands, too few or too many
    fields) is set aside: left out, or with ``keep_bad`` kept with its text in ``_bad_row``
    (NULL for good rows)."""
    if fmt == "csv":
        # read as text and cast here: the reader's own cast looks at the selected columns only, so that
        # which lines are bad would depend on the query
        fields = INSPECTION_SCHEMA.fields
        text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in fields], T.StructField("_line", T.StringType())])
        raw = spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").csv(path)
        typed = {f.name: F.expr(f"try_cast({f.name} AS {f.dataType.simpleString()})") for f in fields}
        odd = F.lit(False)
        for f in fields:
            odd = odd | (F.col(f.name).isNotNull() & typed[f.name].isNull())
        line = F.concat_ws(",", *[F.coalesce(F.col(f.name), F.lit("")) for f in fields])
        df = raw.select(*[typed[f.name].alias(f.name) for f in fields], F.coalesce(F.col("_line"), F.when(odd, line)).alias(BAD_ROW))
    else:
        df = spark.read.schema(INSPECTION_SCHEMA).format(fmt).load(path).withColumn(BAD_ROW, F.lit(None).cast("string"))
    df = df.withColumnsRenamed(INSPECTION_RENAMES)
    return df if keep_bad else df.where(F.col(BAD_ROW).isNull()).drop(BAD_ROW)


def inspection_summary(insp: DataFrame) -> DataFrame:
    """A-S1 log line as a one-row frame: rows and distinct entities (and bad rows, if they were kept)."""
    if BAD_ROW in insp.columns:
        good = F.col(BAD_ROW).isNull()
        return insp.agg(F.count_if(good).alias("n_rows"), F.countDistinct(F.when(good, F.col("enty_id"))).alias("n_entities"),
                        F.count_if(~good).alias("n_bad"))
    return insp.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.countDistinct("enty_id").alias("n_entities"))


def read_embeddings(df: DataFrame, prefix: str = "embed_", target: str = "target_proxy",
                    key: str = "entity_id") -> DataFrame:
    """A-S2: a wide embedding table; features by name prefix, kept whole as
    one ``array<double>`` column."""
    out = X.columns_to_embedding(df, prefix, out="features")
    return out.select(F.col(key), F.col("features"), F.col(target).cast("int").alias(target))


def read_entity_features(df: DataFrame, target: str = "has_pest_ever",
                         exclude: Sequence[str] = ("nodeId", "entity_id", "has_pest_ever", "pest_rate"),
                         threshold: float | None = None) -> DataFrame:
    """A-S3: drop rows with a NULL target, make the target binary and list the
    feature columns (all columns not excluded, in table order)."""
    df = df.dropna(subset=[target])
    y = (F.col(target) > threshold).cast("int") if threshold is not None else F.col(target).cast("int")
    feats = [c for c in df.columns if c not in set(exclude)]
    return df.select("entity_id", *feats, y.alias("label"))


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    ex = set(exclude)
    return [c for c, t in df.dtypes if c not in ex and t in ("double", "float", "int", "bigint")]


def read_new_entities(spark: SparkSession, path: str, features: Sequence[str], key: str = "entity_id") -> DataFrame:
    """A-S5: new rows of a CSV with header: the trained feature columns in training order, as numbers.

    Columns are found by name, whatever their order in the file; others are ignored, a lacking one is an
    error, a value that is no number is NULL (for the fill or imputation that follows)."""
    df = spark.read.option("header", True).csv(path)
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"new-entity table lacks trained features: {missing}")
    return df.select(key, *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in features])


def lookup_features(features: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """A-S4: features for a batch of requested composite keys.

    An equi-join on the full key; Catalyst broadcasts ``keys`` when its
    statistics say it is small and shuffles both sides otherwise.
    """
    return features.join(keys.select(*on).dropDuplicates(list(on)), on=list(on), how="inner")
