"""Joins on keys that may be hot, and tables that keep their layout over the turns of a loop.

Graph operators join many rows (edges, walkers, shared neighbours) with one
table of a few rows per node.  A node may hold a third of the edges, so a key with
more than ``T`` rows is dealt out to ``ceil(rows / T)`` salts: each of its many rows goes to the salt that the hash
of its other columns names, and the node's own row is repeated for each salt.
``T = max(ROWS, rows / (SHARE * partitions))``, a quarter of what a task gets on average: no more than
``SHARE * partitions`` keys can be salted, so their table has a proven bound and is broadcast, and all
salts together repeat no more than twice as many rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.session import cut_lineage, ensure_checkpoint_dir

ROWS = 10_000          # keys of fewer rows are never hot
SHARE = 4
HEAVY = 4096              # a source of more than 1 in HEAVY edges has its vector sent to all tasks
SALT = "_salt"


class Spread:
    """Salts of the hot keys of ``many[key]``.  ``factor``: rows that a row of ``many`` stands for;
    ``rows``: another threshold than the module's."""

    def __init__(self, many: DataFrame, key: str, rows: int | None = None, factor: int = 1, counts: DataFrame | None = None):
        """``counts(<key>, n)``: the rows of each key, if they are known already."""
        if counts is None:
            counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        counts = counts.select(F.col(key).alias("_key"), (F.col("n") * factor).alias("_n"))
        total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
        parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.threshold = rows or max(ROWS, -(-(total or 0) // (SHARE * parts)))
        self.n_hubs = 0
        if (most or 0) > self.threshold:
            self.salts = cut_lineage(counts.where(F.col("_n") > self.threshold)
                                     .select("_key", F.ceil(F.col("_n") / F.lit(self.threshold)).cast("int").alias("_salts")))
            self.n_hubs = self.salts.count()

    def many(self, df: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
        """``df`` with the salt of each row: the hash of the columns ``by``, which tell the rows of a key apart."""
        if not self.n_hubs:
            return df.withColumn(SALT, F.lit(0))
        hubs = F.broadcast(self.salts.select(F.col("_key").alias(key), "_salts"))
        salt = F.coalesce(F.pmod(F.xxhash64(*by, F.lit(11)), F.col("_salts")).cast("int"), F.lit(0))
        return df.join(hubs, key, "left").withColumn(SALT, salt).drop("_salts")

    def one(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` with each row repeated for each salt of its key."""
        if not self.n_hubs:
            return df.withColumn(SALT, F.lit(0))
        hubs = F.broadcast(self.salts.select(F.col("_key").alias(key), "_salts"))
        return df.join(hubs, key, "left").withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))).drop("_salts")

    def join(self, many: DataFrame, one: DataFrame, key: str, by: Sequence[str], on: Sequence[str] = (), how: str = "inner") -> DataFrame:
        """``many`` joined with ``one`` on ``key`` (and ``on``): equal to the plain join, but without a hot key."""
        if not self.n_hubs:
            return many.join(one, [key, *on], how)
        return self.many(many, key, by).join(self.one(one, key), [key, *on, SALT], how).drop(SALT)


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, bucketed by ``keys``: a join or grouping on all of them
    needs no exchange on this side, however often it is read.  The catalog entry is dropped at once; the files stay,
    as checkpoints do."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"layout_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    # dealt as the buckets are, so each bucket is one file of one task
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).format("parquet").saveAsTable(name)
    table = spark.table(name)
    table.schema          # resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


class Layout:
    """Edges (src, dst, w) kept in place over the turns of a loop: hot sources salted, all bucketed by
    source and salt, so that a turn moves the values on the nodes only."""

    def __init__(self, edges: DataFrame, rows: int | None = None):
        w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
        e = cut_lineage(edges.select("src", "dst", w.alias("w")))
        self.spread = Spread(e, "src", rows)
        self.keys = ["src", SALT] if self.spread.n_hubs else ["src"]
        self.edges = bucketed(self.spread.many(e, "src", ["dst"]) if self.spread.n_hubs else e, self.keys)

    def join(self, values: DataFrame) -> DataFrame:
        """Each edge with the columns of its source's row in ``values(node_id, ...)``."""
        v = values.withColumnRenamed("node_id", "src")
        v = self.spread.one(v, "src") if self.spread.n_hubs else v
        return self.edges.join(v, self.keys)


class MeanVectors:
    """Means of the vectors of a node's sources, over edges that stay where they are.

    A source of more than 1 in ``HEAVY`` edges is heavy; there are fewer than ``HEAVY`` of them, so their vectors
    are broadcast, and their edges lie by destination, so a task adds up all of a node's and one row a node is moved.
    The other edges lie by source (:class:`Layout`).  The sums are plain sums of numbers, added up before they are moved: an aggregate of vectors
    would sort all edges with their vectors as soon as a task has more than 128 destinations."""

    def __init__(self, edges: DataFrame, dim: int):
        self.dim = dim
        e = cut_lineage(edges.select("src", "dst"))
        counts = cut_lineage(e.groupBy("src").agg(F.count(F.lit(1)).alias("n")))
        total = counts.agg(F.sum("n")).first()[0] or 0
        self.heavy = cut_lineage(counts.where(F.col("n") * F.lit(HEAVY) > F.lit(total)).select("src"))
        self.n_heavy = self.heavy.count()
        if self.n_heavy:
            few = F.broadcast(self.heavy)
            self.by_dst = bucketed(e.join(few, "src"), ["dst"])
            e = e.join(few, "src", "left_anti")
        self.light = Layout(e)

    def mean(self, values: DataFrame, col: str) -> DataFrame:
        """``node_id`` and the mean ``col`` of its sources' ``values(node_id, <col>)``, for nodes with sources."""
        v = values.select("node_id", F.col(col).alias("v"))
        sent = self.light.join(v).select("dst", "v")
        if self.n_heavy:
            few = F.broadcast(v.withColumnRenamed("node_id", "src").join(F.broadcast(self.heavy), "src"))
            sent = sent.unionByName(self.by_dst.join(few, "src").select("dst", "v"))
        sums = sent.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(self.dim)])
        return sums.select("node_id", F.array(*[F.col(f"s{i}") / F.col("n") for i in range(self.dim)]).alias(col))
