"""Helpers shared by the training-data operators: table access, word splitting,
document keys, window hashes and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskgraph.session import cut_lineage

WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts give an empty array."""
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WS)).otherwise(F.array().cast("array<string>"))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 0 by 5; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def map_batches(df: DataFrame, fn: Callable[[list[list]], dict[str, list]], schema: str) -> DataFrame:
    """Arrow pass over ``df``: ``fn`` gets a list of Python lists (one for each column;
    strings as UTF-8 bytes) and returns a list or array for each column of ``schema``."""
    fields = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(schema))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.cast(pa.binary()).to_pylist() if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)
                    else c.to_pylist() for c in b.columns]
            out = fn(cols)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], kind) for k, kind in fields.items()], names=list(fields))
    return df.mapInArrow(run, schema)


def stream_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of ``df`` dealt out by ``keys`` and sorted by ``keys`` and ``order`` in each task; ``fn`` gets
    the task's rows as one stream of tuples (strings and binaries as bytes) and yields result tuples.  Many small
    groups share a task without a call for each, and nothing but what ``fn`` keeps is held."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def rows(batches):
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for r in fn(rows(batches)):
            held.append(r)
            if len(held) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


# ---------------------------------------------------------------- word hashes
MULT = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2^64
MULT_INV = pow(MULT, -1, 1 << 64)


class WordHasher:
    """64-bit hash per word with a bounded memo (cleared when full)."""

    def __init__(self, seed: int = 0, limit: int = 400_000):
        self.seed, self.limit, self.memo = seed, limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo, seed, one = self.memo, self.seed, xxhash.xxh64_intdigest
        if len(memo) > self.limit:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = one(w, seed)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, so that order by value is random."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


class RollingHash:
    """Hash of every window of ``length`` words from prefix sums modulo 2^64."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.n = n
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(n, MULT), dtype=np.uint64)])
        self.back = powers(n + 1, MULT_INV)

    def windows(self, length: int) -> np.ndarray:
        if self.n < length:
            return np.zeros(0, np.uint64)
        k = self.n - length + 1
        return mix((self.sums[length:] - self.sums[:k]) * self.back[:k])


# ------------------------------------------------------- connected components
def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges``: root is the smallest node reachable.

    Alternating large-star and small-star steps (both are one groupBy-min and one
    join on the node, so a hub's edges are spread by the join's skew handling),
    until the edge set no longer changes: no turn limit.  Every turn is cut by a
    reliable checkpoint; only a count and a checksum reach the driver."""
    e = (edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
         .where("a <> b").distinct())
    e = cut_lineage(e)
    mark = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = (both.join(low, "u").where(F.col("v") > F.col("u"))
             .select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct())
        down = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        e = cut_lineage(joined.select(F.col("m").alias("a"), F.col("v").alias("b"))
                        .union(low.select("m", "u")).where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return (e.select(F.col("b").alias("node"), F.col("a").alias("root"))
            .union(e.select("a", "a").distinct()))
