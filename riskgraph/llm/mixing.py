"""Operator 8, mixing sources to target weights by Pareto order sampling.

Targets: sources in code point order (null last) weigh 3, 1, 2 and so on and
share 150 % of all words; a target stops at twice its source and the excess is
shared again by weight.  Whole copies that every document of a source is sure
of are given first; the rest of the target is a sample in Pareto order: rank by
the odds of a random number over the odds of the inclusion probability, taken
from the front as long as the words fit.  Because documents are whole, the
front leaves a remainder smaller than the next document; further passes fill
it from the documents behind that still fit, until a pass takes nothing, and a last document may go over the
target if that brings the source nearer to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.llm.common import split_words
from riskgraph.session import cut_lineage

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0     # of all words; of a source's words
SLICES = 4096              # slices of a source's Pareto order, so that no window holds a whole source


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` for every source of ``sized(source, size)``.

    The rank of a source (for its weight) comes from a range partitioning and
    counts per partition; the level of the sharing is found from one pair of sums
    a turn, until no further source reaches its ceiling."""
    spark = sized.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    null = F.col("source").isNull().alias("last")
    per = cut_lineage(per.select("*", null).repartitionByRange(n, "last", "source").withColumn("part", F.spark_partition_id()))
    before = (per.groupBy("part").agg(F.count("*").alias("n"))
              .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")))   # a row a partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1 + F.col("before")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    per = cut_lineage(per.join(before, "part").select("source", "source_size", w.alias("weight")))
    whole = per.agg(F.sum("source_size")).first()[0] or 0
    level, fixed = 0.0, None
    ceiling = F.col("source_size") * most
    while True:
        full = ceiling <= F.col("weight") * level
        r = per.agg(F.sum(F.when(full, ceiling).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0)),
                    F.count(F.when(full, 1))).first()
        if r[2] == fixed or not r[1]:
            break
        fixed, level = r[2], (whole * share - r[0]) / r[1]
    return per.select("source", "source_size", F.when(full, ceiling).otherwise(F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs(doc_id, text, source)``.

    Null and blank texts have size 0 and are never taken.  Random numbers come
    from the id's md5, so reruns agree; rows that repeat an id are told apart by
    size and text hash, and rows alike in all of these are numbered, so that one of them can be
    taken without the others.  An empty table gives no rows."""
    words = F.size(split_words(F.col("text"))).cast("long")
    u = ((F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48))
    sized = cut_lineage(docs.select("doc_id", "source", words.alias("size"), F.xxhash64("text").alias("th"), u.alias("u")))
    goal = targets(sized, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = cut_lineage(goal.withColumn("copies", F.floor(ratio)).withColumn("pi", ratio - F.floor(ratio))
                       .withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")))
    small = goal.withColumnRenamed("source", "s")
    pareto = (F.col("u") / (1 - F.col("u"))) / (F.col("pi") / (1 - F.col("pi")))
    rows = (sized.join(small, F.col("source").eqNullSafe(F.col("s"))).drop("s")
            .withColumn("q", F.when(F.col("pi") > 0, pareto))
            .withColumn("slice", F.floor(F.col("u") * SLICES).cast("int"))   # within a source q rises with u
            .withColumn("more", F.lit(False)).withColumn("nr", F.monotonically_increasing_id()))
    rows = cut_lineage(rows)
    left, missing = cut_lineage(small.select("s", "left")), None
    while True:
        free = ~F.col("more") & (F.col("pi") > 0) & (F.col("size") > 0) & (F.col("size") <= F.col("left"))
        size = F.when(free, F.col("size")).otherwise(0)
        here = rows.drop("left").join(left, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("fits", size)
        sums = here.groupBy("source", "slice").agg(F.sum("fits").alias("sum"))
        offsets = sums.select(F.col("source").alias("s"), F.col("slice").alias("sl"),
                              (F.sum("sum").over(Window.partitionBy("source").orderBy("slice")) - F.col("sum")).alias("before"))  # SLICES rows a source
        order = Window.partitionBy("source", "slice").orderBy("q", "u", "doc_id", "size", "th", "nr").rowsBetween(Window.unboundedPreceding, 0)
        upto = F.sum("fits").over(order) + F.col("before")
        here = here.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("sl"))).drop("s", "sl")
        rows = cut_lineage(here.withColumn("upto", upto).withColumn("more", F.col("more") | (F.col("fits") > 0) & (F.col("upto") <= F.col("left")))
                           .drop("upto", "before", "fits"))
        left = cut_lineage(rows.groupBy(F.col("source").alias("s"))
                           .agg((F.first("target") - F.first("copies") * F.first("source_size") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))).alias("left")))
        now = rows.agg(F.sum(F.when(F.col("more"), F.col("size")))).first()[0]     # a whole number
        if now == missing:
            break
        missing = now
    # last, the one document (a row a source) that brings the source nearer to its target, if any does
    here = rows.drop("left").join(left, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    free = here.where(~F.col("more") & (F.col("pi") > 0) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("left")))
    one = free.groupBy("source").agg(F.min(F.struct(F.abs(F.col("left") - F.col("size")).alias("e"), "u", "doc_id", "size", "th", "nr")).alias("o"))
    one = cut_lineage(one.select(F.col("source").alias("s"), F.col("o.nr").alias("o")))
    last = F.coalesce(F.col("nr") == F.col("o"), F.lit(False))
    rows = rows.join(one, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("more", F.col("more") | last)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + F.col("more").cast("long"))).alias("taken"), "th")


def mix_copies(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with ``copy_no`` from 1 on.

    All columns of ``docs`` stay as they are; a row whose document is not taken
    is left out.  Rows are matched on id and text hash, null-safe; rows alike in
    both share their copies out as evenly as they can, the first ones getting one more."""
    took = mix(docs)
    row = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"))
    keys = took.where("size > 0").groupBy(F.col("doc_id").alias("_i"), F.col("th").alias("_t")).agg(
        F.sum(F.col("taken") / F.col("size")).cast("long").alias("_sum"), F.count("*").alias("_n")).where("_sum > 0")
    keys = keys.select("_i", "_t", F.floor(F.col("_sum") / F.col("_n")).cast("int").alias("_each"), (F.col("_sum") % F.col("_n")).cast("int").alias("_odd"), "_n")
    out = row.join(cut_lineage(keys), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")))
    # rows alike are numbered where their copies differ (a few groups a source); all others need no second shuffle
    same = Window.partitionBy("_id", "_th").orderBy("_odd")
    even = out.where("_odd = 0").select("_row", F.col("_each").alias("_copies"))
    odd = out.where("_odd > 0").select("_row", (F.col("_each") + (F.row_number().over(same) <= F.col("_odd")).cast("int")).alias("_copies"))
    both = even.unionByName(odd).where("_copies > 0")
    return both.select("_row.*", F.explode(F.sequence(F.lit(1), "_copies")).alias("copy_no"))
