"""Operator 1, benchmark decontamination (DataFrame and SQL functions only).

A document is tainted by a benchmark item if one of its windows of as many
words as the item has a weighted Jaccard similarity (multisets of ``WIDTH``-word
shingles) of ``SIMILARITY`` or more with it.  A document of fewer words than the item
has one window, its whole text.

1. Mask: a position of a document is marked for n if its shingle occurs in an item
   of n words.  A window that similar shares at least 2s / (1 + s) of its shingles with
   one item (a shorter document s / (1 + s) of both counts together), so windows with
   fewer marks for n are passed over; nothing is lost.
2. Fingerprints: the remaining item-sized windows and the items get 128-bit SimHashes
   (majority of each bit over the shingles).
3. Multi-index: the 16 blocks of 8 bits.  Of fingerprints within ``RADIUS`` = 31
   bits, one block differs in at most one bit, so each item is filed under its block
   values and all values one bit away (9 x 16 keys): every pair within the radius meets.
4. Verification: pairs within the radius are compared shingle by shingle.

At a similarity of 0.8 the expected distance is 19 bits (standard deviation 4),
so the radius holds about 99.9 % of the windows at the limit and all exact ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import split_words
from riskgraph.session import cut_lineage

WIDTH, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 31, 16
BROADCAST_ROWS = 1_000_000     # a vocabulary of up to so many rows (16 bytes each) is broadcast, a larger one is shuffled


def lower_words(text: Column) -> Column:
    return split_words(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def with_shingles(df: DataFrame, words: str, out: str, width: int) -> DataFrame:
    """Adds the hash of the shingle that starts at each word of the array column ``words``
    (shorter lists: one shingle of all words; none: an empty array).

    The words' hashes are a column of their own, so that they are worked out once."""
    h, n = F.col("_h"), F.size("_h")
    each = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(*[F.element_at(h, (i + k).cast("int")) for k in range(width)]))
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    return df.withColumn(out, F.when(n >= width, each).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", words))))
                         .otherwise(F.array().cast("array<bigint>"))).drop("_h")


def runs_of(words: str, n: int) -> Column:
    """Hash of every ``n`` words in a row, as ``with_shingles`` gives it for a list of just them."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i, n))))


def packed_counts(grams: Column, seed: int) -> Column:
    """Counts of the 64 bits over all shingle hashes; bits 16 apart share a long, in fields of 16 bits
    (items and windows have fewer than 2^16 words)."""
    field = F.lit(0x0001000100010001)
    hashes = F.transform(grams, lambda g: F.xxhash64(g, F.lit(seed)))
    zero = F.array(*[F.lit(0).cast("long")] * 16)
    return F.aggregate(hashes, zero, lambda acc, h: F.array(*[acc[j] + F.shiftrightunsigned(h, j).bitwiseAND(field) for j in range(16)]))


def majority(counts: Column, n: Column) -> Column:
    """The bits that more than half of the hashes have."""
    value = F.lit(0).cast("long")
    for j in range(16):
        for q in range(4):
            bit = 1 << (16 * q + j)
            bit = bit - (1 << 64) if bit >= 1 << 63 else bit
            count = F.shiftrightunsigned(counts[j], 16 * q).bitwiseAND(F.lit(0xFFFF))
            value = value.bitwiseOR(F.when(2 * count > n, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return value


def fingerprint(df: DataFrame, grams: str) -> DataFrame:
    """Adds ``f1`` and ``f2``, the 128-bit SimHash of the array column ``grams``."""
    n = F.size(grams)
    return (df.withColumn("_c1", packed_counts(F.col(grams), 1)).withColumn("_c2", packed_counts(F.col(grams), 2))
            .withColumn("f1", majority(F.col("_c1"), n)).withColumn("f2", majority(F.col("_c2"), n)).drop("_c1", "_c2"))


def block_values() -> Column:
    """Array of the 16 blocks of 8 bits, each as block number * 256 + value."""
    return F.array(*[(F.shiftrightunsigned("f1" if k < 8 else "f2", 8 * (k % 8)).bitwiseAND(F.lit(255)) + 256 * k).cast("int") for k in range(BLOCKS)])


def numbered(column: str) -> Column:
    """The multiset as a set: a shingle's second occurrence becomes another value, and so on.
    Takes a column's name, as an expression in its place would be worked out for every element."""
    grams = F.col(column)
    again = F.transform(grams, lambda g, i: F.struct(g.alias("g"), F.size(F.filter(F.slice(grams, 1, i), lambda x: x == g)).alias("k")))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), grams).otherwise(
        F.transform(again, lambda x: F.when(x["k"] == 0, x["g"]).otherwise(F.xxhash64(x["g"], x["k"]))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: float = SIMILARITY, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``doc_id, item_id, start, n_words, similarity``: for each document and item the best window
    (ties: the first), if its similarity is ``least`` or more.

    Null and blank texts and items have no words and match nothing; an item of
    fewer than ``width`` words is one shingle.  Rows that repeat a doc_id count as one
    document with several texts (``by=("doc_id", "th")``: each text by its hash is one); a null
    doc_id is an id like any other.  Other columns are ignored."""
    items = benchmark.select("item_id", lower_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = with_shingles(items, "w", "g0", width).select("item_id", F.size("w").alias("n"), "g0")
    items = items.select("item_id", "n", numbered("g0").alias("g")).distinct()
    items = cut_lineage(fingerprint(items, "g"))
    marks_of = items.select("n", F.explode("g").alias("s")).distinct()
    vocabulary = cut_lineage(marks_of)
    if vocabulary.count() <= BROADCAST_ROWS:
        vocabulary = F.broadcast(vocabulary)
    short = [r["n"] for r in items.where(F.col("n") < width).select("n").distinct().collect()]    # fewer than width numbers

    base = docs.select("doc_id", F.xxhash64("text").alias("th"), lower_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    hits = None
    for n in [width, *short]:
        rows = base.where(F.size("w") >= n)
        rows = with_shingles(rows, "w", "g", width) if n == width else rows.withColumn("g", runs_of("w", n))
        # the outer form: from a plain explode Catalyst infers a filter on the array, which repeats its expressions
        rows = rows.select("doc_id", "th", F.size("w").alias("m"), F.posexplode_outer("g").alias("pos", "s")).where("s is not null")
        size = F.col("n") >= width if n == width else F.col("n") == n
        got = rows.join(vocabulary.where(size) if n != width else vocabulary, "s").where(size).select("doc_id", "th", "m", "n", "pos")
        hits = got if hits is None else hits.unionByName(got)

    # the marks of a document for one n: at most one for each of its words
    per = hits.groupBy("doc_id", "th", "m", "n").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    # k: shingles of the window, the whole text (at least width words) if the document is shorter than n
    k = F.when(F.col("n") >= width, F.least("n", "m") - width + 1).otherwise(1)
    of_item = F.when(F.col("n") >= width, F.col("n") - width + 1).otherwise(1)
    need = F.ceil((k + of_item) * (least / (1 + least)) - F.lit(1e-9)).cast("int")
    per = per.select("*", k.alias("k"), need.alias("need")).where(F.size("p") >= F.col("need"))

    def first_mark(i):
        """Starts of windows whose first mark is number i (from 1) and that hold enough marks."""
        here = F.element_at("p", i)
        before = F.when(i > 1, F.element_at("p", F.greatest(i - 1, F.lit(1))) + 1).otherwise(0)
        lo = F.greatest(F.lit(0), before, F.element_at("p", (i + F.col("need") - 1).cast("int")) - F.col("k") + 1)
        return F.when(lo <= here, F.sequence(lo, here)).otherwise(F.array().cast("array<int>"))

    starts = F.flatten(F.transform(F.sequence(F.lit(1), F.size("p") - F.col("need") + 1), first_mark))
    spots = per.select("doc_id", "th", F.struct("n", "k", starts.alias("starts")).alias("spot")).where(F.size("spot.starts") > 0)
    spots = cut_lineage(spots.groupBy("doc_id", "th").agg(F.collect_list("spot").alias("spots"))    # one for each n
                        .select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "spots"))

    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    # always by shuffle: the documents that hold a spot grow with the table, and every size takes the same way
    held = (texts.hint("shuffle_merge").join(spots, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
            .select("doc_id", "th", lower_words(F.col("text")).alias("w"), F.explode("spots").alias("spot")))
    windows = (held.select("doc_id", "th", "w", "spot.n", "spot.k", F.explode("spot.starts").alias("start"))
               .where(F.col("start") + F.least(F.col("n"), F.size("w")) <= F.size("w"))
               .select("doc_id", "th", "n", "start", F.slice("w", F.col("start") + 1, F.col("n")).alias("v")))
    windows = with_shingles(windows, "v", "g0", width).select("doc_id", "th", "n", "start", F.size("v").alias("nw"), numbered("g0").alias("g"))
    windows = cut_lineage(windows.withColumn("gh", F.xxhash64("n", "g")))

    # fingerprints of different windows only: a passage that many documents share is looked up once
    different = fingerprint(windows.groupBy("n", "gh").agg(F.first("g").alias("g")), "g")
    filed = items.select("item_id", F.col("n").alias("m"), F.col("g").alias("ig"), F.col("f1").alias("i1"), F.col("f2").alias("i2"),
                         F.explode_outer(F.flatten(F.transform(block_values(), lambda b: F.array(b, *[b.bitwiseXOR(F.lit(1 << j)) for j in range(8)])))).alias("slot"))
    looked = different.withColumn("slot", F.explode_outer(block_values()))
    distance = F.bit_count(F.col("f1").bitwiseXOR(F.col("i1"))) + F.bit_count(F.col("f2").bitwiseXOR(F.col("i2")))
    near = (looked.join(filed, (F.col("n") == F.col("m")) & looked["slot"].eqNullSafe(filed["slot"]) & (distance <= RADIUS))
            .select("n", "gh", "g", "item_id", "ig").dropDuplicates(["n", "gh", "item_id"]))
    shared = F.size(F.array_intersect("g", "ig"))
    verified = near.select(F.col("n").alias("n2"), F.col("gh").alias("gh2"), "item_id",
                           (shared / (F.size("g") + F.size("ig") - shared)).alias("similarity")).where(F.col("similarity") >= least)
    found = windows.join(verified, (F.col("n") == F.col("n2")) & (F.col("gh") == F.col("gh2")))
    best = found.groupBy(*by, "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("s"), F.col("nw").alias("n"))).alias("b"))
    return best.select(*by, "item_id", (-F.col("b.s")).cast("long").alias("start"), F.col("b.n").cast("long").alias("n_words"),
                       F.round("b.similarity", 6).alias("similarity"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all their columns) that hold no benchmark item."""
    leaks = find_leaks(docs, benchmark, by=("doc_id", "th")).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    row = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"))
    return row.join(leaks, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left_anti").select("_row.*")
