"""Operator 6, URL filter by the ratio of two character language models.

URLs that the rule list decides are the examples: allowed ones train the model
of accepted URLs, blocked ones that of rejected URLs.  A model is a variable-order
Markov model: the probability of a character blends the orders 0 to ``ORDER``,
each weighted by how often its context was seen.  A URL without a rule is
accepted when the difference of the log-likelihoods per character is at or
above a threshold calibrated on examples kept out of training.

All n-gram counts are exact: a byte and the ``ORDER`` bytes before it are one key
of 54 bits, and the counts of the lower orders are sums over the keys with the same
end.  What a byte adds to the ratio depends on its key alone, so the work follows the
different keys: Spark tables of counts, joined order by order (a context has at most
256 successors, an n-gram at most 257 extensions, so no key of these joins is hot).
Keys that hold more than 1 in ``FREQUENT`` of all places, so fewer than ``FREQUENT``
of them, go to the tasks; the places of all others are joined with the table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskgraph.llm.common import map_batches
from riskgraph.operators.spread import Spread
from riskgraph.session import cut_lineage

# The rules (host, path) of the contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
ORDER, KAPPA = 5, 4.0
SYMBOL = 9                 # bits of a byte in a key: 0 before the start of the URL, byte + 1 in it
FREQUENT = 1 << 14         # keys with a larger share of the places than 1 / FREQUENT are sent to the tasks
UNIT = 1 << 20             # what a place adds is rounded to 1 / UNIT, so sums do not depend on their order
CHUNK = 1 << 20            # places that a task turns into rows at a time
CALIBRATION_FOLDS = 5      # one example in five sets the threshold
STEP, REACH = 0.01, 4.0    # bins of the calibration histogram


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty if it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.lit(2**31 - 1))
    ok = F.coalesce(at > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(ok, host).otherwise(""), F.when(ok, path).otherwise("")


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text (``host`` + path) and verdict of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def keys_of(url: bytes) -> np.ndarray:
    """For each byte of a URL, the ``ORDER`` bytes before it and the byte itself, packed with the byte lowest."""
    n = len(url)
    b = np.zeros(n + ORDER, np.int64)
    b[ORDER:] = np.frombuffer(url, np.uint8)
    b[ORDER:] += 1
    g = np.zeros(n, np.int64)
    for k in range(ORDER + 1):
        g = (g << SYMBOL) | b[k: k + n]
    return g


def end_of(g: Column, order: int) -> Column:
    """The n-gram of an order that a key ends with."""
    return g.bitwiseAND(F.lit((1 << SYMBOL * (order + 1)) - 1).cast("long"))


def key_counts(urls: DataFrame) -> DataFrame:
    """``g, good, bad, places`` for each key of ``urls(url, n, kind)``: its count in accepted (kind 1) and rejected
    (kind 2) examples, each taken ``n`` times, and its places in all URLs, each taken once."""
    def count(cols):
        grams = [keys_of(u) for u in cols[0]]
        size = [len(g) for g in grams]
        g, at, places = np.unique(np.concatenate([*grams, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
        n, kind = np.repeat(np.array(cols[1], np.float64), size), np.repeat(np.array(cols[2], np.int64), size)
        good, bad = (np.bincount(at, n * (kind == k), len(g)).astype(np.int64) for k in (1, 2))   # exact below 2^53
        return {"g": g, "good": good, "bad": bad, "places": places}

    rows = map_batches(urls.select("url", "n", "kind"), count, "g long, good long, bad long, places long")
    return rows.groupBy("g").agg(*[F.sum(c).alias(c) for c in ("good", "bad", "places")])


def key_values(counts: DataFrame) -> DataFrame:
    """``g, d, places``: what a place with key g adds to the ratio, in 1 / ``UNIT``.

    The probability of a byte at order k is (count + KAPPA x that at order k - 1) / (context's count + KAPPA),
    below order 0 it is 1/256."""
    before = None
    for k in range(ORDER + 1):
        level = counts if k == ORDER else counts.groupBy(end_of(F.col("g"), k).alias("g")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        context = Window.partitionBy(F.shiftright("g", SYMBOL))         # at most 256 rows
        level = level.select("*", F.sum("good").over(context).alias("n_good"), F.sum("bad").over(context).alias("n_bad"))
        if before is None:
            level = level.select("*", F.lit(1 / 256).alias("q_good"), F.lit(1 / 256).alias("q_bad"))
        else:
            lower = before.select(F.col("g").alias("_end"), F.col("p_good").alias("q_good"), F.col("p_bad").alias("q_bad"))
            level = level.join(lower, end_of(F.col("g"), k - 1) == F.col("_end")).drop("_end")
        before = level.select(*counts.columns[:1], *(["places"] if k == ORDER else []), *[
            ((F.col(m) + KAPPA * F.col(f"q_{m}")) / (F.col(f"n_{m}") + KAPPA)).alias(f"p_{m}") for m in ("good", "bad")])
    return before.select("g", F.round((F.log("p_good") - F.log("p_bad")) * UNIT).cast("long").alias("d"), "places")


PARTS = "k1 long, k2 long, g long, n long, s long"


def url_parts(urls: DataFrame, keys: np.ndarray, values: np.ndarray) -> DataFrame:
    """``k1, k2, g, n, s`` of ``urls(k1, k2, url)``: one row a URL with the sum s over its places with one of
    ``keys`` (sorted), under a negative g, and one row for each other key g with its n places."""
    fields = to_arrow_schema(StructType.fromDDL(PARTS))

    def rows(k1: list, k2: list, urls: list) -> pa.RecordBatch:
        grams = [keys_of(u) for u in urls]
        at = np.repeat(np.arange(len(urls)), [len(g) for g in grams])
        g = np.concatenate([*grams, np.zeros(0, np.int64)])
        found = np.minimum(np.searchsorted(keys, g), max(0, len(keys) - 1))
        known = keys[found] == g if len(keys) else np.zeros(len(g), bool)
        sums = np.bincount(at[known], values[found[known]], len(urls)).astype(np.int64)            # exact below 2^53
        at, g = at[~known], g[~known]
        order = np.lexsort((g, at))
        at, g = at[order], g[order]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (g[1:] != g[:-1])])) if len(g) else np.zeros(0, np.intp)
        n = np.diff(np.append(first, len(g)))
        k1, k2 = np.array(k1, np.int64), np.array(k2, np.int64)
        none, where = np.zeros(len(urls), np.int64), at[first]
        columns = [(k1, k1[where]), (k2, k2[where]), (-1 - (k1 & np.int64((1 << 62) - 1)), g[first]), (none, n), (sums, np.zeros(len(n), np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, urls = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()
            start = size = 0
            for i, u in enumerate(urls):
                size += len(u)
                if size >= CHUNK or i == len(urls) - 1:
                    yield rows(k1[start:i + 1], k2[start:i + 1], urls[start:i + 1])
                    start, size = i + 1, 0
    return urls.select("k1", "k2", "url").mapInArrow(run, PARTS)


def ratios(urls: DataFrame) -> DataFrame:
    """``k1, k2, ratio`` for each row of ``urls(k1, k2, url, n, kind)``, different URLs with a byte at least: the
    difference of the log-likelihoods per byte under the models that the rows of kinds 1 and 2 give."""
    values = cut_lineage(key_values(cut_lineage(key_counts(urls))))
    total = values.agg(F.sum("places")).first()[0] or 0
    known = values.where(F.col("places") * FREQUENT > F.lit(total)).select("g", "d").orderBy("g").toPandas()   # fewer than FREQUENT rows
    parts = url_parts(urls, known["g"].to_numpy(np.int64), known["d"].to_numpy(np.float64))
    rest = values.where(F.col("places") * FREQUENT <= F.lit(total)).select("g", "d")
    sums = (parts.join(rest, "g", "left").groupBy("k1", "k2")
            .agg(F.sum(F.col("s") + F.col("n") * F.coalesce("d", F.lit(0))).alias("s")))
    return urls.join(sums, ["k1", "k2"]).select("k1", "k2", (F.col("s") / UNIT / F.octet_length("url")).alias("ratio"))


def threshold(examples: DataFrame) -> float:
    """Threshold with the least sum of both error rates on ``examples(ok, n, ratio)`` (a histogram of fixed bins)."""
    bins = examples.select(
        "ok", "n", F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), "ratio")) / STEP).cast("int").alias("bin"))
    hist = {(r["ok"], r["bin"]): r["n"] for r in bins.groupBy("ok", "bin").agg(F.sum("n").alias("n")).collect()}
    good, bad = (sum(n for (o, _), n in hist.items() if o is k) for k in (True, False))
    if not good or not bad:
        return 0.0
    best, lost, passed = (2.0, 0.0), 0, bad
    ends = range(-int(REACH / STEP) - 1, int(REACH / STEP) + 2)
    tied: list[int] = []
    for b in ends:                      # threshold b * STEP: all below are rejected
        error = lost / good + passed / bad
        if error < best[0] - 1e-12:
            best, tied = (error, b), [b]
        elif abs(error - best[0]) <= 1e-12:
            tied.append(b)
        lost += hist.get((True, b), 0)
        passed -= hist.get((False, b), 0)
    return float(np.median(tied)) * STEP   # the middle of the equally good ones


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict, ratio.

    A null or empty URL has ratio 0.  Without examples of both kinds every URL
    has a ratio against an empty model and the threshold is 0 (so ties are
    allowed); repeated rows each get their row and count each as an example;
    other columns are ignored."""
    host, path = host_path(F.col("url"))
    text, verdict = rule_columns(F.col("host"), F.col("path"), rules)

    def ruled(df):
        return df.withColumn("host", host).withColumn("path", path).withColumn("rule", text).withColumn("decided", verdict)
    some = F.coalesce(F.length("url") > 0, F.lit(False))
    base = ruled(pages.select("page_id", "url"))
    # rows without a URL meet no score, so their key only has to spread them
    base = base.withColumn("k1", F.when(some, F.xxhash64("url")).otherwise(F.xxhash64("page_id"))).withColumn(
        "k2", F.when(some, F.xxhash64(F.lit(2), "url")))
    urls = ruled(pages.where(some).groupBy("url").agg(F.count("*").alias("n")))
    kind = F.when(F.col("held") | F.col("ok").isNull(), 0).when(F.col("ok"), 1).otherwise(2)
    urls = urls.select(F.xxhash64("url").alias("k1"), F.xxhash64(F.lit(2), "url").alias("k2"), "url", "n", (F.col("decided") == "allow").alias("ok"),
                       (F.crc32("url") % CALIBRATION_FOLDS == 0).alias("held"))
    urls = cut_lineage(urls.withColumn("kind", kind))
    scores = cut_lineage(ratios(urls))
    cut = threshold(urls.where("held and ok is not null").join(scores, ["k1", "k2"]))
    spread = Spread(urls, "k1", counts=urls.select("k1", "n"))       # a URL may be on many pages
    out = spread.join(base, scores, "k1", ["page_id"], on=["k2"], how="left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("decided", F.when(F.col("ratio") >= cut, "allow").otherwise("block")).alias("verdict"), "ratio")
