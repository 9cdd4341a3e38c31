"""Operator 13, hard negatives by a vertical scan with bounds (BOND).

Vectors are integers, so all scores are exact.  Rows are dealt out in blocks, held by
column: a block has its vectors dimension by dimension.  An anchor reads the dimensions
of a block in descending order of its own magnitudes and adds up partial scores.
What the dimensions still to come can add lies, for the whole block, between sums of
the columns' minima and maxima; so each row's score is known within bounds that
close as the scan goes on.  Every few dimensions the bounds shrink the bitmap of candidates:

* positives (same label): a row goes when its upper bound is below the lower
  bounds of ``POSITIVES`` others;
* negatives (other labels): a row goes when its bounds miss each of the anchor's
  score windows, or when, for each window it may be in, ``NEGATIVES`` rows that
  are surely inside have lower bounds above its upper bound.

When the dimensions are used up, or few candidates are left, their scores are exact.
Each block hands on its best rows for each anchor or window, which are merged by anchor.

The anchors are a stated part of the rows, met with all rows in blocks: each block of
``ROWS`` rows with each block of ``ANCHORS`` anchors is a group of its own, so no task holds more."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import stream_groups
from riskgraph.session import cut_lineage

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90           # per cent of the positive's score between which a negative's lies
SCALE = 256.0
ROWS = 32_768                # rows of a block
ANCHORS = 8_192              # anchors of a block
STEP = 8                     # dimensions read between two looks at the bounds
FEW = 64                     # candidates that are settled without further looks
LARGEST = 1 << 24            # components beyond this (after scaling) could overflow a sum


def integer_vectors(df: DataFrame, vec_col: str) -> DataFrame:
    """``vec_id, label, v``: rows that take part, with the scaled components as little-endian 32-bit integers.

    A null id, label, vector or component, or one that is not finite, takes a row out."""
    def run(batches):
        for b in batches:
            ids, labels, vec = b.column(0), b.column(1), b.column(2)
            rows = [], [], []
            flat = vec.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)      # a null component is NaN here
            at = np.concatenate([[0], np.cumsum(np.asarray(vec.value_lengths().fill_null(0)))])
            good = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            for i, (d, y) in enumerate(zip(ids.to_pylist(), labels.to_pylist())):
                if d is None or y is None or not vec[i].is_valid or good[at[i + 1]] != good[at[i]]:
                    continue
                x = np.floor(SCALE * values[at[i]:at[i + 1]])
                if len(x) and np.abs(x).max() > LARGEST:
                    raise ValueError(f"vector {d} has a component beyond {LARGEST / SCALE:.0f}")
                rows[0].append(d)
                rows[1].append(y)
                rows[2].append(x.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names=["vec_id", "label", "v"])
    return df.select("vec_id", F.col("label").cast("long"), vec_col).mapInArrow(run, "vec_id long, label long, v binary")


class Columns:
    """Rows of a block by dimension."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        vectors = [np.frombuffer(r[2], "<i4") for r in rows]
        width = max((len(v) for v in vectors), default=0)
        self.dims = np.zeros((width, len(rows)), np.int64)
        for i, v in enumerate(vectors):
            self.dims[:len(v), i] = v                     # components that a shorter vector lacks count as 0
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], np.int64)
        self.low, self.high = (self.dims.min(axis=1), self.dims.max(axis=1)) if len(rows) else (np.zeros(width, np.int64),) * 2

    def plan(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Dimensions in the order of the anchor's magnitudes, and for each number of them read what the rest may add."""
        a = np.concatenate([a, np.zeros(max(0, len(self.dims) - len(a)), np.int64)])[:len(self.dims)].astype(np.int64)
        order = np.argsort(-np.abs(a), kind="stable")
        a = a[order]
        one, two = a * self.low[order], a * self.high[order]
        rest = lambda x: np.concatenate([np.cumsum(x[::-1])[::-1], [0]])
        return order, a, rest(np.minimum(one, two)), rest(np.maximum(one, two))


def scan(block: Columns, rows: np.ndarray, a: np.ndarray, shrink) -> tuple[np.ndarray, np.ndarray]:
    """Candidates among ``rows`` (places in the block) that ``shrink`` leaves, with exact scores.

    ``shrink(partial, least, most)`` tells which partial scores may still matter if the rest adds between ``least`` and ``most``."""
    order, a, least, most = block.plan(a)
    score = np.zeros(len(rows), np.int64)
    t = 0
    while t < len(order):
        step = STEP if len(rows) > FEW else len(order) - t
        whole = len(rows) == len(block.ids)
        for d, x in zip(order[t:t + step], a[t:t + step]):
            if x:
                score += x * (block.dims[d] if whole else block.dims[d][rows])
        t += step
        keep = shrink(score, least[min(t, len(order))], most[min(t, len(order))])
        if not keep.all():
            rows, score = rows[keep], score[keep]
        if not len(rows):
            break
    return rows, score


def best(ids: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The ``k`` highest scores, ties by smaller id."""
    if len(ids) > 4 * k:
        near = score >= np.partition(score, len(score) - k)[len(score) - k]
        ids, score = ids[near], score[near]
    order = np.lexsort((ids, -score))[:k]
    return [(int(ids[i]), int(score[i])) for i in order]


def kth(values: np.ndarray, k: int):
    """The k-th largest value, or None if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def nearest(block: Columns, anchor: int, label: int, a: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The anchor's ``k`` best rows of its own label in the block."""
    def shrink(partial, least, most):
        bar = kth(partial, k)
        return np.ones(len(partial), bool) if bar is None else partial + most >= bar + least
    rows = np.flatnonzero((block.labels == label) & (block.ids != anchor))
    rows, score = scan(block, rows, a, shrink)
    return best(block.ids[rows], score, k)


def window(positive_score: int) -> tuple[int, int]:
    """Least and greatest score of a negative for a positive of this score."""
    return -(-LOW * positive_score // 100), HIGH * positive_score // 100


def inside_windows(block: Columns, label: int, a: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each window the anchor's ``k`` best rows of other labels in the block whose scores are in it."""
    def shrink(partial, least, most):
        low, high = partial + least, partial + most
        keep = np.zeros(len(partial), bool)
        for lo, hi in windows:
            if lo > hi:
                continue
            may = (high >= lo) & (low <= hi)
            bar = kth(low[(low >= lo) & (high <= hi)], k)
            keep |= may if bar is None else may & (high >= bar)
        return keep
    rows, score = scan(block, np.flatnonzero(block.labels != label), a, shrink)
    out = []
    for lo, hi in windows:
        ok = (score >= lo) & (score <= hi)
        out.append(best(block.ids[rows[ok]], score[ok], k))
    return out


def blocks(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int, extra: Column) -> DataFrame:
    """Each block of rows beside each block of anchors: ``rb, ab, side, vec_id, label, v, extra``, rows (side 0) ahead of anchors."""
    deal = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols = ["rb", "ab", "side", "vec_id", "label", "v", "extra"]
    left = (rows.withColumn("rb", deal(1, row_blocks)).withColumn("ab", each(anchor_blocks)).withColumn("side", F.lit(0))
            .withColumn("extra", F.array().cast("array<struct<id:long,score:long>>")).select(*cols))
    right = (anchors.withColumn("ab", deal(2, anchor_blocks)).withColumn("rb", each(row_blocks)).withColumn("side", F.lit(1))
             .withColumn("extra", extra).select(*cols))
    return left.unionByName(right)


def search(pairs: DataFrame, answer, schema: str) -> DataFrame:
    """``answer(block, anchor id, label, vector, extra)`` for each anchor against each block of rows."""
    def work(stream):
        key, held, block = None, [], None
        for rb, ab, side, d, label, v, extra in stream:
            if (rb, ab) != key:
                key, held, block = (rb, ab), [], None
            if side == 0:
                held.append((d, label, v))
                continue
            if block is None:
                block, held = Columns(held), []
            yield from answer(block, d, label, np.frombuffer(v, "<i4").astype(np.int64), extra)
    return stream_groups(pairs, ["rb", "ab"], ["side"], work, schema)


def hard_negatives(vectors: DataFrame, is_anchor: Column, vec_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of
    ``vectors(vec_id, label, <vec_col>)`` for which ``is_anchor`` (over vec_id) holds.

    A score is the inner product of the vectors' components, each ``floor(256 * x)``.  An
    anchor's positives are its ``POSITIVES`` best other rows of the same label (ties: smaller id);
    for each, the ``NEGATIVES`` best rows of other labels with ``LOW * positive_score <= 100 * negative_score <= HIGH * positive_score``.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part.
    Of rows that repeat an id the least (by label, then vector) counts, so equal rows count once.
    A vector with fewer components than another has 0 there; a component beyond 65,536 is an error.
    Anchors without a positive, and positives without a negative in the window, give no row.  Other columns are ignored."""
    part = integer_vectors(vectors, vec_col)
    rows = cut_lineage(part.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.label", "s.v"))
    anchors = rows.where(is_anchor)
    row_blocks, anchor_blocks = max(1, -(-rows.count() // ROWS)), max(1, -(-anchors.count() // ANCHORS))
    none = F.array().cast("array<struct<id:long,score:long>>")

    def first(block, d, label, a, _):
        for other, score in nearest(block, d, label, a, POSITIVES):
            yield d, other, score

    near = search(blocks(rows, anchors, row_blocks, anchor_blocks, none), first, "vec_id long, id long, score long")
    # at most POSITIVES rows an anchor and block
    near = near.groupBy("vec_id").agg(F.expr(f"slice(array_sort(collect_list(struct(-score AS s, id))), 1, {POSITIVES})").alias("p"))
    known = cut_lineage(near.select("vec_id", F.expr("transform(p, x -> struct(x.id AS id, -x.s AS score))").alias("near")))

    def second(block, d, label, a, near):
        found = inside_windows(block, label, a, [window(p["score"]) for p in near], NEGATIVES)
        for p, negatives in zip(near, found):
            for other, score in negatives:
                yield d, p["id"], p["score"], other, score

    asked = anchors.join(known, "vec_id")
    got = search(blocks(rows, asked, row_blocks, anchor_blocks, F.col("near")), second,
                 "anchor_id long, positive_id long, positive_score long, id long, score long")
    got = got.groupBy("anchor_id", "positive_id", "positive_score").agg(F.expr(f"slice(array_sort(collect_list(struct(-score AS s, id))), 1, {NEGATIVES})").alias("n"))
    return (got.select("anchor_id", "positive_id", "positive_score", F.posexplode("n").alias("at", "x"))
            .select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"),
                    "positive_score", (-F.col("x.s")).alias("negative_score")))
