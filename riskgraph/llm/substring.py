"""Operator 2, substring deduplication by level-wise doubling.

Level 0 looks at windows of ``length / 2`` words; a window that occurs in one
document alone can't be part of a longer repeat, so only repeated windows are
extended to twice that length (``longest_repeats`` goes on doubling until no
candidate survives).  To shuffle a few per cent of the windows only, the first
level keeps of each full-length window the half-length window with the least
hash: equal full windows hold the same one, so nothing is lost.

Exact copies are folded first: all words of a copy with at least ``length``
words are covered by its smallest twin, and a window of a copy also starts in
that twin."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import RollingHash, WordHasher, map_batches, mix
from riskgraph.session import cut_lineage

LENGTH = 50


def minimisers(h: np.ndarray, span: int) -> np.ndarray:
    """Least value of every ``span`` consecutive values (van Herk's doubling)."""
    k, m = 1, h
    while 2 * k <= span:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    rest = span - k
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def keys_of(text: bytes | None, hasher: WordHasher, length: int) -> np.ndarray:
    """For every window of ``length`` words the hash of its least half-length window."""
    words = text.split() if text else []
    if len(words) < length:
        return np.zeros(0, np.uint64)
    half = length // 2
    return minimisers(RollingHash(hasher(words)).windows(half), length - half + 1)


def level0(docs: DataFrame, length: int) -> DataFrame:
    """Per row: ``doc_id, th, n_words, same`` (hash of the word sequence) and ``ms``, the distinct least half-length windows."""
    hasher = WordHasher(0)

    def run(cols):
        out = {"doc_id": cols[0], "th": cols[1], "n_words": [], "same": [], "ms": []}
        for text in cols[2]:
            words = (text or b"").split()
            out["n_words"].append(len(words))
            out["same"].append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
            out["ms"].append(np.unique(keys_of(text, hasher, length)).view(np.int64))
        return out
    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), run, "doc_id long, th long, n_words long, same binary, ms array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, th, text``: the one form in which texts are shuffled, so that Spark sends them once for all joins of a query."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text")


def candidate_keys(scanned: DataFrame) -> DataFrame:
    """``doc_id, th, ms``: of each text of a document the half-length windows that another document holds too."""
    first = scanned.select("doc_id", "th", F.explode("ms").alias("m"))
    seen = first.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("m")
    return first.join(seen, "m").groupBy("doc_id", "th").agg(F.collect_list("m").alias("ms"))


def repeated_windows(docs: DataFrame, keys: DataFrame, length: int) -> DataFrame:
    """``doc_id, th, starts``: where windows of ``length`` words start that also start in a document
    with a smaller id.  Only windows whose half-length key is in ``keys`` are extended and compared;
    documents without any such start are left out."""
    hasher = WordHasher(0)

    def extend(cols):
        ids, ths, pos, hs = [], [], [], []
        for d, th, text, ms in zip(*cols):
            words = text.split()
            rolling = RollingHash(hasher(words))
            half = length // 2
            m = minimisers(rolling.windows(half), length - half + 1)
            at = np.flatnonzero(np.isin(m, np.array(ms, np.int64).view(np.uint64)))
            ids.append(np.full(len(at), d, np.int64))
            ths.append(np.full(len(at), th, np.int64))
            pos.append(at.astype(np.int32))
            hs.append(rolling.windows(length)[at].view(np.int64))
        cat = lambda x: np.concatenate(x) if x else []
        return {"doc_id": cat(ids), "th": cat(ths), "pos": cat(pos), "h": cat(hs)}

    texts = keyed(docs).join(keys, ["doc_id", "th"])
    windows = map_batches(texts.select("doc_id", "th", "text", "ms"), extend, "doc_id long, th long, pos int, h long")
    least = windows.groupBy("h").agg(F.min("doc_id").alias("lo"))
    return (windows.join(least, "h").where("doc_id > lo")
            .groupBy("doc_id", "th").agg(F.collect_list("pos").alias("starts")))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``) per row of ``docs(doc_id, text)``.

    A null text has no words.  A row with a null id counts as before all others:
    it is a source of repeats and loses none.  Rows that repeat an id: windows of
    one id are one document's, so equal rows lose nothing to each other; different
    texts of one id are copies or not each by itself.  Other columns are ignored."""
    src = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "text")
    scanned = cut_lineage(level0(src, length))
    twin = scanned.groupBy("same").agg(F.min("doc_id").alias("twin"))
    copies = cut_lineage(scanned.where(f"n_words >= {length}").join(twin, "same").where("doc_id > twin").select("doc_id", "th").distinct())
    keys = cut_lineage(candidate_keys(scanned.join(copies, ["doc_id", "th"], "left_anti")))
    starts = repeated_windows(src, keys, length)
    marks = starts.unionByName(copies.select("doc_id", "th", F.array(F.lit(-1)).alias("starts")))
    rows = keyed(src).join(marks, ["doc_id", "th"], "left").select("doc_id", "text", "starts")

    def cut(cols):
        out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")}
        for d, text, st in zip(*cols):
            words = (text or b"").split()
            n = len(words)
            gone = 0
            if st and st[0] == -1:
                gone, words = n, []
            elif st:
                step = np.zeros(n + 1, np.int32)
                at = np.array(st, np.intp)
                at = at[at + length <= n]
                np.add.at(step, at, 1)
                np.add.at(step, at + length, -1)
                keep = np.cumsum(step[:n]) == 0
                gone = int(n - keep.sum())
                words = [w for w, k in zip(words, keep.tolist()) if k]
            kept = b" ".join(words)
            for k, v in zip(out, (None if d == -(2**63) else d, n, gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None)):
                out[k].append(v)
        return out

    got = map_batches(rows, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return got if with_text else got.drop("kept_text")


def longest_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, words``: the largest ``length * 2^k`` at which a window of the document is repeated in
    a document with a smaller id.  Each turn doubles the length and keeps the windows that
    hold a repeated window of the length before; the loop ends when none is left.  Needs distinct ids, as the caller's table has."""
    src = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    keys = candidate_keys(cut_lineage(level0(src, length)))
    starts, found, size = repeated_windows(src, keys, length), None, length
    while True:
        starts = cut_lineage(starts)
        if starts.isEmpty():
            break
        level = starts.select("doc_id", F.lit(size).alias("words"))
        found = level if found is None else found.unionByName(level)
        size *= 2
        starts = repeated_windows(src, candidate_keys(cut_lineage(level0(src, size))), size)
    empty = src.select("doc_id", F.lit(length).alias("words")).where("false")
    return (found if found is not None else empty).groupBy("doc_id").agg(F.max("words").alias("words"))
