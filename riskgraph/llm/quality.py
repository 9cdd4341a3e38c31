"""Operator 5, quality rules by distribution divergence.

Each document's histogram of character classes and of common words is compared
with those of every language (learned from all documents with that ``lang``) by
the Jensen-Shannon distance (square root of the base-2 divergence).  A text is
like prose if, for one language, both distances stay below their limits; texts
below a length guard are not judged on that histogram, since a short text's
histogram is mostly noise."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import map_batches
from riskgraph.session import cut_lineage

SYMBOLS = "#*$%&|<>"
CLASSES = 8  # lower, upper, digit, white space, sentence punctuation, symbol, control, outside ASCII
MIN_WORDS, MAX_REPEAT = 50, 50
COMMON_SHARE = 0.002     # a common word makes up at least this share of a language: at most 500 a language
CHAR_LIMIT, WORD_LIMIT = 0.22, 0.40
CHAR_GUARD, WORD_GUARD = 200, 80   # characters and words below which the histogram isn't judged


def _class_of() -> np.ndarray:
    t = np.full(256, CLASSES, np.intp)                  # UTF-8 continuation bytes: not counted
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            t[b] = 7
        elif b < 0x80:
            t[b] = (0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t\n\x0b\x0c\r"
                    else 4 if c in ".,;:!?'\"()-" else 6 if b < 32 or b == 127 else 5)
    return t


CLASS_OF = _class_of()
PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def plain_words(text: bytes) -> list[bytes]:
    return text.lower().translate(PLAIN).split()


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(CLASS_OF[np.frombuffer(text, np.uint8)], minlength=CLASSES + 1)[:CLASSES]


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, dict[bytes, float]]]:
    """Per language: class histogram and the share of each common word, over all documents with a ``lang``.

    Words are counted in each batch first, then summed by Spark; only classes
    and common words (at most 1 / COMMON_SHARE a language) reach the driver."""
    def count(cols):
        words, classes = {}, {}
        for lang, text in zip(*cols):
            words.setdefault(lang, Counter()).update(plain_words(text))
            classes[lang] = classes.get(lang, 0) + class_counts(text)
        rows = [(g, w, n) for g, c in words.items() for w, n in c.items()]
        rows += [(g, None, 0, *map(int, c)) for g, c in classes.items()]
        rows += [(g, b"", sum(c.values())) for g, c in words.items()]      # b"": all words
        out = {"lang": [r[0].decode() for r in rows], "word": [None if r[1] is None else r[1].decode("utf-8", "replace") for r in rows], "n": [r[2] for r in rows]}
        return out | {f"c{i}": [int(r[3 + i]) if len(r) > 3 else 0 for r in rows] for i in range(CLASSES)}

    cs = [f"c{i}" for i in range(CLASSES)]
    src = docs.where("lang is not null and text is not null").select("lang", "text")
    got = map_batches(src, count, "lang string, word string, n long, " + ", ".join(f"{c} long" for c in cs))
    sums = got.groupBy("lang", "word").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in cs])
    sums = cut_lineage(sums.where(F.col("word").isNull() | (F.col("n") > 1)))
    totals = {r["lang"]: r["n"] for r in sums.where("word = ''").collect()}     # one row a language
    classes = {r["lang"]: np.array([r[c] for c in cs], float) for r in sums.where("word is null").collect()}
    least = F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, v * COMMON_SHARE)]) if totals else None
    refs = {k: (v, {}) for k, v in classes.items() if v.sum() and totals.get(k)}
    if refs:
        for r in sums.where((F.col("word") != "") & (F.col("n") >= least[F.col("lang")])).collect():
            if r["lang"] in refs:
                refs[r["lang"]][1][r["word"].encode()] = r["n"] / totals[r["lang"]]
    return refs


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the base-2 Jensen-Shannon divergence of two histograms (made to sum to 1)."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return math.sqrt(max(0.0, d / 2))


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    n = len(words)
    b = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(b[0x80:0xC0].sum())
    chars = points - int(b[9:14].sum() + b[32])
    symbols = int(sum(b[ord(c)] for c in SYMBOLS))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and line.strip():
            seen.add(line)
    repeat = 0
    if n >= 4:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        w = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
        _, inv, cnt = np.unique(w, return_inverse=True, return_counts=True)
        twice = cnt[inv] > 1
        if twice.any():
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k:n - 2 + k] |= twice
            repeat = int(cover.sum())
    return n, chars, symbols, dup, repeat


def quality_rules(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang)``: base counts, ``base_failed``, ``kept``
    and the two distances to the nearest language (null where not judged).

    Null or empty text: no words, base_failed.  Null lang: no part in the
    references, judged all the same.  No reference at all: kept unless
    base_failed.  Repeated rows each get their row; other columns are ignored."""
    refs = references(docs)
    langs = sorted(refs)
    common = sorted({w for k in langs for w in refs[k][1]})
    at = {w: i for i, w in enumerate(common)}
    shares = []
    for k in langs:
        own = np.array([refs[k][1].get(w, 0.0) for w in common])
        shares.append((np.flatnonzero(own), np.append(own[own > 0], max(0.0, 1 - own.sum()))))
    chars = [refs[k][0] for k in langs]
    other = len(common)

    def judge(cols):
        out = {k: [] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                               "base_failed", "kept", "char_distance", "word_distance")}
        for doc_id, text in zip(*cols):
            base = base_counts(text)
            failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT * base[0]
            cd = wd = None
            kept = not failed
            if text and langs:
                hist = class_counts(text).astype(float)
                words = plain_words(text)
                by_word = np.bincount(np.fromiter((at.get(w, other) for w in words), np.intp, len(words)), minlength=other + 1) if words else None
                judged = []
                for (own, share), ref in zip(shares, chars):
                    c = js_distance(hist, ref) if hist.sum() >= CHAR_GUARD else None
                    w = None
                    if len(words) >= WORD_GUARD:
                        mine = by_word[own]
                        w = js_distance(np.append(mine, len(words) - mine.sum()).astype(float), share)
                    judged.append((max((c or 0) / char_limit, (w or 0) / word_limit), c, w))
                worst, cd, wd = min(judged, key=lambda x: x[0])
                kept = kept and worst <= 1
            for k, v in zip(out, (doc_id, *base, failed, kept, cd, wd)):
                out[k].append(v)
        return out

    return map_batches(docs.select("doc_id", "text"), judge,
                       "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                       "base_failed boolean, kept boolean, char_distance double, word_distance double")
