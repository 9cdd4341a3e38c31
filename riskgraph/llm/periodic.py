"""Operator 11, periodic runs of words by enumeration of maximal pairs.

A run is a stretch of words with smallest period ``q``, of at least
``max(MIN_LENGTH, MIN_EXPONENT * q)`` words, that no neighbouring word extends.
Such a run [i, j) is the maximal pair of the places i and i + q: equal for
``j - i - q`` words, with different words before and behind.  Maximal pairs come
from the LCP-interval tree of the suffixes, taken bottom-up: two places from
different children of an interval are equal for exactly the interval's depth, so
of two children that join those pairs are maximal whose places have different
left words.  Of them the pairs are wanted whose distance is at most ``depth / 3``
(``MIN_EXPONENT - 1``); no pair is extended or compared word by word.

An interval keeps its places as one ordered list in which each has its left word
as class.  Places of an interval closer than half its depth stand a period apart
and all but the first of them have the same left word; so for a new place it is
enough to look at the class of the next place and of the first one in reach, and
all that is read beyond becomes a pair.  The same stretch found with a multiple of
its period is dropped (same start and end, larger distance).

Before suffixes are sorted, stretches that can't hold such a pair are passed over:
over its first ``depth - 4`` places a pair repeats five words at distance q, so a
stretch of consecutive places whose five words come again needs a distance
of at most (stretch + 4) / 3 somewhere.  This loses nothing, as equal words always
have equal hashes.  Suffixes of all stretches of a chunk of texts are sorted at
once by prefix doubling; a text is always in one chunk, whole."""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import map_batches, mix

MIN_LENGTH, MIN_EXPONENT = 6, 4
GRAM = MIN_LENGTH - 1        # least depth of a wanted pair: period 1
CHUNK_WORDS = 400_000        # texts are taken together up to so many words
MEMO = 1_000_000             # numbers of words are forgotten, between chunks, beyond so many


class WordNumbers:
    """A number for each different word, exact within a chunk; filled in the task that uses it."""

    of: dict[bytes, int] | None = None

    def clear(self):
        self.of = None

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if self.of is None:
            self.of = defaultdict(itertools.count(1).__next__)
        return np.fromiter(map(self.of.__getitem__, words), np.int64, len(words))


def stretches(w: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches that may hold starts of wanted pairs: first and last place, and end of what their pairs may read.

    ``w`` holds the word numbers of texts side by side, text k up to ``ends[k]``."""
    n, k = len(w), MIN_EXPONENT - 1
    none = np.zeros(0, np.int64)
    if n < GRAM:
        return none, none, none
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    end = ends[text]
    at = np.flatnonzero(np.arange(n) + GRAM <= end)
    key = np.zeros(len(at), np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for i in range(GRAM):
        key = key * base + mix(w[at + i].astype(np.uint64))
    key = mix(key + mix(text[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    ahead = np.zeros(n, np.int64)                              # distance to the next place of the same words; 0: none
    ahead[at[order[same]]] = at[order[same + 1]] - at[order[same]]
    found = np.flatnonzero(ahead)
    if not len(found):
        return none, none, none
    cut = np.flatnonzero(np.diff(found) > 1)
    first, last = found[np.concatenate([[0], cut + 1])], found[np.concatenate([cut, [len(found) - 1]])]
    least = np.minimum.reduceat(ahead[found], np.concatenate([[0], cut + 1]))
    reach = (last - first + GRAM) // k
    ok = least <= reach
    first, last, reach = first[ok], last[ok], reach[ok]
    return first, last, np.minimum(end[first], last + GRAM + reach)


def suffix_order(symbols: np.ndarray, area: np.ndarray, area_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (within areas, each area by itself) and the length of the common prefix of each with the one before."""
    n = len(symbols)
    here = np.arange(n)
    rank = np.unique(area * (int(symbols.max()) + 1) + symbols, return_inverse=True)[1].astype(np.int64) + 1
    levels, width = [rank], 1
    while True:
        nxt = here + width
        behind = np.where(nxt < area_end, rank[np.minimum(nxt, n - 1)], 0)
        kinds, rank = np.unique(rank * (n + 1) + behind, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        if len(kinds) == n:
            break
        levels.append(rank)
        width *= 2
    order = np.empty(n, np.int64)
    order[rank - 1] = here
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, np.int64)
    together = area[a] == area[b]
    for k in range(len(levels) - 1, -1, -1):
        inside = together & (a < area_end[order[:-1]]) & (b < area_end[order[1:]])
        eq = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        step = np.where(eq, 1 << k, 0)
        a += step
        b += step
    lcp[1:] = a - order[:-1]
    return order, lcp


def maximal_pairs(order: np.ndarray, lcp: np.ndarray, left: np.ndarray) -> list[tuple[int, int, int]]:
    """``(place, distance, depth)`` of all maximal pairs of depth GRAM at least and distance at most ``depth / (MIN_EXPONENT - 1)``."""
    k = MIN_EXPONENT - 1
    sa, classes = order.tolist(), left.tolist()
    turn = np.flatnonzero(lcp >= GRAM)
    turn = turn[np.argsort(-lcp[turn], kind="stable")]
    places: dict[int, list[int]] = {}       # an interval's places in order, kept at the interval's first and last suffix
    other: dict[int, int] = {}              # the interval's other end
    pairs = []
    for i, depth in zip(turn.tolist(), lcp[turn].tolist()):      # deepest intervals first: bottom-up
        reach = depth // k
        lo, hi = other.get(i - 1, i - 1), other.get(i, i)
        one, two = places.get(i - 1), places.get(i)
        one = [sa[i - 1]] if one is None else one
        two = [sa[i]] if two is None else two
        small, big = (one, two) if len(one) < len(two) else (two, one)
        put = []
        for p in small:
            c = classes[p]
            at = bisect_left(big, p)
            put.append(at)
            if at < len(big) and big[at] - p <= reach and classes[big[at]] != c:
                j = at
                while j < len(big) and big[j] - p <= reach:
                    pairs.append((p, big[j] - p, depth))
                    j += 1
            if at and p - big[at - 1] <= reach:
                f = big[bisect_left(big, p - reach)]
                if classes[f] != c:
                    pairs.append((f, p - f, depth))
        if len(small) * 16 > len(big):
            big = sorted(big + small)
        else:
            for p in small:
                at = bisect_left(big, p)
                big.insert(at, p)
        for e in (i - 1, i):
            places.pop(e, None)
            other.pop(e, None)
        places[lo] = places[hi] = big
        other[lo], other[hi] = hi, lo
    return pairs


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of all runs of each text (word numbers), by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return out
    w = np.concatenate(texts)
    ends = np.cumsum([len(t) for t in texts])
    first, last, stop = stretches(w, ends)
    if not len(first):
        return out
    size = stop - first
    area_end = np.cumsum(size)
    area = np.repeat(np.arange(len(first)), size)
    place = np.arange(area_end[-1]) - np.repeat(area_end - size, size) + first[area]     # in w
    begins = np.concatenate([[0], ends[:-1]])
    own = np.searchsorted(ends, first, "right")                                          # text of each area
    left = np.where(place > begins[own[area]], w[np.maximum(place - 1, 0)], 0)           # no word number is 0
    order, lcp = suffix_order(w[place], area, np.repeat(area_end, size))
    best: dict[tuple[int, int, int], int] = {}
    for p, q, depth in maximal_pairs(order, lcp, left):
        start = int(place[p])
        a = int(area[p])
        if start > last[a]:
            continue                        # belongs to a later stretch
        t = int(own[a])
        key = (t, start - int(begins[t]), q + depth)
        if best.get(key, q + 1) > q:
            best[key] = q
    for (t, start, length), q in best.items():
        out[t].append((start, length, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that are in no run behind its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int32)
    for start, length, q in runs:
        step[start + q] += 1
        step[start + length] -= 1
    return list(itertools.compress(words, (np.cumsum(step[:-1]) == 0).tolist()))


def periodic_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` per row of ``docs(doc_id, text)``: all runs as
    ``array<struct<start, length, period>>`` by start and period (words from 0), and the text
    with every run cut to its first period (words joined by one space).

    ``edit(doc_id, words)`` may replace the words before they are looked at.  Null, empty and blank
    texts have no words, no run and an empty ``collapsed``; a null id is handed on; each row stands
    by itself, so equal rows give equal results.  Other columns are ignored."""
    number = WordNumbers()

    def scan(cols):
        out = {"doc_id": [], "n_words": [], "runs": [], "collapsed": []}
        held: list[tuple[int | None, list[bytes], np.ndarray]] = []
        total = 0

        def flush():
            for (d, words, _), runs in zip(held, runs_of([h[2] for h in held])):
                out["doc_id"].append(d)
                out["n_words"].append(len(words))
                out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                out["collapsed"].append(b" ".join(kept_words(words, runs)).decode("utf-8", "replace"))
            held.clear()
            if number.of is not None and len(number.of) > MEMO:
                number.clear()

        for d, text in zip(*cols):
            words = (text or b"").split()
            if edit is not None:
                words = edit(d, words)
            held.append((d, words, number(words)))
            total += len(words)
            if total >= CHUNK_WORDS:
                flush()
                total = 0
        flush()
        return out

    return map_batches(docs.select("doc_id", "text"), scan,
                       "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def plant_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document with the periodic tail that its id's checksum asks for; a null id has none."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def run_digest(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: number of runs, the run of greatest exponent (ties: smallest start, then period), and checksums."""
    better = "x.length * acc.period > acc.length * x.period"          # runs come by start and period, so ties stay with the first
    best = F.expr(f"aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), runs[0], (acc, x) -> if({better}, x, acc))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return (found.withColumn("_best", F.when(F.size("runs") > 0, best))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"),
                    F.col("_best.period").alias("period"), F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words"))
