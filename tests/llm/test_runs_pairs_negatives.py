"""Operators 11 to 13 against plain Python, and on rows they must survive."""
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgraph.llm import minhash, negatives, periodic, queries
from riskgraph.llm.common import table

from .rows import edge_rows

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- operator 11
def brute_runs(w):
    out = set()
    n = len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(6, 4 * q) and not any(w[i:i + size - r] == w[i + r:i + size] for r in range(1, q)):
                out.add((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_small_words():
    random.seed(11)
    texts = []
    for _ in range(1500):
        n = random.choice([0, 1, 4, 5, 6, 7, 12, 30, 60, 120])
        w = [random.randint(1, random.choice([1, 2, 2, 3, 5])) for _ in range(n)]
        if random.random() < 0.6 and n > 8:
            a = random.randrange(n)
            p = 1 + (n - a) // random.randint(3, 10)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            if random.random() < 0.5:
                w[random.randrange(n)] = 9
        texts.append(w)
    got = periodic.runs_of([np.array(w, np.int64) for w in texts])
    expected = [brute_runs(w) for w in texts]
    assert got == expected and sum(map(len, expected)) > 300
    assert periodic.runs_of([]) == [] and periodic.runs_of([np.zeros(0, np.int64)] * 2) == [[], []]


def test_runs_of_long_words():
    """One word over and over, a long period, and many short runs; linear enough for a text of a million words."""
    assert periodic.runs_of([np.ones(300_000, np.int64)]) == [[(0, 300_000, 1)]]
    assert periodic.runs_of([np.tile(np.arange(1, 50_001), 4)]) == [[(0, 200_000, 50_000)]]
    assert periodic.runs_of([np.tile(np.arange(1, 50_001), 4)[:-1]]) == [[]]


def test_op11_query(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(rows)
    some = 0
    for d, text in rows:
        words = text.encode().split()
        n, h = len(words), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        some += len(runs)
        gone = [False] * n
        for s, size, q in runs:
            gone[s + q:s + size] = [True] * (size - q)
        r = got[d]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for w, x in zip(words, gone) if not x)).hexdigest()
    assert some


def test_runs_edges(make_docs):
    more = [(20, "a " * 6, "en", "a"), (21, "a " * 5, "en", "a"), (21, "a " * 5, "en", "a"), (22, "x\ny\x0by\tx  " * 4, None, None), (23, "k " + "a b " * 4 + "b", "en", "a")]
    rows = edge_rows() + more
    found = periodic.periodic_runs(make_docs(rows)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    got = {r.doc_id: r for r in found}
    assert [tuple(x) for x in got[20].runs] == [(0, 6, 1)] and got[20].collapsed == "a" and got[21].runs == []
    assert [tuple(x) for x in got[22].runs] == [(0, 16, 4)] and got[22].collapsed == "x y y x"
    assert [tuple(x) for x in got[23].runs] == [(1, 8, 2)] and got[23].collapsed == "k a b b"
    assert got[3].runs == got[4].runs == got[5].runs == [] and got[3].collapsed == "" and got[5].n_words == 0 and got[6].n_words == 30_000
    assert periodic.run_digest(periodic.periodic_runs(make_docs([]))).collect() == []


# ---------------------------------------------------------------- operator 12
def brute_components(rows, width, num, den):
    sets = {}
    for d, text in rows:
        w = (text or "").encode().lower().split()
        sets[d] = {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_op12_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    expected = brute_components(rows, 4, 80, 100)
    got = queries.op12_minhash_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and not all(r.kept for r in got)


def chain_rows(n):
    """Texts of 60 words; each differs from the next in one word, so neighbours link and ends don't; and a group that meets without a link."""
    random.seed(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        rows.append((i + 1, " ".join(base)))
        base = list(base)
        base[random.randrange(60)] = f"new{i}"
    for i in range(n):      # half the words in common: keys meet, nothing links
        rows.append((1000 + i, " ".join([f"c{k}" for k in range(60)] + [f"own{i}_{k}" for k in range(30)])))
    return rows


def test_chains_and_unlinked_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "TEXTS", 3)
    rows = chain_rows(40)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 4, 80, 100)


def test_join_finds_all_pairs_within_the_radius():
    """Signatures with as many errors as the radius allows, dealt out at random, share a key; the first shared key is the first."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (4000, minhash.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for i in range(len(b)):
        at = rng.choice(minhash.SYMBOLS, minhash.RADIUS, replace=False)
        b[i, at] ^= np.uint16(1)
    same = minhash.chunk_keys(a) == minhash.chunk_keys(b)
    assert same.any(axis=1).all()
    assert (minhash.first_shared(a, b) == same.argmax(axis=1)).all()


def test_components_edges(make_docs):
    got = minhash.near_components(make_docs(edge_rows())).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in edge_rows())
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and not by[2].kept and by[7].component_id == 6 and by[10].component_id == 1
    assert by[3].component_id == 3 and by[3].n_shingles == 0 and by[3].kept and by[8].n_shingles == 1
    assert by[None].component_id is None and by[None].kept
    assert minhash.near_components(make_docs([])).collect() == []
    with pytest.raises(ValueError):
        minhash.near_components(make_docs([]), 4, 70, 100)


# ---------------------------------------------------------------- operator 13
def brute_negatives(rows):
    vectors = {}
    for d, y, v in rows:
        if d is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = tuple(math.floor(256 * float(x)) for x in v)
        key = (y, np.array(v, "<i4").tobytes())
        if d not in vectors or key < vectors[d][0]:
            vectors[d] = (key, y, v)
    out = []
    for d, (_, y, v) in vectors.items():
        if d % 100:
            continue
        score = sorted(((-sum(a * b for a, b in zip(v, o)), e, z) for e, (_, z, o) in vectors.items() if e != d))
        for s, p, _ in [x for x in score if x[2] == y][:5]:
            near = [(e, -t) for t, e, z in score if z != y and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(d, p, k + 1, e, -s, t) for k, (e, t) in enumerate(near)]
    return sorted(out)


def test_op13_query(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    got = sorted(tuple(r) for r in queries.op13_hard_negatives(spark, SF).collect())
    assert got == brute_negatives(rows) and len(got) > 100


def test_negatives_edges(spark, monkeypatch):
    """Nulls, not-a-number, empty and shorter vectors, ties, equal rows, several blocks."""
    for name, value in (("ROWS", 40), ("ANCHORS", 2), ("STEP", 2), ("FEW", 3)):
        monkeypatch.setattr(negatives, name, value)
    random.seed(13)
    rows = [(i, i % 3, [random.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)]) for i in range(400)]
    rows += [(400, 1, None), (500, None, [1.0] * 6), (600, 1, [1.0, None]), (700, 1, [float("nan")] * 6), (800, 1, [float("inf")] * 6),
             (None, 1, [1.0] * 6), (900, 2, []), (901, 0, [1.0]), (100, 1, rows[100][2]), (902, 1, [1.0, 1.0]), (200, 9, [0.0])]
    schema = "vec_id long, label int, embedding array<float>, score long, rb int, extra string"
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema)
    got = sorted(tuple(r) for r in negatives.hard_negatives(docs, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_negatives(rows) and got
    assert negatives.hard_negatives(docs.where("false"), F.col("vec_id") % 100 == 0).collect() == []
    with pytest.raises(Exception, match="component beyond"):
        negatives.hard_negatives(spark.createDataFrame([(1, 1, [1e9])], "vec_id long, label int, embedding array<double>"), F.lit(True)).collect()


def test_bounds_shrink_the_candidates():
    """A few dimensions that say most leave few rows for the others."""
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, np.concatenate([rng.integers(-200, 200, 8), rng.integers(-2, 3, 56)]).astype("<i4").tobytes()) for i in range(5000)]
    block = negatives.Columns(rows)
    a = np.frombuffer(rows[0][2], "<i4").astype(np.int64)
    seen = []

    def shrink(partial, least, most):
        bar = negatives.kth(partial, 5)
        keep = partial + most >= bar + least
        seen.append(int(keep.sum()))
        return keep
    negatives.scan(block, np.flatnonzero(block.labels == 0)[1:], a, shrink)
    assert seen[0] < 200


def test_parity_bits_pass_every_link():
    """Sets of all sizes, also beyond MOST_BITS: what links is let through, and unrelated sets are not."""
    rng = np.random.default_rng(8)
    for n in (1, 4, 5, 9, 31, 33, 60, 500, 530, 5000, 40_000):
        for gone, more in ((0, 0), (1, 0), (n // 9, n // 9), (n // 5, 0), (0, n // 4)):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, more, dtype=np.uint64)]))
            both = len(a) - gone
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                assert minhash.may_link(len(a), len(b), minhash.parity_bits(a), minhash.parity_bits(b), 80, 100)
        c = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        if n > 30 and n < 10_000:
            assert not minhash.may_link(len(a), len(c), minhash.parity_bits(a), minhash.parity_bits(c), 80, 100)
