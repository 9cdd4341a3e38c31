"""Operator 12, near duplicates by a multi-index Hamming join of MinHash signatures.

A set's signature is ``SYMBOLS`` symbols of ``BITS`` bits, each the low bits of the
least value of the set's shingles under one hash function.  Two sets of Jaccard J differ
in a symbol with probability 1 - J (a little less), so those that link lie within
``RADIUS`` symbols of each other.  The join finds all pairs within it: the signature
is split into ``CHUNKS`` chunks; if two signatures differ in at most ``2 * CHUNKS - 1``
symbols, one chunk at least has at most one error.  All single errors of a chunk are enumerated
by leaving out each of its symbols in turn, so such a pair shares a key (chunk, symbol left out, symbols that
are left).  At a similarity of exactly 0.8 a pair is beyond the radius with a probability of
3 in 100,000, and the less the higher it is.  Every candidate is confirmed on the full shingle sets.

Equal sets fold first.  Of the sets that share a key each is taken with the key's
first one; pairs within the radius and of fitting sizes are confirmed and
connect most of a group of copies.  What is connected need not be compared again, so
only keys that still hold sets of different components go on: there all pairs of different
components within the radius, found in blocks of signatures, are confirmed.  No link
between components is lost and a group of copies never meets itself whole.

Many sets may lie within the radius and yet not link (a symbol in ten is luck).  So that
these pairs are neither written nor read in full, a set brings its parity bits along: one bit
for each residue of its shingles, flipped by each.  Bits in which two sets differ are at most the
shingles that only one of them has, so a pair with too many can't link; the others are confirmed."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import WordHasher, components, map_batches, mix, stream_groups
from riskgraph.llm.jaccard import linked, overlaps, shingle_set
from riskgraph.session import cut_lineage

CHUNKS, WIDTH, BITS = 10, 4, 16
SYMBOLS = CHUNKS * WIDTH
RADIUS = 2 * CHUNKS - 1
BLOCK = 1024             # signatures of one side of a comparison task
TEXTS = 64               # texts that are confirmed with one other in a task
MOST_BITS = 1 << 15      # parity bits of a set at most (a bound for its size on the way, the filter stays safe)
FUNCTIONS = mix(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SYMBOLS symbols for each (non-empty) set."""
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    if sets:
        flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        for i in range(SYMBOLS):
            least = np.minimum.reduceat(flat * FUNCTIONS[2 * i] + FUNCTIONS[2 * i + 1], at)
            out[:, i] = mix(least) & np.uint64((1 << BITS) - 1)
    return out


def parity_bits(s: np.ndarray) -> bytes:
    """Parities of the counts of a set's shingles by residue; a power of two, twice the set's size or more, of residues."""
    m = 64
    while m < 2 * len(s) and m < MOST_BITS:
        m *= 2
    got = np.bincount((s & np.uint64(m - 1)).astype(np.intp), minlength=m) & 1
    return np.packbits(got.astype(np.uint8), bitorder="little").tobytes()


def fold_bits(bits: np.ndarray, size: int) -> np.ndarray:
    """Parity bits over fewer residues."""
    while len(bits) > size:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def may_link(na: int, nb: int, a: bytes, b: bytes, num: int, den: int) -> bool:
    """False if two sets of these sizes and parity bits can't link: they differ in too many shingles."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    apart = int(np.bitwise_count(fold_bits(x, size) ^ fold_bits(y, size)).sum())
    return apart * (den + num) <= (na + nb) * (den - num)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """``CHUNKS * WIDTH`` keys for each signature: a chunk without one of its symbols (exact, no hash)."""
    s = sig.astype(np.int64)
    out = np.empty((len(s), SYMBOLS), np.int64)
    for c in range(CHUNKS):
        for gone in range(WIDTH):
            key = np.full(len(s), c * WIDTH + gone, np.int64)
            for j in range(WIDTH):
                if j != gone:
                    key = key << BITS | s[:, c * WIDTH + j]
            out[:, c * WIDTH + gone] = key
    return out


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number (chunk * WIDTH + symbol left out) of the first key that rows of ``a`` share with ``b``; SYMBOLS if none."""
    wrong = (a != b).reshape(len(a), CHUNKS, WIDTH)
    errors = wrong.sum(axis=2)
    chunk = np.argmax(errors <= 1, axis=1)
    row = np.arange(len(a))
    gone = np.where(errors[row, chunk] == 1, np.argmax(wrong[row, chunk], axis=1), 0)
    return np.where(errors[row, chunk] <= 1, chunk * WIDTH + gone, SYMBOLS)


def near_components(docs: DataFrame, width: int = 4, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs(doc_id, text)``: documents link when
    ``den * intersection >= num * union`` of their sets of ``width``-word shingles (A-Z lower-cased);
    component_id is the smallest doc_id reachable, kept says that it is the document's own.

    The signatures are laid out for a similarity of 0.8 or more; below it the radius would miss pairs,
    so such a call is an error.  Null and blank texts have an empty set, link with nothing and are kept.  A row with a null
    id neither links nor has a component (null) and is kept.  Rows that repeat an id are linked
    through it.  Other columns are ignored."""
    if num * 10 < 8 * den:
        raise ValueError("near_components is laid out for a similarity of 0.8 or more")
    hasher = WordHasher(0)

    def scan(cols):
        sets = [shingle_set((t or b"").lower().split(), hasher, width) for t in cols[1]]
        sig = iter(signatures([s for s in sets if len(s)]))
        return {"doc_id": cols[0], "n_shingles": [len(s) for s in sets],
                "same": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "sig": [next(sig).tobytes() if len(s) else None for s in sets], "bits": [parity_bits(s) if len(s) else None for s in sets]}

    scanned = cut_lineage(map_batches(docs.select("doc_id", "text"), scan, "doc_id long, n_shingles long, same binary, sig binary, bits binary"))
    full = scanned.where("doc_id is not null and n_shingles > 0")
    folded = full.groupBy("same").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bits").alias("bits"))
    folded = cut_lineage(folded)
    nodes = folded.select("node", "n", "sig", "bits")

    def spread(cols):
        sig = np.frombuffer(b"".join(cols[1]), np.uint16).reshape(-1, SYMBOLS)
        return {"key": chunk_keys(sig).ravel(), "node": np.repeat(np.array(cols[0], np.int64), SYMBOLS)}

    keys = map_batches(nodes.select("node", "sig"), spread, "key long, node long")
    met = keys.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("hi")).where("lead < hi").select("key", "lead")
    members = cut_lineage(keys.join(met, "key").where("node <> lead"))

    tried = cut_lineage(close_pairs(members.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), nodes, num, den))
    # about as many texts as there are copies: always by shuffle, at every size
    links = cut_lineage(confirm(docs.hint("shuffle_merge"), tried, width, num, den))
    root = components(links)
    more = other_pairs(members, nodes, root, num, den).join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(cut_lineage(confirm(docs, cut_lineage(more), width, num, den)))
    copies = full.select("doc_id", "same").join(folded.select("same", "node"), "same").where("doc_id <> node")
    found = components(links.unionByName(copies.select(F.col("node").alias("a"), F.col("doc_id").alias("b"))))
    out = scanned.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def close_pairs(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Of ``pairs(a, b)`` those within the radius that can link by size and parity bits."""
    one, two = (nodes.select(F.col("node").alias(x), *(F.col(c).alias(c + x) for c in ("n", "sig", "bits"))) for x in "ab")

    def near(cols):
        a, b, na, nb, sa, sb, ba, bb = cols
        sig = [np.frombuffer(b"".join(s), np.uint16).reshape(-1, SYMBOLS) for s in (sa, sb)]
        ok = [i for i in ((sig[0] != sig[1]).sum(axis=1) <= RADIUS).nonzero()[0] if may_link(na[i], nb[i], ba[i], bb[i], num, den)]
        return {"a": [a[i] for i in ok], "b": [b[i] for i in ok]}

    fit = pairs.join(two, "b").join(one, "a").where(F.lit(den) * F.least("na", "nb") >= F.lit(num) * F.greatest("na", "nb"))
    return map_batches(fit.select("a", "b", "na", "nb", "siga", "sigb", "bitsa", "bitsb"), near, "a long, b long").distinct()


def other_pairs(members: DataFrame, nodes: DataFrame, root: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b`` (a < b): pairs of different components that share a key, lie within the radius and can link by size and parity bits.

    Pairs with the first set of a key are left to the caller, who has had them."""
    part = members.join(root.withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    busy = part.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = part.join(busy.where("lo < hi").select("key", "blocks"), "key").join(nodes, "node")
    own = F.pmod(F.xxhash64("node", F.lit(5)), "blocks").cast("int")
    # each pair of blocks once: a row goes to its block beside each other one
    rows = rows.withColumn("own", own).withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("key", F.least("own", "o").alias("l"), F.greatest("own", "o").alias("r"), (F.col("own") > F.col("o")).cast("int").alias("side"), "node", "part", "n", "sig", "bits")

    def pick(stream):
        group, held = None, []
        for row in stream:
            if row[:3] != group:
                yield from pairs_in(group, held)
                group, held = row[:3], []
            held.append(row[3:])
        yield from pairs_in(group, held)

    def pairs_in(group, held):
        if len(held) < 2:
            return
        key, l, r = group
        slot = key >> BITS * (WIDTH - 1)
        side = np.array([h[0] for h in held])
        node, part, n = (np.array([h[i] for h in held], np.int64) for i in (1, 2, 3))
        sig = np.frombuffer(b"".join(h[4] for h in held), np.uint16).reshape(-1, SYMBOLS)
        for i in range(len(held)):
            if l == r:
                ok = np.arange(len(held)) > i
            elif side[i] == 0:
                ok = side == 1
            else:
                continue
            ok &= (part != part[i]) & (node != node[i]) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i]))
            at = ok.nonzero()[0]
            at = at[(sig[at] != sig[i]).sum(axis=1) <= RADIUS] if len(at) else at
            if len(at):
                at = at[first_shared(sig[at], sig[i]) == slot]            # told once, by the first key that the pair shares
                for j in at:
                    if may_link(int(n[i]), int(n[j]), held[i][5], held[j][5], num, den):
                        yield int(min(node[i], node[j])), int(max(node[i], node[j]))

    return stream_groups(rows, ["key", "l", "r"], ["side", "node"], pick, "a long, b long").distinct()


def confirm(docs: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Of ``pairs(a, b)`` those whose texts link on their full shingle sets."""
    hasher = WordHasher(0)
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / TEXTS).cast("int").alias("blocks"))
    ahead = size.select(F.col("a").alias("doc_id"), "a", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(0).alias("side"))
    rest = pairs.join(size, "a").select(F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b", F.lit(6)), "blocks").cast("int").alias("block"), F.lit(1).alias("side"))
    texts = ahead.unionByName(rest).join(docs.select("doc_id", "text"), "doc_id")

    def compare(stream):
        group, lead = None, []
        for a, block, side, d, text in stream:
            if (a, block) != group:
                group, lead = (a, block), []
            s = shingle_set((text or "").encode().lower().split(), hasher, width)
            if side == 0:
                lead.append(s)
            elif len(s) and any(linked(int(overlaps(t, s, np.array([0, len(s)]))[0]), len(s), len(t), num, den) for t in lead if len(t)):
                yield a, d

    return stream_groups(texts.select("a", "block", "side", "doc_id", "text"), ["a", "block"], ["side"], compare, "a long, b long").distinct()
