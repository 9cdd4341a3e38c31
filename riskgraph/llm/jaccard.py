"""Operator 10, exact Jaccard join in the metric space of shingle sets.

Distance is 1 - Jaccard; two documents link at a distance of at most ``1 - J``.
Sets that are equal fold first, so only different sets are compared.

Regions.  Documents as pivots can't split unrelated texts: nearly all sit at a
distance of almost 1 from every pivot, so the triangle window would copy each
into each region.  The first level therefore cuts the shingle space into parts:
linked sets differ in at most ``T`` shingles, so of ``T + 1 + S`` parts at least
``S + 1`` are equal in both (``S`` parts are spare, so that parts of fewer than
two shingles, which say little, can be passed over unless a set has more than
``S`` of them).  Sets that share an equal part meet; the one of least hash is the
pivot, and the region of a pivot is all that meet it in some part - boundary
sets lie in several regions.

Below a similarity of ``PARTS_FROM`` parts would hold two or three shingles only;
there sets meet that share a shingle of their prefixes (class ``Prefixes``).

Of a region only sets stay that, by size and by a sketch of counts (a lower bound
of the difference of two sets), may link with another one.  Inside a region its pivots (the least hash and up to ``PIVOTS`` more) do the
work: each set's distance to each pivot is taken, sets within the link distance
are linked to the pivot (and so to each other), and of the others a set meets
only those that the triangle inequality allows: for each pivot the two distances
may differ by the link distance at most.  A large region is dealt out in blocks
of about ``BLOCK`` sets (open sets against all), so no task holds more than a
block, and no pair is written unless it links."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import WordHasher, components, map_batches, mix, powers, stream_groups
from riskgraph.session import cut_lineage

BLOCK = 512          # sets of one side of a comparison task
PIVOTS = 8           # pivots of a region whose distances serve as windows
FREQUENT = 1000      # a frequent shingle is in at least one document of so many
PARTS_FROM = 0.85    # from this similarity on parts hold enough shingles to tell sets apart
SHINGLES_A_CELL = 5  # of the sketches that rule out most pairs before sets are read
SKETCH_BLOCK = 2048  # sketches of one side of a comparison task
GROWTH = 1.5         # size classes of the parts


def shingle_set(words: list[bytes], hasher: WordHasher, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a lower-cased word list; fewer words than ``width`` make one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = hasher(words)
    k = min(width, n)
    base = powers(k, 0xC2B2AE3D27D4EB4F)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h += w[i:n - k + 1 + i] * base[i]
    return np.unique(mix(h + np.uint64(k)))


def linked(inter, a, b, num: int, den: int):
    """den * intersection >= num * union."""
    return den * inter >= num * (a + b - inter)


class Parts:
    """Signatures of a set: an equal part of two linked sets gives both an equal signature."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * GROWTH)))
        self.edges = np.array(edges, np.int64)

    def differ(self, top: int) -> int:
        """Most shingles by which two linked sets can differ if the larger has ``top``."""
        return int((2 * top * (self.den - self.num)) // (self.den + self.num))

    def signatures(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        if not n:
            return np.zeros(0, np.int64)
        out = []
        lo = int(np.searchsorted(self.edges, n, "right")) - 1
        hi = int(np.searchsorted(self.edges, n * self.den // self.num, "right")) - 1     # the partner may be that much larger
        for c in range(lo, hi + 1):
            t = self.differ(int(self.edges[c + 1]) - 1)
            spare = (t + 7) // 8
            m = t + 1 + spare
            part = ((s >> np.uint64(33)) % np.uint64(m)).astype(np.intp)
            sizes = np.bincount(part, minlength=m)
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, part, mix(s))
            sig = mix(sums + np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c * 1_000_003))
            thin = sizes < 2
            take = np.ones(m, bool) if m == 1 or thin.sum() > spare else ~thin
            out.append(sig[take])
        return np.unique(np.concatenate(out)).view(np.int64)


class Prefixes:
    """The prefix filter as signatures, for links below a similarity where parts are too thin: two linked sets share one of
    their first ``n - ceil(num / den * n) + 1`` shingles in any order common to both.  Frequent shingles come last (by
    their counts), so that a passage of many documents brings only those together that hold little else."""

    def __init__(self, num: int, den: int, keys: np.ndarray, counts: np.ndarray):
        self.num, self.den, self.keys, self.counts = num, den, keys, counts

    def signatures(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        if not n:
            return np.zeros(0, np.int64)
        rank = np.zeros(n, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
            rank = np.where(self.keys[at] == s, self.counts[at], 0)
        first = np.lexsort((s, rank))[:n - -(-self.num * n // self.den) + 1]
        return s[first].view(np.int64)


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in more than about one document of ``FREQUENT``, with their counts, over all documents.

    Lossy counting: a batch reports the shingles that reach that share in it, and the sums that reach half the share
    are kept, so what reaches the driver is bounded by 2 x FREQUENT times the mean size of a set.  Only the order of
    shingles depends on it, no result does."""
    hasher = WordHasher(0)

    def count(cols):
        sets = [shingle_set((t or b"").lower().split(), hasher, width) for t in cols[0]]
        keys, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = n >= max(2, -(-len(sets) // FREQUENT))
        return {"s": keys[often].view(np.int64), "n": n[often]}

    total = docs.count()
    got = map_batches(docs.select("text"), count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    got = got.where(F.col("n") >= max(2, total // (2 * FREQUENT))).toPandas()
    keys = got["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got["n"].to_numpy(np.int64)[order]


def size_class(n: int) -> int:
    """Classes of sizes by powers of ``GROWTH``."""
    c = 0
    while GROWTH ** (c + 1) <= n:
        c += 1
    return c


def sketch(s: np.ndarray, cls: int) -> bytes:
    """Counts (to 255) of a set's shingles in about a fifth as many cells as sets of this class and the next have shingles.

    The sum of the differences of two sketches is at most the number of shingles that only one of the sets has."""
    cells = max(8, int(GROWTH ** cls / SHINGLES_A_CELL))
    got = np.bincount(((s >> np.uint64(7)) % np.uint64(cells)).astype(np.intp), minlength=cells)
    return np.minimum(got, 255).astype(np.uint8).tobytes()


def overlaps(s: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Size of the intersection of the sorted set ``s`` with each of the sets in ``flat``."""
    at = np.searchsorted(s, flat)
    hit = np.zeros(len(flat) + 1, np.int64)
    hit[1:] = np.cumsum(s[np.minimum(at, len(s) - 1)] == flat)
    return hit[ends[1:]] - hit[ends[:-1]]


class Block:
    """Several sets side by side."""

    def __init__(self, rows: list[tuple]):
        """rows: (id, set, distances to the pivots)"""
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.sets = [np.frombuffer(r[1], np.uint64) for r in rows]
        self.dist = np.array([r[2] for r in rows], np.float64).reshape(len(rows), -1)
        self.n = np.array([len(x) for x in self.sets], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.n)])
        self.flat = np.concatenate(self.sets)


def compare(doc_id: int, s: np.ndarray, dist: np.ndarray, block: Block, num: int, den: int) -> np.ndarray:
    """Ids of the block's sets that link with ``s``: candidates by size and by the window of each pivot."""
    ok = (block.ids != doc_id) & (den * np.minimum(block.n, len(s)) >= num * np.maximum(block.n, len(s)))
    ok &= (np.abs(block.dist - dist) <= 1 - num / den + 1e-9).all(axis=1)
    at = np.flatnonzero(ok)
    if not len(at):
        return at
    if 4 * len(at) < len(ok):
        inter = np.array([overlaps(s, block.sets[j], np.array([0, block.n[j]]))[0] for j in at])
    else:
        inter = overlaps(s, block.flat, block.ends)[at]
    return block.ids[at[linked(inter, len(s), block.n[at], num, den)]]


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs(doc_id, text)``: documents link when
    ``den * intersection >= num * union`` of their sets of ``width``-word shingles (A-Z lower-cased);
    component_id is the smallest doc_id reachable.

    Null or blank texts have an empty set, link with nothing and form their own
    component.  A row with a null id neither links nor has a component (null).
    Rows that repeat an id are linked through it.  Other columns are ignored."""
    hasher = WordHasher(0)
    parts = Parts(num, den) if num >= PARTS_FROM * den else Prefixes(num, den, *frequent_shingles(docs, width))

    def scan(cols):
        out = {"doc_id": cols[0], "n_shingles": [], "same": [], "sid": [], "sigs": [], "classes": []}
        for text in cols[1]:
            s = shingle_set((text or b"").lower().split(), hasher, width)
            # its own size class, and those that its larger partners may be in
            out["classes"].append([{"cls": c, "sketch": sketch(s, c)} for c in range(size_class(len(s)), size_class(len(s) * den // num) + 1)] if len(s) else [])
            same = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            out["n_shingles"].append(len(s))
            out["same"].append(same)
            out["sid"].append(int.from_bytes(same[:8], "little", signed=True))
            out["sigs"].append(parts.signatures(s))
        return out

    scanned = cut_lineage(map_batches(docs.select("doc_id", "text"), scan, "doc_id long, n_shingles long, same binary, sid long, sigs array<long>, classes array<struct<cls:int,sketch:binary>>"))
    full = scanned.where("doc_id is not null and n_shingles > 0")
    named = full.select("doc_id", "same", "sid")
    reps = cut_lineage(named.groupBy("same", "sid").agg(F.min("doc_id").alias("rep")))
    # rows meet by id (ids close to each other take little room); copies are folded into their set behind that
    sig = full.select("doc_id", F.explode("sigs").alias("sig"))
    met = sig.groupBy("sig").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("sig", "lo")
    # of rows that meet at all, those of sizes that can link.  Copies are one node from here on, and a region of one node is none.
    names = full.select("doc_id", "sid", F.col("classes.cls").alias("classes")).distinct()
    rows = sig.join(met.select("sig"), "sig").join(names, "doc_id").select("sid", "sig", F.explode("classes").alias("cls"))
    rows = cut_lineage(rows.distinct())
    least = rows.groupBy("sig", "cls").agg(F.min("sid").alias("pivot"), F.max("sid").alias("hi")).where("pivot < hi").drop("hi")
    members = rows.join(least, ["sig", "cls"]).select("pivot", "cls", F.col("sid").alias("node")).distinct()
    sketches = full.select(F.col("sid").alias("node"), "n_shingles", F.explode("classes").alias("c")).select("node", "n_shingles", "c.cls", "c.sketch")
    members = cut_lineage(likely(cut_lineage(members), sketches.dropDuplicates(["node", "cls"]), num, den))
    of = cut_lineage(reps.groupBy("sid").agg(F.min("rep").alias("rep")))

    def sets(cols):
        out = {"node": [], "set": []}
        for sid, text in zip(*cols):
            s = shingle_set((text or b"").lower().split(), hasher, width).tobytes()
            if int.from_bytes(hashlib.blake2b(s, digest_size=16).digest()[:8], "little", signed=True) == sid:    # else another text of the same id
                out["node"].append(sid)
                out["set"].append(s)
        return out

    wanted = members.select("node").distinct().join(of.withColumnRenamed("sid", "node"), "node").select(F.col("rep").alias("doc_id"), F.col("node").alias("sid"))
    # equal rows once; the join has dealt the rows out by id already
    texts = docs.select("doc_id", "text").join(wanted, "doc_id").dropDuplicates(["doc_id", "sid", "text"])
    held = cut_lineage(map_batches(texts.select("sid", "text"), sets, "node long, set binary"))
    links = region_links(held, members, num, den)
    links = (links.join(of.select(F.col("sid").alias("a"), F.col("rep").alias("x")), "a")
             .join(of.select(F.col("sid").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    pairs = links.unionByName(named.join(reps, ["same", "sid"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    roots = components(pairs)
    out = scanned.select("doc_id", "n_shingles").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def likely(members: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """``pivot, node``: members of a region that, by size and sketch, may link with another member."""
    blocks = members.groupBy("pivot", "cls").agg(F.ceil(F.count("*") / SKETCH_BLOCK).cast("int").alias("b"))
    rows = members.join(blocks, ["pivot", "cls"]).join(sketches, ["node", "cls"])
    own = F.pmod(F.xxhash64("node", F.lit(3)), "b").cast("int")
    each = F.explode(F.expr("sequence(0, b - 1)"))
    cols = ["pivot", "cls", "l", "r", "side", "node", "n_shingles", "sketch"]
    left = rows.withColumn("l", own).withColumn("r", each).withColumn("side", F.lit(0)).select(*cols)
    right = rows.withColumn("r", own).withColumn("l", each).withColumn("side", F.lit(1)).select(*cols)

    def pick(stream):
        key, waiting, ids, sizes, cells = None, [], None, None, None
        for pivot, cls, l, r, side, node, n, raw in stream:
            if (pivot, cls, l, r) != key:
                key, waiting, ids = (pivot, cls, l, r), [], None
            if side == 0:
                waiting.append((node, n, raw))
                continue
            if waiting:
                ids, sizes = np.array([w[0] for w in waiting], np.int64), np.array([w[1] for w in waiting], np.int64)
                cells, waiting = np.stack([np.frombuffer(w[2], np.uint8) for w in waiting]).astype(np.int16), []
            if ids is None:
                continue
            at = np.flatnonzero((ids != node) & (den * np.minimum(sizes, n) >= num * np.maximum(sizes, n)))
            if len(at):
                apart = np.abs(cells[at] - np.frombuffer(raw, np.uint8).astype(np.int16)).sum(axis=1, dtype=np.int64)
                if (apart * (den + num) <= (sizes[at] + n) * (den - num)).any():
                    yield pivot, node

    return stream_groups(left.unionByName(right), ["pivot", "cls", "l", "r"], ["side", "node"], pick, "pivot long, node long").distinct()


def region_links(held: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``(a, b)`` inside the regions ``members(pivot, node)`` of the sets ``held(node, set)``,
    enough to connect all that are connected."""
    # pivots of a region: its least node, and the smallest in each of PIVOTS slots of a hash
    slot = members.groupBy("pivot", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("slot")).agg(F.min("node").alias("p"))
    pivots = slot.select("pivot", "p").union(members.select("pivot", "pivot").distinct()).distinct()
    size = members.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    ahead = (pivots.join(size, "pivot").join(held.withColumnRenamed("node", "p"), "p")
             .select("pivot", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(0).alias("side"), F.col("p").alias("node"), "set"))
    rest = (members.join(size, "pivot").join(held, "node")
            .select("pivot", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int").alias("block"), F.lit(1).alias("side"), "node", "set"))

    def distances(rows):
        key, held_pivots = None, []
        for pivot, block, side, d, raw in rows:
            if (pivot, block) != key:
                key, held_pivots = (pivot, block), []
            s = np.frombuffer(raw, np.uint64)
            if side == 0:
                held_pivots.append((d, s))
                continue
            dist, mask, own = [], 0, False
            for i, (p, t) in enumerate(held_pivots):
                inter = len(s) if p == d else int(overlaps(s, t, np.array([0, len(t)]))[0])
                dist.append(1 - inter / (len(s) + len(t) - inter))
                own |= p == d
                if linked(inter, len(s), len(t), num, den):
                    mask |= 1 << i
            near = [p for i, (p, _) in enumerate(held_pivots) if mask >> i & 1 and p != d]
            yield pivot, d, own, mask, near, dist

    placed = cut_lineage(stream_groups(ahead.unionByName(rest), ["pivot", "block"], ["side", "node"], distances,
                                       "pivot long, node long, is_pivot boolean, mask int, near array<long>, dist array<double>"))
    first = placed.select(F.explode("near").alias("a"), F.col("node").alias("b"))

    # Pivots that share a near set are connected.  The largest such group of a region (by its sets) is settled:
    # all its sets are connected already, so only a pair with a set outside the group can bring a new link.
    kinds = placed.where("mask > 0").groupBy("pivot", "mask").agg(F.count("*").alias("n"))   # at most 2^(PIVOTS + 1) a region

    def largest(rows):
        key, groups = None, []
        for pivot, mask, n in [*rows, (None, 0, 0)]:
            if pivot != key:
                if groups:
                    yield key, max(groups, key=lambda g: (g[1], g[0]))[0]
                key, groups = pivot, []
            if mask:
                joined = [g for g in groups if g[0] & mask]
                groups = [g for g in groups if not g[0] & mask]
                whole = mask
                for g in joined:
                    whole |= g[0]
                groups.append((whole, n + sum(g[1] for g in joined)))

    hub = stream_groups(kinds, ["pivot"], ["mask"], largest, "pivot long, hub int")
    # pivots have met all sets of their region; what is left are the other sets
    left = placed.where("not is_pivot").join(hub, "pivot", "left").withColumn("open", F.coalesce(F.col("mask").bitwiseAND(F.col("hub")) == 0, F.lit(True)))
    open_size = (left.groupBy("pivot").agg(F.count("*").alias("n"), F.count(F.when(F.col("open"), 1)).alias("u")).where("u > 0 and n > 1")
                 .select("pivot", F.ceil(F.col("u") / BLOCK).cast("int").alias("lb"), F.ceil(F.col("n") / BLOCK).cast("int").alias("rb")))
    todo = left.select("pivot", "node", "open", "dist").join(open_size, "pivot").join(held, "node").withColumn("h", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1 << 30)))
    opened = (todo.where("open").withColumn("l", (F.col("h") % F.col("lb")).cast("int"))
              .withColumn("r", F.explode(F.expr("sequence(0, rb - 1)"))).withColumn("side", F.lit(0)))
    all_ = (todo.withColumn("r", (F.col("h") % F.col("rb")).cast("int"))
            .withColumn("l", F.explode(F.expr("sequence(0, lb - 1)"))).withColumn("side", F.lit(1)))
    cols = ["pivot", "l", "r", "side", "node", "set", "dist"]

    def blocks(rows):
        key, waiting, block = None, [], None
        for pivot, l, r, side, d, raw, dist in rows:
            if (pivot, l, r) != key:
                key, waiting, block = (pivot, l, r), [], None
            if side == 0:
                waiting.append((d, raw, dist))
                continue
            if waiting:
                block, waiting = Block(waiting), []
            if block is not None:
                for other in compare(d, np.frombuffer(raw, np.uint64), np.array(dist), block, num, den):
                    yield int(other), d

    second = stream_groups(opened.select(*cols).unionByName(all_.select(*cols)), ["pivot", "l", "r"], ["side", "node"], blocks, "a long, b long")
    return cut_lineage(first.unionByName(second))
