"""Operators against plain Python on the small driver tables and on hand-made rows."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskgraph.llm import decontam, jaccard, langid, licenses, lines, mixing, quality, substring, toxicity, urls
from riskgraph.llm.common import components, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def test_substring_dedup(docs, rows):
    words = {d: t.encode().split() for d, t in rows}
    first = {}
    for d, _ in rows:
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i:i + 50]), d)
    got = {r.doc_id: r for r in substring.dedup_substrings(docs).collect()}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i:i + 50])] < d:
                gone[i:i + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())


def test_substrings_of_a_repeated_id(spark):
    """A copy and a unique text under one id."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b + " tail")], "doc_id long, text string")
    got = {(r.doc_id, r.kept_text): r.n_removed for r in substring.dedup_substrings(docs, with_text=True).collect()}
    assert got == {(1, a): 0, (2, ""): 60, (2, b): 0, (3, "tail"): 60}


def test_doubling(spark):
    w = [f"w{i}" for i in range(400)]
    data = [(1, " ".join(w)), (2, "x " + " ".join(w[:250])), (3, "y " + " ".join(w[300:360])), (4, "z")]
    got = {r.doc_id: r.words for r in substring.longest_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {2: 200, 3: 50}


def test_leaks(docs, spark, rows):
    bench = table(spark, SF, "benchmark")
    items = {r.item_id: r.text.encode().lower().split() for r in bench.collect()}
    expected = {}
    for d, t in rows:
        w = t.encode().lower().split()
        for i, it in items.items():
            n, goal, best = len(it), Counter(tuple(it[k:k + 5]) for k in range(len(it) - 4)), None
            for s in range(len(w) - n + 1):
                own = Counter(tuple(w[k:k + 5]) for k in range(s, s + n - 4)) if tuple(w[s + n // 2:s + n // 2 + 2]) or True else None
                if not own.keys() & goal.keys():
                    continue
                shared = sum((own & goal).values())
                j = shared / (2 * (n - 4) - shared)
                if j >= 0.8 and (best is None or j > best[0]):
                    best = (j, s)
            if best:
                expected[(d, i)] = (round(best[0], 6), best[1])
        if len(expected) > 2 and d > 120:
            break
    top = d
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontam.find_leaks(docs.where(f"doc_id <= {top}"), bench).collect()}
    assert got == expected and got


def test_leaks_of_texts_shorter_than_the_item(spark):
    items = {1: [f"a{i}" for i in range(59)], 2: [f"b{i}" for i in range(15)], 3: [f"c{i}" for i in range(45)]}
    texts = {1: items[1][:-5], 2: items[2][:-1], 3: items[3][5:], 4: items[1][:46], 5: items[1][:40], 6: items[2][:4]}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, r.similarity) for r in decontam.find_leaks(docs, bench).collect()}
    # 46 of 59 words: 42 of 55 shingles, below 0.8
    assert got == {(1, 1): (0, 54, round(50 / 55, 6)), (2, 2): (0, 14, round(10 / 11, 6)), (3, 3): (0, 40, round(36 / 41, 6))}


def brute_components(rows, width, num, den):
    sets, root = {}, {}
    for d, t in rows:
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        root[d] = d

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            inter = len(sets[a] & sets[b])
            if inter and den * inter >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80)])
def test_jaccard_join(spark, rows, width, num):
    rng = random.Random(5)
    base = [f"v{rng.randrange(5000)}" for _ in range(260)]
    extra = []
    for k in range(60):                                   # a family of near copies at all distances
        w = list(base)
        for _ in range(rng.randrange(0, 16)):
            w[rng.randrange(len(w))] = f"n{k}_{rng.randrange(9)}"
        extra.append((10_000 + k, " ".join(w[:rng.randrange(230, 261)])))
    short = [(20_000 + k, t) for k, t in enumerate(["a", "a", "a b", "A b", "", " ", "a b c d", "a b c d", "a b c e"])]
    data = rows + extra + short
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           jaccard.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), width, num, 100).collect()}
    assert got == brute_components(data, width, num, 100)


def test_blocks_and_windows(spark, monkeypatch):
    """Regions of many blocks with few sets each give the same links."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(6)
    base = [f"v{i}" for i in range(120)]
    data = []
    for k in range(80):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"n{k}_{rng.randrange(99)}"
        data.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           jaccard.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == brute_components(data, 3, 90, 100)


def test_components_path_and_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def test_lines(spark, docs, rows):
    sep = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r.doc_id: set(r.removed) for r in lines.line_report(docs).collect()}
    seen, more = set(), 0
    for d, t in rows:
        for i, line in enumerate(t.split("\n")):
            key = sep.sub(" ", line.lower()).strip(" ")
            if not key:
                assert i not in got[d]
            elif key in seen:
                assert i in got[d]
            else:
                more += i in got[d]
                seen.add(key)
    long = " ".join(f"tok{i}" for i in range(300))
    data = [(1, "alpha beta gamma\nfirst"), (2, "Alpha, beta; GAMMA!\nsecond"), (3, long), (4, long + " tail"), (5, long.replace("tok7 ", "other "))]
    kept = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert kept[1] == data[0][1] and kept[2] == "second" and kept[3] == long


def test_line_links_equal_brute_force(spark, docs):
    """Groups are those of all pairs within the radius and the edit similarity."""
    from pyspark.sql import functions as F
    rng = random.Random(8)
    base = [f"tok{i}" for i in range(90)]
    family = []
    for k in range(25):                                    # lines at all distances from each other
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(40)}"
        family.append(" ".join(w))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000, "\n".join(family))], "doc_id long, text string"))
    rows = lines.fingerprints(docs)
    distinct = rows.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "th", "line")).alias("first"), F.first("fp").alias("fp"), F.first("n").alias("n"))
    fp = distinct.collect()
    close = [(a, b) for i, a in enumerate(fp) for b in fp[i + 1:] if bin((a.fp ^ b.fp) & (2**64 - 1)).count("1") <= 2]
    whole = {r.doc_id: r.text for r in docs.collect()}
    sep = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def edit(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]
    root = {r.k1: r.k1 for r in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in close:
        x, y = (sep.sub(" ", whole[r["first"].doc_id].split("\n")[r["first"].line].lower()).strip(" ") for r in (a, b))
        if edit(x, y) <= int(0.1 * max(len(x), len(y)) + 1e-9):
            p, q = find(a.k1), find(b.k1)
            root[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in lines.line_groups(docs, distinct).collect()}
    assert all(got[k] == got[find(k)] for k in root if find(k) != k)          # lines near in SimHash and edits
    assert len({k for k in root if find(k) != k}) > 5
    line = {r.k1: sep.sub(" ", whole[r["first"].doc_id].split("\n")[r["first"].line].lower()).strip(" ") for r in fp}
    groups = defaultdict(list)
    for k, r in got.items():
        groups[r].append(line[k])
    for g in groups.values():                              # and no group but by links
        near, todo = {g[0]}, [g[0]]
        while todo:
            x = todo.pop()
            new = [y for y in g if y not in near and edit(x, y) <= int(0.1 * max(len(x), len(y)) + 1e-9)]
            near.update(new)
            todo += new
        assert len(near) == len(g)


def test_line_fingerprints_are_majorities(spark):
    """SimHashes of lines of all sizes, beyond one chunk too, bit by bit."""
    from pyspark.sql import functions as F
    data = [(n, " ".join(f"w{n}x{i % 1000}" for i in range(n))) for n in (1, 2, 3, 8, 62, 63, 64, 65, 126, 127, 256, 900, 70_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.fp for r in lines.fingerprints(docs).collect()}
    words = docs.select("doc_id", F.explode(F.split("text", " ")).alias("w")).select("doc_id", F.xxhash64("w").alias("h"))
    hashes = defaultdict(list)
    for r in words.collect():
        hashes[r.doc_id].append(r.h)
    for n, _ in data:
        want = sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes[n]) > n)
        assert got[n] & (2**64 - 1) == want, n


@pytest.mark.parametrize("hot", [False, True])
def test_hot_line_keys_change_nothing(spark, monkeypatch, hot):
    """Lines that all share a run of words, with copies; dealt out to salts or not, the same lines go."""
    if hot:
        monkeypatch.setattr(lines, "ROWS", 0)
        monkeypatch.setattr(lines, "SHARE", 1000)
        monkeypatch.setattr(lines, "PROBE", 1)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    data = []
    for i in range(60):
        w = ["international", "community", *[word() for _ in range(9)]]
        data += [(3 * i, " ".join(w)), (3 * i + 1, " ".join([*w[:6], "q" + w[6][1:], *w[7:]])), (3 * i + 2, " ".join(w).upper() if i % 2 else word())]
    gone = {r.doc_id: r.n_removed for r in lines.line_report(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()}
    assert gone == {d: int(d % 3 == 1 or (d % 3 == 2 and d // 3 % 2 == 1)) for d, _ in data}


def test_recall_of_longer_lines(spark):
    """Letters changed at random places: of the pairs of edit similarity 0.9 and more, 0.9 are found at each length."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    data, kind = [], {}
    for n in (12, 20, 40, 80):
        for part in (0.03, 0.06, 0.09):
            for _ in range(60):
                a = " ".join(word() for _ in range(n))
                at = set(rng.sample([i for i, c in enumerate(a) if c != " "], int(part * len(a))))
                b = "".join(rng.choice("qrstuvwxyz") if i in at else c for i, c in enumerate(a))
                d = len(data)
                data += [(d, a), (d + 1, b)]
                kind[d + 1] = (n, part)
    found = defaultdict(int)
    for r in lines.line_report(spark.createDataFrame(data, "doc_id long, text string")).collect():
        if r.doc_id in kind:
            found[kind[r.doc_id]] += r.n_removed
        else:
            assert r.n_removed == 0
    print({k: round(v / 60, 2) for k, v in found.items()})
    assert all(sum(found[n, part] for part in (0.03, 0.06, 0.09)) >= 0.9 * 180 for n in (12, 20, 40, 80))
    assert all(found[n, part] >= 0.95 * 60 for n in (12, 20, 40, 80) for part in (0.03, 0.06))


def test_near_lines_are_found_by_edit_similarity_alone(spark):
    """Short lines: all pairs of edit similarity 0.9; longer ones: a letter or a word changed."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))

    def changed(line, k):
        for at in sorted(rng.sample(range(len(line)), k), reverse=True):
            line = line[:at] + rng.choice(["", "q", line[at] + "z"]) + line[at + 1:]
        return " ".join(line.split())
    pairs = []
    for n in range(10, 54):                                # up to one change more than the length allows
        for _ in range(4):
            a = " ".join(word() for _ in range(20))[:n].strip() + "x"
            b = changed(a, rng.randrange(1, len(a) // 10 + 2))
            pairs.append((a, b, True))
    for n in (12, 20, 40, 100):
        for _ in range(20):
            w = [word() for _ in range(n)]
            pairs.append((" ".join(w), changed(" ".join(w), 1), False))
            pairs.append((" ".join(w), " ".join(w[:n // 2] + [w[n // 2][:1] + "q"] + w[n // 2 + 1:]), False))

    def edit(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]
    same = [edit(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9) for a, b, _ in pairs]
    data = [(2 * i, a) for i, (a, _, _) in enumerate(pairs)] + [(2 * i + 1, b) for i, (_, b, _) in enumerate(pairs)]
    gone = {r.doc_id: r.n_removed for r in lines.line_report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert sum(same) > 250 and not all(same)
    for i, s in enumerate(same):
        assert gone[2 * i + 1] == s, pairs[i]


def test_language(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in langid.identify(docs).collect() if r.held_out]
    assert got and sum(truth[r.doc_id] == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_every_labelled_language_is_learned(spark):
    """Only long texts, one text among many letterless rows, and copies."""
    rng = random.Random(4)

    def text(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    data = [(i, text("abcd", 9_000), "long") for i in range(4)]
    data += [(100 + i, "123 " * i, "rare") for i in range(400)] + [(900 + i, "7 " * 9_000 + text("mnop", 300), "rare") for i in range(4)]
    same = text("stuv", 400)
    data += [(2_000 + i, same, "copied") for i in range(600)] + [(3_000 + i, text("stuv", 30), "copied") for i in range(20)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    train = langid.training_text(docs)
    assert set(train) == {"long", "rare", "copied"} and max(map(len, train.values())) <= langid.TRAIN_BYTES
    assert train["copied"].count(same[:500].encode()) <= 1 and len(train["copied"]) > len(same) + 500
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert got[0] == "long" and got[900] == "rare" and got[3_000] == "copied"


def test_cross_parsing_counts():
    train, text = b"abracadabra alakazam", b"cadabra zalaka bra"
    m = langid.Models({"x": train})
    n, i, phrases = len(text), 0, 0
    while i < n:
        k = 1
        while i + k <= n and text[i:i + k] in train:
            k += 1
        i += max(1, k - 1)
        phrases += 1
    assert m.normalised([text])[0, 0] == pytest.approx(phrases * np.log2(len(train)) / n)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    clean = [d for d, y in truth.items() if y == 0]
    assert sum(got[d].predicted for d in clean) <= 0.02 * len(clean)
    pos, neg = ([got[d].score for d, y in truth.items() if y == k] for k in (1, 0))
    assert np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg]) > 0.75


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    good = np.where(rng.random((4000, 6)) < 0.5, np.where(y[:, None], 1, 0), 0) | (rng.random((4000, 6)) < 0.01)
    noise = (rng.random((4000, 1)) < 0.3).astype(int).repeat(4, axis=1)      # four voters that repeat one coin
    q = toxicity.label_model(np.concatenate([good, noise], axis=1).astype(int), 0.2)
    assert ((q > 0.5) == y).mean() > 0.95


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = Counter(zip(words, words[1:], words[2:]))
    cover = {i + k for i in range(len(words) - 2) if tri[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_quality_base(docs, rows):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for d, t in rows:
        r = got[d]
        n, chars, sym, dup, rep = brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, sym, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    assert quality.base_counts("é # é # é #\n\nx\nx".encode()) == (8, 8, 3, 1, 6)


def test_js_distance():
    assert quality.js_distance(np.array([1.0, 0]), np.array([0.0, 2])) == pytest.approx(1)
    assert quality.js_distance(np.array([1.0, 3]), np.array([2.0, 6])) == pytest.approx(0)


def test_url_rules_and_model(spark):
    pages = table(spark, SF, "pages")
    got = urls.judge_urls(pages).collect()
    for r, p in zip(sorted(got, key=lambda r: r.page_id), sorted(pages.collect(), key=lambda p: p.page_id)):
        m = re.match(r".*?://([^/?#]*)([^?#]*)", p.url, re.S)
        host, path = m[1].lower(), m[2]
        fits = [(len(h + q), h + q, v) for h, q, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        rule = max(fits, default=(0, None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule[1]) and (rule[2] is None or r.verdict == rule[2])


def url_rows(spark, rows):
    """``urls.ratios`` of (url, kind, copies), as a dict."""
    df = spark.createDataFrame([(i, -i, u, n, k) for i, (u, k, n) in enumerate(rows)], "k1 long, k2 long, url string, n long, kind int")
    return {r.url: r.ratio for r in urls.ratios(df).join(df, ["k1", "k2"]).collect()}


def plain_ratios(rows):
    """The same by dictionaries of byte strings: all orders counted and blended at each byte."""
    counts = [defaultdict(int), defaultdict(int)]
    grams = lambda u: [(k, *[None if j < 0 else b[j] for j in range(i - k, i + 1)]) for b in [u.encode()] for i in range(len(b)) for k in range(urls.ORDER + 1)]
    for u, kind, n in rows:
        for g in grams(u) if kind else ():
            counts[kind - 1][g] += n
            counts[kind - 1][("context", *g[:-1])] += n
    out = {}
    for u, _, _ in rows:
        p, total = [1 / 256, 1 / 256], 0.0
        for g in grams(u):
            p = [1 / 256, 1 / 256] if g[0] == 0 else p
            p = [(c[g] + urls.KAPPA * q) / (c[("context", *g[:-1])] + urls.KAPPA) for c, q in zip(counts, p)]
            total += math.log(p[0] / p[1]) if g[0] == urls.ORDER else 0
        out[u] = total / len(u.encode())
    return out


@pytest.mark.parametrize("frequent", [1, 200, urls.FREQUENT])
def test_url_ratios_equal_plain_counts(spark, monkeypatch, frequent):
    """Whatever share of the keys is sent to the tasks: none, some, all."""
    monkeypatch.setattr(urls, "FREQUENT", frequent)
    monkeypatch.setattr(urls, "CHUNK", 100)
    rng = random.Random(4)
    rows = {"http://" + "".join(rng.choice("abé./") for _ in range(rng.randrange(1, 30))): None for _ in range(80)}
    rows = [(u, rng.randrange(3), rng.randrange(1, 4)) for u in [*rows, "a" * 500, "\x00", "\x00a", "ÿ"]]
    got, want = url_rows(spark, rows), plain_ratios(rows)
    assert got.keys() == want.keys()
    assert max(abs(got[u] - want[u]) for u in want) < 2e-6


def test_url_ratio_tells_classes_apart(spark):
    rng = random.Random(3)
    make = lambda kind: f"https://{kind}{rng.randrange(999)}.net/{kind * rng.randrange(1, 4)}/{rng.randrange(9999)}"
    rows = {make("good" if i % 2 else "spam"): i for i in range(500)}
    got = url_rows(spark, [(u, 0 if i >= 400 else 1 if i % 2 else 2, 1) for u, i in rows.items()])
    assert min(got[u] for u, i in rows.items() if i >= 400 and i % 2) > 0 > max(got[u] for u, i in rows.items() if i >= 400 and not i % 2)
    ex = spark.createDataFrame([(i % 2 == 1, 1, got[u]) for u, i in rows.items() if i >= 400], "ok boolean, n long, ratio double")
    assert urls.threshold(ex) == pytest.approx(0, abs=1)


def test_url_verdicts_follow_the_calibrated_ratio(spark):
    """All pages: the ratio of the plain model, and the verdict at one threshold for all URLs without a rule."""
    got = {r.page_id: r for r in urls.judge_urls(table(spark, SF, "pages")).collect()}
    pages = {p.page_id: p.url for p in table(spark, SF, "pages").collect()}
    held = lambda u: zlib.crc32(u.encode()) % urls.CALIBRATION_FOLDS == 0
    kinds = {u: 0 if held(u) or got[i].rule is None else 1 if got[i].verdict == "allow" else 2 for i, u in pages.items()}
    copies = Counter(pages.values())
    want = plain_ratios([(u, k, copies[u]) for u, k in kinds.items()])
    assert max(abs(got[i].ratio - want[u]) for i, u in pages.items()) < 2e-6
    free = [r for r in got.values() if r.rule is None]
    assert free and max([r.ratio for r in free if r.verdict == "block"], default=-9) < min([r.ratio for r in free if r.verdict == "allow"], default=9)


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    source = {r.doc_id: r.source for r in docs.collect()}
    size, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = source[r.doc_id]
        size[s] += r["size"]
        taken[s] += r.taken
        goal[s] = r.target
        assert r.taken in (0, r["size"], 2 * r["size"])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    level, full = 1.5 * sum(size.values()), set()
    level /= sum(weight.values())
    while more := {s for s in size if s not in full and weight[s] * level >= 2 * size[s]}:
        full |= more
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
    for s in size:
        assert goal[s] == pytest.approx(2 * size[s] if s in full else weight[s] * level)
        # near the target, or so few documents that no further one would bring the source nearer
        short = goal[s] - taken[s]
        free = [r["size"] for r in got if source[r.doc_id] == s and r["size"] and r.taken < 2 * r["size"] and r.taken / r["size"] <= goal[s] / size[s]]
        assert abs(short) <= 0.05 * goal[s] + 20 or all(abs(short - x) >= abs(short) for x in free)


def test_license_expressions():
    post = licenses.to_postfix
    assert post(["mit", "or", "apache-2.0", "and", "bsd-3-clause"]) == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert post(["gpl-2.0", "with", "classpath", "or", "mit"]) == ["gpl-2.0", "classpath", "with", "mit", "or"]
    assert post(["(", "mit", "or", "isc", ")", "and", "mpl-2.0"]) == ["mit", "isc", "or", "mpl-2.0", "and"]
    assert post(["mit", "or"]) is post(["(", "mit"]) is post(["mit", "isc"]) is None
    assert licenses.evaluate(["mit", "isc", "or", "mpl-2.0", "and"]) == [{"mit", "mpl"}, {"isc", "mpl"}]
    assert licenses.tag_labels(" (mit or apache-2.0) some words") == {"mit", "apache"}


def test_tags_come_from_an_automaton():
    text = "spdx-license-identifier: mit\nx spdx-license-identifier:isc\nspdx-license-identifier: (bsd or"
    ends = [e for e, _ in licenses.tag_automaton().iter(text)]
    assert ends == [m.end() - 1 for m in re.finditer(licenses.TAG, text)]
    assert licenses.scan(text, licenses.automaton(), licenses.tag_automaton())[5:] == ("isc,mit", 1.0)


def test_license_scan(spark, docs, rows):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    data = rows + [(90_000, "The MIT-License, mit license mit license; GNU General\nPublic License é-license"), (90_001, "SPDX-License-Identifier: MIT OR Apache-2.0\nx")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for d, t in data:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        at = [(i, v) for p, v in phrases.items() for i in range(len(w)) if tuple(w[i:i + len(p)]) == p]
        r = got[d]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({v for _, v in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert got[90_001].labels == "apache,mit" and got[90_001].score == 1.0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    docs, counts = table(spark, SF, "documents"), []
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        assert docs.columns[:len(names)] == names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "benchmark decontamination", "mixing"]
    assert counts[0] == counts[1] >= counts[2] >= counts[3] > 0 and corpus_pipeline.run(spark, SF).count() == counts[4]
