"""Operator 4, toxicity by weak supervision.

Voters look at a text and vote toxic (1), clean (-1) or abstain (0): general
word lists, lists of words and word stems induced from the labelled training
rows, and patterns.  A generative label model (a latent class, fitted by EM
without the labels) estimates how each voter behaves in both classes, and from
what the classes leave unexplained the correlation of voters; voters that repeat
each other count less.  The model's posterior labels train a logistic
classifier on words and word stems, which scores every text.

Fitting uses a bounded sample: about ``SAMPLE`` labelled training rows, those with the
least hashes (all of them if there are fewer).  Of these only votes and the
``FEATURES`` most telling features reach the driver; texts don't."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import held_out, map_batches
from riskgraph.session import cut_lineage

SAMPLE = 20_000
STEMS = (4, 5, 6)         # prefix lengths of word stems
LISTS = 24                # induced lists, each a voter
LEAST_ROWS, LEAST_SHARE = 3, 0.9   # a feature of an induced list: so many sampled rows, so large a share of them toxic
FEATURES = 4096           # features of the classifier
MOST_INDUCED = 4096
# General insults in four languages; each list is a voter.
WORD_LISTS = (
    "idiot moron imbecile stupid dumb fool jerk",
    "scum trash garbage filth vermin loser worthless",
    "pathetic disgusting clown hate kill die",
    "connard salaud imbécile crétin abruti ordure merde stupide idiote",
    "arschloch idiot dummkopf abschaum drecksau trottel blödmann scheiße",
    "imbécil estúpido basura idiota pendejo cabrón mierda asqueroso",
)
YOU_ARE = re.compile(r"\b(?:you are|you re|you're|du bist|tu es|vous êtes|eres)\b")
WORD = re.compile(r"[^\W\d_]+")
VOTERS = len(WORD_LISTS) + LISTS + 3


def words_of(text: bytes | None) -> tuple[str, set[str]]:
    low = (text or b"").decode("utf-8", "replace").lower()
    return low, set(WORD.findall(low))


def features(word: str) -> list[str]:
    """A word (marked by its end) and its stems."""
    return [word + "$"] + [word[:k] for k in STEMS if len(word) >= k]


class Lookup:
    """Numbers of the chosen features that a word has, with a bounded memo."""

    def __init__(self, chosen: list[str], limit: int = 400_000):
        self.at, self.limit, self.memo = {f: i for i, f in enumerate(chosen)}, limit, {}

    def __call__(self, words: set[str]) -> set[int]:
        if len(self.memo) > self.limit:
            self.memo.clear()
        out: set[int] = set()
        memo, at = self.memo, self.at
        for w in words:
            got = memo.get(w)
            if got is None:
                got = memo[w] = tuple(at[f] for f in features(w) if f in at)
            if got:
                out.update(got)
        return out


def votes_of(text: bytes | None, lists: list[frozenset[str]], induced: Lookup, member: list[int]) -> list[int]:
    low, words = words_of(text)
    out = [int(not words.isdisjoint(x)) for x in lists]
    hit = [0] * LISTS
    for i in induced(words):
        hit[member[i]] = 1
    out += hit
    some = any(out)
    out.append(int(bool(YOU_ARE.search(low))))
    out.append(-1 if len(words) >= 20 and not some else 0)                 # enough words, none of any list
    out.append(-1 if some is False and low.count("!") == 0 else 0)
    return out


def label_model(votes: np.ndarray, prior: float, turns: int = 50) -> np.ndarray:
    """Posterior probability of the toxic class for each row of votes (-1, 0, 1)."""
    n, j = votes.shape
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    base = np.log(prior / (1 - prior))
    # to begin with, voters that are all but copies of each other share one voice
    raw = votes - votes.mean(axis=0)
    norm = np.sqrt(np.maximum((raw * raw).sum(axis=0), 1e-9))
    weight = 1 / np.maximum(1, (np.abs(raw.T @ raw / norm / norm[:, None]) > 0.95).sum(axis=0))
    q = 1 / (1 + np.exp(-np.clip(base + 2.0 * (votes == 1) @ weight - 0.5 * (votes == -1) @ weight, -30, 30)))
    for _ in range(turns):
        p1 = (np.einsum("i,ijv->jv", q, onehot) + 0.1) / (q.sum() + 0.3)
        p0 = (np.einsum("i,ijv->jv", 1 - q, onehot) + 0.1) / ((1 - q).sum() + 0.3)
        # what the classes leave unexplained: correlation of the residuals
        mean = q[:, None] * (p1[:, 2] - p1[:, 0]) + (1 - q)[:, None] * (p0[:, 2] - p0[:, 0])
        r = votes - mean
        cov = r.T @ r / n
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        rho = np.abs(cov / sd / sd[:, None])
        np.fill_diagonal(rho, 0)
        weight = 1 / (1 + np.where(rho > 0.05, rho, 0).sum(axis=1))
        odds = np.einsum("ijv,jv->ij", onehot, np.log(p1 / p0))
        new = 1 / (1 + np.exp(-np.clip(base + odds @ weight, -30, 30)))
        if np.abs(new - q).max() < 1e-6:
            q = new
            break
        q = new
    return q


def logistic(rows: np.ndarray, cols: np.ndarray, n: int, k: int, y: np.ndarray, turns: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on binary features (row, column), by Adam steps on the full sample."""
    w, b = np.zeros(k), 0.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, turns + 1):
        z = np.bincount(rows, w[cols], minlength=n) + b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.append(np.bincount(cols, g[rows], minlength=k) / n + ridge * w, g.mean())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        step = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return w, float(b)


def sample_rows(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """``h, toxic, text`` of the labelled training rows with the least hashes, about ``size`` of them."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id"))
    n = known.count()
    if n > size:
        known = known.where(F.col("h") < int(-(2**63) + 2**64 * size / n))
    return docs.select("doc_id", "text").join(known, "doc_id").select("h", "toxic", "text")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """Features, weights and intercept of the classifier."""
    rows = cut_lineage(sample_rows(docs, labels))
    size = rows.agg(F.count("*"), F.sum("toxic")).first()
    n, pos = size[0], int(size[1] or 0)
    if not pos or pos == n:
        return [], np.zeros(0), 30.0 if n and pos == n else -30.0

    def count(cols):
        total, toxic = Counter(), Counter()
        for _, y, text in zip(*cols):
            own = {f for w in words_of(text)[1] for f in features(w)}
            total.update(own)
            if y:
                toxic.update(own)
        return {"f": list(total), "n": list(total.values()), "k": [toxic[f] for f in total]}

    stats = map_batches(rows, count, "f string, n long, k long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    stats = cut_lineage(stats.where(F.col("n") >= LEAST_ROWS))
    rate = F.lit(pos / n)
    share = F.col("k") / F.col("n")
    gain = (F.col("k") * F.log((share + 1e-6) / rate) + (F.col("n") - F.col("k")) * F.log((1 - share + 1e-6) / (1 - rate)))
    best = [r["f"] for r in stats.orderBy(gain.desc(), "f").limit(FEATURES).collect()]
    induced = [r["f"] for r in stats.where(share >= LEAST_SHARE).orderBy(F.col("k").desc(), "f").limit(MOST_INDUCED).collect()]
    member = [xxhash.xxh32_intdigest(f.encode()) % LISTS for f in induced]
    lists = [frozenset(x.split()) for x in WORD_LISTS]

    def look(cols):
        vote, chosen = Lookup(induced), Lookup(best)
        return {"h": cols[0], "votes": [votes_of(t, lists, vote, member) for t in cols[2]],
                "own": [sorted(chosen(words_of(t)[1])) for t in cols[2]]}

    seen = map_batches(rows, look, "h long, votes array<int>, own array<int>").orderBy("h").toPandas()    # the sample's votes and features
    votes = np.array(seen["votes"].tolist())
    y = label_model(votes, min(0.5, max(1e-3, pos / n)))
    lengths = seen["own"].map(len).to_numpy()
    flat = np.concatenate(seen["own"].tolist()).astype(np.intp) if lengths.sum() else np.zeros(0, np.intp)
    w, b = logistic(np.repeat(np.arange(len(seen)), lengths), flat, len(seen), len(best), y)
    return best, w, b


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs(doc_id, text)``.

    Null and empty texts get the classifier's intercept.  Without labelled training
    rows, or with those of one class, every score is that class's (0 without any).
    Repeated rows each get their row; other columns are ignored."""
    chosen, w, b = fit(docs, labels)

    def run(cols):
        own = Lookup(chosen)
        score = []
        for text in cols[2]:
            at = list(own(words_of(text)[1]))
            score.append(float(1 / (1 + np.exp(-np.clip(w[at].sum() + b, -30, 30)))))
        return {"doc_id": cols[0], "held_out": cols[1], "score": score, "predicted": [int(s >= 0.5) for s in score]}

    return map_batches(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run,
                       "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` (all their columns) whose text scores below 0.5."""
    chosen, w, b = fit(docs, labels)

    def run(batches):
        import pyarrow as pa
        own = Lookup(chosen)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            keep = [w[list(own(words_of(t.encode() if t else None)[1]))].sum() + b < 0 for t in text.to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
