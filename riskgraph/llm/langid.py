"""Operator 3, language identification by cross-parsing.

For each language a suffix automaton of labelled text recognises all its
substrings.  A text is parsed greedily: each phrase is the longest match with
the language's text, and the next phrase starts behind it.  The language that
needs the fewest phrases, normalised by the text's length and by the logarithm
of the training length (longer training text means longer matches), wins.

The automata are fitted on a bounded sample: per language, of each different
text with a letter a span of ``SPAN`` characters from a place its hash chooses, in
hash order while they fit into ``TRAIN_BYTES`` bytes (one that doesn't fit is passed
over), of the first ``TRAIN_ROWS`` in that order.  A span has at most 4 x ``SPAN`` bytes,
so each language with a labelled letter is learned.  All text of all documents is parsed; texts are cut into lanes of ``LANE`` bytes that are parsed
side by side with numpy, so a lane's end also ends a phrase."""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.llm.common import held_out, map_batches
from riskgraph.session import cut_lineage

TRAIN_BYTES, TRAIN_ROWS, SPAN = 40_000, 200, 2_000
LANE, PART = 512, 8_000_000
SHARPNESS = 24
LETTER = regex.compile(r"\p{L}")
SQL_LETTER = r"\p{L}"
ASCII_OTHER = {i: " " for i in range(128) if not chr(i).isalpha()}


def plain(text: str) -> bytes:
    """Lower-cased UTF-8; ASCII characters that are no letters are spaces, and spaces are single."""
    return b" ".join(text.lower().translate(ASCII_OTHER).encode("utf-8", "replace").split())


class SuffixAutomaton:
    """Dense transition table of the suffix automaton of a byte string: ``table[state * width + symbol]``,
    0 where there is none (no transition leads to the root)."""

    def __init__(self, text: bytes, symbol: np.ndarray, width: int):
        goto: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbol[np.frombuffer(text, np.uint8)].tolist():
            cur = len(goto)
            goto.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in goto[p]:
                goto[p][c] = cur
                p = link[p]
            if p >= 0:
                q = goto[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(goto)
                    goto.append(dict(goto[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and goto[p].get(c) == q:
                        goto[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.width = width
        self.table = np.zeros(len(goto) * width, np.int32)
        for s, row in enumerate(goto):
            for c, t in row.items():
                self.table[s * width + c] = t

    def phrases(self, lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each lane; ``lanes[t, k]`` is symbol t of lane k, lanes by falling length."""
        n = lanes.shape[1]
        state, count = np.zeros(n, np.int32), np.zeros(n, np.int64)
        first = self.table[:self.width]
        for t in range(lanes.shape[0]):
            k = int(np.searchsorted(-lengths, -t, "left"))        # lanes longer than t
            sym = lanes[t, :k]
            nxt = self.table[state[:k] * self.width + sym]
            stop = nxt == 0
            count[:k] += stop                                     # a phrase ends before this symbol
            state[:k] = np.where(stop, first[sym], nxt)
        return count


class Models:
    """Automata of all languages over one alphabet (the bytes seen in training, and one for others)."""

    def __init__(self, train: dict[str, bytes]):
        seen = sorted(set(b"".join(train.values())))
        self.symbol = np.full(256, len(seen), np.intp)
        self.symbol[seen] = np.arange(len(seen))
        self.langs = sorted(train)
        self.automata = [SuffixAutomaton(train[k], self.symbol, len(seen) + 1) for k in self.langs]
        self.weight = np.array([np.log2(max(2, len(train[k]))) for k in self.langs])

    def normalised(self, texts: list[bytes]) -> np.ndarray:
        """texts x languages: phrases per byte times log2 of the training length."""
        total = np.array([len(t) for t in texts], np.int64)
        per = -(-total // LANE)
        owner = np.repeat(np.arange(len(texts)), per)
        first = np.cumsum(per) - per
        start = np.cumsum(total) - total
        at = start[owner] + (np.arange(len(owner)) - first[owner]) * LANE
        length = np.minimum(LANE, start[owner] + total[owner] - at)
        order = np.argsort(-length, kind="stable")
        at, length, owner = at[order], length[order], owner[order]
        flat = np.append(self.symbol[np.frombuffer(b"".join(texts), np.uint8)].astype(np.int32), np.zeros(LANE, np.int32))
        lanes = np.empty((int(length[0]) if len(length) else 0, len(at)), np.int32)
        for t in range(len(lanes)):
            lanes[t] = flat[at + t]
        out = np.zeros((len(texts), len(self.langs)))
        for i, a in enumerate(self.automata):
            got = np.bincount(owner, a.phrases(lanes, length) + 1, minlength=len(texts))
            out[:, i] = got * self.weight[i] / np.maximum(1, total)
        return out


_CACHE: dict[int, Models] = {}


def models_of(train: dict[str, bytes]) -> Models:
    """The models, kept between the tasks of one Python worker."""
    key = hash(tuple(sorted(train.items())))
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Models(train)
    return _CACHE[key]


def training_text(docs: DataFrame) -> dict[str, bytes]:
    """Per language the sample's text, at most ``TRAIN_BYTES`` (plus separators)."""
    h = F.xxhash64("text")
    at = F.pmod(F.xxhash64(h, F.lit(7)), F.greatest(F.lit(1), F.length("text") - SPAN + 1)) + 1
    chosen = F.substring("text", at.cast("int"), F.lit(SPAN))
    spans = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(SQL_LETTER) & ~held_out(F.col("doc_id")))
    spans = spans.select("lang", h.alias("h"), "text", chosen.alias("_c"))
    first_letter = F.substring("text", F.regexp_instr("text", F.lit(SQL_LETTER)), F.lit(SPAN))
    spans = spans.select("lang", "h", F.when(F.col("_c").rlike(SQL_LETTER), F.col("_c")).otherwise(first_letter).alias("span"))
    rows = spans.groupBy("lang", "h").agg(F.max(F.octet_length("span")).alias("n"))      # copies count once
    # the least in 64 slices of a language first, so that no window holds a whole language
    own = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h")
    first = rows.withColumn("r", F.row_number().over(own)).where(F.col("r") <= TRAIN_ROWS)
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= TRAIN_ROWS)
    picked, room = [], {}
    for r in cut_lineage(first).select("lang", "h", "n", "r").orderBy("lang", "r").collect():     # TRAIN_ROWS rows a language
        if room.setdefault(r["lang"], TRAIN_BYTES) >= r["n"]:
            room[r["lang"]] -= r["n"]
            picked.append((r["lang"], r["h"]))
    if not picked:
        return {}
    wanted = set(picked)
    got = spans.where(F.col("h").isin(list({h for _, h in picked}))).groupBy("lang", "h").agg(F.max("span").alias("span")).orderBy("h").collect()
    out: dict[str, list[bytes]] = {}
    for r in got:
        if (r["lang"], r["h"]) in wanted:
            out.setdefault(r["lang"], []).append(plain(r["span"]))
    return {k: b" ".join(v) for k, v in out.items()}


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs(doc_id, text, lang)``.

    ``und`` with score 0 where the text is null or has no letter, or where nothing
    is labelled.  Equal results: the language first by code point.  The score is
    the winner's share of all languages' results to the power of -SHARPNESS.
    Other columns are ignored; repeated rows each get their row."""
    train = training_text(docs)

    def run(cols):
        m = models_of(train)
        ids, held, texts = cols
        plains = [plain(t.decode("utf-8", "replace")) if t and m.langs and LETTER.search(t.decode("utf-8", "replace")) else b"" for t in texts]
        pred, score = ["und"] * len(ids), [0.0] * len(ids)
        part, size = [], 0
        for i in range(len(ids) + 1):
            if part and (i == len(ids) or size >= PART):
                got = np.maximum(m.normalised([plains[j] for j in part]), 1e-12)
                best = got.argmin(axis=1)
                share = 1 / ((got.min(axis=1, keepdims=True) / got) ** SHARPNESS).sum(axis=1)
                for j, b, s in zip(part, best, share):
                    pred[j], score[j] = m.langs[b], float(s)
                part, size = [], 0
            if i < len(ids) and plains[i]:
                part.append(i)
                size += len(plains[i])
        return {"doc_id": ids, "held_out": held, "lang_pred": pred, "score": score}

    return map_batches(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run,
                       "doc_id long, held_out boolean, lang_pred string, score double")
