"""Operator 9, licence scan: an Aho-Corasick automaton finds notice phrases (on
the words of the text) and identifier tags; the expression behind a tag is
read by a shunting-yard parser (``and`` / ``or`` / ``with`` and brackets)."""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from riskgraph.llm.common import map_batches

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notice phrases of the method: phrase -> (label, confidence).
NOTICES = {
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd license": ("bsd", 0.8),
    "isc license": ("isc", 0.8),
    "licensed under cc by": ("cc-by", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "licensed under the apache license": ("apache", 0.95),
    "released into the public domain": ("public-domain", 0.7),
    "all rights reserved": ("proprietary", 0.5),
}
BASE_CONFIDENCE, TAG_CONFIDENCE = 0.8, 1.0
TAG = "spdx-license-identifier:"
# Identifier prefix -> label, longest first.
FAMILIES = {"agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "apache": "apache", "mit": "mit", "bsd": "bsd", "mpl": "mpl",
            "epl": "epl", "isc": "isc", "cc-by": "cc-by", "cc0": "public-domain", "unlicense": "public-domain"}
RANK = {"or": 1, "and": 2, "with": 3}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*")


def label_of(identifier: str) -> str | None:
    return next((v for k, v in FAMILIES.items() if identifier.startswith(k)), None)


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting yard; None for an expression that isn't well formed."""
    out, stack, operand_next = [], [], True
    for t in tokens:
        if t == "(":
            if not operand_next:
                return None
            stack.append(t)
        elif t == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif t in RANK:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[t]:
                out.append(stack.pop())
            stack.append(t)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(t)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> list[frozenset[str]]:
    """Alternatives of an expression, each the set of labels that hold together:
    ``or`` joins alternatives, ``and`` combines them, ``with`` keeps the licence
    and drops its exception.  At most 64 different alternatives are formed by the
    few known labels of an expression line; equal ones fold."""
    stack: list[list[frozenset[str]]] = []
    for t in postfix:
        if t in RANK:
            b, a = stack.pop(), stack.pop()
            if t == "or":
                stack.append(list(dict.fromkeys(a + b)))
            elif t == "and":
                stack.append(list(dict.fromkeys(x | y for x in a for y in b)))
            else:
                stack.append(a)
        else:
            label = label_of(t)
            stack.append([frozenset([label] if label else [])])
    return stack[0]


def labels_of(postfix: list[str]) -> set[str]:
    """All labels in the alternatives of ``evaluate``, without forming them: an exception behind ``with`` has none."""
    stack: list[set[str]] = []
    for t in postfix:
        if t in RANK:
            b, a = stack.pop(), stack.pop()
            if t != "with":
                small, a = sorted((a, b), key=len)
                a |= small
            stack.append(a)
        else:
            stack.append({x} if (x := label_of(t)) else set())
    return stack[0]


def tag_labels(line: str) -> set[str]:
    """Labels of the longest well-formed expression at the start of what follows a tag on its line; one pass over the line."""
    tokens: list[str] = []
    end, depth, operand_next = 0, 0, True
    for m in TOKEN.finditer(line):
        t = m[0]
        opens = t == "(" or t not in RANK and t != ")"
        if opens != operand_next or t == ")" and not depth:
            break                                   # nothing that goes on from here is well formed
        tokens.append(t)
        depth += (t == "(") - (t == ")")
        operand_next = t in RANK or t == "("
        if not operand_next and not depth:
            end = len(tokens)
    p = to_postfix(tokens[:end])
    return labels_of(p) if p else set()


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES]:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def tag_automaton() -> ahocorasick.Automaton:
    """Finds tags in the raw text (phrases are found in its words)."""
    a = ahocorasick.Automaton()
    a.add_word(TAG, TAG)
    a.make_automaton()
    return a


def scan(text: str, find: ahocorasick.Automaton, tags: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of a text whose A-Z are lower-cased."""
    words = WORD.findall(text)
    hay = " " + " ".join(words) + " "
    starts, base, labels, miss = [], set(), set(), 1.0
    passed = at = 0                                 # words that end before ``at``, carried on from match to match
    for end, phrase in find.iter(hay):
        passed, at = passed + hay.count(" ", at, end), end
        if phrase in BASE:
            starts.append(passed - phrase.count(" ") - 1)
            base.add(BASE[phrase])
        else:
            label, c = NOTICES[phrase]
            if label not in labels:
                miss *= 1 - c
            labels.add(label)
    miss *= (1 - BASE_CONFIDENCE) ** len(base)
    for end, _ in tags.iter(text):
        stop = text.find("\n", end)
        found = tag_labels(text[end + 1: stop if stop >= 0 else len(text)])
        if found:
            labels |= found
            miss *= 1 - TAG_CONFIDENCE
    labels |= base
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), round(1 - miss, 6) + 0.0)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double")


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` with the columns of ``SCHEMA``.

    A null text counts as empty (no words, empty labels, null places, score 0);
    repeated rows each get their row; other columns are ignored.  The automata
    hold the fixed phrases and the tag only and are built once in each task."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    state = {}

    def run(cols):
        find, tags = state.get("a") or state.setdefault("a", (automaton(), tag_automaton()))
        rows = [(d, *scan((t or b"").lower().decode("utf-8", "replace"), find, tags)) for d, t in zip(*cols)]
        return {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_batches(docs.select("doc_id", "text"), run, SCHEMA)
