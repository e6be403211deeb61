"""Pipelined ranking against the formula in plain code."""

import math
import random
import re

import numpy as np
import pytest

from gradloom.llm import ranking
from gradloom.llm.storage import new_folder

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    """docs and items as lists of (id, text)."""
    kept = [(i, terms(t)) for i, t in docs]
    kept = [(i, t) for i, t in kept if t]
    n, total = len(kept), sum(len(t) for _, t in kept)
    df = {}
    for _, t in kept:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    wants = {}
    for i, t in items:
        wants.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in wants.items():
        scored = []
        for place, (i, t) in enumerate(kept):
            m = 100 - 90 + (90 * len(t) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * t.count(w)) // (1000 * t.count(w) + 8 * m)) for w in wanted if w in t)
            if score > 0:
                scored.append((-score, i is None, i or 0, place))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i, _) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, **settings):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, rank string, score int")
    items = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, block int")
    got = ranking.rank(docs, items, new_folder(spark, "ranking"), **settings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def random_texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "日本", "the", "The"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, weights, k=rng.randint(1, 40)))) for i in range(n)]


@pytest.mark.parametrize("settings", [{}, {"owners": 1}, {"owners": 7, "group": 2, "band": 5}, {"most_wanted": 0, "k": 3}])
def test_equals_plain_code(spark, monkeypatch, settings):
    monkeypatch.setattr("gradloom.llm.tokens.SLICE_BYTES", 600)
    monkeypatch.setattr("gradloom.llm.tokens.slices.__defaults__", (600,))  # many small blocks
    docs = random_texts(1, 300)
    docs += [(i + 1000, docs[7][1]) for i in range(40)]  # copies: ties over several blocks
    items = random_texts(2, 9)
    assert ranked(spark, docs, items, **settings) == plain(docs, items, settings.get("k", 10))


def test_odd_rows(spark):
    long = "alpha beta " * 50_000 + "gamma"
    docs = [(1, None), (2, ""), (3, " .,!\x7f"), (4, long), (5, "gamma"), (5, "gamma"), (None, "gamma"), (7, "ALPHA ÉTÉ"), (8, "été")]
    items = [(1, "gamma alpha"), (2, None), (3, "nothing here"), (None, "Été"), (4, "gamma"), (4, "ALPHA gamma gamma")]
    assert ranked(spark, docs, items) == plain(docs, items)
    assert ranked(spark, docs, []) == [] and ranked(spark, [], items) == []


def test_what_is_dropped_on_the_way_is_never_among_the_best(spark):
    rng = np.random.default_rng(3)
    docs = [(int(i), " ".join(f"t{w}" for w in rng.zipf(1.3, 30) if w < 200)) for i in range(400)]
    items = [(int(i), " ".join(f"t{w}" for w in rng.integers(1, 200, 25))) for i in range(12)]
    assert ranked(spark, docs, items, k=2, owners=6) == plain(docs, items, 2)
