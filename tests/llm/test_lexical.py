"""Ranked lexical search against plain scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from quillspark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k):
    terms = [(d, Counter(TERM.findall(t.translate(LOW)))) for d, t in docs if t is not None]
    terms = [(d, c) for d, c in terms if c]
    total, length = len(terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOW)))
    out = []
    for i, c in asked.items():
        scored = []
        for row, (d, h) in enumerate(terms):
            n = h.total()
            m = 75 + 25 * n * total // length
            s = sum(times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * h[t] // (1000 * h[t] + 12 * m)) for t, times in c.items() if h[t])
            if s > 0 and d is not None:
                scored.append((-s, d, row))
        out += [(i, r + 1, d, -s) for r, (s, d, _) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(spark, docs, items, k):
    d = spark.createDataFrame([(*x, "x", 1) for x in docs], "doc_id long, text string, term string, row long")
    i = spark.createDataFrame([(*x, 7) for x in items], "item_id long, text string, score int")
    return sorted(map(tuple, lexical.search(d, i, k).collect()), key=str)


def corpus(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    return rng, lambda size: " ".join(rng.choices(vocabulary, weights, k=size))


@pytest.fixture(scope="module")
def tables():
    rng, text = corpus(5, 300)
    docs = [(d, text(rng.randint(1, 120))) for d in range(300)]
    items = [(i, text(rng.randint(1, 30))) for i in range(12)]
    docs += [(300 + i, t) for i, t in items]  # whole passages
    return docs, items


def test_many_documents(spark, tables):
    docs, items = tables
    assert got(spark, docs, items, 5) == brute(docs, items, 5)


def test_odd_rows(spark, tables):
    docs, items = tables
    docs = [*docs, (None, items[0][1]), (400, None), (401, ""), (402, " .,- "), (403, "ÉCOLE école W1\x00w2 x_y"), (5, "w1 w1 w399"), (5, "w1 w1 w399"), (6, "Ａ１ 日本語 w3")]
    items = [*items, (20, None), (21, ""), (22, "école ÉCOLE w1 w1"), (23, "nowhere"), (24, "w1 w2"), (24, "w2 日本語")]
    assert got(spark, docs, items, 20) == brute(docs, items, 20)


def test_ties_and_copies(spark):
    """Copies by the hundred: equal scores go to the smaller ids, and a word that all hold weighs little."""
    docs = [(d, "the same words here") for d in range(300, 0, -1)] + [(d, f"the other {d}") for d in range(301, 320)]
    items = [(1, "the same words"), (2, "the"), (3, "other 305 the the")]
    found = got(spark, docs, items, 7)
    assert found == brute(docs, items, 7)
    assert [r[2] for r in found if r[0] == 1] == [1, 2, 3, 4, 5, 6, 7]


def test_long_text_in_slices(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", 1 << 10)
    text = b"alpha " * 1000 + b"Q" * 5000 + b" beta\tGAMMA" * 700
    assert lexical.term_counts(text) == Counter(text.lower().split())
    docs = [(1, ("long text " * 300_000) + "needle"), (2, "needle"), (3, "hay")]
    assert got(spark, docs, [(1, "needle text")], 5) == brute(docs, [(1, "needle text")], 5)


def test_without_known_terms(spark, tables, monkeypatch):
    """More terms than are broadcast: the same result by shuffled joins."""
    docs, items = tables
    monkeypatch.setattr(lexical, "ASKED_TERMS", 3)
    assert got(spark, docs, items, 5) == brute(docs, items, 5)


def test_common_terms_are_set_aside(spark, tables):
    """Most matches are with terms that cannot decide; these are joined with few documents only."""
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index = lexical.postings(d)
    assert index.where("term = ''").count() == len(docs)
    assert index.where("term <> ''").count() == sum(len(set(t.split())) for _, t in docs)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")], 5) == got(spark, [(1, "a b")], [], 5) == got(spark, [], [], 5) == []
    assert got(spark, [(1, None)], [(1, "a")], 5) == []
