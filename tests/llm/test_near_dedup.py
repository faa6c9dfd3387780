"""Near duplicates against all pairs on full sets of words, kept as words."""

import random
import re

import numpy as np
import pytest

from quillspark.llm import near_dedup

SCHEMA = "doc_id long, text string"


def shingles(text, words):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def expected(rows, words, percent=80):
    """[(id, set size, component)] of each row: rows of one id are one document."""
    sets = [(i, shingles(t, words)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if None not in (a, b) and a != b and x and y and top(a) != top(b) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return sorted(((i, len(s), None if i is None else top(i)) for i, s in sets), key=repr)


def found(df, words, percent=80, **named):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.find(df, words, percent, **named).collect()), key=repr)


def noisy(seed, groups, size, edits, words=60):
    """Texts of groups around a base each, with up to edits words of each text changed."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{g}x{rng.randrange(400)}" for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(words)] = f"z{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out


def test_odd_rows(spark):
    texts = ["", None, " \t\n", "one", "ONE", "one two", "one two", "tail " * 4000, "tail " * 3999, "été ÉTÉ 日本 語", "a\x0bb\x0cc d", "x" * 9000, "x" * 9000 + " y"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one two"), (None, None), (3, "one"), (3, "one two"), (40, "p q r s t u v w x y"), (41, "p q r s t u v w x y z"), (40, "p q r s t u v w x y")]
    df = spark.createDataFrame(rows, SCHEMA)
    for words in (2, 5):
        assert found(df, words) == expected(rows, words)
    none = spark.createDataFrame([], SCHEMA)
    assert found(none, 2) == [] and near_dedup.keep_one(none).count() == 0


def test_words_of_equal_sums(spark):
    """The words a/b of Thue and Morse, which sums of powers cannot tell apart."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word[:1024]), (4, word[1024:])]
    assert found(spark.createDataFrame(rows, SCHEMA), 2) == expected(rows, 2)


@pytest.mark.parametrize(("block", "partners"), [(512, 256), (16, 4), (2, 2)])
def test_groups_against_all_pairs(spark, monkeypatch, block, partners):
    """Copies, near copies and groups whose members are close to the threshold, in whole and in small
    blocks, down to the split of buckets by a second band."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "PARTNERS", partners)
    texts = noisy(1, 6, 15, 4) + noisy(2, 2, 80, 9) + noisy(3, 60, 1, 0)
    texts += texts[:25] + [texts[0]] * 30
    random.Random(4).shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, 2) == expected(rows, 2)


def test_other_thresholds(spark):
    rows = list(enumerate(noisy(5, 5, 12, 12)))
    df = spark.createDataFrame(rows, SCHEMA)
    for percent in (50, 90, 100):
        assert found(df, 2, percent) == expected(rows, 2, percent)
    with pytest.raises(ValueError):
        near_dedup.find(df, 2, 1)


def test_keep_one_keeps_all_columns(spark):
    texts = noisy(6, 4, 10, 3)
    rows = [(i, t, "own", i) for i, t in enumerate(texts)] + [(None, texts[0], "null", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, root long")
    want = {i for i, _, c in expected([r[:2] for r in rows], 5) if i == c}
    got = near_dedup.keep_one(df)
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == want


def test_texts_cut_in_slices(spark):
    """Texts over a slice (1 MB), alike but for some words."""
    rng = np.random.default_rng(8)
    w = [f"t{k}" for k in rng.integers(0, 50_000, 250_000)]
    near = [x if k % 40 else "new" for k, x in enumerate(w)]
    far = [x if k % 4 else f"n{k}" for k, x in enumerate(w)]
    rows = [(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(w).upper())]
    assert len(rows[0][1]) > 1 << 20
    assert found(spark.createDataFrame(rows, SCHEMA), 2) == expected(rows, 2)
