"""Toxicity against a plain reading of its rules, letter by letter."""

import math
import random
import unicodedata

import pytest

from quillspark.llm import toxicity

GONE = {*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD}


def letters(text):
    """[(lower-case character, what it is read as)]"""
    out = []
    for c in text.lower():
        if ord(c) in GONE:
            continue
        to = toxicity.HOMOGLYPHS.get(c) or toxicity.DIGITS.get(c) or c
        if 0xC0 <= ord(c) < 0x250:
            base = unicodedata.normalize("NFKD", c)[0]
            to = base.lower() if base.isascii() and base.isalpha() else to
        elif 0xFF21 <= ord(c) < 0xFF5B:
            to = unicodedata.normalize("NFKC", c).lower()
        out.append((c, "i" if to == "l" else to))
    return out


def plain(text, lexicon):
    read = letters(text or "")
    word = "".join(to for _, to in read)
    begins = [k == 0 or not (read[k - 1][0].isalpha() or read[k - 1][0].isdigit() and read[k - 1][1].isalpha()) for k in range(len(read))]
    spared = []
    for p in map(toxicity.fold, toxicity.EXCEPTIONS):
        spared += [(k, k + len(p)) for k in range(len(read)) if begins[k] and word.startswith(p, k) and not word[k + len(p) : k + len(p) + 1].isalpha()]
    total = 0.0
    for k in range(len(read)):
        found = [w for t, w in lexicon.items() if begins[k] and word.startswith(toxicity.fold(t), k) and not any(a <= k and k + len(t) <= z for a, z in spared)]
        total += max(found, default=0.0)
    n = len(text or "")
    return 0.0 if not total else 1 / (1 + math.exp(-toxicity.SLOPE * (total / math.sqrt(max(1, n / toxicity.SHORT_TEXT)) - toxicity.MIDDLE)))


def test_scores_equal_the_plain_reading(spark):
    rng = random.Random(1)
    lexicon = {**dict.fromkeys(toxicity.SEEDS, 4.0), "idio": 2.0, "loserly": 5.5}
    parts = ["idiot", "1d1ot", "mоrоn", "@moron", "hey!idiot", "$loser", "|idiot", "trash can", "trash cans", "trash cannot", "trash", "clownfish", "class clown", "clown", "LOSERLY", "ïdïot", "id​iot", "ＩＤＩＯＴ", "kind", " ", "  ", "0idiot", "9idiot", "İ", "unidiotic", "\n", "été", "日本"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(8)))) for i in range(300)] + [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(6)))) for i in range(300, 600)]
    rows += [(600, None), (601, ""), (602, "word " * 60_000 + "idiot " * 5), (603, "trash can " * 3000 + "moron"), (None, "you idiot"), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, score long, score_hits string")
    got = toxicity.score(df, lexicon).collect()
    want = sorted(((i, t, plain(t, lexicon)) for i, t in rows), key=repr)
    for (i, t, s), r in zip(want, sorted(got, key=lambda r: repr((r.doc_id, r.text, r.score)))):
        assert (i, t) == (r.doc_id, r.text) and r.score == pytest.approx(s, abs=1e-12), t


def test_signs_exceptions_and_length():
    a = toxicity.matcher(dict.fromkeys(toxicity.SEEDS, 4.0))
    for t in ("@moron", "hey!idiot", "$loser", "|idiot", "$tupid", "you trash cannot stay"):
        assert toxicity.raw_score(t, a) == (4.0, 1), t
    for t in ("the trash can is full", "trash cans", "a clownfish", "unidiotic"):
        assert toxicity.raw_score(t, a)[0] == 0, t
    assert toxicity.squash(8, 500) > 0.9 and toxicity.squash(8, 2500) < 0.3 and toxicity.squash(40, 12_500) > 0.9


def test_learning(spark):
    docs = spark.createDataFrame([(i, f"grumbaz{i % 7} thing" if i % 2 else "pleasant thing") for i in range(300)] + [(None, "x"), (301, None), (1, "grumbaz1 thing")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (301, None), (1, 0)], "doc_id long, toxic int")
    learned = toxicity.train(docs, labels)
    assert any("grumbaz".startswith(t) for t in learned) and not any("pieasant".startswith(t) for t in learned)
    seeds = set(map(toxicity.fold, toxicity.SEEDS))
    assert set(toxicity.train(docs, labels.limit(0))) == set(toxicity.train(docs.limit(0), labels)) == seeds
    assert toxicity.score(docs.limit(0), learned).count() == 0


def test_held_out_rows_teach_nothing(spark):
    """Labels of rows held out do not change the lexicon."""
    import zlib

    docs = spark.createDataFrame([(i, f"word{i % 5} zzterm" if i % 2 else "plain") for i in range(400)], "doc_id long, text string")
    rows = [(i, i % 2) for i in range(400)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in rows]
    assert toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int")) == toxicity.train(docs, spark.createDataFrame(turned, "doc_id long, toxic int"))
