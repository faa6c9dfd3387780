"""License matches against a plain search over all windows."""

import random
import re

import pytest

from quillspark.llm import bpe, licenses

TEXTS = licenses.TEMPLATES


def plain_words(text):
    return [m[0].lower() for m in re.finditer(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", text)]


def shingles(words):
    return [tuple(words[k : k + 5]) for k in range(len(words) - 4)]


def plain(text):
    """Names of the templates of which some window, widened as the scan's, holds the share."""
    s, out = shingles(plain_words(text or "")), set()
    for name, t in TEXTS.items():
        own = set(own_list := shingles(plain_words(t)))
        wide = int(len(own_list) * (1 + 2 * licenses.SLACK))
        for i in range(len(s)):
            if s[i] in own and len(own & set(s[i : i + wide])) >= 0.8 * len(own):
                out.add(name)
                break
    return out


def scanned(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, license string")
    return {r.doc_id: r.matches for r in licenses.scan(df).collect()}


def edited(rng, text, inserted, dropped):
    w = text.split()
    for _ in range(dropped):
        del w[rng.randrange(len(w))]
    for _ in range(inserted):
        w.insert(rng.randrange(len(w) + 1), rng.choice(["foo", "bar", "baz"]))
    return " ".join(w)


def test_against_all_windows(spark):
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "software", "permission", "the", "license", "of"]) for _ in range(n))
    rows = [(0, ""), (1, None), (2, "one two"), (3, filler(500)), (4, "licensed to drive"), (5, "this work is licensed under the gnu general public license version 3!"), (6, "Released under the MIT License. Released under the MIT License.")]
    for name in TEXTS:
        for k, (a, z) in enumerate(((0, 0), (2, 0), (0, 2), (3, 3))):
            rows.append((len(rows), f"{filler(rng.randrange(60))} {edited(rng, TEXTS[name], a, z)} {filler(rng.randrange(60))}"))
    got = scanned(spark, rows)
    for i, t in rows:
        assert {m.license for m in got[i]} == plain(t), (i, t)
        for m in got[i]:
            part = (t.encode()[m.start : m.end]).decode()
            own = set(shingles(plain_words(TEXTS[m.license])))
            assert len(own & set(shingles(plain_words(part)))) / len(own) == pytest.approx(m.containment)
    assert len(got[6]) == 2


def test_insertions_do_not_hide_a_text(spark):
    rng = random.Random(2)
    rows = [(i, edited(rng, TEXTS["MIT"], 4, 0)) for i in range(30)]
    assert all("MIT" in {m.license for m in found} for found in scanned(spark, rows).values())


def test_texts_cut_in_slices(spark):
    """A text over a slice, with licenses around every cut and spaces that fill more than a kilobyte."""
    wide = (" " * 700).join(TEXTS["ISC"].split())
    body = "word " * 60_000
    near = body * 4
    cut = bpe.SLICE_BYTES - 300
    text = near[:cut] + " " + TEXTS["MIT"] + " " + body + wide + " " + body * 3
    assert len(text) > 2 * bpe.SLICE_BYTES
    found = scanned(spark, [(1, text), (2, "Licensed under CC BY-NC 4.0"), (None, TEXTS["Zlib"])])
    assert [m.license for m in found[1]] == ["MIT", "MIT-grant", "ISC"]
    for m in found[1]:
        assert m.containment == 1.0 and plain_words(text.encode()[m.start : m.end].decode()) == plain_words(TEXTS[m.license])
    assert [m.license for m in found[2]] == ["CC-BY-NC-4.0"] and [m.license for m in found[None]] == ["Zlib"]


def test_templates_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(none).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(none, {"x": "too short"})
