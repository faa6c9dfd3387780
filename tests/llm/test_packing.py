"""Packing against exact and plain solvers, and its pieces against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from quillspark.llm import packing, queries


def used(done, items, size):
    """Sequences of a packing, once it is seen to hold exactly the items."""
    count = Counter()
    for fill, times in done:
        assert times > 0 and sum(fill) <= size
        for n in fill:
            count[n] += times
    assert count == Counter(items)
    return sum(t for _, t in done)


def plain_best_fit(items, size):
    rooms = []
    for n in sorted(items, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


def optimum(items, size):
    """Over all subsets: the fewest sequences and the least filling of the last."""
    best = [(len(items) + 1, 0)] * (1 << len(items))
    best[0] = (1, 0)
    for m, (b, f) in enumerate(best):
        b, f = best[m]
        for i, n in enumerate(items):
            if not m >> i & 1:
                x = (b, f + n) if f + n <= size else (b + 1, n)
                best[m | 1 << i] = min(best[m | 1 << i], x)
    return best[-1][0] if items else 0


def test_best_fit_is_best_fit():
    rng = random.Random(1)
    for _ in range(1000):
        size = rng.choice([20, 30, 50, 100])
        items = [rng.randrange(1, size + 1 if rng.random() < 0.3 else size // 2 + 1) for _ in range(rng.randrange(40))]
        assert used(packing.best_fit(dict(Counter(items)), size), items, size) == plain_best_fit(items, size)


def test_small_packings_are_the_smallest():
    rng = random.Random(2)
    cases = [([3, 3, 4, 8, 8, 9, 9, 11, 12, 15, 16, 19], 30), ([19, 22, 22, 23, 35, 39, 42, 47, 63, 65], 100), ([600, 370, 330, 324, 224, 200], 1024), ([], 10), ([7], 7)]
    for _ in range(1000):
        size = rng.choice([20, 30, 100])
        cases.append(([rng.randrange(*((1, size + 1) if rng.random() < 0.3 else (size // 8, size // 2 + 1))) for _ in range(rng.randrange(11))], size))
    for items, size in cases:
        best = optimum(items, size)
        assert packing.bound(dict(Counter(items)), size) <= best
        assert used(packing.bin_completion(dict(Counter(items)), size), items, size) == best, (items, size)


def test_many_pieces_near_the_bound():
    rng = random.Random(3)
    for _ in range(10):
        items = [rng.randrange(1, 1025) for _ in range(3000)]
        done = used(packing.bin_completion(dict(Counter(items)), 1024), items, 1024)
        assert done <= plain_best_fit(items, 1024) and done <= 1.01 * packing.bound(dict(Counter(items)), 1024)
    assert used(packing.bin_completion(dict.fromkeys((600, 370, 330, 324, 224, 200), 50), 1024), [600, 370, 330, 324, 224, 200] * 50, 1024) == 100


def test_fillings_against_all_subsets():
    """Every subset is matched or beaten by a filling that is listed: one whose pieces dominate its own."""
    rng = random.Random(4)
    for _ in range(100):
        items = sorted((rng.randrange(2, 14) for _ in range(7)), reverse=True)
        listed = packing.fillings(dict(Counter(items)), items[0], 30, 30)
        for fill in listed:
            assert fill[0] == items[0] and sum(fill) <= 30 and not Counter(fill) - Counter(items)
        top = max(sum(x for k, x in enumerate(items[1:]) if m >> k & 1) for m in range(64) if sum(x for k, x in enumerate(items[1:]) if m >> k & 1) + items[0] <= 30)
        assert sum(listed[0]) == items[0] + top


def test_pieces_and_places(spark):
    library = Tokenizer.from_file(queries.VOCABULARY)
    library.encode_special_tokens = True
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = ["", None, "The cat sat.\n" * 3, "The cat sat.\n" * 3, "x" * 5000, "été 日本 × 12  \n\n tail  ", "word " * 3000, "numbers 12 and words " * 55_000, word + "\n" + word.translate(str.maketrans("ab", "ba"))]
    rows = [((1 << 53) + 1 + i if i != 2 else None, t, i, "x") for i, t in enumerate(texts)] + [(7, "again", 0, "x")] * 3 + [(None, None, 0, None)] * 40
    size = 64
    want = []
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())))
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id long, length string")
    got = packing.pack_documents(df, queries.VOCABULARY, size).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert packing.bound(Counter(w[3] for w in want), size) <= len(by) <= plain_best_fit([w[3] for w in want], size)
    assert packing.pack_documents(df.limit(0), queries.VOCABULARY, size).count() == 0
