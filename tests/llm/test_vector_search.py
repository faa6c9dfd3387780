"""Top-k against plain products of all pairs."""

import numpy as np
import pytest

from quillspark.llm import vector_search as vs


def brute(rows, asked, k):
    usable = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q, x in [u for u in usable if asked(u[0])]:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in usable if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def got(spark, rows, k=5, of="array<double>"):
    more = ", score long, rank int, vec string" if len(rows[0]) > 2 else ""
    v = spark.createDataFrame(rows, f"vec_id long, embedding {of}{more}")
    return sorted(map(tuple, vs.top_k(v, v.where("vec_id % 50 = 0"), k).collect()))


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [1.0] * 6), (404, [1.0] * 6), (450, [2.0]), (451, []), (452, [1.0] * 9), (None, [1.0] * 6), (500, [float("inf")]), (550, [])]
    wide = [(i, v, 1, 2, "x") for i, v in rows]
    assert got(spark, wide) == brute(rows, lambda i: i % 50 == 0, 5)
    assert got(spark, rows, 3) == brute(rows, lambda i: i % 50 == 0, 3)
    few = [(0, [1.0]), (1, [2.0])]
    assert got(spark, few) == brute(few, lambda i: i % 50 == 0, 5)
    big = [(i, [float(x) for x in rng.normal(size=4) * 2.0**20]) for i in range(60)]
    assert got(spark, big) == brute(big, lambda i: i % 50 == 0, 5)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    for v, q in ((none, none), (some, none), (none, some)):
        assert vs.top_k(v, q).count() == 0


def test_copies_and_repeated_rows(spark):
    """A vector that most rows share, in many blocks; ties go to the smaller id."""
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(i, [float(x) for x in rng.normal(size=2)]) for i in range(500, 700)] + [(7, [1.0, 2.0]), (501, [5.0, 5.0])]
    want = brute(rows, lambda i: i % 50 == 0, 5)
    assert got(spark, rows) == want


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_cover_tree_search(kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8192, 32))
    if kind == "clustered":
        centres = rng.normal(size=(40, 32))
        x = centres[rng.integers(0, 40, 8192)] + 0.05 * x
    x = np.floor(256 * x / np.sqrt((x * x).sum(1, keepdims=True)))
    q, ids = x[::50], np.arange(8192)
    tree = vs.CoverTree(x)
    row, found, score, scored = vs.search(ids[::50], q, np.full(len(q), vs.LOWEST), ids, tree, 5)
    s = (q @ x.T).astype(np.int64)
    for r in range(len(q)):
        want = sorted((-v, i) for i, v in enumerate(s[r]) if i != 50 * r)[:5]
        assert list(zip(-score[row == r], found[row == r])) == want
    assert scored <= s.size
    if kind == "clustered":
        assert scored < 0.25 * s.size, scored / s.size


def test_cover_tree_levels():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(2000, 3)), np.zeros((500, 3))])
    tree = vs.CoverTree(x)
    top = np.sqrt(((x - x[0]) ** 2).sum(1)).max()
    assert sorted(np.concatenate(tree.leaves)) == list(range(len(x)))
    for i, (centres, radius, _, parent) in enumerate(tree.levels):
        gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + np.eye(len(centres)) * 1e9
        assert (gaps > top / 2**i * (1 - 1e-9)).all() or i == 0
        if i:
            above = tree.levels[i - 1][0][parent]
            assert (np.sqrt(((centres - above) ** 2).sum(1)) <= top / 2 ** (i - 1) * (1 + 1e-9)).all()
    for k, leaf in enumerate(tree.leaves):
        assert np.sqrt(((x[leaf] - tree.levels[-1][0][k]) ** 2).sum(1)).max(initial=0) <= tree.levels[-1][1][k]


def test_blocks_and_cells(spark, monkeypatch):
    """Several cells and blocks, with queries sent only where their floor is reached."""
    monkeypatch.setattr(vs, "CELL_ROWS", 64)
    monkeypatch.setattr(vs, "DATA_BLOCK", 50)
    monkeypatch.setattr(vs, "SAMPLE", 100)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 5))
    rows = [(i, [float(c) for c in centres[i % 8] + 0.1 * rng.normal(size=5)]) for i in range(1200)]
    assert got(spark, rows) == brute(rows, lambda i: i % 50 == 0, 5)
