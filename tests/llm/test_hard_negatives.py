"""Hard negatives against plain products of all pairs."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import hard_negatives as hn


def brute(rows, every, k=5):
    usable = [(i, g, [int(np.floor(256 * c)) for c in v]) for i, v, g in rows if i is not None and g is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out, seen = [], set()
    for a, g, x in sorted(usable, key=lambda r: (r[0], r[1], np.array(r[2], "<f8").tobytes())):
        if a % every or a in seen:
            continue
        seen.add(a)
        others = sorted((-dot(x, y), i, h) for i, h, y in usable if i != a)
        for s, p, _ in [o for o in others if o[2] == g][:k]:
            fit = [(t, n) for t, n, h in others if h != g and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n) in enumerate(fit)]
    return sorted(out)


def got(spark, rows, every, k=5):
    v = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, far int, score long")
    found = hn.mine(v, F.col("vec_id") % every == 0, k=k)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def clustered(seed, n, wide=8, groups=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, wide))
    return [(i, [float(x) for x in centre[g] * (1 + 0.2 * rng.random()) + rng.normal(size=wide) * 0.2], int((g + (rng.random() < 0.3)) % 4)) for i, g in enumerate(rng.integers(0, groups, n))]


def test_against_all_pairs(spark):
    rows = clustered(1, 600)
    want = brute(rows, 20)
    assert len(want) > 100 and got(spark, rows, 20) == want
    assert got(spark, rows, 20, 2) == brute(rows, 20, 2)


def test_many_cells_and_blocks(spark, monkeypatch):
    """Small cells, blocks and copies of blocks: anchors go to some of them only, and the result stays."""
    for name, value in (("CELL_ROWS", 40), ("BLOCK", 32), ("ASKED", 10), ("STEP", 8)):
        monkeypatch.setattr(hn, name, value)
    rows = clustered(2, 500)
    assert got(spark, rows, 10) == brute(rows, 10)


def test_brackets_hold_every_score():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(300, 16)) * rng.random((300, 1)))
    table = hn.Table(x[:100], float((x * x).sum(1).max()))
    far, asked = table.far(table.lifted(x)), table.far(table.lifted(x, query=True))
    scores = x @ x.T
    for i in range(300):
        low, high = table.brackets(float(x[i] @ x[i]), asked[i], far, far)
        assert (low <= scores[i]).all() and (scores[i] <= high).all()
    assert abs(table.lifted(x)[:, -1] ** 2 + (x * x).sum(1) - table.most).max() < 1e-6 * table.most


def test_few_rows_are_scored(spark):
    """Where vectors lie in groups, brackets leave most rows unscored."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(20, 16)) * 300
    x = np.floor(np.repeat(centre, 100, 0) + rng.normal(size=(2000, 16)) * 10)
    table = hn.Table(x[::10], float((x * x).sum(1).max()))
    far, scored = table.far(table.lifted(x)), 0
    for i in range(0, 2000, 50):
        q = table.lifted(x[i : i + 1], query=True)
        _, n = hn.searched(table, x[i], float(x[i] @ x[i]), table.far(q)[0], np.array([-(1 << 62)]), np.array([1 << 62]), np.arange(2000), x, far, 5)
        scored += n
    assert scored < 0.35 * 40 * 2000


def test_odd_rows(spark):
    rows = clustered(5, 200)
    rows += [(200, None, 1), (220, [1.0, None], 1), (240, [float("nan")], 2), (260, [float("inf")], 2), (None, [1.0] * 8, 1), (280, [1.0] * 8, None), (300, [], 1), (320, [2.0], 1), (340, [1.0] * 11, 2)]
    rows += [(20, rows[20][1], 3), (20, rows[20][1], 3), (7, rows[7][1], rows[7][2]), (361, rows[40][1], rows[40][2]), (362, rows[40][1], (rows[40][2] + 1) % 4)]  # repeated ids, copies
    assert got(spark, rows, 20) == brute(rows, 20)


def test_ties_and_negative_scores(spark):
    rows = [(i, [1.0, 0.5], i % 2) for i in range(60)] + [(i, [-1.0, -0.5], 2) for i in range(60, 70)] + [(70, [1.0, 0.5], 2), (80, [0.0, 0.0], 3), (81, [0.0, 0.0], 3), (82, [0.0, 0.0], 4)]
    assert got(spark, rows, 10) == brute(rows, 10)
    big = [(i, [x * 2.0**20 for x in v], g) for i, v, g in clustered(6, 80)]
    assert got(spark, big, 10) == brute(big, 10)


def test_empty_tables(spark):
    assert got(spark, [], 10) == got(spark, [(1, [1.0], 1)], 10) == got(spark, [(10, None, 1)], 10) == []
    assert got(spark, [(0, [1.0], 1)], 10) == []
