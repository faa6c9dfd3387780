"""Embedding near-duplicates against cosines of all pairs."""

import numpy as np

from quillspark.llm import embedding_dedup as ed
from quillspark.llm import hnsw


def brute(rows, least=0.9):
    wide = max((len(v) for _, v in rows if v is not None), default=0)

    def fit(v):
        ok = v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)
        return np.pad(np.array(v, float), (0, wide - len(v))) / np.sqrt(sum(c * c for c in v)) if ok else None

    x = [None if i is None else fit(v) for i, v in rows]
    linked = [[j for j, b in enumerate(x) if j != k and b is not None and a @ b >= least - 1e-12] if a is not None else [] for k, a in enumerate(x)]
    parent = {i: i for i, _ in rows if i is not None}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, js in enumerate(linked):
        for j in js:
            a, b = sorted((top(rows[k][0]), top(rows[j][0])))
            parent[b] = a
    return sorted(((i, len(linked[k]), None if i is None else top(i), i is None or top(i) == i) for k, (i, _) in enumerate(rows)), key=str)


def got(spark, rows):
    v = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "vec_id long, embedding array<double>, vec string, links int, kept boolean")
    found = ed.find(v)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, found.collect()), key=str)


def groups(seed, n, sizes, wide=16, noise=0.05):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=wide) for _ in range(n)]
    for size in sizes:
        c = rng.normal(size=wide)
        rows += [c * (0.5 + rng.random()) + rng.normal(size=wide) * noise for _ in range(size)]
    order = rng.permutation(len(rows))
    return [(i, [float(x) for x in rows[j]]) for i, j in enumerate(order)]


def test_groups_of_near_copies(spark):
    rows = groups(1, 500, [2, 2, 3, 40, 120])
    assert got(spark, rows) == brute(rows)


def test_chains_across_shards(spark, monkeypatch):
    """Links that lead from vector to vector round a circle, over many small shards and copies of graphs."""
    monkeypatch.setattr(ed, "SHARD", 40)
    monkeypatch.setattr(ed, "QUERIES", 100)
    monkeypatch.setattr(ed, "GROUP", 16)
    step = 0.4
    rows = [(i, [float(np.cos(step * i / 8)), float(np.sin(step * i / 8)), 0.0]) for i in range(100)] + [(100 + i, [0.0, 0.1 * i, 5.0]) for i in range(60)]
    found = got(spark, rows)
    assert found == brute(rows) and len({r[2] for r in found}) == 2


def test_odd_rows(spark):
    rows = groups(2, 60, [5])
    copy = rows[3][1]
    rows += [(70, None), (71, [None, 1.0]), (72, [float("nan"), 1.0]), (73, [float("inf")]), (74, []), (75, [0.0, 0.0]), (76, [-0.0]), (None, copy), (None, None)]
    rows += [(77, copy), (78, [2 * c for c in copy]), (79, [c * 1e-200 for c in copy]), (80, [c * 1e200 for c in copy]), (81, [*copy, 0.0]), (82, [*copy, 1e-3]), (83, [1.0]), (84, [1.0, 0.1])]
    rows += [(5, copy), (5, copy), (6, [-c for c in copy]), (85, [-c for c in copy])]  # repeated ids join what they are linked with
    assert got(spark, rows) == brute([(i, [c / max(map(abs, v)) for c in v] if v and all(c is not None and np.isfinite(c) for c in v) and any(v) else v) for i, v in rows])


def test_copies_by_the_thousand(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(i, [3.0, -1.0, float(i)]) for i in range(3000, 3010)]
    found = got(spark, rows)
    assert {r[1:3] for r in found if r[0] < 3000} == {(2999, 0)}
    assert {r[1:3] for r in found if r[0] >= 3000} == {(9, 3000)}


def test_empty_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert got(spark, [(1, [1.0])]) == [(1, 0, 1, True)]


def test_every_node_can_be_reached():
    """Members of dense groups, which others drop from their links, are linked from what is nearest to them."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(1500, 32)), rng.normal(size=32) + rng.normal(size=(700, 32)) * 0.02]).astype(np.float32)
    x /= np.sqrt((x * x).sum(1))[:, None]
    graph = hnsw.Graph.build(x, hnsw.levels(np.arange(len(x))))
    seen = np.zeros(len(x), bool)
    at = np.unique(graph._entries(x[:1], 0))
    while len(at := at[(at >= 0) & ~seen[np.maximum(at, 0)]]):
        seen[at] = True
        at = np.unique(graph.links[0][at])
    assert seen.all()
    assert graph.links[0].shape[1] <= hnsw.LOWEST_LINKS + 6 * hnsw.KEPT


def test_widened_beams_find_whole_groups():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(2000, 64)), rng.normal(size=64) + rng.normal(size=(500, 64)) * 0.05]).astype(np.float32)
    x /= np.sqrt((x * x).sum(1))[:, None]
    graph = hnsw.Graph.build(x, hnsw.levels(np.arange(len(x))))
    want = x @ x.T >= 0.9
    got_ = np.zeros(want.shape, bool)
    got_[graph.search(x, ed.BEAM, np.float32(0.9))] = True
    assert not (got_ & ~want).any() and (got_ & want).sum() >= 0.99 * want.sum()
    none = hnsw.Graph(x, graph.nodes, [np.full_like(links, -1) for links in graph.links])
    assert ed._missed(none, x[:200], 32, 0.9) and not ed._missed(graph, x[:200], 64, 0.9)
