"""Exact top-k by inner product with a dual cover-tree search.

1. A bounded sample of the vectors (SAMPLE of them, and at most SAMPLE_BYTES) gives pivots; every
   vector goes to its nearest pivot's cell, and cells over DATA_BLOCK rows are dealt in several blocks
   by row. Blocks are regions of space, and a vector that a third of all rows share fills blocks of
   its own. Only counts and covering radii of the cells (MAX_CELLS at most) reach the driver.
2. Every query is searched in the sample first. Its kth score there is a floor under its kth score in
   the whole, so it is sent only to cells whose bound q.c + |q| r reaches that floor.
3. Every block is indexed once by a cover tree, and the queries that come to it stream by in groups,
   with a cover tree each. Node pairs are visited level by level and pruned when
   a.b + |a| r_b + |b| r_a + r_a r_b, with covering radii r, is below the worst kth score of the query
   group. At the leaves each query group takes the data in order of its bound and stops at the first
   below its worst kth score, which rises as it goes.
4. The k best of each block are merged for each query.

A tree's levels are nested nets: those of level i are more than R / 2**i apart and cover all points
within R / 2**i, with R the first radius; each centre hangs under the nearest of the level above.

Components become floor(256 x). Vectors that are null or hold null or non-finite components take no
part, and neither do rows with a null id. Shorter vectors count as padded with zeros; empty ones are
zero. Scores beyond 64 bits are clipped. Ties go to the smaller id; rows that repeat an id are
candidates each, a query that is repeated is answered once for its id (all its rows' best together),
and it never meets rows of its own id. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept, parts

#: Rows of a block of data and of a group of queries, and points to a leaf of either tree: query groups
#: are small, for their radius and their worst kth score bound what they must visit.
DATA_BLOCK, QUERY_BLOCK, LEAF, QUERY_LEAF = 8192, 2048, 64, 4
#: Vectors that pivots and floors come from, at most, and bytes of them.
SAMPLE, SAMPLE_BYTES = 4096, 16 << 20
#: Rows that a cell should have, and the most cells.
CELL_ROWS, MAX_CELLS = 2048, 1024


def quantise(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec): little-endian doubles of floor(256 x); unusable vectors left out."""

    def run(batches):
        for b in batches:
            ids, lists = b.column(0), b.column(1).cast(pa.list_(pa.float64()))
            n = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten() if lists.null_count else lists.values[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
            n = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, n)
            x = flat.to_numpy(zero_copy_only=False)
            off = np.concatenate([[0], np.cumsum(n)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            ok = (bad[off[1:]] == bad[off[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore"):
                x = np.floor(256 * x)
            vec = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(8 * off.astype(np.int64)), pa.py_buffer(x.astype("<f8").tobytes())])
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([ids.filter(keep), vec.filter(keep).cast(pa.binary())], ["vec_id", "vec"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).mapInArrow(run, "vec_id long, vec binary")


def matrix(column, width: int = 0) -> np.ndarray:
    """Rows of a binary column as doubles, padded with zeros to one width."""
    rows = [np.frombuffer(v.as_buffer()) if v.as_buffer().size else np.zeros(0) for v in column]
    width = max([width, *map(len, rows)])
    if rows and all(len(r) == width for r in rows):
        return np.stack(rows)
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def greedy(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Farthest-first centres, at most ``most``: rows, the distance of each to those before, and for all
    points the nearest centre's number and its distance."""
    rows, gaps = [0], [np.inf]
    near, of = norms(x - x[0]), np.zeros(len(x), np.int64)
    while len(rows) < most and near.max() > 0:
        j = int(near.argmax())
        d = norms(x - x[j])
        closer = d < near
        gaps.append(near[j])
        near[closer], of[closer] = d[closer], len(rows)
        rows.append(j)
    return np.array(rows), np.array(gaps), of, near


class CoverTree:
    """Levels of nested nets over the rows of x, the last with about ``leaf`` points to a centre.

    levels[i]: (centres as vectors, covering radii over all points below, norms, parents in levels[i-1]).
    leaves[k]: the rows below the kth centre of the last level."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        rows, gaps, of, near = greedy(x, -(-len(x) // leaf))
        top = float(norms(x - x[0]).max()) or 1.0
        with np.errstate(divide="ignore"):
            born = np.where(np.isinf(gaps), 0, np.floor(np.log2(top / gaps)).astype(np.float64) + 1).astype(int)  # gap > top / 2 ** born
        last = int(born.max())
        above = np.arange(len(rows))  # of each centre: the nearest of a higher level
        for k in range(1, len(rows)):
            higher = np.flatnonzero(born[:k] < born[k])
            above[k] = higher[norms(x[rows[higher]] - x[rows[k]]).argmin()]
        nets, holder = [], of
        for i in range(last, -1, -1):
            own = np.flatnonzero(born <= i)
            radius = np.zeros(len(rows))
            np.maximum.at(radius, holder, norms(x - x[rows[holder]]))
            nets.append((own, radius[own]))
            holder = np.where(born[holder] == i, above[holder], holder)
        nets.reverse()
        self.levels = []
        for i, (own, radius) in enumerate(nets):
            place = np.full(len(rows), -1)
            if i:
                place[nets[i - 1][0]] = np.arange(len(nets[i - 1][0]))
            c = x[rows[own]]
            self.levels.append((c, radius, norms(c), place[np.where(born[own] == i, above[own], own)] if i else np.zeros(len(own), np.int64)))
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(rows) + 1))
        self.leaves = [order[cuts[k] : cuts[k + 1]] for k in nets[-1][0]]

    def at(self, i: int):
        """Level i, or the last where the tree has fewer: its centres are their own parents then."""
        if i < len(self.levels):
            return self.levels[i]
        c, radius, norm, _ = self.levels[-1]
        return c, radius, norm, np.arange(len(c))

    def least(self, values: np.ndarray, i: int) -> np.ndarray:
        """The least value below each centre of level i."""
        out = np.array([values[leaf].min() if len(leaf) else np.inf for leaf in self.leaves])
        for j in range(len(self.levels) - 1, min(i, len(self.levels) - 1), -1):
            up = np.full(len(self.levels[j - 1][0]), np.inf)
            np.minimum.at(up, self.levels[j][3], out)
            out = up
        return out


def bounds(a, b) -> np.ndarray:
    """Above every inner product of a point below a centre of a and one below a centre of b."""
    (ca, ra, na, _), (cb, rb, nb, _) = a, b
    size = (na + ra)[:, None] * (nb + rb)[None]
    return ca @ cb.T + na[:, None] * rb + nb * ra[:, None] + ra[:, None] * rb + 1e-9 * size + 1


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as 64-bit integers; clipped where they are longer."""
    if not q.size or not d.size:
        return np.zeros((len(q), len(d)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(d).max()) * q.shape[1] < 2**53:
        return (q @ d.T).astype(np.int64)
    big = np.array([[sum(int(a) * int(b) for a, b in zip(x, y)) for y in d] for x in q], object).reshape(len(q), len(d))
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)


LOWEST = np.iinfo(np.int64).min


def search(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, did: np.ndarray, tree: CoverTree, k: int):
    """(query row, data id, score) of each query's k best in the tree that reach its floor, and the pairs
    that were scored."""
    width = max(q.shape[1], tree.x.shape[1])
    asks, x = CoverTree(widened(q, width), QUERY_LEAF), widened(tree.x, width)
    worst = floor.copy()
    scores = [np.zeros(0, np.int64)] * len(q)
    idents = [np.zeros(0, np.int64)] * len(q)
    wide = lambda level: (widened(level[0], width), *level[1:])
    alive = np.ones((1, 1), bool)
    for i in range(max(len(asks.levels), len(tree.levels))):
        a, b = asks.at(i), wide(tree.at(i))
        b_ = bounds(a, b)
        alive = alive[a[3]][:, b[3]] & ~(b_ < asks.least(worst.astype(np.float64), i)[:, None])
    scored = 0
    for g, rows in enumerate(asks.leaves):
        order = np.flatnonzero(alive[g])
        order = order[np.argsort(-b_[g, order], kind="stable")]
        at = 0
        while at < len(order) and not b_[g, order[at]] < float(worst[rows].min()):
            take, some = at, 0
            while take < len(order) and some < 16 * LEAF and (take == at or not b_[g, order[take]] < float(worst[rows].min())):
                some += len(tree.leaves[order[take]])
                take += 1
            data = np.concatenate([tree.leaves[j] for j in order[at:take]])
            at = take
            found = products(asks.x[rows], x[data])
            scored += found.size
            ids = did[data]
            for r, row in zip(rows, found):
                ok = (row >= worst[r]) & (ids != qid[r])
                if not ok.any():
                    continue
                s, d = np.concatenate([scores[r], row[ok]]), np.concatenate([idents[r], ids[ok]])
                if len(s) > 4 * k:
                    near = s >= np.partition(s, len(s) - k)[len(s) - k]
                    s, d = s[near], d[near]
                best = np.lexsort((d, np.invert(s)))[:k]
                scores[r], idents[r] = s[best], d[best]
                if len(best) == k:
                    worst[r] = max(worst[r], s[best[-1]])
    counts = np.array([len(s) for s in scores])
    return np.repeat(np.arange(len(q)), counts), np.concatenate([np.zeros(0, np.int64), *idents]), np.concatenate([np.zeros(0, np.int64), *scores]), scored


FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score)."""
    spark = vectors.sparkSession
    data, asked = kept(quantise(vectors, id_col, vec_col), "vectors"), quantise(queries, id_col, vec_col)
    size = data.agg(F.count("*").alias("n"), F.max(F.octet_length("vec")).alias("wide")).first()
    some = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SAMPLE, SAMPLE_BYTES // max(8, size["wide"] or 0)))).collect()
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = matrix(pa.array([bytes(r["vec"]) for r in some], pa.binary()), (size["wide"] or 0) // 8)
    rows, _, _, _ = greedy(sample, max(1, min(MAX_CELLS, size["n"] // CELL_ROWS)))
    sent = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in some]), sample, sample[rows]))

    def celled(batches):
        pivots = sent.value[2]
        own = (pivots * pivots).sum(1)
        for b in batches:
            x = matrix(b.column(1), pivots.shape[1])
            cell = (own - 2 * x @ pivots.T).argmin(1) if len(x) else np.zeros(0, np.int64)
            far = norms(x - pivots[cell]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], ["vec_id", "vec", "cell", "far"])

    data = kept(data.mapInArrow(celled, "vec_id long, vec binary, cell long, far double").withColumn("row", F.xxhash64(F.monotonically_increasing_id())), "cells")
    cells = sorted((r["cell"], -(-r["n"] // DATA_BLOCK), r["far"]) for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect())
    dealt = spark.sparkContext.broadcast(tuple(np.array(c) for c in zip(*cells)))
    many = spark.createDataFrame([(int(c), int(n)) for c, n, _ in cells], "cell long, many long")
    blocks = data.join(F.broadcast(many), "cell")  # MAX_CELLS rows at most
    blocks = blocks.select((F.col("cell") * (1 << 32) + F.pmod("row", "many")).alias("block"), F.lit(False).alias("asks"), "vec_id", "vec", F.lit(LOWEST).alias("floor"))

    def routed(batches):
        ids, x, pivots = sent.value
        tree, (cell, blocks_of, radius) = CoverTree(x), dealt.value
        centres, norm = pivots[cell], norms(pivots[cell])
        for b in (w.slice(i, QUERY_BLOCK) for w in batches for i in range(0, w.num_rows, QUERY_BLOCK)):
            qid, q = b.column(0).to_numpy(), matrix(b.column(1))
            floor = np.full(len(q), LOWEST)
            row, _, score, _ = search(qid, q, floor, ids, tree, k)
            full = np.bincount(row, minlength=len(q)) == k
            np.minimum.at(worst := np.full(len(q), np.iinfo(np.int64).max), row, score)
            floor[full] = worst[full]
            q = widened(q, centres.shape[1])
            length = norms(q)[:, None]
            reach = q @ widened(centres, q.shape[1]).T + length * radius + 1e-9 * length * (norm + radius) + 1
            i, c = np.nonzero(~(reach < floor.astype(np.float64)[:, None]))
            times = blocks_of[c]
            part = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            i, block = np.repeat(i, times), np.repeat(cell[c], times) * (1 << 32) + part
            for at in range(0, len(i), QUERY_BLOCK):
                take = pa.array(i[at : at + QUERY_BLOCK])
                yield pa.RecordBatch.from_arrays([pa.array(block[at : at + QUERY_BLOCK]), pa.array(np.ones(len(take), bool)), b.column(0).take(take), b.column(1).take(take), pa.array(floor[take])], ["block", "asks", "vec_id", "vec", "floor"])

    asks = asked.mapInArrow(routed, "block long, asks boolean, vec_id long, vec binary, floor long")
    both = blocks.unionByName(asks).repartition(parts(spark), "block").sortWithinPartitions("block", "asks")
    got = both.mapInArrow(_meet(k), FOUND)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _meet(k: int):
    """Blocks of data, each followed by the queries that come to it."""

    def run(batches):
        block, ids, data, tree = None, [], [], None
        for b in batches:
            of, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                if hi == lo:
                    continue
                if of[lo] != block:
                    block, ids, data, tree = of[lo], [], [], None
                if not asks[lo]:
                    ids.append(b.column(2).slice(lo, hi - lo).to_numpy())
                    data.append(matrix(b.column(3).slice(lo, hi - lo)))
                    continue
                if not data:
                    continue
                if tree is None:
                    width = max(x.shape[1] for x in data)
                    tree, ids = CoverTree(np.concatenate([widened(x, width) for x in data])), np.concatenate(ids)
                for at in range(lo, hi, QUERY_BLOCK):
                    n = min(QUERY_BLOCK, hi - at)
                    qid = b.column(2).slice(at, n).to_numpy()
                    row, d, score, _ = search(qid, matrix(b.column(3).slice(at, n)), b.column(4).slice(at, n).to_numpy(), ids, tree, k)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(d), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
