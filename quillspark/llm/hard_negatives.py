"""Hard-negative mining by inner product over a pivot table.

1. Every vector x gets one more component, sqrt(M - x.x) with M the greatest x.x of all rows, and every
   anchor q gets a 0 there. Then the squared distance of the two is q.q + M - 2 q.x, so an inner product
   is a Euclidean distance and the triangle inequality holds.
2. A bounded sample (SAMPLE rows, SAMPLE_BYTES) gives PIVOTS farthest-first pivots and CELLS centres. Every
   row is stored with its distances to all pivots, in blocks of rows that are near one centre; cells over
   BLOCK rows are dealt in several blocks by row. Only the least and greatest distance to each pivot
   of the blocks of a cell reach the driver.
3. An anchor's score with a row lies in the bracket that |d(q, p) - d(x, p)| and d(q, p) + d(x, p) give,
   over all pivots p. The same brackets, with the least and greatest distances of a cell, tell which
   cells an anchor is sent to.
4. Positives: an anchor's kth best score in the sample is a floor; rows of its label whose bracket reaches
   the floor are scored exactly, the highest brackets first, until none reaches the kth best.
5. Negatives: with the positives known, a row of another label is scored where its bracket meets the
   window of some positive, again from the top, until none reaches the kth best of any window.
6. The best of the blocks are merged for each anchor and positive by a window.

Components become floor(256 x). Rows take no part whose id, label or vector is null, or whose vector holds
null or non-finite components. Shorter vectors count as padded with zeros; empty ones are zero. Scores
beyond 64 bits are clipped. Equal scores rank by id. Rows that repeat an id are candidates each, but
never of an anchor with that id; a repeated anchor is asked once, with its smallest label and, of
these, the smallest vector by its bytes. Empty tables give empty results; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept, lean, parts
from .vector_search import LOWEST, greedy, matrix, norms, products, widened

#: Pivots, rows of the sample and its bytes.
PIVOTS, SAMPLE, SAMPLE_BYTES = 24, 4096, 16 << 20
#: Rows of a block and of a cell, the most cells, and anchors that one copy of a block is searched for.
BLOCK, CELL_ROWS, CELLS, ASKED = 8192, 4096, 1024, 1 << 16
#: Rows that are scored at once, and anchors that are routed at once.
STEP, ROUTED = 256, 512

ROW = "vec_id long, label long, vec binary, far binary, square double"


class Table:
    """Pivots in the augmented space, and what brackets need."""

    def __init__(self, sample: np.ndarray, most: float):
        self.most, self.width = most, sample.shape[1]
        self.sample = self.lifted(sample)
        self.pivots = self.sample[greedy(self.sample, PIVOTS)[0]]

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.most - (x * x).sum(1)))
        return np.column_stack([x, last])

    def far(self, lifted: np.ndarray) -> np.ndarray:
        """Distances to all pivots."""
        p = self.pivots
        return np.sqrt(np.maximum(0, (lifted * lifted).sum(1)[:, None] + (p * p).sum(1) - 2 * lifted @ p.T))

    def scores(self, square: float, near: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) inner products at distances of ``near`` to ``most`` from a query; its q.q is
        ``square``. Slack covers the rounding of distances."""
        slack = 1 + 1e-6 * (square + self.most)
        return (square + self.most - most * most) / 2 - slack, (square + self.most - near * near) / 2 + slack

    def brackets(self, square: float, asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Brackets of the scores of rows whose distances to the pivots lie from ``low`` to ``high``."""
        near = np.maximum(np.maximum(asked - high, low - asked).max(1), 0)
        return self.scores(square, near, (asked + high).min(1))


def usable(vectors: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(vec_id, label, vec): little-endian doubles of floor(256 x)."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(odd, F.lit(False)))

    def run(batches):
        for b in batches:
            lists = b.column(2)
            x = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False)).astype("<f8")
            off = 8 * np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))]).astype(np.int64)
            vec = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(off), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), vec.cast(pa.binary())], ["vec_id", "label", "vec"])

    return v.mapInArrow(run, "vec_id long, label long, vec binary")


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, k: int = 5, least: Fraction = Fraction(4, 5), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each of the first k
    positives of an anchor the first k rows of other labels that score from ``least`` of the positive's
    score up to all of it. ``is_anchor`` is over vec_id."""
    spark = vectors.sparkSession
    rows = kept(usable(vectors, id_col, vec_col, F.col("label") if label is None else label), "usable")
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    size = rows.select(F.octet_length("vec").alias("wide")).agg(F.count("*").alias("n"), F.max("wide").alias("wide")).first()
    if not size["n"]:
        return empty

    def squares(batches):
        for b in batches:
            x = matrix(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([(x * x).sum(1).max() if x.size else 0.0])], ["most"])

    most = rows.select("vec").mapInArrow(squares, "most double").agg(F.max("most")).first()[0] or 0.0
    some = rows.orderBy(F.xxhash64("vec_id", "label"), "vec_id", "label", "vec").limit(max(1, min(SAMPLE, SAMPLE_BYTES // max(8, size["wide"])))).collect()
    sample = matrix(pa.array([bytes(r["vec"]) for r in some], pa.binary()), size["wide"] // 8)
    pivots = Table(sample, most)
    centres = pivots.sample[greedy(pivots.sample, max(1, min(CELLS, size["n"] // CELL_ROWS)))[0]]
    known = spark.sparkContext.broadcast((pivots, centres, np.array([r["vec_id"] for r in some]), np.array([r["label"] for r in some]), sample))

    def placed(batches):
        pivots, centres, *_ = known.value
        own = (centres * centres).sum(1)
        for b in batches:
            x = matrix(b.column(2), pivots.width)
            lifted = pivots.lifted(x)
            far = pivots.far(lifted)
            cell = (own - 2 * lifted @ centres.T).argmin(1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in far], pa.binary()), pa.array((x * x).sum(1)), pa.array(cell)], ["vec_id", "label", "vec", "far", "square", "cell"])

    stored = kept(rows.mapInArrow(lean(placed), f"{ROW}, cell long").withColumn("row", F.xxhash64(F.monotonically_increasing_id())), "pivot_table")

    def reach(batches):
        """Least and greatest distances to the pivots of each cell in a task."""
        held: dict[int, list] = {}
        for b in batches:
            cell, far = b.column(0).to_numpy(), matrix(b.column(1))
            for c in np.unique(cell):
                f = far[cell == c]
                n, lo, hi = held.get(int(c), (0, np.inf, -np.inf))
                held[int(c)] = n + len(f), np.minimum(lo, f.min(0)), np.maximum(hi, f.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([h[0] for h in held.values()], pa.int64()), pa.array([h[1].tolist() for h in held.values()], pa.list_(pa.float64())), pa.array([h[2].tolist() for h in held.values()], pa.list_(pa.float64()))], ["cell", "n", "lo", "hi"])

    ends = stored.select("cell", "far").mapInArrow(reach, "cell long, n long, lo array<double>, hi array<double>")
    ends = ends.select("cell", "n", F.posexplode(F.arrays_zip("lo", "hi")).alias("p", "d")).groupBy("cell", "p").agg(F.sum("n").alias("n"), F.min("d.lo").alias("lo"), F.max("d.hi").alias("hi"))
    ends = ends.groupBy("cell").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("p", "lo", "hi"))).alias("d")).orderBy("cell").collect()  # CELLS rows at most
    cells = spark.sparkContext.broadcast((np.array([r["cell"] for r in ends]), np.array([-(-r["n"] // BLOCK) for r in ends]), np.array([[d["lo"] for d in r["d"]] for r in ends]), np.array([[d["hi"] for d in r["d"]] for r in ends])))

    first = Window.partitionBy("vec_id").orderBy("label", "vec")
    anchors = kept(stored.where(is_anchor).withColumn("__n", F.row_number().over(first)).where("__n = 1").select("vec_id", "label", "vec", "square"), "anchors")
    copies = -(-anchors.count() // ASKED)
    many = F.broadcast(spark.createDataFrame([(int(r["cell"]), -(-r["n"] // BLOCK)) for r in ends], "cell long, many long"))
    blocks = stored.join(many, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))) if copies > 1 else F.lit(0))
    blocks = blocks.select((F.col("cell") * (1 << 32) + F.pmod("row", "many")).alias("block"), "part", F.lit(False).alias("asks"), "vec_id", "label", "vec", "far", "square", F.lit(None).cast("array<long>").alias("bounds"))
    if not copies:
        return empty

    def sent(asked: DataFrame, windows: Callable) -> DataFrame:
        """Anchors, with the bounds of their windows, once for each block that may hold what they look for."""

        def run(batches):
            pivots, (cell, blocks_of, lo, hi) = known.value[0], cells.value
            for b in (w.slice(i, ROUTED) for w in batches for i in range(0, w.num_rows, ROUTED)):
                far, square = pivots.far(pivots.lifted(matrix(b.column(2), pivots.width), query=True)), b.column(3).to_numpy()
                own = pa.array([r.tobytes() for r in far], pa.binary())
                at, block, bounds = [], [], []
                for i, (low, high) in enumerate(windows(b)):
                    least_, most_ = pivots.brackets(square[i], far[i], lo, hi)
                    hit = np.flatnonzero((most_ >= float(low.min())) & (least_ <= float(high.max()))) if len(low) else np.zeros(0, np.int64)
                    for c in hit:
                        block += [int(cell[c]) * (1 << 32) + j for j in range(blocks_of[c])]
                    n = int(blocks_of[hit].sum())
                    at += [i] * n
                    bounds += [np.concatenate([low, high]).tolist()] * n
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(np.ones(len(at), bool)), *[c.take(take) for c in (b.column(0), b.column(1), b.column(2), own, b.column(3))], pa.array(bounds, pa.list_(pa.int64()))], ["block", "asks", "vec_id", "label", "vec", "far", "square", "bounds"])

        asks = asked.mapInArrow(lean(run), f"block long, asks boolean, {ROW}, bounds array<long>")
        return asks.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(copies)).cast("int"))

    def met(asks: DataFrame, negative: bool) -> DataFrame:
        both = blocks.unionByName(asks).repartition(parts(spark), "block", "part").sortWithinPartitions("block", "part", "asks")
        return both.mapInArrow(lean(_meet(known, k, negative)), "anchor_id long, nth int, vec_id long, score long")

    def floors(b):
        """Of each anchor: its kth best score with rows of its label in the sample, up to the greatest long."""
        _, _, ids, labels, sample = known.value
        got = products(widened(matrix(b.column(2)), sample.shape[1]), sample)
        for i, (d, kind) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            s = got[i, (labels == kind) & (ids != d)]
            yield np.array([np.partition(s, len(s) - k)[len(s) - k] if len(s) >= k else LOWEST]), np.array([np.iinfo(np.int64).max])

    def between(b):
        for low, high in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
            yield np.array(low, np.int64), np.array(high, np.int64)

    order = [F.desc("score"), F.col("vec_id")]
    found = met(sent(anchors, floors), False)
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("anchor_id").orderBy(*order))).where(F.col("nth") <= k)
    positives = kept(found.select("anchor_id", "nth", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    over, under = least.numerator, least.denominator
    low = F.expr(f"if(positive_score < 0, 0, (cast(positive_score as decimal(20, 0)) * {over} + {under - 1}) div {under})")  # below 0 a share of a score is more than all of it: an empty window
    wins = positives.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("nth", low.alias("low"), F.col("positive_score").alias("high")))).alias("w"))
    wins = wins.select(F.col("anchor_id").alias("vec_id"), F.transform("w", lambda x: x["low"]).alias("low"), F.transform("w", lambda x: x["high"]).alias("high"))
    asked = anchors.join(wins, "vec_id").select("vec_id", "label", "vec", "square", "low", "high")
    got = met(sent(asked, between), True)
    got = got.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "nth").orderBy(*order))).where(F.col("rank") <= k)
    return got.join(positives, ["anchor_id", "nth"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score, then id."""
    near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k]) if len(score) > k else np.arange(len(score))
    return near[np.lexsort((ids[near], np.invert(score[near])))[:k]]


def searched(pivots: Table, q: np.ndarray, square: float, far: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, x: np.ndarray, x_far: np.ndarray, k: int):
    """For each window from low to high: (ids, scores) of the k first rows of x in it; and the rows scored."""
    under, over = pivots.brackets(square, far, x_far, x_far)
    order = np.flatnonzero((over >= float(low.min())) & (under <= float(high.max())))
    order = order[np.argsort(-over[order], kind="stable")]
    floor, held = low.copy(), [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(low)
    at = 0
    while at < len(order) and over[order[at]] >= float(floor.min()):
        take = order[at : at + STEP]
        at += len(take)
        score = products(q[None], x[take])[0]
        for w in range(len(low)):
            ok = (score >= floor[w]) & (score <= high[w])
            if ok.any():
                i, s = np.concatenate([held[w][0], ids[take[ok]]]), np.concatenate([held[w][1], score[ok]])
                top = best(s, i, k)
                held[w] = i[top], s[top]
                if len(top) == k:
                    floor[w] = max(floor[w], held[w][1][-1])
    return held, at


def _meet(known, k: int, negative: bool):
    """Blocks of rows, each followed by the anchors that come to it."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        pivots = known.value[0]
        mark, data, ready = None, [], None
        for b in batches:
            block, part, asks = (b.column(j).to_numpy(zero_copy_only=False) for j in range(3))
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                if hi == lo:
                    continue
                if (block[lo], part[lo]) != mark:
                    mark, data, ready = (block[lo], part[lo]), [], None
                here = b.slice(lo, hi - lo)
                if not asks[lo]:
                    data.append((here.column(3).to_numpy(), here.column(4).to_numpy(), matrix(here.column(5), pivots.width), matrix(here.column(6))))
                    continue
                if not data:
                    continue
                ready = ready or tuple(np.concatenate(c) for c in zip(*data))
                ids, labels, x, x_far = ready
                out = []
                anchor, kind, q, far, square = here.column(3).to_numpy(), here.column(4).to_numpy(), matrix(here.column(5), pivots.width), matrix(here.column(6)), here.column(7).to_numpy()
                for i, bounds in enumerate(here.column(8).to_pylist()):
                    low, high = np.array(bounds, np.int64).reshape(2, -1)
                    fit = np.flatnonzero(((labels != kind[i]) if negative else (labels == kind[i])) & (ids != anchor[i]))
                    held, _ = searched(pivots, q[i], square[i], far[i], low, high, ids[fit], x[fit], x_far[fit], k) if len(fit) else ([], 0)
                    out += [(anchor[i], w + 1, d, s) for w, (di, si) in enumerate(held) for d, s in zip(di, si)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int32() if j == 1 else pa.int64()) for j in range(4)], ["anchor_id", "nth", "vec_id", "score"])

    return run


#: DuckDB SQL of the query over embeddings, for ids that are neither null nor repeated.
SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS a, o.vec_id AS o, a.label = o.label AS same, CAST(list_inner_product(a.e, o.e) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, o) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (
  SELECT p.a AS anchor_id, p.o AS positive_id, p.score AS positive_score, s.o AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.a, p.o ORDER BY s.score DESC, s.o) AS INTEGER) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
