"""Embedding near-duplicates by cosine over navigable small-world graphs, one for each shard.

1. Equal vectors collapse into classes, with partial aggregation first; a class is named by its smallest
   id and weighs as many rows as it has.
2. A bounded sample (SAMPLE classes, SAMPLE_BYTES) gives centres; a class goes to the cell of its nearest
   centre, and cells over SHARD classes are dealt in several shards by row. A task builds a graph for each
   shard and chooses its beam: AUDIT of its members are asked for, with the beam doubled until the
   share of all links that it finds, and the mean share of each member, reach RECALL, or until
   the beam is the whole shard. The graphs are a table of nodes with their links, written once.
3. Every class asks every shard from its own on, so a pair is met once, from one side. A shard
   is left out only where no member can reach the threshold: where the angle to its centre is over its
   radius and the threshold's angle together. Queries stream past a shard's graph in groups.
4. In a group, a beam that is full of links is widened for its query until it holds others. Then ASKED of
   the group's queries are compared with the whole shard; if they miss more than 1 - RECALL of their
   links, the shard's beam is doubled and the group is asked again.
5. All that a beam met near the threshold is verified in double precision. A task adds up how many rows
   each class is linked with, and unites what is linked: it emits counts and a spanning forest, at most one
   row for each class it met, and no pairs.
6. Components come from min-label propagation over the forests of all tasks.

A link that the graphs miss is lost, in counts and perhaps in components; RECALL bounds the share, as far as
the audits tell, and the README has measured figures. No link is false. Vectors of other lengths count as
padded with zeros. Vectors that are null, empty or zero, or hold null or non-finite components, link
with nothing and are their own component. Rows with a null id take no part: no links, a null component, and
kept. Rows that repeat an id are vectors each, each with its own links, and share one component. Ties
cannot arise: of a component the smallest id is kept. Empty tables give empty results; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hnsw
from .near_dedup import components
from .shared import kept, lean, parts
from .vector_search import greedy, matrix, norms

#: Classes of the sample and its bytes; classes of a shard, and the most cells.
SAMPLE, SAMPLE_BYTES, SHARD, CELLS = 4096, 16 << 20, 8192, 4096
#: The first beam, members that a shard's audit asks for, queries of a group, and those that are audited.
BEAM, AUDIT, GROUP, ASKED = 32, 512, 1024, 32
#: The share of links that audits ask for.
RECALL = 0.99
#: How far under the threshold what a graph meets is still verified: it computes in 32 bits.
SLACK = 1e-5


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; each is scaled by its greatest component first, so that squares stay finite."""
    x = x / np.maximum(np.abs(x).max(1, initial=0), np.finfo(float).tiny)[:, None]
    return x / np.maximum(norms(x), np.finfo(float).tiny)[:, None]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec): little-endian doubles, without zeros at the end; null where a vector takes no part."""

    def run(batches):
        for b in batches:
            out = []
            for v in b.column(1):
                x = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False)
                x = x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None
                out.append(None if x is None else (x[: np.flatnonzero(x)[-1] + 1] + 0.0).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>")).mapInArrow(lean(run), "vec_id long, vec binary")


NODE = "shard long, asks boolean, place long, rep long, weight long, vec binary, home boolean, beam int, low array<int>, high array<int>"
FIELDS = [f.split(" ")[0] for f in NODE.split(", ")]
INTS = pa.list_(pa.int32())


def _batch(**columns) -> pa.RecordBatch:
    """A record batch of NODE; columns left out are null."""
    kinds = {"shard": pa.int64(), "asks": pa.bool_(), "place": pa.int64(), "rep": pa.int64(), "weight": pa.int64(), "vec": pa.binary(), "home": pa.bool_(), "beam": pa.int32(), "low": INTS, "high": INTS}
    n = len(columns["shard"])
    return pa.RecordBatch.from_arrays([columns[f] if isinstance(columns.get(f), pa.Array) else pa.array(columns[f], kinds[f]) if f in columns else pa.nulls(n, kinds[f]) for f in FIELDS], FIELDS)


def _missed(graph: hnsw.Graph, q: np.ndarray, beam: int, least: float) -> bool:
    """Whether a beam finds too few of the links of q."""
    want = q @ graph.x.T >= least
    got = np.zeros(want.shape, bool)
    got[graph.search(q, beam, least)] = True
    each = want.sum(1)
    got, each = (got & want).sum(1)[each > 0], each[each > 0]
    return bool(len(each)) and min(got.sum() / each.sum(), (got / each).mean()) < RECALL


def _built(threshold: float):
    """Rows (shard, rep, weight, vec), sorted by shard, as nodes of a graph for each shard."""

    def graph_of(shard: int, rep: np.ndarray, weight: np.ndarray, vec: pa.Array) -> Iterator[pa.RecordBatch]:
        x = unit(matrix(vec)).astype(np.float32)
        height = hnsw.levels(rep)
        graph = hnsw.Graph.build(x, height)
        some = x[np.linspace(0, len(x) - 1, min(AUDIT, len(x))).astype(int)]
        beam = BEAM
        while beam < len(x) and _missed(graph, some, beam, threshold - SLACK):
            beam *= 2
        low = [row[row >= 0].tolist() for row in graph.links[0]]
        high: list[list[int]] = [[] for _ in low]
        for nodes, links in zip(graph.nodes[1:], graph.links[1:]):
            for node, row in zip(nodes, links):
                high[node] += [int((row >= 0).sum()), *row[row >= 0].tolist()]
        n = len(x)
        yield _batch(shard=np.full(n, shard), asks=np.zeros(n, bool), place=np.arange(n), rep=rep, weight=weight, vec=vec, beam=np.full(n, beam, np.int32), low=pa.array(low, INTS), high=pa.array(high, INTS))

    def run(batches):
        shard, held = None, []
        for b in batches:
            of = b.column(0).to_numpy()
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                if hi > lo:
                    if of[lo] != shard and held:
                        yield from _joined(held, lambda *c, s=shard: graph_of(s, *c))
                        held = []
                    shard = of[lo]
                    held.append([b.column(j).slice(lo, hi - lo) for j in (1, 2, 3)])
        if held:
            yield from _joined(held, lambda *c: graph_of(shard, *c))

    return run


def _joined(held: list, make):
    rep, weight, vec = (pa.concat_arrays([h[j] for h in held]) for j in range(3))
    return make(rep.to_numpy(), weight.to_numpy(), vec)


class Shard:
    """A shard's graph, what its members are linked with so far, and which of them are united."""

    def __init__(self, rows: list[pa.RecordBatch], threshold: float):
        t = pa.Table.from_batches(rows).combine_chunks()
        column = lambda c: t.column(c).chunk(0)
        self.rep, self.weight, self.threshold = column("rep").to_numpy(), column("weight").to_numpy(), threshold
        self.vec = matrix(column("vec"))
        self.width = self.vec.shape[1]
        self.whole = unit(self.vec)
        low, high = column("low"), column("high")
        n = len(self.rep)
        lists = [(np.arange(n), np.diff(low.offsets.to_numpy()), low.flatten().to_numpy())]
        levels: list[list[tuple[int, list[int]]]] = []
        for node, row in enumerate(high.to_pylist()):
            at, k = 0, 0
            while at < len(row):
                if k == len(levels):
                    levels.append([])
                levels[k].append((node, row[at + 1 : at + 1 + row[at]]))
                at, k = at + 1 + row[at], k + 1
        lists += [(np.array([x[0] for x in level]), np.array([len(x[1]) for x in level]), np.array([y for x in level for y in x[1]], np.int64)) for level in levels]
        links = []
        for nodes, count, flat in lists:
            out = np.full((len(nodes), max(1, int(count.max(initial=0)))), -1, np.int64)
            r = np.repeat(np.arange(len(nodes)), count)
            out[r, np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)] = flat
            links.append(out)
        self.graph = hnsw.Graph(self.whole.astype(np.float32), [x[0] for x in lists], links)
        self.beam = int(t.column("beam")[0].as_py())
        self.links, self.root = np.zeros(n, np.int64), np.arange(n)

    def ask(self, rep: np.ndarray, weight: np.ndarray, vec: pa.Array, home: np.ndarray):
        """(rows that each query is linked with, the place of a member it is linked with or -1)."""
        q = unit(matrix(vec, self.width))
        beyond = np.sqrt(np.maximum(0, 1 - (q[:, self.width :] ** 2).sum(1)))  # components that no member has
        near = q[:, : self.width]
        low = near.astype(np.float32)
        least = self.threshold - SLACK
        sample = low[np.linspace(0, len(q) - 1, min(ASKED, len(q))).astype(int)]
        while self.beam < len(self.rep) and _missed(self.graph, sample, self.beam, least):
            self.beam *= 2
        i, j = self.graph.search(low, self.beam, least)
        ok = ~home[i] | (self.rep[j] > rep[i])  # in its own shard a pair is met from both sides
        i, j = i[ok], j[ok]
        sure = np.concatenate([np.einsum("ij,ij->i", near[i[k : k + 65536]], self.whole[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)]) >= self.threshold
        i, j = i[sure & (beyond[i] > 0)], j[sure & (beyond[i] > 0)]
        found = np.zeros(len(q), np.int64)
        np.add.at(found, i, self.weight[j])
        np.add.at(self.links, j, weight[i])
        first = np.full(len(q), -1, np.int64)
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for lo, hi in zip(*((c := np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)), np.append(c[1:], len(i)))):
            roots = np.unique(self.root[j[lo:hi]])
            if len(roots) > 1:
                self.root[np.isin(self.root, roots[1:])] = roots[0]
            first[i[lo]] = j[lo]
        return found, first

    def rest(self) -> pa.RecordBatch:
        """Of the members: what they are linked with, and a member they are united with."""
        some = np.flatnonzero((self.links > 0) | (self.root != np.arange(len(self.root))))
        return pa.RecordBatch.from_arrays([pa.array(self.rep[some]), pa.array(self.links[some]), pa.array(self.rep[self.root[some]])], ["rep", "links", "other"])


def _asked(threshold: float):
    """Nodes of a shard, each shard followed by the queries that come to it: (rep, links, other)."""

    def run(batches):
        mark, nodes, shard = None, [], None
        for b in batches:
            of, part, asks = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                if hi == lo:
                    continue
                if (of[lo], part[lo]) != mark:
                    if shard:
                        yield shard.rest()
                    mark, nodes, shard = (of[lo], part[lo]), [], None
                if not asks[lo]:
                    nodes.append(b.slice(lo, hi - lo))
                    continue
                if not nodes:
                    continue
                shard = shard or Shard(nodes, threshold)
                for at in range(lo, hi, GROUP):
                    g = b.slice(at, min(GROUP, hi - at))
                    rep = g.column("rep").to_numpy()
                    links, first = shard.ask(rep, g.column("weight").to_numpy(), g.column("vec"), g.column("home").to_numpy(zero_copy_only=False))
                    some = first >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(shard.rep[first[some]])], ["rep", "links", "other"])
        if shard:
            yield shard.rest()

    return run


def graphs(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Of classes (rep, weight, vec): the graphs (NODE), the classes with their shard, and the queries."""
    spark = classes.sparkSession
    size = classes.agg(F.count("*").alias("n"), F.max(F.octet_length("vec")).alias("wide")).first()
    if not size["n"]:
        return None
    some = classes.orderBy(F.xxhash64("rep"), "rep").limit(max(1, min(SAMPLE, SAMPLE_BYTES // size["wide"]))).select("vec").collect()
    sample = unit(matrix(pa.array([bytes(r["vec"]) for r in some], pa.binary()), size["wide"] // 8))
    centres = spark.sparkContext.broadcast(sample[greedy(sample, max(1, min(CELLS, size["n"] // SHARD)))[0]])

    def celled(batches):
        c = centres.value
        for b in batches:
            near = np.clip(unit(matrix(b.column(2), c.shape[1])) @ c.T, -1, 1)
            cell = near.argmax(1) if len(near) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(np.arccos(near[np.arange(len(cell)), cell]))], ["rep", "weight", "vec", "cell", "angle"])

    held = kept(classes.mapInArrow(lean(celled), "rep long, weight long, vec binary, cell long, angle double"), "cells")
    cells = held.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("far")).orderBy("cell").collect()  # CELLS rows at most
    many = [-(-r["n"] // SHARD) for r in cells]
    base = np.cumsum([0, *many])
    dealt = spark.createDataFrame([(int(r["cell"]), int(b), int(m)) for r, b, m in zip(cells, base, many)], "cell long, base long, many long")
    held = held.join(F.broadcast(dealt), "cell")
    held = kept(held.select("rep", "weight", "vec", (F.col("base") + F.pmod(F.xxhash64("rep"), "many")).alias("shard")), "sharded")
    index = kept(held.select("shard", "rep", "weight", "vec").repartition(parts(spark), "shard").sortWithinPartitions("shard", "rep").mapInArrow(lean(_built(threshold)), NODE), "graphs")
    of = spark.sparkContext.broadcast((np.array([r["cell"] for r in cells]), np.array([r["far"] for r in cells]), base))

    def routed(batches):
        cell, far, base = of.value
        c = centres.value[cell]
        for b in (w.slice(k, GROUP) for w in batches for k in range(0, w.num_rows, GROUP)):
            own = b.column(3).to_numpy()
            angle = np.arccos(np.clip(unit(matrix(b.column(2), c.shape[1])) @ c.T, -1, 1))
            may = angle <= far + np.arccos(threshold) + 1e-6
            at, shard = np.nonzero(np.repeat(may, np.diff(base), axis=1))
            on = shard >= own[at]
            take, shard = pa.array(at[on]), shard[on]
            yield _batch(shard=shard, asks=np.ones(len(shard), bool), place=np.zeros(len(shard), np.int64), rep=b.column(0).take(take), weight=b.column(1).take(take), vec=b.column(2).take(take), home=shard == own[at[on]])

    return index, held, held.select("rep", "weight", "vec", "shard").mapInArrow(lean(routed), NODE)


#: Queries that one copy of a graph is asked, about.
QUERIES = 1 << 18


def find(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    spark = vectors.sparkSession
    rows = kept(usable(vectors, id_col, vec_col), "vectors")
    own = rows.where("vec is not null and vec_id is not null")
    classes = kept(own.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).select("rep", "weight", "vec"), "classes")
    # rows that repeat an id may be the smallest of several classes, which need names of their own
    names = classes.withColumn("class", F.monotonically_increasing_id())
    names = kept(names, "names")
    made = graphs(names.select(F.col("class").alias("rep"), "weight", "vec"), threshold)
    if made is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    index, held, queries = made
    copies = max(1, -(-held.count() // QUERIES))
    nodes = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))) if copies > 1 else F.lit(0))
    asks = queries.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(copies)).cast("int"))
    order = ["shard", "part", *FIELDS[1:]]
    both = nodes.select(order).unionByName(asks.select(order)).repartition(parts(spark), "shard", "part").sortWithinPartitions("shard", "part", "asks", "place")
    found = kept(both.mapInArrow(lean(_asked(threshold)), "rep long, links long, other long"), "found")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classed = names.select("vec", F.col("class").alias("rep"), F.col("rep").alias("first"), "weight")
    of = classed.select("rep", "first")
    forest = found.where("rep <> other").join(of, "rep").select("other", F.col("first").alias("a")).join(of.withColumnRenamed("rep", "other"), "other").select("a", F.col("first").alias("b"))
    several = rows.where("vec is not null").select("vec_id", "vec").join(classed.select("vec", "first"), "vec").where("vec_id <> first").select(F.col("first").alias("a"), F.col("vec_id").alias("b"))
    root = components(forest.unionByName(several).distinct())
    out = rows.select("vec_id", "vec").join(classed.join(counts, "rep", "left").select("vec", "weight", "links"), "vec", "left")
    out = out.join(root.withColumnRenamed("id", "vec_id"), "vec_id", "left").withColumn("component_id", F.coalesce("root", "vec_id"))
    n = F.when(F.col("vec_id").isNull() | F.col("vec").isNull(), 0).otherwise(F.col("weight") - 1 + F.coalesce("links", F.lit(0)))
    return out.select("vec_id", n.cast("long").alias("n_links"), "component_id", (F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id"))).alias("kept"))


#: DuckDB SQL of find() over embeddings, for ids that are neither null nor repeated and vectors of one length.
SQL = """
WITH RECURSIVE
v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
g AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(id, root) AS (SELECT a, a FROM g UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.id),
l AS (SELECT id, min(root) AS root FROM r GROUP BY 1),
n AS (SELECT a AS id, count(*) AS n FROM g GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.id = vec_id LEFT JOIN l ON l.id = vec_id
"""
