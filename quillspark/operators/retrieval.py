"""Ranking: BM25, exact dense search, symbol lookup, reciprocal rank fusion and reranking.

The corpus is never collected. Query sides are broadcast only when ``small`` holds after a count of
them; beyond that the same joins shuffle, and dense search passes over the corpus once for each block
of queries. Access rules (project and roles) hold before any ranking, never after it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import ship
from ..functions import text as T
from ..storage import kept

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
#: Most rows of a query side that may be broadcast.
BROADCAST_ROWS = 50_000
#: Most bytes of query vectors that are.
BROADCAST_BYTES = 64 << 20
#: Most pairs of a vector and a query that a task scores at once.
PAIRS = 1 << 21


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows (counted up to that)."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def bounded(df: DataFrame, queries: DataFrame, each: int) -> DataFrame:
    """df, which has ``each`` rows of a query at most, with a broadcast hint if that makes few rows."""
    most = BROADCAST_ROWS // each
    return F.broadcast(df) if queries.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if its estimated size makes fewer scan tasks than there are cores, as with
    a file of one row group; larger inputs are left as they lie."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else df


def accessible(project: Column, roles: Column, projects: Column, of: Column) -> Column:
    """Whether a request for ``projects`` by someone in the roles ``of`` may see a row."""
    return F.coalesce(F.array_contains(projects, project) & F.arrays_overlap(roles, of), F.lit(False))


def corpus_stats(tokenised: DataFrame) -> DataFrame:
    """(term, df, dl) of documents (id, t): the documents that hold a term; the row of the empty term has
    the number of all documents and their lengths. Partial sums leave each task with its vocabulary."""
    each = tokenised.select(F.size("t").alias("dl"), F.explode(F.array_append(F.array_distinct("t"), "")).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("dl"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, access: bool = False) -> DataFrame:
    """(query_id, rank, id, score): Okapi scores of the k best documents of each (query_id, query);
    each distinct query term counts once, zero scores are dropped, ties go to the smaller id. Statistics
    are those of all documents; only the tokens that some query has are counted by document. With
    access, documents have project_id and allowed_roles, queries projects and roles."""
    seen = ["project_id", "allowed_roles"] if access else []
    asks = ["projects", "roles"] if access else []
    t = spread(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"), *seen)).withColumn("t", T.tokens(F.col("t")))
    terms = small(queries.select("query_id", *asks, F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term")))
    stats = corpus_stats(t)
    # filters on dl and inner joins stay above the aggregation, so all parts reuse one exchange of it
    size = stats.where("dl is not null").select(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    stats = stats.where("dl is null").crossJoin(F.broadcast(size)).withColumn("idf0", idf)  # size is one row
    mean = stats.agg(F.avg("idf0").alias("mean_idf"))
    asked = small(terms.select("term").distinct())
    stats = stats.join(asked, "term").crossJoin(F.broadcast(mean))
    stats = stats.withColumn("idf", F.when(F.col("idf0") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf0"))).select("term", "idf", "avgdl")
    held = t.select("id", *seen, F.size("t").alias("dl"), F.explode("t").alias("term")).join(asked, "term", "left_semi")
    held = held.groupBy("id", "term").agg(F.count("*").alias("tf"), *[F.first(c).alias(c) for c in ("dl", *seen)])
    hit = held.join(terms.join(stats, "term"), "term")
    hit = hit.where(accessible(*map(F.col, ("project_id", "allowed_roles", "projects", "roles")))) if access else hit
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hit.groupBy("query_id", "id").agg(F.sum(part).alias("score")).where("score > 0")
    return ranked(scored, k)


def bm25_then_access(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, top: DataFrame | None = None) -> DataFrame:
    """The compatible form: access is applied to the 3 k best, so a request may get fewer than k rows that
    it could see. bm25 with access filters first. ``top`` are the 3 k best, where an index gave them."""
    asks, seen = queries.select("query_id", "projects", "roles"), docs.select(F.col(id_col).alias("id"), "project_id", "allowed_roles")
    top = (bm25(docs, queries, id_col, text, 3 * k) if top is None else top).drop("rank")
    top = seen.join(bounded(top, queries, 3 * k), "id").join(asks, "query_id")
    return ranked(top.where(accessible(*map(F.col, ("project_id", "allowed_roles", "projects", "roles")))).select("query_id", "id", "score"), k)


def ranked(scored: DataFrame, k: int | None, order: list[Column] | None = None) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*(order or [F.desc(F.round("score", 9)), F.col("id")]))
    out = scored.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda l, r: l.cast("double") * r.cast("double")), F.lit(0.0), lambda s, v: s + v)  # noqa: E731,E741
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def dense(vectors: DataFrame, queries: DataFrame, k: int = 20, threshold: float | None = 0.65, id_col: str = "vec_id", vec: str = "embedding", access: bool = False, own: bool = False) -> DataFrame:
    """(query_id, id, score, rank): exact cosine top-k of (query_id, vector) against all vectors, which
    stream past the queries in Arrow batches; a task keeps the k best and emits them once. Queries are broadcast
    in blocks of BROADCAST_ROWS and BROADCAST_BYTES, one pass over the vectors for each block. Vectors of another length or
    without one score 0. A query's own id is left out unless ``own``. Access as in bm25."""
    spark = vectors.sparkSession
    ship(spark)
    seen = ["project_id", "allowed_roles"] if access else []
    d = spread(vectors.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"), *seen).where("id is not null"))
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("q"), *(["projects", "roles"] if access else []))
    schema = ST.StructType([q.schema["query_id"], ST.StructField("id", d.schema["id"].dataType), ST.StructField("score", ST.DoubleType())])
    size = q.agg(F.count("*").alias("n"), F.sum(F.size("q")).alias("b")).first()
    blocks = max(-(-size["n"] // BROADCAST_ROWS), -(-8 * (size["b"] or 0) // BROADCAST_BYTES))
    out = None
    for n in range(blocks):
        mine = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)
        sent = spark.sparkContext.broadcast([tuple(np.array(c) if n == 1 and c is not None else c for n, c in enumerate(r)) for r in mine.collect()])
        got = d.mapInArrow(_nearest(sent, k, threshold, access, own), schema)
        out = got if out is None else out.unionByName(got)
    return ranked(out if out is not None else spark.createDataFrame([], schema), k)


def _nearest(sent, k: int, threshold: float | None, access: bool, own: bool):
    def unit(rows, width: int) -> np.ndarray:
        x = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            if r is not None and len(r) == width:
                x[i] = r
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def run(batches):
        asks = sent.value
        ids = np.array([r[0] for r in asks], object)
        widths = sorted({len(r[1]) for r in asks if r[1] is not None} | {1})
        by = {w: (np.array([i for i, r in enumerate(asks) if (len(r[1]) if r[1] is not None and len(r[1]) else 1) == w], np.int64)) for w in widths}
        q = {w: unit([asks[i][1] for i in at], w) for w, at in by.items()}
        may: dict = {}

        def allowed(project, roles) -> np.ndarray:
            key = project, tuple(roles or ())
            if key not in may:
                may[key] = np.array([project in (r[2] or ()) and bool(set(key[1]) & set(r[3] or ())) for r in asks], bool)
            return may[key]

        floor = np.full(len(asks), -np.inf)  # the kth best score so far of each query
        held: list[list[tuple[float, float, object]]] = [[] for _ in asks]
        kind = None
        rows_at_once = max(1, min(2048, PAIRS // max(1, len(asks))))
        for whole in batches:
            for b in (whole.slice(j, rows_at_once) for j in range(0, whole.num_rows, rows_at_once)):
                kind = b.column(0).type
                got, lists = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
                mask = np.stack([allowed(p, r) for p, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]) if access and len(got) else None
                for w, at in by.items():
                    s = np.clip(unit(lists, w) @ q[w].T, -1.0, 1.0) if len(at) else np.zeros((len(got), 0))
                    r = np.round(s, 9)
                    ok = r >= floor[at]
                    ok &= True if threshold is None else s >= threshold
                    ok &= mask[:, at] if access else True
                    for c in np.flatnonzero(ok.any(0)):
                        i = at[c]
                        near = np.flatnonzero(ok[:, c] & (True if own else got != ids[i]))
                        if len(near) > k:
                            near = near[r[near, c] >= np.partition(r[near, c], len(near) - k)[len(near) - k]]
                        held[i] += [(-r[j, c], s[j, c], got[j]) for j in near]
                        if len(held[i]) > 4 * k:
                            held[i] = sorted(held[i], key=lambda x: (x[0], x[2]))[:k]
                            floor[i] = -held[i][-1][0]
        rows = [(ids[i], j, float(s)) for i, best in enumerate(held) for _, s, j in sorted(best, key=lambda x: (x[0], x[2]))[:k]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], _kind(ids)), pa.array([r[1] for r in rows], kind or pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["query_id", "id", "score"])

    return run


def _kind(values) -> pa.DataType:
    return pa.string() if any(isinstance(v, str) for v in values) else pa.int64()


def fuse(lists: list[DataFrame], k: int | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, rank from 1, id); blank ids use up a rank but
    score nothing; ties keep the order of first appearance."""
    all_ = None
    for n, x in enumerate(lists):
        x = x.select("query_id", F.col("id").cast("string").alias("id"), "rank", F.lit(n).alias("list_no"))
        all_ = x if all_ is None else all_.unionByName(x)
    got = all_.where("id is not null and id <> ''").groupBy("query_id", "id").agg(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    return ranked(got, k, [F.desc(F.round("score", 12)), F.col("seen"), F.col("id")]).select("query_id", "rank", "id", "score", F.col("seen.list_no").alias("first_list"))


def rerank(candidates: DataFrame, query: str = "query", content: str = "content", k: int = 5) -> DataFrame:
    """Orders candidates by the share of query tokens they hold; empty contents score -999."""
    q, c = F.array_distinct(T.tokens(F.col(query))), F.array_distinct(T.tokens(F.col(content)))
    score = F.when(F.coalesce(F.length(content), F.lit(0)) == 0, -999.0).when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, c)) / F.size(q))
    return ranked(candidates.drop("rank", "score").withColumn("score", score.cast("double")), k)


def symbols(names: DataFrame, keywords: DataFrame, k: int = 5) -> DataFrame:
    """First k names (by ord) whose last :: segment contains the keyword, case-sensitively."""
    from .substrings import holding

    last = spread(names).withColumn("__last", F.element_at(F.split(F.col("fqn"), "::"), -1))
    hit = holding(last, "__last", kept(keywords.select("query_id", "keyword").distinct(), "keywords"), "keyword").drop("__last")
    w = Window.partitionBy("query_id", "keyword").orderBy("ord", "fqn")
    return hit.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
