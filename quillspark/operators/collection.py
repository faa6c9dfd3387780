"""A stored collection of vectors: partitions by project and model version, INT8 codes with proven bounds.

Of a unit vector u the collection keeps ``scale`` and 8-bit codes c = round(u / scale), and ``error``, the
length of u - scale c. For a unit query q the score q.u is then within ``error`` of scale (q.c), for the rest
is q.(u - scale c), which no unit q makes longer than that vector. So codes settle most pairs:

1. Codes stream past a packed matrix of queries. A task keeps, for each query, the k greatest lower bounds so
   far; a row whose upper bound is below the kth cannot be among the k best. What may be leaves the
   task once, at its end.
2. Of all tasks the kth greatest lower bound decides again. Only what is left is scored exactly, from the
   vectors themselves, which are a column that the first pass does not read.

The result is that of ``retrieval.dense`` over the same partitions. Queries go out in groups of QUERY_BYTES.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import ship
from ..storage import kept
from .retrieval import cosine, ranked

#: Bytes of queries that are sent to tasks at once, rows that are scored at once, and most pairs of them with queries.
QUERY_BYTES, STEP, PAIRS = 64 << 20, 2048, 1 << 21
#: Bounds are widened by this: scores are compared rounded to nine digits.
SLACK = 1e-8


def unit(lists, width: int | None = None) -> np.ndarray:
    """Rows of length 1; rows without a usable vector are 0."""
    width = max((len(v) for v in lists if v is not None), default=0) if width is None else width
    x = np.array([v if v is not None and len(v) == width else [0.0] * width for v in lists], float).reshape(len(lists), width)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, error) of unit rows."""
    scale = np.abs(x).max(1, initial=0) / 127
    codes = np.rint(np.divide(x, scale[:, None], out=np.zeros_like(x), where=scale[:, None] > 0)).astype(np.int8)
    rest = x - codes * scale[:, None]
    return codes, scale, np.sqrt((rest * rest).sum(1)) * (1 + 1e-9)


def write_collection(vectors: DataFrame, path: str, id_col: str = "vec_id", vec: str = "embedding") -> None:
    """Appends vectors (id, project_id, model_version, vector) to a collection; of one partition all have
    one length. Files are sorted by id, so an id's row group is found by its statistics."""
    ship(vectors.sparkSession)
    v = vectors.select(F.col(id_col).alias("id"), "project_id", "model_version", F.col(vec).cast("array<double>").alias("vector")).where("id is not null")

    def run(batches):
        for b in batches:
            lists = b.column(3).to_pylist()
            codes, scale, error = coded(unit(lists))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(error)], [*b.schema.names, "codes", "scale", "error"])

    schema = ST.StructType([*v.schema.fields, ST.StructField("codes", ST.BinaryType()), ST.StructField("scale", ST.DoubleType()), ST.StructField("error", ST.DoubleType())])
    laid = v.mapInArrow(run, schema).repartition("project_id", "model_version", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("project_id", "model_version", "id")
    laid.write.mode("append").partitionBy("project_id", "model_version").parquet(path)


def open_collection(spark: SparkSession, path: str, projects: list[str], version: str) -> DataFrame:
    """The vectors of some projects and one version; no other partition is read."""
    found = spark.read.parquet(path).schema
    text = [ST.StructField(f.name, ST.StringType()) if f.name in ("project_id", "model_version") else f for f in found.fields]
    return spark.read.schema(ST.StructType(text)).parquet(path).where(F.col("project_id").isin(projects) & (F.col("model_version") == version))


def drop_version(spark: SparkSession, path: str, project: str, version: str) -> bool:
    """Deletes the partition of one model version of a project, and no other; whether there was one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/project_id={project}/model_version={version}")
    return bool(at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True))


def candidates(held: DataFrame, queries: DataFrame, k: int, threshold: float, own: bool = False) -> DataFrame:
    """(query_id, id, low, high): the pairs that may be among the k best of a query, by their codes."""
    spark = held.sparkSession
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("q"))
    size = asked.agg(F.count("*").alias("n"), F.sum(F.size("q")).alias("b")).first()
    groups = max(1, -(-8 * (size["b"] or 0) // QUERY_BYTES))
    schema = ST.StructType([asked.schema["query_id"], held.schema["id"], ST.StructField("low", ST.DoubleType()), ST.StructField("high", ST.DoubleType())])
    out = None
    for g in range(groups):
        some = (asked if groups == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)).collect()
        sent = spark.sparkContext.broadcast(([r["query_id"] for r in some], unit([r["q"] for r in some])))
        got = held.select("id", "codes", "scale", "error").mapInArrow(_bounded(sent, k, threshold, own), schema)
        out = got if out is None else out.unionByName(got)
    kth = Window.partitionBy("query_id").orderBy(F.desc("low"))
    floor = out.withColumn("n", F.row_number().over(kth)).where(F.col("n") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("low")).alias("floor"))
    return out.join(floor, "query_id").where(f"floor is null or high >= floor - {SLACK}").drop("floor")


def step(queries: int) -> int:
    """Rows that are scored at once against so many queries."""
    return max(1, min(STEP, PAIRS // max(1, queries)))


def _bounded(sent, k: int, threshold: float, own: bool):
    def run(batches):
        names, q = sent.value
        if not names or not q.shape[1]:
            return
        floor = np.full((len(names), k), -np.inf)  # the k greatest lower bounds of each query
        held: list[tuple] = []
        width, kind, zero = q.shape[1], None, ~q.any(1)
        numbers, rows = {name: n for n, name in enumerate(names)}, step(len(names))

        def live(part):
            keep = part[3] >= floor[part[0], 0] - SLACK
            return tuple(c[keep] if isinstance(c, np.ndarray) else c.filter(pa.array(keep)) for c in part)

        for whole in batches:
            for b in (whole.slice(j, rows) for j in range(0, whole.num_rows, rows)):
                kind = b.column(0).type
                ok = [len(c.as_py()) == width for c in b.column(1)]
                codes = np.frombuffer(b"".join(c.as_py() if fit else bytes(width) for c, fit in zip(b.column(1), ok)), np.int8).reshape(-1, width).astype(np.float64)
                scale, error = b.column(2).to_numpy() * ok, b.column(3).to_numpy() * ok
                near = (q @ codes.T) * scale
                low, high = near - error, near + error
                if not own:
                    same = [(numbers[i], j) for j, i in enumerate(b.column(0).to_pylist()) if i in numbers]
                    if same:
                        low[tuple(zip(*same))] = high[tuple(zip(*same))] = -np.inf
                floor = np.partition(np.concatenate([floor, low], 1), low.shape[1], 1)[:, -k:]
                floor.sort(1)
                may = (high >= floor[:, :1] - SLACK) & (high >= threshold - SLACK)
                if zero.any():  # all rows score 0: the first by id
                    first = np.argsort(np.array(b.column(0).to_pylist(), object), kind="stable")[: k + 1]
                    may[zero] &= np.isin(np.arange(b.num_rows), first)
                r, c = np.nonzero(may)
                held.append((r, b.column(0).take(pa.array(c)), low[r, c], high[r, c]))
                if len(held) >= 16:
                    held = [live((np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])))]
        for r, i, low, high in map(live, held):
            yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in r], pa.string() if names and isinstance(names[0], str) else pa.int64()), i.cast(kind), pa.array(low), pa.array(high)], ["query_id", "id", "low", "high"])

    return run


def search(held: DataFrame, queries: DataFrame, k: int = 20, threshold: float = 0.65, own: bool = False) -> DataFrame:
    """(query_id, id, score, rank): exact cosine top k of queries (query_id, vector) over an opened collection."""
    ship(held.sparkSession)
    pairs = kept(candidates(held, queries, k, threshold, own).select("query_id", "id"), "pairs")
    scored = pairs.join(held.select("id", "vector"), "id").join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
    scored = scored.select("query_id", "id", F.coalesce(cosine(F.col("vector"), F.col("q")), F.lit(0.0)).alias("score")).where(F.col("score") >= threshold)
    return ranked(scored, k)
