"""The semantic cache: rows of answered requests, and the lookup of similar ones under the same access hash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import ids

#: About as many entries, and as many requests, of one access hash meet in one group; more are dealt over more groups.
BLOCK = 4096
#: Requests that are compared at once.
SLICE = 256


def cache_entry(entries: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """Cache rows (rbac_hash, query_preview, query_embedding, result, expires_at) of answered requests
    (user_id, projects, query, query_embedding, result, ts)."""
    return entries.select(
        ids.rbac_hash(F.col("user_id"), F.col("projects")).alias("rbac_hash"), F.substring("query", 1, 120).alias("query_preview"), "query_embedding", "result",
        (F.col("ts") + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"),
    )


def cache_lookup(cache: DataFrame, requests: DataFrame, threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(query_id, result): of the live entries with the request's access hash the most similar, if it reaches
    the threshold; ties go to the smaller result. Requests: query_id, user_id, projects, vector, now.

    Equal entries count once, with the latest end; vectors without a direction, of another length, or with
    null or non-finite components are similar to nothing. Entries and requests of a hash are dealt over
    as many groups as their counts ask for, so a hash that a third of all rows share is many tasks; a group gives
    one row for a request at most."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    e = cache.select("rbac_hash", F.col("query_embedding").cast("array<double>").alias("vector"), "result", micros("expires_at")).dropna()
    e = e.groupBy("rbac_hash", "vector", "result").agg(F.max("expires_at").alias("expires_at"))
    q = requests.select("query_id", F.col("vector").cast("array<double>").alias("vector"), micros("now"), ids.rbac_hash(F.col("user_id"), F.col("projects")).alias("rbac_hash")).dropna().distinct()
    groups = lambda df, name: df.groupBy("rbac_hash").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = groups(e, "es").join(groups(q, "qs"), "rbac_hash")
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    e = e.join(sizes, "rbac_hash").select("rbac_hash", deal("es", "result", "vector").alias("en"), every("qs").alias("qn"), "vector", "result", "expires_at")
    q = q.join(sizes, "rbac_hash").select("rbac_hash", every("es").alias("en"), deal("qs", "query_id", "vector", "now").alias("qn"), "query_id", "vector", "now")
    keys = ["rbac_hash", "en", "qn"]
    schema = ST.StructType([q.schema["query_id"], ST.StructField("sim", ST.DoubleType()), e.schema["result"]])

    def meet(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        entries = entries.sort_values("result", kind="stable")
        sim, at = nearest(entries["vector"], None, entries["expires_at"], asked["vector"], asked["now"])
        hit = sim >= threshold
        return pd.DataFrame({"query_id": asked["query_id"][hit], "sim": sim[hit], "result": entries["result"].to_numpy()[at[hit]]})

    best = e.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(meet, schema)
    return best.groupBy("query_id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "result")).alias("b")).select("query_id", "b.result")


def nearest(vectors, since, until, asked, now) -> tuple[np.ndarray, np.ndarray]:
    """(cosine to nine digits, position) of the most similar entry of each request, the first of equals, among
    those with since <= now < until (since None: always); -inf where there is none."""
    width = max([len(v) for v in [*vectors, *asked]], default=0)
    e, el = _unit(vectors, width)
    q, ql = _unit(asked, width)
    until, now = np.asarray(until, dtype=np.int64), np.asarray(now, dtype=np.int64)
    best, at = np.full(len(q), -np.inf), np.zeros(len(q), dtype=np.int64)
    if not len(e):
        return best, at
    for n in range(0, len(q), SLICE):
        s = slice(n, n + SLICE)
        sim = np.round(q[s] @ e.T, 9)
        met = (ql[s, None] == el) & (until > now[s, None])
        if since is not None:
            met &= np.asarray(since, dtype=np.int64) <= now[s, None]
        sim = np.where(met & ~np.isnan(sim), sim, -np.inf)
        at[s] = sim.argmax(axis=1)
        best[s] = sim[np.arange(len(sim)), at[s]]
    return best, at


def _unit(vectors, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of one width, and their own lengths; rows that have no direction are NaN."""
    x, size = np.zeros((len(vectors), width)), np.zeros(len(vectors), dtype=np.int64)
    for n, v in enumerate(vectors):
        x[n, : len(v)] = np.array(v, dtype=np.float64)
        size[n] = len(v)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.where(np.isfinite(norm) & (norm > 0), x / norm, np.nan), size
