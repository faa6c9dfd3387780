"""Index maintenance: snapshot diff, upsert, delete, purge, dedup, expiry, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or modified between two snapshots."""
    o, n = old.select(key, F.col(value).alias("o"), F.lit(1).alias("io")), new.select(key, F.col(value).alias("n"), F.lit(1).alias("in"))
    change = F.when(F.col("io").isNull(), "added").when(F.col("in").isNull(), "removed").otherwise("modified")
    return o.join(n, key, "full_outer").where("io is null or `in` is null or not (o <=> n)").select(key, change.alias("change"))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """New rows replace existing ones of the same key; of repeated new keys the last write wins."""
    last = latest(new, [key], [F.desc(order)])
    return existing.join(last, key, "left_anti").unionByName(last)


def replace_files(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Delete-then-insert: all rows of the files in new are replaced."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_files(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone, keys, "left_anti")


def purge(existing: DataFrame, project: str, version: str | None = None) -> DataFrame:
    """Without a project, or without one model version of it."""
    gone = F.col("project_id").eqNullSafe(project)
    return existing.where(~(gone if version is None else gone & F.col("model_version").eqNullSafe(version)))


def dedup_first(chunks: DataFrame, hash_col: str, order: str) -> DataFrame:
    """The first row of each hash. Partial minima come before the shuffle, so a hash that a third of
    all rows share never meets in one task."""
    first = chunks.groupBy(hash_col).agg(F.min(order).alias(order))
    return chunks.join(first, [hash_col, order], "left_semi")


def invalidate(cache: DataFrame, project: str) -> DataFrame:
    return cache.where(~F.array_contains("project_ids", project))


def live(df: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    return df.where(F.col(expires) > now)


def collection_stats(points: DataFrame) -> DataFrame:
    return points.groupBy("project_id", "model_version").agg(F.count("*").alias("points"))


#: The columns of a stored chunk, in order.
PAYLOAD = [
    "chunk_id", "chunk_hash", "content", "file_path", "language", "node_type", "node_name", "start_line", "end_line", "parent_class",
    "imports_context", "docstring", "commit_hash", "branch", "repository_name", "project_id", "tenant_id", "allowed_roles", "sensitivity_level",
    "calls", "called_by", "imports", "has_secrets_redacted", "embedding_model", "embedding_model_version", "indexed_at", "file_last_modified",
]


def payload(chunks: DataFrame) -> DataFrame:
    """Flat rows of chunks: every column of PAYLOAD, parent class and docstring empty where null; columns
    that chunks lack are null."""
    have = set(chunks.columns)
    col = lambda c: F.coalesce(F.col(c), F.lit("")) if c in ("parent_class", "docstring") else F.col(c)
    return chunks.select(*[(col(c) if c in have else F.lit("" if c in ("parent_class", "docstring") else None).cast("string")).alias(c) for c in PAYLOAD])


def unwrapped(results: DataFrame, source: str) -> DataFrame:
    """(id, score, payload, source) of ranked results whose payload may lie one level down and whose id may
    only be in the payload: columns id, score, payload, result.payload (structs with chunk_id)."""
    body = F.coalesce("payload", "result.payload")
    return results.select(F.coalesce(F.col("id").cast("string"), body["chunk_id"]).alias("id"), "score", body.alias("payload"), F.lit(source).alias("source"))
