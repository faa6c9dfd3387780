"""Sources and sinks: file trees, logs, evaluation sets, edges, cache entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT = "time string, event string, session string, prompt_preview string, length long, model string, tier string, latency_s double"
CASE = T.StructType([T.StructField("query", T.StringType()), T.StructField("expected_chunk_ids", T.ArrayType(T.StringType())), T.StructField("expected_file_paths", T.ArrayType(T.StringType())), T.StructField("category", T.StringType()), T.StructField("project_id", T.StringType()), T.StructField("notes", T.StringType())])


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, size): files under root with their text; malformed UTF-8 is replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    text = F.decode("content", "UTF-8") if spark.conf.get("spark.sql.legacy.codingErrorAction", "false") == "true" else F.call_function("decode", F.call_function("make_valid_utf8", F.col("content").cast("string")).cast("binary"), F.lit("UTF-8"))
    return raw.select("path", text.alias("content"), F.col("length").alias("size"))


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(path)


def cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE).json(path, multiLine=True)


def write_cases(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def edges(spark: SparkSession, path: str, project: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("project_id") == project).select("src", "dst", "relation")


def write_edges(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the projects in df, no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def branch_tip(refs: DataFrame) -> DataFrame:
    """(name, tip): the local ref, else that of origin, else HEAD."""
    return refs.select("name", F.coalesce("local", "remote", "head", F.lit("unknown")).alias("tip"))
