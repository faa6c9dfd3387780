"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the folder its context checkpoints to. Where neither is
    set a local session gets a folder of its own; a cluster is refused, for its executors share none."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _own.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="quillspark-")
        _own[sc.applicationId] = where
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the driver ends."""
    where = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, where)
    return where


def remove(spark: SparkSession, where: str) -> None:
    """Deletes a folder, for what no plan reads any more."""
    with contextlib.suppress(Exception):  # the session may be gone
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut, its columns are read apart,
    and joins deal both of their sides out anew, so that skewed keys can be split."""
    spark = df.sparkSession
    where = new_folder(spark, name)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder with its partitioning."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
