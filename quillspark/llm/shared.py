"""Helpers of the llm operators."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession

from .. import ship
from ..storage import cut, kept, new_folder, shared_folder

__all__ = ["cut", "kept", "lean", "new_folder", "parts", "shared_folder", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run):
    """run for mapInArrow, after which the worker gives the memory it freed back to the system: workers
    live on from stage to stage beside the executor's heap."""

    def trimmed(batches):
        import ctypes
        import gc

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # the C library may have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return trimmed


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """The name, or one that begins with it, which no column of df has (in either case of letters)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
