"""Retrieval analytics and training-data operators for Spark."""

from __future__ import annotations

import os


def ship(spark) -> None:
    """Puts this package's folder on the path of Python workers that start from now on. On a cluster
    the package must be installed there or sent with --py-files."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
