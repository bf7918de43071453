"""Python workers import this package by name; on one machine its folder is enough."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def ensure_importable(spark: SparkSession) -> None:
    """Put this package's folder on the path of workers that start from now on. A cluster gets the package by --py-files or an installation."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, have]))
