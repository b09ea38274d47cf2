"""Lets Python workers import this package where the driver found it."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def let_import(spark: SparkSession) -> None:
    """Add the package's folder to the workers' module path; where it is installed otherwise, this changes nothing."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([*have, ROOT])
