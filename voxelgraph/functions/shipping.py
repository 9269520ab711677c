"""Lets Python workers import the package where it isn't installed."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    env = spark.sparkContext.environment
    now = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in now.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, now) if x)
