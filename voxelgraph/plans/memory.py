"""Tables in the shared folder: they cut lineage in iterative operators and are shared between queries of one session."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple, tuple] = {}


def folder(spark: SparkSession) -> str:
    """Below spark.checkpoint.dir; one of this machine only where none is set and the session is local."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"/tmp/checkpoints/{sc.applicationId}"
    return f"{path}/voxelgraph"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blobs(df: DataFrame, name: str) -> DataFrame:
    """written, for rows of some MB: each has a row group of its own, else writer and reader hold a hundred rows or more at a time."""
    return written(df, name, **{"parquet.block.row.count.limit": 1})


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """build(spark, sf_dir), written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        own = written(build(spark, sf_dir), name)
        _KEPT[key] = (own.schema, own.inputFiles()[0].rsplit("/", 1)[0] if own.inputFiles() else None)
    schema, path = _KEPT[key]
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def forget() -> None:
    """The next queries build their tables anew."""
    _KEPT.clear()
