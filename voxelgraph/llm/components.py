"""Connected components of a distributed edge table: in one task while it is small, by large-star and small-star steps beyond."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import ship, written

#: Links that one task joins, counted first: 16 bytes each.
FEW = 1 << 21


def least_ids(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id of the links and the least id that it reaches, by hooking roots and halving paths."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root, u, v = np.arange(len(ids)), at[: len(a)], at[len(a) :]
    while True:
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        if (low == high).all():
            return ids, ids[root]
        np.minimum.at(root, high, low)
        while not (root[root] == root).all():
            root = root[root]


def connected(links: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """(doc_id, component_id) of every document with a link; component_id is the smallest reachable id.

    At most `few` links meet in one task on an executor. Beyond that each round joins every node to the least of its
    neighbourhood and is written to the shared folder, so lineage stays short; the number of rounds grows with the logarithm
    of the longest chain. Minima are aggregated before they are shuffled, so that a hub costs a row a task. Nothing but
    counters reaches the driver. Links of a document with itself count for nothing; without links the result is empty.
    """
    ship(links.sparkSession)
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).distinct()

    def solve(table: pa.Table) -> pa.Table:
        return pa.table([pa.array(x, pa.int64()) for x in least_ids(table.column("u").to_numpy(), table.column("v").to_numpy())], ["doc_id", "component_id"])

    edges = written(edges, "edges")
    if edges.count() <= few:
        return written(edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(solve, "doc_id bigint, component_id bigint"), "components")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "small")
        now = edges.agg(F.count("*"), F.sum("u"), F.sum("v"), F.countDistinct("u")).first()
        if now == seen or now[0] == now[3] and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        seen = now
    nodes = edges.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "doc_id")
    return nodes.unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id")).distinct())
