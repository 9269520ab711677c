"""Assertions inside a plan: a query with an offender fails and names the first one, whenever its rows are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded(rows: DataFrame, offenders: DataFrame, keys: list[str], what: str) -> DataFrame:
    """rows, unless `offenders` has any: then the plan fails with how many there are and the least by `keys`."""
    worst = offenders.agg(F.count("*").alias("n"), F.min(F.struct(*keys)).alias("first"))
    told = F.concat(F.lit(f"{what}: "), F.col("n").cast("string"), F.lit(", first "), F.to_json("first"))
    guard = worst.select(F.when(F.col("n") > 0, F.raise_error(told).cast("int")).otherwise(F.lit(0)).alias("guard"))  # one row
    return rows.join(F.broadcast(guard)).where("guard = 0").drop("guard")


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], what: str) -> DataFrame:
    """rows with the columns of `table` that stands under their keys; a key that table lacks fails the query."""
    return guarded(rows.join(table, keys), rows.join(table.select(*keys), keys, "left_anti"), keys, what)


def every(rows: DataFrame, condition: str | Column, keys: list[str], what: str) -> DataFrame:
    """rows, all of which must meet the condition (null doesn't)."""
    ok = F.expr(condition) if isinstance(condition, str) else condition
    return guarded(rows, rows.where(~F.coalesce(ok, F.lit(False))), keys, what)


def some(rows: DataFrame, what: str) -> DataFrame:
    """rows, of which there must be one."""
    count = rows.agg(F.count("*").alias("n"))
    guard = count.select(F.when(F.col("n") == 0, F.raise_error(F.lit(what)).cast("int")).otherwise(F.lit(0)).alias("guard"))
    return guard.join(rows, F.lit(True), "left").where("guard = 0").drop("guard")
