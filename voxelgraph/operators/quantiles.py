"""Exact quantiles without gathering the values: counting passes over narrowing ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.memory import written

#: Ranges that a pass counts for each wanted place in a group's order: the most rows that an aggregate holds for it.
BINS = 1024


def quantiles(rows: DataFrame, value: str, fractions: list[float], group: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """(group columns, fraction, quantile): interpolated between the two nearest values, as NumPy does by default; nulls don't count.

    A quantile lies between two places of the sorted values. Each place starts with the range of all values; a pass counts the
    values of its range by `bins` equal parts and goes on with the part that the place falls in, from its least to its greatest value,
    until these are one. A group without values gives no row.
    """
    keys = group or []
    own = written(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v")), "values")
    span = own.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0")
    asked = span.select(*keys, "n", "lo", "hi", F.explode(F.array(*(F.lit(float(f)) for f in fractions))).alias("fraction"))
    asked = asked.withColumn("at", F.col("fraction") * (F.col("n") - 1))
    asked = asked.select(*keys, "fraction", "at", "lo", "hi", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("place"))
    wanted = written(asked.select(*keys, "fraction", "at", "place"), "wanted")
    now = written(asked.select(*keys, "place", "lo", "hi", F.col("place").alias("rest")).distinct(), "ranges")
    found = None
    while True:
        sure = now.where("lo = hi").select(*keys, "place", F.col("lo").alias("v"))
        found = sure if found is None else found.unionByName(sure)
        left = now.where("lo < hi")
        if left.isEmpty():
            break
        ranges = left.select(*keys, "lo", "hi").distinct()  # two places for each fraction and group at most
        met = own.join(ranges, keys) if keys else own.join(F.broadcast(ranges))
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).alias("part")
        counted = met.where("v BETWEEN lo AND hi").groupBy(*keys, "lo", "hi", part).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        counted = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("part")))
        now = left.join(counted, [*keys, "lo", "hi"]).where("rest < upto AND rest >= upto - c")
        now = written(now.select(*keys, "place", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("rest") - (F.col("upto") - F.col("c"))).alias("rest")), "ranges")
    both = wanted.join(found, [*keys, "place"])
    ends = both.groupBy(*keys, "fraction", "at").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return ends.select(*keys, "fraction", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("quantile"))
