"""Voxel domains as DataFrames: (vid, z, y, x, pore, ...), vid = (z * H + y) * W + x."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACES = [(0, 0, -1), (0, 0, 1), (0, -1, 0), (0, 1, 0), (-1, 0, 0), (1, 0, 0)]
FORWARD = [(0, 0, 1), (0, 1, 0), (1, 0, 0)]
CUBE = [(z, y, x) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (z, y, x) != (0, 0, 0)]


@dataclass(frozen=True)
class Shape:
    height: int
    width: int
    depth: int | None = None


ORDERS = Shape(30, 50)


def with_coordinates(df: DataFrame, shape: Shape, vid: str = "vid") -> DataFrame:
    """Adds z, y, x decoded from the flat id."""
    v = F.col(vid)
    return df.withColumns({"z": F.floor(v / (shape.height * shape.width)).cast("int"), "y": (F.floor(v / shape.width) % shape.height).cast("int"), "x": (v % shape.width).cast("int")})


def flat(z: Column, y: Column, x: Column, shape: Shape) -> Column:
    return ((z.cast("bigint") * shape.height + y) * shape.width + x).cast("bigint")


def index_grid(spark: SparkSession, depth: int, shape: Shape) -> DataFrame:
    return with_coordinates(spark.range(depth * shape.height * shape.width).withColumnRenamed("id", "vid"), shape)


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table-derived domain: o_orderkey is the flat id; two thirds of the voxels are pore."""
    own = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("vid"), (F.col("o_orderstatus") != "P").alias("pore"), F.col("o_totalprice").alias("val"))
    return with_coordinates(own, ORDERS)


def sites_of(voxels: DataFrame) -> DataFrame:
    """(site_id, vid, z, y, x): pore voxels with vid % 97 = 13, numbered in order of vid.

    Numbers come from counts by block of ids, so that only one row for each block meets in one place.
    """
    from pyspark.sql import Window

    own = voxels.where("pore AND vid % 97 = 13").withColumn("block", F.floor(F.col("vid") / 100_000))
    counts = own.groupBy("block").count()
    base = counts.select("block", F.coalesce(F.sum("count").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("block").orderBy("vid")) - 1
    return own.withColumn("rank", rank).join(base, "block").select((F.col("base") + F.col("rank")).cast("int").alias("site_id"), "vid", "z", "y", "x")


def neighbours(left: DataFrame, right: DataFrame, offsets: list[tuple], shape: Shape, periodic_x: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(vid, nb, dz, dy, dx, columns of `keep` for both ends as name and nb_name): an equi-join on shifted ids.

    Rows of `left` with their neighbours in `right`; y and x never wrap, but for x if periodic_x.
    """
    moves = F.array(*(F.struct(F.lit(o[0]).alias("dz"), F.lit(o[1]).alias("dy"), F.lit(o[2]).alias("dx")) for o in offsets))
    a = left.select("vid", "z", "y", "x", *keep, F.explode(moves).alias("o")).select("vid", "z", "y", "x", *keep, "o.*")
    y, x = F.col("y") + F.col("dy"), F.col("x") + F.col("dx")
    x = F.pmod(x, F.lit(shape.width)) if periodic_x else x
    a = a.where((y >= 0) & (y < shape.height) & (x >= 0) & (x < shape.width) & (F.col("z") + F.col("dz") >= 0)).withColumn("nb", flat(F.col("z") + F.col("dz"), y, x, shape))
    b = right.select(F.col("vid").alias("nb"), *(F.col(c).alias(f"nb_{c}") for c in keep))
    return a.join(b, "nb").select("vid", "nb", "dz", "dy", "dx", *keep, *(f"nb_{c}" for c in keep))


def exposed(left: DataFrame, right: DataFrame, offsets: list[tuple], shape: Shape) -> DataFrame:
    """(vid, dz, dy, dx): faces of `left` whose other side isn't in `right`; the domain's border counts as exposed."""
    moves = F.array(*(F.struct(F.lit(o[0]).alias("dz"), F.lit(o[1]).alias("dy"), F.lit(o[2]).alias("dx")) for o in offsets))
    a = left.select("vid", "z", "y", "x", F.explode(moves).alias("o")).select("vid", "z", "y", "x", "o.*")
    y, x, z = F.col("y") + F.col("dy"), F.col("x") + F.col("dx"), F.col("z") + F.col("dz")
    inside = (y >= 0) & (y < shape.height) & (x >= 0) & (x < shape.width) & (z >= 0)
    a = a.withColumn("nb", F.when(inside, flat(z, y, x, shape)).otherwise(F.lit(-1)))
    return a.join(right.select(F.col("vid").alias("nb")), "nb", "left_anti").select("vid", "dz", "dy", "dx")
