"""Bridges between the parts of planar masks: closest pairs of neighbouring parts, and thick lines along them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.memory import written
from ..plans.relaxation import rooted
from .grid import Shape, flat
from .search import nearest

#: The four steps inside a plane.
PLANE = [(0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]


def plane_parts(mask: DataFrame, shape: Shape, least: int) -> DataFrame:
    """(vid, z, y, x, root) of the parts of each plane z with `least` voxels or more."""
    own = mask.join(rooted(mask, PLANE, shape), "vid").select("vid", "z", "y", "x", "root")
    large = own.groupBy("root").count().where(F.col("count") >= least).select("root")
    return own.join(large, "root", "left_semi").select("vid", "z", "y", "x", "root")


def closest_pairs(parts: DataFrame, cell: int = 4) -> DataFrame:
    """(z, left, right, d2, a, b): parts in order of their mean x (then their root), and the closest voxels of each with the next in its
    plane: least distance, then least a, then least b. Found by cells of a lattice, exact for parts of any size."""
    middle = parts.groupBy("z", "root").agg(F.avg("x").alias("cx"))
    chain = middle.withColumn("next", F.lead("root").over(Window.partitionBy("z").orderBy("cx", "root"))).where("next IS NOT NULL")
    chain = written(chain.select("root", "next"), "chain")
    points = parts.join(chain, "root").select(F.col("vid").alias("pid"), "z", "y", "x", F.col("root").alias("pair"))
    sites = parts.join(chain.select(F.col("root").alias("pair"), F.col("next").alias("root")), "root").select(F.col("vid").alias("sid"), "z", "y", "x", "pair")
    near = nearest(points, sites, "d2", cell, "pair").join(points.select("pid", "pair", "z"), "pid").join(chain.withColumnRenamed("root", "pair"), "pair")
    best = near.groupBy("z", "pair", "next").agg(F.min(F.struct("dist", "pid", "sid")).alias("b"))
    return best.select("z", F.col("pair").alias("left"), F.col("next").alias("right"), F.col("b.dist").cast("bigint").alias("d2"), F.col("b.pid").alias("a"), F.col("b.sid").alias("b"))


def thick_lines(ends: DataFrame, shape: Shape, radius: int) -> DataFrame:
    """(vid, z, y, x) of disks along the lines of ends (z, y0, x0, y1, x1): as many points as the longer side, rounded to even at halves."""
    n = F.greatest(F.abs(F.col("y1") - F.col("y0")), F.abs(F.col("x1") - F.col("x0")), F.lit(1))
    own = ends.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("t"))
    at = [F.rint(F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * (F.col("t") / F.col("n"))).cast("int").alias(f"{c}c") for c in "yx"]
    disk = F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius))
    own = own.select("z", *at).distinct().select("z", "yc", "xc", F.explode(disk).alias("o")).select("z", (F.col("yc") + F.col("o.dy")).alias("y"), (F.col("xc") + F.col("o.dx")).alias("x"))
    own = own.where((F.col("y") >= 0) & (F.col("y") < shape.height) & (F.col("x") >= 0) & (F.col("x") < shape.width)).distinct()
    return own.select(flat(F.col("z"), F.col("y"), F.col("x"), shape).alias("vid"), "z", "y", "x")


def bridged(mask: DataFrame, shape: Shape, radius: int = 5, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """The mask (vid, z, y, x) with thick lines between neighbouring parts, and the closest pairs: the parts of a plane with `least`
    voxels or more are one part then."""
    pairs = written(closest_pairs(written(plane_parts(mask, shape, least), "plane-parts")), "closest")
    place = lambda c, n: (F.floor(F.col(c) / shape.width) % shape.height).cast("int").alias(f"y{n}"), lambda c, n: (F.col(c) % shape.width).cast("int").alias(f"x{n}")
    ends = pairs.select("z", *(f(c, n) for c, n in (("a", 0), ("b", 1)) for f in place))
    return written(mask.select("vid", "z", "y", "x").unionByName(thick_lines(ends, shape, radius)).distinct(), "bridged"), pairs
