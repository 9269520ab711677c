"""Geometry of cells and faces for finite volumes: volumes, centroids, area vectors, geodesic metric, walls.

Lengths are in voxels of edge h. Vectors are (x, y, z); a face's area vector points from the lesser label to the greater.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import FACES, Shape, exposed

SMALL, TINY = 1e-12, 1e-300


def cells(voxels: DataFrame, h: float = 1.0) -> DataFrame:
    """(cell, volume, cx, cy, cz) of vid, z, y, x, cell."""
    middle = (F.avg((F.col(c) + 0.5) * h).alias(f"c{c}") for c in "xyz")
    return voxels.groupBy("cell").agg((F.count("*") * h**3).alias("volume"), *middle)


def face_vectors(facelets: DataFrame, voxels: DataFrame, h: float = 1.0) -> DataFrame:
    """(owner, neighbor, area, ax, ay, az, fx, fy, fz, r_owner, r_neigh): sums of voxel faces by pair, face centres, and
    area-weighted distances from the sites to the face."""
    own = facelets.join(voxels.select("vid", "z", "y", "x"), "vid")
    side = {"x": 2, "y": 1, "z": 0}
    vector = (F.sum(F.when(F.col("axis") == k, F.col("sign")).otherwise(0) * h * h).alias(f"a{c}") for c, k in side.items())
    centre = (F.avg((F.col(c) + F.when(F.col("axis") == k, 1.0).otherwise(0.5)) * h).alias(f"f{c}") for c, k in side.items())
    lengths = ((F.avg(f"r_{a}2") * h / 2).alias(b) for a, b in (("owner", "r_owner"), ("neighbor", "r_neigh")))
    return own.groupBy("owner", "neighbor").agg((F.count("*") * h * h).alias("area"), *vector, *centre, *lengths)


def geodesic_metric(faces: DataFrame, cells: DataFrame, floor: float = 1e-12) -> DataFrame:
    """faces with ell, w_owner, w_neigh, t and dvec (dx, dy, dz): the direction between centroids, of length ell."""
    a, b = (cells.select(F.col("cell").alias(n), *(F.col(f"c{c}").alias(f"{n[0]}{c}") for c in "xyz")) for n in ("owner", "neighbor"))
    own = faces.join(a, "owner").join(b, "neighbor").withColumn("ell", F.greatest(F.col("r_owner") + F.col("r_neigh"), F.lit(SMALL)))
    norm = F.greatest(F.sqrt(sum((F.col(f"n{c}") - F.col(f"o{c}")) ** 2 for c in "xyz")), F.lit(SMALL))
    own = own.withColumns({f"d{c}": (F.col(f"n{c}") - F.col(f"o{c}")) * F.col("ell") / norm for c in "xyz"})
    own = own.withColumns({"w_owner": F.col("r_neigh") / F.col("ell"), "w_neigh": F.col("r_owner") / F.col("ell"), "t": F.greatest(F.greatest(F.col("area"), F.lit(TINY)) / F.col("ell"), F.lit(floor))})
    return own.drop(*(f"{n}{c}" for n in "on" for c in "xyz"))


def wall_transmissibility(voxels: DataFrame, pore: DataFrame, centroids: DataFrame, shape: Shape, depth: int, h: float = 1.0, floor: float = 0.25, periodic_x: bool = False) -> DataFrame:
    """(cell, twall): sum over wall faces of h^2 / max((face centre - centroid) . normal, floor h)."""
    faces = exposed(voxels, pore, FACES, shape)
    if periodic_x:
        faces = faces.join(voxels.select("vid", "x"), "vid").where(f"NOT (x = 0 AND dx = -1 OR x = {shape.width - 1} AND dx = 1)").drop("x")
    own = faces.join(voxels.select("vid", "z", "y", "x", "cell"), "vid").join(centroids, "cell")
    away = sum(F.col(f"d{c}") * ((F.col(c) + 0.5 + 0.5 * F.col(f"d{c}")) * h - F.col(f"c{c}")) for c in "xyz")
    return own.groupBy("cell").agg(F.sum(h * h / F.greatest(away, F.lit(floor * h))).alias("twall"))


def lsq_gradient(metric: DataFrame, values: DataFrame, tikhonov: float = 1e-12) -> DataFrame:
    """(cell, mxx, mxy, mxz, myy, myz, mzz, gx, gy, gz): the weighted normal matrix of each cell (weights t, directions dvec,
    tikhonov on the diagonal) and the gradient of `values` (cell, v) by its closed-form inverse."""
    a, b = (values.select(F.col("cell").alias(n), F.col("v").alias(f"v{n[0]}")) for n in ("owner", "neighbor"))
    own = metric.join(a, "owner").join(b, "neighbor").withColumn("dv", F.col("vn") - F.col("vo"))
    both = own.withColumn("cell", F.explode(F.array("owner", "neighbor")))  # directions and differences change sign together
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    m = both.groupBy("cell").agg(*((F.sum(F.col("t") * F.col(f"d{i}") * F.col(f"d{j}")) + (tikhonov if i == j else 0.0)).alias(f"m{i}{j}") for i, j in pairs), *(F.sum(F.col("t") * F.col(f"d{i}") * F.col("dv")).alias(f"b{i}") for i in "xyz"))
    a, b, c, d, e, f = (F.col(f"m{i}{j}") for i, j in pairs)
    det = a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)
    m = m.withColumn("det", F.when(F.abs(det) > TINY, det).otherwise(F.signum(det + TINY) * TINY))
    inverse = {"xx": d * f - e * e, "xy": c * e - b * f, "xz": b * e - c * d, "yy": a * f - c * c, "yz": b * c - a * e, "zz": a * d - b * b}
    at = lambda i, j: inverse["".join(sorted(i + j))]
    m = m.withColumns({f"g{i}": sum(at(i, j) * F.col(f"b{j}") for j in "xyz") / F.col("det") for i in "xyz"})
    return m.drop("det", "bx", "by", "bz")
