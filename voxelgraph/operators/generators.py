"""Procedural masks and seeds as voxel tables, literal fixtures, case catalogues."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.memory import written
from .grid import Shape, flat, index_grid, neighbours

#: Deterministic stand-in for a random order of voxels.
def shuffled(vid: str = "vid") -> Column:
    return (F.col(vid) * 7919 + 13) % 10007


def least_by_hash(voxels: DataFrame, n: int) -> DataFrame:
    return voxels.orderBy(shuffled(), "vid").limit(n)


def thin_wall(spark: SparkSession, depth: int, shape: Shape, thickness: int = 2, wall_x: int | None = None, gate: tuple[int, int] = (12, 12), centre: tuple[int, int] | None = None) -> tuple[DataFrame, int, int]:
    """(vid, z, y, x, pore) of a box with a wall across x and one gate (sizes and centre in z, y), and the wall's ends [x0, x1)."""
    h, w = shape.height, shape.width
    if thickness < 1 or thickness >= w - 2 or min(gate) < 1:
        raise ValueError("the wall must leave room on both sides, and the gate be open")
    x0 = max(1, min(w - thickness - 1, (w // 2 if wall_x is None else wall_x) - thickness // 2))
    x1 = x0 + thickness
    (zc, yc), (gz, gy) = centre or (depth // 2, h // 2), (min(gate[0], depth), min(gate[1], h))
    z0, y0 = max(0, zc - gz // 2), max(0, yc - gy // 2)
    solid = f"x >= {x0} AND x < {x1} AND NOT (z >= {z0} AND z < {min(depth, z0 + gz)} AND y >= {y0} AND y < {min(h, y0 + gy)})"
    return index_grid(spark, depth, shape).withColumn("pore", ~F.expr(solid)), x0, x1


def wall_seeds(pore: DataFrame, x0: int, x1: int, width: int, n: int, mode: str, margin: int = 4, band: int = 4) -> DataFrame:
    """n seeds: random anywhere, two_sides_random (at least `margin` from the wall, half on each side) or two_sides_near_wall."""
    if mode == "random":
        return least_by_hash(pore, n)
    if mode not in ("two_sides_random", "balanced", "two_sides_near_wall", "near_wall"):
        raise ValueError(f"unknown seed mode {mode}")
    far = mode in ("two_sides_random", "balanced")
    left = f"x <= {x0 - 1 - margin}" if far else f"x >= {max(0, x0 - band)} AND x < {x0}"
    right = f"x >= {x1 + margin}" if far else f"x >= {x1} AND x <= {min(width - 1, x1 + band - 1)}"
    sides = [least_by_hash(pore.where(s), k) for s, k in ((left, n // 2), (right, n - n // 2))]
    for side, k in zip(sides, (n // 2, n - n // 2), strict=True):
        if side.count() < k:
            raise ValueError("not enough room for the seeds of a side")
    return sides[0].unionByName(sides[1])


def channel(spark: SparkSession, depth: int, shape: Shape, length: float = 3.6, widest: float = 1.0, narrowest: float = 0.4, cycles: int = 3) -> DataFrame:
    """(vid, z, y, x) within a round channel whose width swings along x."""
    place = lambda c, n: ((F.col(c) + 0.5) / n - 0.5) * widest
    across = F.sqrt(place("y", shape.height) ** 2 + place("z", depth) ** 2)
    at = (F.col("x") + 0.5) / shape.width * length
    width = 0.5 * (widest + narrowest) + 0.5 * (widest - narrowest) * F.sin(2 * math.pi * cycles * at / length)
    return index_grid(spark, depth, shape).where(across <= 0.5 * width)


def centre_seeds(pore: DataFrame, depth: int, shape: Shape, n: int) -> DataFrame:
    """n seeds along the centre line, each moved to the first pore voxel within two steps in z and y where it stands in solid."""
    spark = pore.sparkSession
    xs = [round((0.1 + 0.8 * k / max(n - 1, 1)) * (shape.width - 1)) for k in range(n)]
    shifts = [(0, 0), *((dz, dy) for dz in range(-2, 3) for dy in range(-2, 3))]
    asked = spark.createDataFrame([(k, r, min(max(depth // 2 + dz, 0), depth - 1), min(max(shape.height // 2 + dy, 0), shape.height - 1), x) for k, x in enumerate(xs) for r, (dz, dy) in enumerate(shifts)], "k int, r int, z int, y int, x int")
    met = asked.withColumn("vid", flat(F.col("z"), F.col("y"), F.col("x"), shape)).join(pore.select("vid"), "vid")
    out = met.groupBy("k").agg(F.min_by("vid", "r").alias("vid"))
    if out.count() < n:
        raise RuntimeError("no pore voxel near the centre line")
    return out


def extruded(mask: DataFrame, depth: int, shear: int, width: int) -> DataFrame:
    """(z, y, x) of a plane mask (y, x) repeated in depth, shifted along x by rint((z / (depth - 1) - 1/2) shear); nothing wraps."""
    own = mask.select("y", "x", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("z"))
    own = own.withColumn("x", (F.col("x") + F.rint((F.col("z") / max(depth - 1, 1) - 0.5) * shear)).cast("int"))
    return own.where((F.col("x") >= 0) & (F.col("x") < width)).select("z", "y", "x")


def resized(mask: DataFrame, before: tuple[int, int], after: tuple[int, int], depth: int) -> DataFrame:
    """(z, y, x, pore): a plane mask (y, x, pore) at another size by nearest neighbours (ends on ends), repeated in depth."""
    own = mask.sparkSession.range(after[0] * after[1]).select(F.floor(F.col("id") / after[1]).cast("int").alias("ty"), (F.col("id") % after[1]).cast("int").alias("tx"))
    source = [F.floor(F.col(t) * (b - 1) / max(a - 1, 1) + 0.5).cast("int").alias(c) for t, c, b, a in (("ty", "y", before[0], after[0]), ("tx", "x", before[1], after[1]))]
    own = own.select("ty", "tx", *source).join(mask.select("y", "x", "pore"), ["y", "x"])
    return own.select(F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("z"), F.col("ty").alias("y"), F.col("tx").alias("x"), "pore")


def smoothed(values: DataFrame, shape: Shape, passes: int = 6) -> DataFrame:
    """(vid, z, y, x, val): each pass takes the mean of a voxel and its four neighbours in the plane, across both ends."""
    moves = F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))))
    own = values.select("z", "y", "x", "val")
    for _ in range(passes):
        spread = own.select("z", "y", "x", "val", F.explode(moves).alias("o"))
        own = spread.groupBy("z", F.pmod(F.col("y") + F.col("o.dy"), F.lit(shape.height)).alias("y"), F.pmod(F.col("x") + F.col("o.dx"), F.lit(shape.width)).alias("x")).agg((F.sum("val") / 5).alias("val"))
        own = written(own, "smooth")
    return own.select(flat(F.col("z"), F.col("y"), F.col("x"), shape).alias("vid"), "z", "y", "x", "val")


def texture(values: DataFrame, shape: Shape, passes: int = 6, share: float = 0.35) -> DataFrame:
    """(vid, top): the highest `share` of each smoothed plane."""
    own = smoothed(values, shape, passes)
    edge = own.groupBy("z").agg(F.percentile("val", 1 - share).alias("edge"))
    return own.join(F.broadcast(edge), "z").select("vid", (F.col("val") > F.col("edge")).alias("top"))


#: Small masks: shape, solid boxes (z, y, x ranges) and boxes opened again; fixed values.
FIXTURES = {
    "plane": (Shape(12, 18, 1), [((0, 1), (2, 10), (8, 10)), ((0, 1), (0, 2), (3, 6)), ((0, 1), (9, 12), (13, 16))], [((0, 1), (5, 7), (8, 10))]),
    "block": (Shape(8, 11, 6), [((0, 6), (1, 7), (5, 6)), ((0, 2), (0, 3), (2, 4)), ((4, 6), (5, 8), (8, 10))], [((2, 4), (3, 5), (5, 6))]),
    "graph": (Shape(8, 11, 1), [((0, 1), (4, 7), (4, 5)), ((0, 1), (0, 1), (7, 9)), ((0, 1), (1, 2), (8, 9))], []),
}


def fixture(spark: SparkSession, name: str) -> DataFrame:
    """(vid, z, y, x, pore) of a small literal mask."""
    shape, solid, opened = FIXTURES[name]
    inside = lambda box: " AND ".join(f"{c} >= {a} AND {c} < {b}" for c, (a, b) in zip("zyx", box, strict=True))
    closed = " OR ".join(f"({inside(b)})" for b in solid)
    again = " OR ".join(f"({inside(b)})" for b in opened) or "false"
    return index_grid(spark, shape.depth, shape).withColumn("pore", ~F.expr(closed) | F.expr(again))


#: Cases of the catalogue: name, name in print, kind of mask, number of the stride list; fixed values.
CASES = [("orthogonal_duct", "Orthogonal duct", "procedural", 0), ("skewed_duct", "Skewed duct", "procedural", 0), ("A_thin_wall", "Thin-wall synthetic", "procedural", 0), ("B_narrow_throat", "Narrow-throat synthetic", "procedural", 0), ("C_maze", "Maze synthetic", "procedural", 0), ("bentheimer_sandstone_crop", "Bentheimer segmented sandstone crop", "npz_mask", 1), ("fibrous_filter_proxy", "Fibrous filter proxy", "npz_mask", 1)]
PROXY_STRIDES = [(4, 8, 8), (2, 6, 6), (2, 4, 4)]


def cases(spark: SparkSession, strides: list[tuple[int, int, int]]) -> DataFrame:
    """(case_name, paper_case, mask_kind, rank, sz, sy, sx): every case with its strides; `strides` are the procedural ones'."""
    rows = [(name, paper, kind, rank, *s) for name, paper, kind, which in CASES for rank, s in enumerate((strides, PROXY_STRIDES)[which])]
    return spark.createDataFrame(rows, "case_name string, paper_case string, mask_kind string, rank int, sz int, sy int, sx int")


def chosen(catalogue: DataFrame, names: list[str], first: int | None = None, ranks: list[int] | None = None) -> DataFrame:
    """Cases by name or name in print, their first strides or those of given ranks; raises if none is left."""
    out = catalogue.where(F.col("case_name").isin(names) | F.col("paper_case").isin(names))
    out = out.where(F.col("rank") < first) if first is not None else out
    out = out.where(F.col("rank").isin(ranks)) if ranks is not None else out
    if out.isEmpty():
        raise ValueError(f"no case among {names}")
    return out


def lattice(pore: DataFrame, stride: tuple[int, int, int], family: str = "stride_half_admissible", required: bool = True) -> DataFrame:
    """(vid, z, y, x, lz, ly, lx) of pore voxels on a lattice: from half a stride on, or from the origin; raises for other
    families and, if required, where none is left."""
    family = family.lower()
    if family not in ("stride_half_admissible", "stride_offset_origin"):
        raise ValueError(f"unknown seed family {family}")
    offset = [s // 2 if family == "stride_half_admissible" else 0 for s in stride]
    out = pore.where(" AND ".join(f"{c} >= {o} AND ({c} - {o}) % {s} = 0" for c, o, s in zip("zyx", offset, stride, strict=True)))
    out = out.select("vid", "z", "y", "x", *(F.floor((F.col(c) - o) / s).cast("int").alias(f"l{c}") for c, o, s in zip("zyx", offset, stride, strict=True)))
    if required and out.isEmpty():
        raise RuntimeError(f"no seed of family {family} for stride {stride}")
    return out


def blocks_demo(spark: SparkSession) -> DataFrame:
    """(vid, z, y, x, cell, d): two blocks of 3 x 3 x 3 side by side."""
    return index_grid(spark, 3, Shape(3, 6)).withColumn("cell", (F.col("x") >= 3).cast("int")).withColumn("d", F.lit(0))


def surface(voxels: DataFrame, shape: Shape) -> DataFrame:
    """(vid, dz, dy, dx, nb_cell): faces of cells to nothing (null) or to another cell, from either side."""
    from .grid import FACES, exposed

    inner = neighbours(voxels, voxels, FACES, shape, keep=("cell",)).where("cell <> nb_cell").select("vid", "dz", "dy", "dx", "nb_cell")
    return exposed(voxels, voxels, FACES, shape).withColumn("nb_cell", F.lit(None).cast("int")).unionByName(inner)


def maze_edges(rows: int, columns: int, loops: float = 0.0, seed: int = 0) -> list[tuple[int, int]]:
    """Open walls (a, b), a < b, of a maze on rows x columns rooms: a depth-first walk that turns at random, which reaches
    every room, and each other wall opened with probability `loops`. A plan of rooms, so it is made on the driver."""
    rng = random.Random(seed)

    def around(room: int) -> list[int]:
        i, j = divmod(room, columns)
        return [a * columns + b for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)) if 0 <= a < rows and 0 <= b < columns]

    path = [rng.randrange(rows * columns)]
    seen, opened = set(path), set()
    while path:
        free = [r for r in around(path[-1]) if r not in seen]
        if free:
            room = rng.choice(free)
            opened.add((min(path[-1], room), max(path[-1], room)))
            seen.add(room)
            path.append(room)
        else:
            path.pop()
    walls = [(a, b) for a in range(rows * columns) for b in around(a) if a < b and (a, b) not in opened]
    return sorted(opened | {w for w in walls if rng.random() < loops})


def maze(spark: SparkSession, depth: int, shape: Shape, corridor: int = 3, wall: int = 2, loops: float = 0.05, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Pore voxels (vid, z, y, x) of a maze in (z, x), the same at every y within a shell of solid, and its rooms' centres (room,
    z, y, x). Rooms and openings are boxes; each is dealt out as its voxels, so that no voxel is held against every box."""
    rooms = [range(wall + corridor // 2, n - wall - (corridor - corridor // 2 - 1), corridor + wall) for n in (depth, shape.width)]
    if corridor < 1 or wall < 1 or min(map(len, rooms)) < 2 or shape.height - 2 * wall < 2:
        raise ValueError("no room for a maze")
    columns = len(rooms[1])
    at = lambda room: (rooms[0][room // columns] - corridor // 2, rooms[1][room % columns] - corridor // 2)
    boxes = [(*at(r), corridor, corridor) for r in range(len(rooms[0]) * columns)]
    for a, b in maze_edges(len(rooms[0]), columns, loops, seed):
        (z, x), (z2, x2) = at(a), at(b)
        boxes.append((z, x, z2 - z + corridor, x2 - x + corridor))
    own = spark.createDataFrame(boxes, "z0 int, x0 int, nz int, nx int")
    span = lambda a, n: F.explode(F.sequence(a, a + n - 1))
    own = own.select("x0", "nx", span(F.col("z0"), F.col("nz")).alias("z")).select("z", span(F.col("x0"), F.col("nx")).alias("x")).distinct()
    own = own.select("z", F.explode(F.sequence(F.lit(wall), F.lit(shape.height - wall - 1))).alias("y"), "x")
    middle = shape.height // 2
    centres = spark.createDataFrame([(r, rooms[0][r // columns], middle, rooms[1][r % columns]) for r in range(len(rooms[0]) * columns)], "room int, z int, y int, x int")
    return own.select(flat(F.col("z"), F.col("y"), F.col("x"), shape).alias("vid"), "z", "y", "x"), centres


def spaced_rooms(rows: int, columns: int, n: int, apart: int, seed: int = 0) -> list[int]:
    """n rooms in random order, each at least `apart` rooms from those before; raises if they can't be placed."""
    order = list(range(rows * columns))
    random.Random(seed).shuffle(order)
    out: list[int] = []
    for room in order:
        if len(out) < n and all((room // columns - r // columns) ** 2 + (room % columns - r % columns) ** 2 >= apart * apart for r in out):
            out.append(room)
    if len(out) < n:
        raise ValueError(f"only {len(out)} of {n} rooms are {apart} apart")
    return out
