"""Skeletons by thinning that keeps the topology.

Voxels join by 26 neighbours, the background by 6. A voxel is simple if its 26 neighbours hold one piece of foreground, and if the
background among the 18 that share a face or an edge with it is one piece as far as it touches the voxel; taking one simple voxel
away changes no component, cavity or tunnel. Voxels of one parity of (z, y, x) are never neighbours, so all simple ones of a parity
go at once with the same result as one by one. A round takes the eight parities in turn, each from the voxels that had a face
to the background when the round began; voxels with one neighbour are ends of lines and stay.

A job makes two rounds: a block with a rim of eight voxels for each, as deep as eight steps can reach, is thinned by one task, and keeps
its own voxels. Rounds end when none takes a voxel away; their number follows half the thickness of the domain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.memory import written
from .blocks import Frame, blockwise
from .grid import CUBE, Shape

#: How far a round reaches, and how many rounds a job makes.
HALO, ROUNDS = 8, 2
_AT = {o: i for i, o in enumerate(CUBE)}


def _touching(places: list[tuple], most: int) -> np.ndarray:
    """For each of the 26 neighbours the bits of those places that differ from it by at most `most` steps, each axis by one."""
    out = np.zeros(len(CUBE), np.uint32)
    for o in places:
        near = [p for p in places if p != o and max(abs(a - b) for a, b in zip(o, p, strict=True)) == 1 and sum(abs(a - b) for a, b in zip(o, p, strict=True)) <= most]
        out[_AT[o]] = sum(1 << _AT[p] for p in near)
    return out


_EDGES = [o for o in CUBE if sum(map(abs, o)) <= 2]
_FACES = np.uint32(sum(1 << _AT[o] for o in CUBE if sum(map(abs, o)) == 1))
_NEAR18 = np.uint32(sum(1 << _AT[o] for o in _EDGES))
_BY26, _BY6 = _touching(CUBE, 3), _touching(_EDGES, 1)


def _one_piece(bits: np.ndarray, asked: np.ndarray, touching: np.ndarray) -> np.ndarray:
    """Whether all `asked` bits (some of `bits`, at least one) are joined through bits."""
    piece = asked & (~asked + np.uint32(1))
    while True:
        grown = piece.copy()
        for i, t in enumerate(touching):
            grown |= np.where(piece >> np.uint32(i) & np.uint32(1), t, np.uint32(0))
        grown &= bits
        if (grown == piece).all():
            return (asked > 0) & (asked & ~piece == 0)
        piece = grown


def simple(bits: np.ndarray) -> np.ndarray:
    """Whether a voxel with these neighbours (bit i for CUBE[i]) can go without a change of topology."""
    kinds, at = np.unique(bits.astype(np.uint32), return_inverse=True)
    empty = ~kinds & _NEAR18
    return (_one_piece(kinds, kinds, _BY26) & _one_piece(empty, empty & _FACES, _BY6))[at]


def _bits(alive: np.ndarray, at: np.ndarray, steps: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint32)
    for i, s in enumerate(steps):
        out |= alive[at + s].astype(np.uint32) << np.uint32(i)
    return out


def _round(alive: np.ndarray, z: np.ndarray, y: np.ndarray, x: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
    """Takes voxels away in place; z, y, x: true coordinates of the voxels at `at` in a flat box of this size."""
    steps = np.array([(o[0] * size[1] + o[1]) * size[2] + o[2] for o in CUBE])
    faces = [steps[i] for i, o in enumerate(CUBE) if sum(map(abs, o)) == 1]
    border = ~np.all([alive[at + s] for s in faces], axis=0)
    parity = z % 2 * 4 + y % 2 * 2 + x % 2
    for k in range(8):
        own = at[border & (parity == k)]
        bits = _bits(alive, own, steps)
        ends = np.bitwise_count(bits) <= 1
        alive[own[~ends & simple(bits)]] = False


def thinned(voxels: DataFrame, shape: Shape, most: int = 1000) -> DataFrame:
    """(vid, z, y, x) of the skeleton of voxels (vid, z, y, x)."""

    def run(frame: Frame, table: pa.Table) -> pa.Table:
        size = np.array(frame.shape) + 2  # and a border of background
        z, y, x = (p - low + 1 for p, low in zip(frame.place, frame.low, strict=True))
        at = (z * size[1] + y) * size[2] + x
        alive = np.zeros(size.prod(), dtype=bool)
        alive[at] = True
        left = alive[at]
        for _ in range(ROUNDS):
            _round(alive, *(p[left] for p in frame.place), at[left], size)
            left = alive[at]
        return table.filter(pa.array(frame.inner & left)).select(["vid", "z", "y", "x"])

    now = written(voxels.select(F.col("vid").cast("bigint").alias("vid"), *(F.col(c).cast("int").alias(c) for c in "zyx")), "thin")
    left = now.count()
    for _ in range(0, most, ROUNDS):
        now = written(blockwise(now, HALO * ROUNDS, run, "vid bigint, z int, y int, x int", shape=shape), "thin")
        before, left = left, now.count()
        if left == before:
            return now
    raise RuntimeError(f"thinning doesn't settle in {most} rounds")


def euler_numbers(voxels: DataFrame) -> DataFrame:
    """(root, euler) of each part (vid, z, y, x, root): corners less edges plus faces less cubes, each counted once."""
    cell = voxels.select("root", *(F.col(c) * 2 + 1 for c in "zyx")).toDF("root", "z", "y", "x")
    offsets = F.array(*(F.struct(*(F.lit(v).alias(f"d{c}") for c, v in zip("zyx", o, strict=True))) for o in [*CUBE, (0, 0, 0)]))
    cell = cell.select("root", "z", "y", "x", F.explode(offsets).alias("o"))
    kind = F.abs("o.dz") + F.abs("o.dy") + F.abs("o.dx")  # 0: cube, 3: corner
    cell = cell.select("root", (F.col("z") + F.col("o.dz")).alias("z"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.when(kind % 2 == 1, 1).otherwise(-1).alias("sign")).distinct()
    return cell.groupBy("root").agg(F.sum("sign").alias("euler"))
