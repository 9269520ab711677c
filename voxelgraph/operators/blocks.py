"""Work on blocks of voxels with a rim around them: what a block's voxels need within `reach` is in its rows, so no pairs are shuffled."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .grid import FACES, Shape

#: Side of a block.
SIDE = 64


class Frame:
    """A block with its rim as a dense box: `at` are the flat places of the rows, `inner` which of them are the block's own."""

    def __init__(self, table: pa.Table, block: tuple[int, int, int], side: int):
        self.place = [table.column(c).to_numpy().astype(np.int64) for c in "zyx"]
        self.low = [int(v.min()) for v in self.place]
        self.shape = tuple(int(v.max()) - low + 1 for v, low in zip(self.place, self.low, strict=True))
        self.inner = np.all([v // side == b for v, b in zip(self.place, block, strict=True)], axis=0)
        self.at = self.flat(*self.place)

    def flat(self, z: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return ((z - self.low[0]) * self.shape[1] + (y - self.low[1])) * self.shape[2] + (x - self.low[2])

    def inside(self, z: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.all([(v >= low) & (v < low + n) for v, low, n in zip((z, y, x), self.low, self.shape, strict=True)], axis=0)

    def dense(self, values: np.ndarray | bool, none: object, at: np.ndarray | None = None) -> np.ndarray:
        out = np.full(self.shape, none)
        out.reshape(-1)[self.at if at is None else at] = values
        return out


def shifted(box: np.ndarray, o: tuple[int, int, int], none: object) -> np.ndarray:
    """What stands at each place plus o; `none` outside the box."""
    out = np.full_like(box, none)
    if all(abs(d) < n for d, n in zip(o, box.shape, strict=True)):
        to = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(o, box.shape, strict=True))
        of = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(o, box.shape, strict=True))
        out[to] = box[of]
    return out


def blockwise(rows: DataFrame, reach: int, run: Callable[[Frame, pa.Table], pa.Table], schema: str, rim: str = "true", side: int = SIDE, shape: Shape | None = None) -> DataFrame:
    """run(frame, rows) of each block; rows (z, y, x, ...) that meet `rim` are also in the rows of every block that they are within
    `reach` of along each axis. A block without rows of its own isn't run; shape: where the domain ends, so that none lies beyond."""
    ship(rows.sparkSession)
    own = rows
    for c in "zyx":
        low, high = F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side)
        low = F.greatest(low, F.lit(0)) if shape else low
        high = F.least(high, F.lit(((shape.height if c == "y" else shape.width) - 1) // side)) if shape and c != "z" else high
        near = F.sequence(low, high)
        own = own.withColumn(f"block_{c}", F.explode(F.when(F.expr(rim), near).otherwise(F.array(F.floor(F.col(c) / side)))))
    empty = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in schema.split(", "))])

    def part(key: tuple, table: pa.Table) -> pa.Table:
        frame = Frame(table, tuple(k.as_py() for k in key), side)
        return run(frame, table).cast(empty) if frame.inner.any() else empty.empty_table()

    return own.groupBy(*(f"block_{c}" for c in "zyx")).applyInArrow(part, schema)


def exposed(voxels: DataFrame, shape: Shape) -> DataFrame:
    """(z, y, x, dz, dy, dx): faces of voxels (z, y, x) whose other side is none of them, as of grid.exposed, without a row for each
    neighbour."""

    def run(frame: Frame, _: pa.Table) -> pa.Table:
        box, own = frame.dense(True, False), frame.dense(True, False, frame.at[frame.inner])
        parts = []
        for o in FACES:
            at = np.argwhere(own & ~shifted(box, o, False)) + np.array(frame.low)
            parts.append(np.column_stack((at, np.tile(np.array(o), (len(at), 1)))))
        return pa.table(list(np.concatenate(parts).T), ["z", "y", "x", "dz", "dy", "dx"])

    return blockwise(voxels.select("z", "y", "x"), 1, run, "z int, y int, x int, dz int, dy int, dx int", shape=shape)
