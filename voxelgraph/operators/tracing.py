"""Lines that run downhill on a voxel field until they reach the outlet.

The field is written once as tiles with a rim of one voxel. A line walks inside a tile as far as it goes, in one task with the other
lines that stand there, and is handed over where it leaves the tile: there is a job for each tile that the longest line crosses,
not for each of its steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..plans.memory import written
from .grid import Shape

TILE = 32
#: Steps in the order that decides between equal scores; a fixed value.
ORDER = [(0, 0, 1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0), (0, 0, -1)]
LINES = "line_id bigint, path array<bigint>, state string"


def field_tiles(voxels: DataFrame, value: str) -> DataFrame:
    """(tz, ty, tx, blob): the values of a tile's voxels and its rim, a cube of doubles with NaN where there is none."""
    n = TILE + 2

    def frame(table: pa.Table) -> pa.Table:
        t = [int(table.column(f"t{c}")[0].as_py()) for c in "zyx"]
        z, y, x = (table.column(c).to_numpy().astype(np.int64) - k * TILE + 1 for c, k in zip("zyx", t, strict=True))
        out = np.full(n**3, np.nan)
        out[(z * n + y) * n + x] = table.column("v").to_numpy()
        return pa.table([pa.array([k], pa.int32()) for k in t] + [pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], ["tz", "ty", "tx", "blob"])

    own = voxels.select("z", "y", "x", F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    for c in "zyx":
        own = own.withColumn(f"t{c}", F.explode(F.sequence(F.floor((F.col(c) - 1) / TILE).cast("int"), F.floor((F.col(c) + 1) / TILE).cast("int"))))
    return written(own.groupBy("tz", "ty", "tx").applyInArrow(frame, "tz int, ty int, tx int, blob binary"), "field-tiles")


def streamlines(starts: DataFrame, voxels: DataFrame, value: str, shape: Shape, steps: int = 1600, bias: float = 0.015, slack: float = 0.02, outlet: float = 0.02, least: int = 1) -> DataFrame:
    """(line_id, seq, vid, state): lines from (line_id, vid) over voxels (vid, z, y, x, value).

    A line goes on to the unvisited face neighbour with the least value less bias * dx, the first of ORDER on ties. It ends `reached`
    where x is in the last two planes or the value is `outlet` or less, `stuck` where no neighbour is left, `rises` where the next
    value is higher by more than slack, `long` after `steps` steps. Lines of fewer than `least` voxels are left out.
    """
    spark = voxels.sparkSession
    ship(spark)
    tiles = field_tiles(voxels, value)
    n, plane = TILE + 2, shape.height * shape.width

    def walk(path: list[int], field: np.ndarray, corner: list[int]) -> str:
        visited = set(path)
        while True:
            z, rest = divmod(path[-1], plane)
            y, x = divmod(rest, shape.width)
            at = [v - c for v, c in zip((z, y, x), corner, strict=True)]
            if not all(1 <= a <= TILE for a in at):
                return "on"
            here = field[tuple(at)]
            if x >= shape.width - 2 or here <= outlet:
                return "reached"
            if len(path) > steps:
                return "long"
            best = None
            for dz, dy, dx in ORDER:
                there = field[at[0] + dz, at[1] + dy, at[2] + dx]
                to = path[-1] + dz * plane + dy * shape.width + dx
                if there == there and to not in visited and 0 <= y + dy < shape.height and 0 <= x + dx < shape.width and (best is None or there - bias * dx < best[0]):
                    best = (there - bias * dx, to, there)
            if best is None:
                return "stuck"
            if best[2] > here + slack:
                return "rises"
            path.append(best[1])
            visited.add(best[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tz, ty, tx, blob, lines in zip(*(batch.column(c).to_pylist() for c in ("tz", "ty", "tx", "blob", "lines")), strict=True):
                field = np.frombuffer(zlib.decompress(blob)).reshape(n, n, n)
                paths = [list(line["path"]) for line in lines]
                states = [walk(p, field, [tz * TILE - 1, ty * TILE - 1, tx * TILE - 1]) for p in paths]
                yield pa.RecordBatch.from_arrays([pa.array([line["line_id"] for line in lines], pa.int64()), pa.array(paths, pa.list_(pa.int64())), pa.array(states)], ["line_id", "path", "state"])

    salt = F.pmod(F.xxhash64("line_id"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))  # a tile with many lines is walked by many tasks
    now = starts.join(voxels.where(F.col(value).isNotNull()).select("vid"), "vid", "left_semi").select(F.col("line_id").cast("bigint").alias("line_id"), F.array(F.col("vid").cast("bigint")).alias("path"), F.lit("on").alias("state"))
    done = None
    for _ in range(steps + 1):
        last = F.element_at("path", -1)
        place = [F.floor(v / TILE).cast("int").alias(f"t{c}") for c, v in (("z", F.floor(last / plane)), ("y", F.floor(last / shape.width) % shape.height), ("x", last % shape.width))]
        here = now.select("line_id", "path", *place, salt.alias("salt")).groupBy("tz", "ty", "tx", "salt").agg(F.collect_list(F.struct("line_id", "path")).alias("lines"))
        moved = written(tiles.join(here, ["tz", "ty", "tx"]).select("tz", "ty", "tx", "blob", "lines").mapInArrow(run, LINES), "walked")
        ended = moved.where("state <> 'on'")
        done = ended if done is None else done.unionByName(ended)
        now = moved.where("state = 'on'")
        if now.isEmpty():
            break
    return done.where(F.size("path") >= least).select("line_id", "state", F.posexplode("path").alias("seq", "vid"))
