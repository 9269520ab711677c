"""Fixpoints on voxel graphs by tile-blocked supersteps.

The grid is cut into tiles of TILE**3 voxels, one row each: a blob with the states of its voxels. A superstep runs only the
tiles that got a message, relaxes each in NumPy to its own fixpoint by a frontier of changed voxels, and sends what changed
on its rim to the tiles around it. Only the tiles that ran are written, each superstep in a folder of its own; which folder has a tile's
newest state is noted by tile number in the driver (one number for up to TILE**3 voxels). Supersteps end when no message is left.
Their number follows the tiles that a path crosses, a task holds one tile, and rims and the tiles that run are shuffled. States are
(distance, label), the lesser is better, compared within EPS for weighted distances.

Components need no supersteps: each tile finds its own by pointer jumping, faces between tiles give pairs of roots, and the
pairs are contracted, in one task while there are few (counted), by large and small stars beyond that.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..operators.grid import Shape, neighbours
from .memory import folder, written

TILE, EPS, FAR = 32, 1e-9, 1e300
NONE = np.iinfo(np.int64).max
ROW = "tile bigint, message boolean, blob binary"
#: Pairs of roots that one task contracts: 16 bytes each.
FEW = 4_000_000


def pack(*arrays: np.ndarray) -> bytes:
    """int64 arrays of equal length, floats by their bits."""
    return np.stack([x.astype(np.float64).view(np.int64) if x.dtype.kind == "f" else x.astype(np.int64) for x in arrays]).tobytes() if arrays else b""


def unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    """Arrays of a blob; kinds: i or f for each."""
    return [x.view(np.float64).copy() if k == "f" else x.copy() for x, k in zip(np.frombuffer(blob, np.int64).reshape(len(kinds), -1), kinds, strict=True)]


class Tiles:
    """Numbers of tiles, and frames: a tile with a rim one voxel deep, as flat arrays."""

    def __init__(self, shape: Shape, periodic_x: bool):
        self.shape, self.periodic = shape, periodic_x
        self.ny, self.nx = -(-shape.height // TILE), -(-shape.width // TILE)
        self.n = TILE + 2

    def column(self):
        z, y, x = (F.floor(F.col(c) / TILE) for c in "zyx")
        return ((z * self.ny + y) * self.nx + x).cast("bigint")

    def origin(self, tile: int) -> tuple[int, int, int]:
        rest, tx = divmod(tile, self.nx)
        tz, ty = divmod(rest, self.ny)
        return tz * TILE - 1, ty * TILE - 1, tx * TILE - 1

    def frame(self, tile: int, z: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        oz, oy, ox = self.origin(tile)
        return ((z - oz) * self.n + (y - oy)) * self.n + (x - ox)

    def places(self, tile: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        oz, oy, ox = self.origin(tile)
        return at // (self.n * self.n) + oz, at // self.n % self.n + oy, at % self.n + ox

    def images(self, tile: int) -> np.ndarray:
        """Cells of the frame; those that show a voxel of the same tile across the ends of x point to it."""
        out = np.arange(self.n**3)
        if self.periodic and self.nx == 1:
            x = out % self.n - 1
            out = out - (x == self.shape.width) * self.shape.width + (x == -1) * self.shape.width
        return out

    def sent(self, tile: int, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each tile around: which of the voxels it sees, and their places there."""
        z, y, x = self.places(tile, at)
        for shift in (0, self.shape.width, -self.shape.width) if self.periodic else (0,):
            seen: dict[int, list] = {}
            for dz in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        tz, ty, tx = (z + dz) // TILE, (y + dy) // TILE, (x + shift + dx) // TILE
                        ok = (tz >= 0) & (ty >= 0) & (ty < self.ny) & (tx >= 0) & (tx < self.nx) & (x + shift >= -1) & (x + shift <= self.shape.width)
                        to = (tz * self.ny + ty) * self.nx + tx
                        for t in np.unique(to[ok]).tolist():
                            if t != tile:
                                seen.setdefault(t, []).append(np.flatnonzero(ok & (to == t)))
            for t, own in seen.items():
                own = np.unique(np.concatenate(own))
                yield t, own, z[own], y[own], x[own] + shift


def settled(offsets: list[tuple], n: int, images: np.ndarray, open_: np.ndarray, d: np.ndarray, lab: np.ndarray, g: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Relaxes d and lab in place from the active cells; returns the cells that changed."""
    steps = np.array([(o[0] * n + o[1]) * n + o[2] for o in offsets])[:, None]
    weights = np.array([o[3] for o in offsets], dtype=float)[:, None]
    changed = np.zeros(len(d), dtype=bool)
    while len(active):
        to = active + steps
        inside = (to >= 0) & (to < len(d))
        to = images[np.where(inside, to, 0)]
        ok = inside & open_[to] & (g[to] == g[active])
        to, c, own = to[ok], np.broadcast_to(d[active], ok.shape)[ok] + np.broadcast_to(weights, ok.shape)[ok], np.broadcast_to(lab[active], ok.shape)[ok]
        better = c < d[to] - EPS
        nearer = np.unique(to[better])
        np.minimum.at(d, to[better], c[better])
        lab[nearer] = NONE
        near = c <= d[to] + EPS
        to, own = to[near], own[near]
        before = lab[to]
        np.minimum.at(lab, to, own)
        active = np.unique(np.concatenate((nearer, to[lab[to] < before])))
        changed[active] = True
    return np.flatnonzero(changed)


def relaxed(voxels: DataFrame, offsets: list[tuple], shape: Shape, group: str | None = None, periodic_x: bool = False, most: int = 10_000) -> DataFrame:
    """(vid, d, label) of every voxel that a state reaches.

    voxels: vid, z, y, x, d (double, null if unknown), label (bigint), and `group` if given: states pass only between
    voxels with the same group. offsets: (dz, dy, dx, weight). Raises if `most` supersteps aren't enough.
    """
    spark = voxels.sparkSession
    ship(spark)
    tiles = Tiles(shape, periodic_x)
    n = tiles.n

    def run(tile: int, at: np.ndarray, d: np.ndarray, lab: np.ndarray, g: np.ndarray, got: list[bytes]) -> pa.Table:
        """The tile's row after its messages, and the messages it sends."""
        frame = np.full((2, n**3), FAR), np.full((2, n**3), -1, np.int64)
        fd, fl, fg = frame[0][0], frame[1][0], frame[1][1]
        open_ = np.zeros(n**3, dtype=bool)
        fd[at], fl[at], fg[at], open_[at] = d, np.where(d < FAR, lab, NONE), g, True
        active = at[d < FAR] if not got else at[:0]
        for blob in got:
            z, y, x, hd, hl, hg = unpack(blob, "iiifii")
            own = tiles.frame(tile, z, y, x)
            fd[own], fl[own], fg[own] = hd, hl, hg
            active = np.union1d(active, own)
        moved = settled(offsets, n, tiles.images(tile), open_, fd, fl, fg, active)
        if not got:
            moved = at[fd[at] < FAR]
        out = [(tile, False, pack(at, fd[at], fl[at], g))]
        local = (moved // (n * n), moved // n % n, moved % n)
        rim = np.any([(v == 1) | (v == TILE) for v in local], axis=0)
        if periodic_x:
            x = tiles.places(tile, moved)[2]
            rim |= (x == 0) | (x == shape.width - 1)
        moved = moved[rim]
        out += [(t, True, pack(z, y, x, fd[moved[own]], fl[moved[own]], fg[moved[own]])) for t, own, z, y, x in tiles.sent(tile, moved)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["tile", "message", "blob"])

    def first(table: pa.Table) -> pa.Table:
        a = {c: table.column(c).to_numpy() for c in table.column_names}
        tile = int(a["tile"][0])
        return run(tile, tiles.frame(tile, a["z"].astype(np.int64), a["y"], a["x"]), a["d"].copy(), a["label"], a["g"], [])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, blob, got in zip(*(batch.column(c) for c in ("tile", "blob", "got")), strict=True):
                yield from run(tile.as_py(), *unpack(blob.as_py(), "ifii"), got.as_py()).to_batches()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, blob in zip(batch.column("tile"), batch.column("blob"), strict=True):
                at, d, lab, _ = unpack(blob.as_py(), "ifii")
                z, y, x = tiles.places(tile.as_py(), at)
                near = d < FAR
                yield pa.RecordBatch.from_arrays([pa.array(((z * shape.height + y) * shape.width + x)[near]), pa.array(d[near]), pa.array(lab[near])], ["vid", "d", "label"])

    own = voxels.select("z", "y", "x", F.coalesce("d", F.lit(FAR)).cast("double").alias("d"), F.coalesce("label", F.lit(-1)).cast("bigint").alias("label"), (F.col(group) if group else F.lit(0)).cast("bigint").alias("g"), tiles.column().alias("tile"))
    base = f"{folder(spark)}/supersteps-{uuid.uuid4().hex}"
    newest: dict[int, int] = {}

    def put(ran: DataFrame, version: int) -> tuple[DataFrame, set[int]]:
        """Writes the rows of a superstep and notes which tiles it has run; its messages, and the tiles that they are for."""
        ran.write.parquet(f"{base}/version={version}")
        made = spark.read.schema(ROW).parquet(f"{base}/version={version}")
        tiles_of = made.select("tile", "message").collect()  # numbers only, a tile and those around it
        newest.update((r.tile, version) for r in tiles_of if not r.message)
        return made.where("message"), {r.tile for r in tiles_of if r.message}

    def states(asked: dict[int, int]) -> DataFrame:
        """(tile, blob): the newest state of tiles, from the supersteps that wrote them."""
        versions = sorted(set(asked.values()))
        every = spark.read.option("basePath", base).schema(f"{ROW}, version int").parquet(*(f"{base}/version={v}" for v in versions))
        own = F.broadcast(spark.createDataFrame(list(asked.items()), "tile bigint, version int"))
        return every.where("NOT message").join(own, ["tile", "version"]).select("tile", "blob")

    messages, to = put(own.groupBy("tile").applyInArrow(first, ROW), 0)
    for version in range(1, most + 1):
        asked = {t: newest[t] for t in to if t in newest}
        if not asked:
            break
        got = messages.groupBy("tile").agg(F.collect_list("blob").alias("got"))  # at most a blob for each tile around
        messages, to = put(states(asked).join(got, "tile").select("tile", "blob", "got").mapInArrow(step, ROW), version)
    else:
        if to & newest.keys():
            raise RuntimeError(f"no fixpoint after {most} supersteps")
    if not newest:
        return spark.createDataFrame([], "vid bigint, d double, label bigint")
    return states(newest).mapInArrow(rows, "vid bigint, d double, label bigint")


def least_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id of the pairs and the least id of its component, by hooking and pointer jumping."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = np.arange(len(ids))
    u, v = at[: len(a)], at[len(a) :]
    while True:
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        if (low == high).all():
            return ids, ids[root]
        np.minimum.at(root, high, low)
        while not (root[root] == root).all():
            root = root[root]


def contracted(pairs: DataFrame, few: int = FEW) -> DataFrame:
    """(id, root) of every id in pairs (a, b) of different ids: the least id that it reaches."""

    def solve(table: pa.Table) -> pa.Table:
        ids, root = least_roots(table.column("a").to_numpy(), table.column("b").to_numpy())
        return pa.table([ids, root], ["id", "root"])

    if pairs.count() <= few:
        return pairs.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(solve, "id bigint, root bigint")
    edges = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "small")
        if edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and edges.groupBy("u").count().where("count > 1").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def rooted(voxels: DataFrame, offsets: list[tuple], shape: Shape, group: str | None = None, periodic_x: bool = False, few: int = FEW) -> DataFrame:
    """(vid, root) of every voxel: the least vid of the connected part, of one group if a column is named."""
    spark = voxels.sparkSession
    ship(spark)
    tiles = Tiles(shape, False)
    n = tiles.n
    forward = [(o[0] * n + o[1]) * n + o[2] for o in offsets if tuple(o[:3]) > (0, 0, 0)]

    def local(table: pa.Table) -> pa.Table:
        a = {c: table.column(c).to_numpy() for c in table.column_names}
        at = tiles.frame(int(a["tile"][0]), a["z"].astype(np.int64), a["y"], a["x"])
        row = np.full(n**3, -1)
        row[at] = np.arange(len(at))
        root = np.arange(len(at))
        order = np.argsort(a["vid"])  # rows in ascending vid, so that the least row is the least vid
        at, vid, g = at[order], a["vid"][order], a["g"][order]
        row[at] = np.arange(len(at))
        pairs = [(np.flatnonzero(row[at + s] >= 0), s) for s in forward]
        u = np.concatenate([p for p, _ in pairs]) if pairs else at[:0]
        v = np.concatenate([row[at[p] + s] for p, s in pairs]) if pairs else at[:0]
        same = g[u] == g[v]
        ids, least = least_roots(u[same], v[same])
        root[ids] = least
        return pa.table([pa.array(x, t) for x, t in ((vid, pa.int64()), (a["z"][order], pa.int32()), (a["y"][order], pa.int32()), (a["x"][order], pa.int32()), (g, pa.int64()), (vid[root], pa.int64()))], ["vid", "z", "y", "x", "g", "root"])

    own = voxels.select("vid", *(F.col(c).cast("int").alias(c) for c in "zyx"), (F.col(group) if group else F.lit(0)).cast("bigint").alias("g"), tiles.column().alias("tile"))
    own = written(own.groupBy("tile").applyInArrow(local, "vid bigint, z int, y int, x int, g bigint, root bigint"), "parts")
    edge = " OR ".join([f"pmod({c}, {TILE}) IN (0, {TILE - 1})" for c in "zyx"] + ([f"x = {shape.width - 1}"] if periodic_x else []))
    rim = own.where(edge)
    across = neighbours(rim, rim, [o[:3] for o in offsets if tuple(o[:3]) > (0, 0, 0)], shape, periodic_x, ("g", "root")).where("g = nb_g AND root <> nb_root")
    pairs = written(across.select(F.least("root", "nb_root").alias("a"), F.greatest("root", "nb_root").alias("b")).distinct(), "root-pairs")
    if pairs.isEmpty():
        return own.select("vid", "root")
    found = contracted(pairs, few).select(F.col("id").alias("root"), F.col("root").alias("least"))
    return own.join(found, "root", "left").select("vid", F.coalesce("least", "root").alias("root"))
