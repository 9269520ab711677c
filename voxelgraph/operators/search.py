"""Nearest sites, candidate windows, straight and monotone paths: equi-joins on lattice cells, offsets and runs, never all pairs."""

from __future__ import annotations

from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.memory import written
from .blocks import Frame, blockwise, shifted
from .grid import CUBE, Shape, flat


def sorted_abs(a: str, b: str) -> tuple[Column, Column, Column]:
    """The absolute differences of two points' coordinates (columns a + z, ..., b + z, ...), largest first."""
    d = [F.abs(F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "zyx"]
    top, low = F.greatest(*d), F.least(*d)
    return top, d[0] + d[1] + d[2] - top - low, low


def metric(kind: str, a: str = "p", b: str = "s") -> Column:
    """d2: squared Euclidean, l1: sum of steps, d26: (a - b) + sqrt 2 (b - c) + sqrt 3 c of the sorted differences."""
    top, mid, low = sorted_abs(a, b)
    if kind == "d26":
        return (top - mid) + F.sqrt(F.lit(2.0)) * (mid - low) + F.sqrt(F.lit(3.0)) * low
    return top * top + mid * mid + low * low if kind == "d2" else top + mid + low


def nearest(points: DataFrame, sites: DataFrame, kind: str = "d2", cell: int = 4, group: str | None = None, other: bool = False, unlike: str | None = None) -> DataFrame:
    """(pid, sid, dist) of points (pid, z, y, x) and sites (sid, z, y, x): the nearest, the least sid of equally near ones.

    Sites are looked up in the 27 lattice cells around the point's; a find within the cell's width is certain, as what lies outside
    is farther along one axis alone, and the other points go on with cells twice as wide. Without conditions the finds within `cell`
    come from blocks first. group: a column that both must share (points without any site of theirs drop out). other: a site never
    finds itself. unlike: a column in which both must differ.
    """
    keep = [group] if group else []
    apart = [F.col(unlike).alias("apart")] if unlike else []
    places = sites.select(F.col("sid"), *(F.col(c).alias(f"s{c}") for c in "zyx"), *keep, *apart)
    left = points.select("pid", *(F.col(c).alias(f"p{c}") for c in "zyx"), *keep, *(x.alias("own") for x in apart))
    ends = lambda rows, p: rows.agg(*(f(f"{p}{c}").alias(f"{n}{c}") for c in "zyx" for n, f in (("lo", F.min), ("hi", F.max)))).first()
    to, of = ends(places, "s"), ends(left, "p")
    if to["loz"] is None or of["loz"] is None:
        return points.select("pid", F.lit(None).cast("bigint").alias("sid"), F.lit(None).cast("double").alias("dist")).where("false")
    widest = max(max(to[f"hi{c}"], of[f"hi{c}"]) - min(to[f"lo{c}"], of[f"lo{c}"]) for c in "zyx")
    out, size = None, cell
    if group:
        left = written(left.join(places.select(group).distinct().hint("merge"), group, "left_semi"), "unsure")
    elif not other and not unlike:
        out = written(_nearest_in_blocks(points, sites, kind, cell), "nearest")
        left, size = written(left.join(out.select("pid").hint("merge"), "pid", "left_anti"), "unsure"), 2 * cell
        if left.isEmpty():
            return out
    while True:
        asked = left
        for c in "zyx":
            at = F.floor(F.col(f"p{c}") / size)
            asked = asked.withColumn(f"c{c}", F.explode(F.array(at - 1, at, at + 1)))
        met = asked.join(places.withColumns({f"c{c}": F.floor(F.col(f"s{c}") / size) for c in "zyx"}).hint("merge"), ["cz", "cy", "cx", *keep])
        met = met.where("pid <> sid") if other else met
        met = met.where("own <> apart") if unlike else met
        best = met.groupBy("pid").agg(F.min(F.struct(metric(kind).cast("double").alias("dist"), "sid")).alias("b")).select("pid", "b.sid", "b.dist")
        last = widest < size
        sure = written(best if last else best.where(F.col("dist") <= float(size) ** (2 if kind == "d2" else 1)), "nearest")
        out = sure if out is None else out.unionByName(sure)
        if last:
            return out
        left = written(left.join(sure.select("pid").hint("merge"), "pid", "left_anti"), "unsure")
        if left.isEmpty():
            return out
        size *= 2


def _nearest_in_blocks(points: DataFrame, sites: DataFrame, kind: str, reach: int) -> DataFrame:
    """nearest() for points with a site within `reach`: shells of equal distance around the points that are left, from the least on."""
    none = np.iinfo(np.int64).max
    shells: dict[float, list] = {}
    for o in product(range(-reach, reach + 1), repeat=3):
        low, mid, top = sorted(abs(v) for v in o)
        far = {"d2": float(low * low + mid * mid + top * top), "l1": float(low + mid + top), "d26": (top - mid) + np.sqrt(2.0) * (mid - low) + np.sqrt(3.0) * low}[kind]
        if far <= float(reach) ** (2 if kind == "d2" else 1):
            shells.setdefault(float(far), []).append(o)

    def run(frame: Frame, table: pa.Table) -> pa.Table:
        ids, site = table.column("id").to_numpy(), table.column("site").to_numpy(zero_copy_only=False)
        own = np.full(frame.shape, none).reshape(-1)
        np.minimum.at(own, frame.at[site], ids[site])
        left = np.flatnonzero(~site)
        found = []
        for far in sorted(shells):
            sid = np.full(len(left), none)
            for o in shells[far]:
                at = [v[left] + d for v, d in zip(frame.place, o, strict=True)]
                ok = np.flatnonzero(frame.inside(*at))
                sid[ok] = np.minimum(sid[ok], own[frame.flat(*(v[ok] for v in at))])
            got = sid < none
            found.append((ids[left[got]], sid[got], np.full(int(got.sum()), far)))
            left = left[~got]
            if not len(left):
                break
        return pa.table([np.concatenate(c) for c in zip(*found, strict=True)], ["pid", "sid", "dist"])

    place = [F.col(c).cast("int").alias(c) for c in "zyx"]
    both = points.select(F.col("pid").cast("bigint").alias("id"), *place, F.lit(False).alias("site")).unionByName(sites.select(F.col("sid").cast("bigint").alias("id"), *place, F.lit(True).alias("site")))
    own = blockwise(both, reach, run, "pid bigint, sid bigint, dist double", "site")
    return own.select(F.col("pid").cast(points.schema["pid"].dataType).alias("pid"), F.col("sid").cast(sites.schema["sid"].dataType).alias("sid"), "dist")


def ball(sites: DataFrame, voxels: DataFrame, radius: int, shape: Shape, kind: str = "d26") -> DataFrame:
    """(vid, sid, dist) of voxels within `radius` of a site (sid, z, y, x): a join on ids of the sites' boxes."""
    box = sites.select("sid", *(F.col(c).alias(f"s{c}") for c in "zyx"))
    for c in "zyx":
        box = box.withColumn(f"p{c}", F.explode(F.sequence(F.col(f"s{c}") - radius, F.col(f"s{c}") + radius)))
    box = box.where((F.col("pz") >= 0) & (F.col("py") >= 0) & (F.col("py") < shape.height) & (F.col("px") >= 0) & (F.col("px") < shape.width))
    box = box.withColumn("dist", metric(kind).cast("double")).where(F.col("dist") <= radius).withColumn("vid", flat(F.col("pz"), F.col("py"), F.col("px"), shape))
    return box.join(voxels.select("vid"), "vid").select("vid", "sid", "dist")


def lattice_candidates(voxels: DataFrame, sites: DataFrame, stride: tuple[int, int, int], offset: tuple[int, int, int]) -> DataFrame:
    """(vid, site_id, l1, z, y, x, sz, sy, sx): the sites of the 4 x 4 x 4 lattice cells around a voxel's.

    sites: (site_id, lz, ly, lx) on the lattice offset + index * stride. A voxel's base index is floor((v - offset) / stride),
    its window one cell before to two after.
    """
    own = sites.select("site_id", *(F.col(f"l{c}") for c in "zyx"))
    for k, c in enumerate("zyx"):
        own = own.withColumn(f"s{c}", F.col(f"l{c}") * stride[k] + offset[k]).withColumn(f"b{c}", F.explode(F.sequence(F.col(f"l{c}") - 2, F.col(f"l{c}") + 1)))
    base = [F.floor((F.col(c) - offset[k]) / stride[k]).cast("bigint").alias(f"b{c}") for k, c in enumerate("zyx")]
    own = own.withColumns({f"b{c}": F.col(f"b{c}").cast("bigint") for c in "zyx"})
    met = voxels.select("vid", *(F.col(c).alias(f"p{c}") for c in "zyx"), *base).join(own, ["bz", "by", "bx"])
    return met.select("vid", "site_id", metric("l1").alias("l1"), *(F.col(f"p{c}").alias(c) for c in "zyx"), "sz", "sy", "sx")


def runs(voxels: DataFrame) -> DataFrame:
    """(vid, rz, ry, rx): the least id of the straight run of voxels through each along every axis."""
    out = voxels.select("vid", "z", "y", "x")
    for c in "zyx":
        rest = [d for d in "zyx" if d != c]
        out = out.withColumn("island", F.col(c) - F.row_number().over(Window.partitionBy(*rest).orderBy(c))).withColumn(f"r{c}", F.min("vid").over(Window.partitionBy(*rest, "island"))).drop("island")
    return out.select("vid", "rz", "ry", "rx")


def clear_paths(pairs: DataFrame, voxels: DataFrame, shape: Shape) -> DataFrame:
    """pairs (vid, site_id, z, y, x, sz, sy, sx) with `clear`: one of the six paths from the site to the voxel that go axis by
    axis holds no solid. A straight piece is free if both its ends lie in one run, so only the corners are looked up."""
    corners = [F.struct(*(F.lit(bool(k >> i & 1)).alias(f"a{c}") for i, c in enumerate("zyx"))) for k in range(8)]
    own = pairs.select("vid", "site_id", "z", "y", "x", "sz", "sy", "sx", F.explode(F.array(*corners)).alias("k"))
    at = [F.when(F.col(f"k.a{c}"), F.col(c)).otherwise(F.col(f"s{c}")) for c in "zyx"]
    own = own.withColumn("corner", flat(*at, shape)).withColumn("code", sum(F.col(f"k.a{c}").cast("int") * (1 << i) for i, c in enumerate("zyx")))
    met = own.join(runs(voxels).withColumnRenamed("vid", "corner"), "corner")
    wide = met.groupBy("vid", "site_id").agg(*(F.max(F.when(F.col("code") == k, F.col(f"r{c}"))).alias(f"{c}{k}") for k in range(8) for c in "zyx"))
    ways = []
    for order in permutations(range(3)):
        code, ok = 0, F.lit(True)
        for i in order:
            after = code | 1 << i
            c = "zyx"[i]
            ok = ok & F.coalesce(F.col(f"{c}{code}") == F.col(f"{c}{after}"), F.lit(False))
            code = after
        ways.append(ok)
    any_way = ways[0]
    for w in ways[1:]:
        any_way = any_way | w
    found = wide.select("vid", "site_id", any_way.alias("clear"), ways[-1].alias("canonical"))
    return pairs.join(found, ["vid", "site_id"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("clear", "canonical")})


def window_paths(voxels: DataFrame, sites: DataFrame, stride: tuple[int, int, int], offset: tuple[int, int, int]) -> DataFrame:
    """What lattice_candidates and clear_paths say of each voxel's window, without a row for each pair: (vid, site_id, l1, clear,
    canonical) of the nearest site, next_l1 of the second, clear_site and clear_l1 of the nearest with a free path; equally near ones
    in order of site_id. Voxels without a site in their window are left out.

    sites: (site_id, vid, z, y, x), each on a voxel of the lattice. All paths stay in the box of voxel and site, so a block holds them.
    """
    reach = 2 * max(stride)
    none, code = np.iinfo(np.int64).max, 1 << 32
    schema = "vid bigint, site_id int, l1 int, clear boolean, canonical boolean, next_l1 int, clear_site int, clear_l1 int"

    def run(frame: Frame, table: pa.Table) -> pa.Table:
        own = frame.inner
        here = [v[own] for v in frame.place]
        open_ = frame.dense(True, False)
        site = frame.dense(table.column("site_id").fill_null(-1).to_numpy(), -1).reshape(-1)
        walls = [np.cumsum(~open_, axis=k, dtype=np.int32).reshape(-1) for k in range(3)]
        open_ = open_.reshape(-1)
        n = int(own.sum())
        first, second, best = (np.full(n, none) for _ in range(3))
        clear, canonical = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        for shift in product(range(-1, 3), repeat=3):
            there = [off + ((v - off) // s + k) * s for v, off, s, k in zip(here, offset, stride, shift, strict=True)]
            rows = np.flatnonzero(frame.inside(*there))
            rows = rows[site[frame.flat(*(v[rows] for v in there))] >= 0]
            if not len(rows):
                continue
            a, b = [v[rows] for v in there], [v[rows] for v in here]
            at = [frame.flat(*(q if k >> i & 1 else p for i, (p, q) in enumerate(zip(a, b, strict=True)))) for k in range(8)]
            free = {(k, i): open_[at[k]] & open_[at[k | 1 << i]] & (walls[i][at[k]] == walls[i][at[k | 1 << i]]) for k in range(8) for i in range(3) if not k >> i & 1}
            ways = [free[0, p] & free[1 << p, q] & free[1 << p | 1 << q, r] for p, q, r in permutations(range(3))]
            any_way = np.any(ways, axis=0)
            key = sum(np.abs(p - q) for p, q in zip(a, b, strict=True)) * code + site[at[0]]
            nearer = key < first[rows]
            second[rows] = np.where(nearer, first[rows], np.minimum(second[rows], key))
            first[rows], clear[rows], canonical[rows] = np.where(nearer, key, first[rows]), np.where(nearer, any_way, clear[rows]), np.where(nearer, ways[-1], canonical[rows])
            best[rows] = np.minimum(best[rows], np.where(any_way, key, none))
        got = first < none
        part = lambda v, f: pa.array(f(v[got]), mask=v[got] == none)
        columns = [pa.array(table.column("vid").to_numpy()[own][got]), part(first, lambda v: v % code), part(first, lambda v: v // code), pa.array(clear[got]), pa.array(canonical[got]), part(second, lambda v: v // code), part(best, lambda v: v % code), part(best, lambda v: v // code)]
        return pa.table(columns, [f.split()[0] for f in schema.split(", ")])

    own = voxels.select("vid", *(F.col(c).cast("int").alias(c) for c in "zyx")).join(sites.select("vid", F.col("site_id").cast("bigint").alias("site_id")), "vid", "left")
    return blockwise(own, reach, run, schema)


def sight(voxels: DataFrame, shape: Shape, doublings: int) -> DataFrame:
    """(vid, dz, dy, dx, k): for 26 directions the largest k <= doublings such that 2^k steps that way stay in voxels; -1 if not
    even one does. 2^k steps are free if the first half is and the second is from its end; a block's rim is 2^doublings deep."""

    def run(frame: Frame, table: pa.Table) -> pa.Table:
        open_, at = frame.dense(True, False), frame.at[frame.inner]
        found = []
        for o in CUBE:
            free, k = shifted(open_, o, False), np.full(len(at), -1, np.int32)
            for level in range(doublings + 1):
                k += free.reshape(-1)[at]
                free = free & shifted(free, tuple(v << level for v in o), False)
            found.append(k)
        vid = table.column("vid").to_numpy()[frame.inner]
        moves = [np.repeat(np.array([o[i] for o in CUBE], np.int32), len(vid)) for i in range(3)]
        return pa.table([np.tile(vid, len(CUBE)), *moves, np.concatenate(found)], ["vid", "dz", "dy", "dx", "k"])

    return blockwise(voxels.select("vid", *(F.col(c).cast("int").alias(c) for c in "zyx")), 1 << doublings, run, "vid bigint, dz int, dy int, dx int, k int", shape=shape)
