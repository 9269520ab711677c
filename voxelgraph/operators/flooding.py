"""Ownership by flooding: certified cores around the sites, jumps of halving length past free voxels, and local relaxation of what
is left open. Jumps of up to BLOCK steps are made in blocks with a rim, where obstacles are seen; longer ones by joins on the voxels
whose lines are free for so long.

A state is (vid, z, y, x, open, d, label): `open` is false for voxels whose owner is certain; these send, but never change.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.memory import written
from ..plans.relaxation import relaxed
from .blocks import Frame, blockwise, shifted
from .fields import WEIGHTED, closure_fill
from .grid import CUBE, Shape, flat, neighbours
from .search import metric, nearest

LINES = [o for o in CUBE if o > (0, 0, 0)]
FAR = 1e300
#: The longest jump that is made in blocks.
BLOCK = 32


def straight(voxels: DataFrame) -> DataFrame:
    """(vid, z, y, x, runs): the least id of the run of voxels through each, along the 13 lines of LINES."""
    lines = F.array(*(F.struct(F.lit(i).alias("i"), *(F.lit(v).alias(f"d{c}") for c, v in zip("zyx", o, strict=True))) for i, o in enumerate(LINES)))
    own = voxels.select("vid", "z", "y", "x", F.explode(lines).alias("o")).select("vid", "z", "y", "x", "o.*")
    own = own.withColumn("t", F.when(F.col("dz") != 0, F.col("z")).when(F.col("dy") != 0, F.col("y")).otherwise(F.col("x")))
    own = own.withColumns({f"l{c}": F.col(c) - F.col("t") * F.col(f"d{c}") for c in "zyx"})
    line = ["i", "lz", "ly", "lx"]
    own = own.withColumn("island", F.col("t") - F.row_number().over(Window.partitionBy(*line).orderBy("t")))
    own = own.withColumn("run", F.min("vid").over(Window.partitionBy(*line, "island")))
    runs = F.transform(F.array_sort(F.collect_list(F.struct("i", "run"))), lambda s: s["run"])
    return own.groupBy("vid").agg(F.first("z").alias("z"), F.first("y").alias("y"), F.first("x").alias("x"), runs.alias("runs"))


def free_lines(voxels: DataFrame, shape: Shape, top: int) -> dict[int, DataFrame]:
    """By jump, from BLOCK up to `top`: (vid, order) of voxels from which so many steps against CUBE[order] are free. Twice as many are
    free if they are from both halves' starts; ends with the first jump that none can make."""

    def run(frame: Frame, table: pa.Table) -> pa.Table:
        open_, at, vid = frame.dense(True, False), frame.at[frame.inner], table.column("vid").to_numpy()[frame.inner]
        found = [(vid[free], np.full(int(free.sum()), order, np.int32)) for order, o in enumerate(CUBE) for free in (_free(open_, tuple(-v for v in o), BLOCK).reshape(-1)[at],)]
        return pa.table([np.concatenate(c) for c in zip(*found, strict=True)], ["vid", "order"])

    own = written(blockwise(voxels.select("vid", *(F.col(c).cast("int").alias(c) for c in "zyx")), BLOCK, run, "vid bigint, order int", shape=shape), "free")
    out, jump = {}, BLOCK
    while jump <= top and not own.isEmpty():
        out[jump] = own
        far = own.withColumn("vid", _away(own, jump, shape))
        own = written(far.join(own, ["vid", "order"]).withColumn("vid", F.col("vid") - (_away(own, jump, shape) - F.col("vid"))), "free")
        jump *= 2
    return out


def _away(rows: DataFrame, jump: int, shape: Shape) -> Column:
    """The voxel `jump` steps against CUBE[order] from vid."""
    steps = F.array(*(F.lit(-jump * ((o[0] * shape.height + o[1]) * shape.width + o[2])).cast("bigint") for o in CUBE))
    return F.col("vid") + F.get(steps, F.col("order"))


def _free(open_: np.ndarray, o: tuple[int, int, int], jump: int) -> np.ndarray:
    """Whether `jump` (a power of two) steps along o stay in open places."""
    free, k = open_ & shifted(open_, o, False), 1
    while k < jump:
        free, k = free & shifted(free, tuple(v * k for v in o), False), 2 * k
    return free


def jumped(state: DataFrame, jump: int, shape: Shape, free: DataFrame) -> DataFrame:
    """One synchronous step: an open voxel takes the best of the 26 states that stand `jump` steps away on free lines (free: see
    free_lines), if that is shorter than its own; of equal ones the first in order of (dz, dy, dx), as seen from the voxel."""
    length = F.get(F.array(*(F.lit(jump * math.sqrt(sum(map(abs, o)))) for o in CUBE)), F.col("order"))
    sent = state.where("label IS NOT NULL").select("vid", "d", "label").join(free, "vid")
    best = written(sent.select(_away(sent, jump, shape).alias("vid"), F.struct((F.col("d") + length).alias("d"), "order", "label").alias("s")).groupBy("vid").agg(F.min("s").alias("s")), "sent")
    if best.isEmpty():
        return state
    better = F.col("open") & (F.col("s.d") < F.coalesce("d", F.lit(FAR)))
    now = state.join(best, "vid", "left").withColumns({"d": F.when(better, F.col("s.d")).otherwise(F.col("d")), "label": F.when(better, F.col("s.label")).otherwise(F.col("label"))})
    return written(now.drop("s"), "flood")


def jumped_in_blocks(state: DataFrame, jumps: list[int], shape: Shape, eps: float = 0.0) -> DataFrame:
    """As many synchronous steps as there are jumps, each as in jumped() but that it must be shorter by more than eps: a block with a rim
    as deep as the jumps together holds all that its voxels can get."""

    def run(frame: Frame, table: pa.Table) -> pa.Table:
        open_ = frame.dense(True, False)
        asked = frame.dense(table.column("open").to_numpy(zero_copy_only=False), False)
        d = frame.dense(table.column("d").fill_null(FAR).to_numpy(), FAR)
        label = frame.dense(table.column("label").fill_null(-1).to_numpy(), -1)
        for jump in jumps:
            best, own = np.full_like(d, FAR), label
            for o in CUBE:
                step = tuple(jump * v for v in o)
                free = _free(open_, o, jump)
                if not free.any():
                    continue
                got = shifted(d, step, FAR) + jump * math.sqrt(sum(map(abs, o)))
                nearer = free & (got < best)
                best, own = np.where(nearer, got, best), np.where(nearer, shifted(label, step, -1), own)
            better = asked & (best < d - eps)
            d, label = np.where(better, best, d), np.where(better, own, label)
        at = frame.at[frame.inner]
        d, label = d.reshape(-1)[at], label.reshape(-1)[at]
        inner = table.filter(pa.array(frame.inner))
        return pa.table([*(inner.column(c) for c in ("vid", "z", "y", "x", "open")), pa.array(d, mask=label < 0), pa.array(label, mask=label < 0)], ["vid", "z", "y", "x", "open", "d", "label"])

    own = state.select("vid", *(F.col(c).cast("int").alias(c) for c in "zyx"), "open", "d", "label")
    return written(blockwise(own, sum(jumps), run, "vid bigint, z int, y int, x int, open boolean, d double, label bigint", shape=shape), "flood")


def jumped_down(state: DataFrame, voxels: DataFrame, shape: Shape, last: int = 1) -> DataFrame:
    """The state after all jumps down to `last`: those longer than BLOCK by joins on the few free lines so long, the others in blocks."""
    every = jumps(voxels, shape, last)
    long = [j for j in every if j > BLOCK]
    free = free_lines(voxels, shape, long[0]) if long else {}
    for jump in long:
        state = jumped(state, jump, shape, free[jump]) if jump in free else state
    return jumped_in_blocks(state, every[len(long) :], shape) if every[len(long) :] else state


def started(voxels: DataFrame, sites: DataFrame) -> DataFrame:
    """The state in which each voxel that holds a site is its own (of two sites the lesser); sites elsewhere count for nothing."""
    own = sites.groupBy("vid").agg(F.min("site_id").cast("bigint").alias("label"))
    return voxels.select("vid", "z", "y", "x").join(own, "vid", "left").withColumns({"open": F.lit(True), "d": F.when(F.col("label").isNotNull(), 0.0)})


def jumps(voxels: DataFrame, shape: Shape, last: int = 1) -> list[int]:
    """Powers of two from the largest that is no longer than the domain's longest side down to `last`."""
    depth = voxels.agg(F.max("z") + 1).first()[0]
    top = max(shape.height, shape.width, depth or 1).bit_length() - 1
    return [1 << k for k in range(top, -1, -1) if 1 << k >= last]


def flooded(voxels: DataFrame, sites: DataFrame, shape: Shape, relax: int = 1) -> DataFrame:
    """(vid, site_id, d), null where nothing came: jump flooding over the whole domain, then `relax` steps of length one. An upper
    bound of the distance, as each is the length of a free path."""
    state = jumped_down(written(started(voxels, sites), "flood"), voxels, shape)
    for _ in range(relax):
        state = jumped_in_blocks(state, [1], shape, 1e-6)
    return state.select("vid", F.col("label").cast("int").alias("site_id"), "d")


def settled(voxels: DataFrame, state: DataFrame, shape: Shape) -> DataFrame:
    """(vid, site_id, d): a flooded state (vid, site_id, d) relaxed until nothing changes; exact, with the least site on ties, if every
    part that holds a site has a state."""
    own = voxels.select("vid", "z", "y", "x").join(state.select("vid", "d", F.col("site_id").cast("bigint").alias("label")), "vid", "left")
    return relaxed(own, WEIGHTED, shape).select("vid", F.col("label").cast("int").alias("site_id"), "d")


def balls(voxels: DataFrame, radii: DataFrame, shape: Shape) -> DataFrame:
    """(vid, z, y, x) of voxels within some site's radius by the free-space distance; radii: (site_id, z, y, x, radius)."""
    box = radii.where("radius > 0").select(*(F.col(c).alias(f"s{c}") for c in "zyx"), "radius")
    for c in "zyx":
        reach = F.ceil("radius").cast("int")
        top = {"y": shape.height - 1, "x": shape.width - 1}.get(c)
        end = F.col(f"s{c}") + reach
        box = box.withColumn(f"p{c}", F.explode(F.sequence(F.greatest(F.col(f"s{c}") - reach, F.lit(0)), F.least(end, F.lit(top)) if top is not None else end)))
    near = box.where(metric("d26") <= F.col("radius")).select(flat(F.col("pz"), F.col("py"), F.col("px"), shape).alias("vid")).distinct()
    return voxels.select("vid", "z", "y", "x").join(near, "vid", "left_semi")


#: Modes of stamping: the largest radius, the most steps, and what the radius is shortened by when cores are kept; whether the second
#: nearest site certifies more voxels.
MODES = {"A": (64.0, 16, 1e-6, False), "B": (64.0, 16, 1e-6, False), "C": (None, None, 0.0, False), "D": (None, None, 0.0, True)}


def stamped(voxels: DataFrame, radii: DataFrame, shape: Shape, mode: str = "C") -> DataFrame:
    """(vid, site_id, d) of voxels whose owner is certain: nearer to a site than its radius, by paths inside the radii's balls.

    radii: (site_id, vid, z, y, x, radius), a radius below half the distance to the next site. Labels grow by one voxel a step from the
    rim of what changed in the step before, at most as many steps as the largest radius is long. Sites are kept always.
    """
    cap, most, shrink, second = MODES[mode]
    extent = voxels.agg(F.max("z").alias("z")).first()["z"] or 0
    cap = min(cap or math.inf, float(extent + shape.height - 1 + shape.width - 1))
    every = written(radii.withColumn("radius", F.least("radius", F.lit(cap))).join(voxels.select("vid"), "vid", "left_semi"), "radii")
    core = _stamped_in_blocks(voxels, every.where(F.col("radius") <= BLOCK), shape, most, shrink)
    radii = every.where(F.col("radius") > BLOCK)  # balls that no block holds; no two balls meet, so each half stands alone
    if not radii.isEmpty():
        core = core.unionByName(_stamped_by_joins(voxels, radii, shape, most, shrink))
    return core.unionByName(second_nearest(voxels, every, shape).join(core.select("vid"), "vid", "left_anti")) if second else core


def _stamped_in_blocks(voxels: DataFrame, radii: DataFrame, shape: Shape, most: int | None, shrink: float) -> DataFrame:
    """stamped() for balls of radius BLOCK at most: a block with a rim as deep as the largest holds every path to its voxels."""
    steps = math.ceil(radii.agg(F.max("radius")).first()[0] or 0)
    steps = steps if most is None else min(steps, most)
    site = radii.groupBy("vid").agg(F.min(F.struct(F.col("site_id").cast("bigint").alias("label"), "radius")).alias("s")).select("vid", "s.*")

    def run(frame: Frame, table: pa.Table) -> pa.Table:
        open_ = frame.dense(True, False)
        label = frame.dense(table.column("label").fill_null(-1).to_numpy(), -1)
        radius = frame.dense(table.column("radius").fill_null(-1.0).to_numpy(), -1.0)
        d = np.where(label < 0, FAR, 0.0)
        for _ in range(steps):
            best, of, far = d.copy(), label, radius
            for o in CUBE:
                got, own, reach = shifted(d, o, FAR) + math.sqrt(sum(map(abs, o))), shifted(label, o, -1), shifted(radius, o, -1.0)
                nearer = open_ & (got <= reach) & ((got < best - 1e-9) | (got <= best + 1e-9) & (own < of))
                best, of, far = np.where(nearer, got, best), np.where(nearer, own, of), np.where(nearer, reach, far)
            if (of == label).all() and (best == d).all():
                break
            d, label, radius = best, of, far
        at = frame.at[frame.inner]
        vid, d, label, radius = table.column("vid").to_numpy()[frame.inner], *(v.reshape(-1)[at] for v in (d, label, radius))
        own = (label >= 0) & (d <= np.maximum(radius - shrink, 0.0))
        return pa.table([vid[own], label[own].astype(np.int32), d[own]], ["vid", "site_id", "d"])

    rows = voxels.select("vid", *(F.col(c).cast("int").alias(c) for c in "zyx")).join(site, "vid", "left")
    return written(blockwise(rows, steps, run, "vid bigint, site_id int, d double", shape=shape), "stamp")


def _stamped_by_joins(voxels: DataFrame, radii: DataFrame, shape: Shape, most: int | None, shrink: float) -> DataFrame:
    """stamped() for balls of any radius: a step is a join of the rim with its neighbours."""
    place = written(balls(voxels, radii, shape).unionByName(radii.select("vid", "z", "y", "x")).distinct(), "balls")
    steps = math.ceil(radii.agg(F.max("radius")).first()[0] or 0)
    rim = radii.groupBy("vid").agg(F.min(F.struct(F.lit(0.0).alias("d"), F.col("site_id").cast("bigint").alias("label"))).alias("s"))
    known = rim
    for _ in range(min(steps, most) if most is not None else steps):
        near = neighbours(rim.select("vid").join(place, "vid"), place, CUBE, shape)
        length = F.sqrt((F.abs("dz") + F.abs("dy") + F.abs("dx")).cast("double"))
        met = near.join(rim, "vid").select(F.col("nb").alias("vid"), F.struct((F.col("s.d") + length).alias("d"), F.col("s.label").alias("label")).alias("n"))
        best = met.groupBy("vid").agg(F.min("n").alias("n")).join(known.withColumnRenamed("s", "o"), "vid", "left")
        rim = written(best.where("o IS NULL OR n.d < o.d - 1e-9 OR n.d <= o.d + 1e-9 AND n.label < o.label").select("vid", F.col("n").alias("s")), "stamp-rim")
        if rim.isEmpty():
            break
        known = written(known.join(rim.select("vid"), "vid", "left_anti").unionByName(rim), "stamp")
    own = known.select("vid", F.col("s.label").cast("int").alias("site_id"), F.col("s.d").alias("d"))
    return own.join(radii.select("site_id", "radius"), "site_id").where(F.col("d") <= F.greatest(F.col("radius") - shrink, F.lit(0.0))).select("vid", "site_id", "d")


def second_nearest(voxels: DataFrame, sites: DataFrame, shape: Shape, margin: float = 1e-6) -> DataFrame:
    """(vid, site_id, d) of voxels whose nearest site by the free-space distance leads the second by `margin` and is reached by a free
    path of that length: cube diagonals first, then diagonals of the two longer axes, then the longest axis."""
    points = voxels.select(F.col("vid").alias("pid"), "z", "y", "x")
    places = sites.select(F.col("site_id").alias("sid"), "z", "y", "x", F.col("site_id").alias("first"))
    first = written(nearest(points, places, "d26", 4), "first")
    second = nearest(points.join(first.select("pid", F.col("sid").alias("first")), "pid"), places, "d26", 4, unlike="first").select("pid", F.col("dist").alias("next"))
    own = first.join(second, "pid", "left").where(f"next IS NULL OR dist + {margin} <= next")
    own = written(own.join(points, "pid").join(sites.select(F.col("site_id").alias("sid"), *(F.col(c).alias(f"s{c}") for c in "zyx")), "sid"), "ahead")
    seen = _seen_in_blocks(voxels, own.where(F.col("dist") <= BLOCK), shape)
    own = own.where(F.col("dist") > BLOCK)
    return seen if own.isEmpty() else seen.unionByName(_seen_on_lines(voxels, own, shape))


def _seen_in_blocks(voxels: DataFrame, own: DataFrame, shape: Shape) -> DataFrame:
    """second_nearest() for sites within BLOCK: after k steps the path stands min(k, distance) from the site along each axis."""
    reach = math.ceil(own.agg(F.max("dist")).first()[0] or 0)

    def run(frame: Frame, table: pa.Table) -> pa.Table:
        open_ = frame.dense(True, False).reshape(-1)
        asked = frame.inner & table.column("site_id").is_valid().to_numpy(zero_copy_only=False)
        place = [v[asked] for v in frame.place]
        site = [table.column(f"s{c}").fill_null(0).to_numpy()[asked].astype(np.int64) for c in "zyx"]
        away = [p - s for p, s in zip(place, site, strict=True)]
        free = np.ones(len(place[0]), dtype=bool)
        for k in range(max((int(np.abs(a).max(initial=0)) for a in away), default=0)):
            at = [s + np.sign(a) * np.minimum(k, np.abs(a)) for s, a in zip(site, away, strict=True)]
            inside = frame.inside(*at)
            free &= inside
            free[inside] &= open_[frame.flat(*at)[inside]]
        return pa.table([table.column(c).filter(pa.array(asked)).filter(pa.array(free)) for c in ("vid", "site_id", "d")], ["vid", "site_id", "d"])

    ahead = own.select(F.col("pid").alias("vid"), F.col("sid").cast("int").alias("site_id"), F.col("dist").cast("double").alias("d"), *(F.col(f"s{c}").cast("int").alias(f"s{c}") for c in "zyx"))
    rows = voxels.select("vid", *(F.col(c).cast("int").alias(c) for c in "zyx")).join(ahead, "vid", "left")
    return written(blockwise(rows, reach, run, "vid bigint, site_id int, d double", shape=shape), "seen")


def _seen_on_lines(voxels: DataFrame, own: DataFrame, shape: Shape) -> DataFrame:
    """second_nearest() for sites at any distance: both ends of each line of the path are in one run of voxels."""
    delta = {c: F.abs(F.col(c) - F.col(f"s{c}")) for c in "zyx"}
    rank = F.array_sort(F.array(*(F.struct((-delta[c]).alias("n"), F.lit(k).alias("axis")) for k, c in enumerate("zyx"))))
    own = own.withColumn("rank", rank)
    size = [-F.get("rank", F.lit(k))["n"] for k in range(3)]
    sign = {c: F.when(F.col(c) >= F.col(f"s{c}"), 1).otherwise(-1) for c in "zyx"}
    steps = [size[2], size[1] - size[2], size[0] - size[1]]
    at = {c: F.col(f"s{c}") for c in "zyx"}
    ends, lines = [flat(at["z"], at["y"], at["x"], shape)], []
    for n, axes in ((steps[0], 3), (steps[1], 2), (steps[2], 1)):
        part = {c: sum((F.when(F.get("rank", F.lit(j))["axis"] == k, 1).otherwise(0) for j in range(axes)), F.lit(0)) for k, c in enumerate("zyx")}
        move = {c: part[c] * sign[c] for c in "zyx"}
        at = {c: at[c] + n * move[c] for c in "zyx"}
        ends.append(flat(at["z"], at["y"], at["x"], shape))
        code = (move["z"] * 9 + move["y"] * 3 + move["x"]).cast("int")
        lines.append(F.abs(code))  # a line and its reverse have opposite codes
    own = own.select("pid", "sid", "dist", *(e.alias(f"e{k}") for k, e in enumerate(ends)), *(c.alias(f"l{k}") for k, c in enumerate(lines)))
    runs = straight(voxels).select("vid", F.map_from_arrays(F.array(*(F.lit(abs(o[0] * 9 + o[1] * 3 + o[2])) for o in LINES)), F.col("runs")).alias("runs"))
    runs = written(runs, "line-runs")
    for k in range(3):
        a = runs.select(F.col("vid").alias(f"e{k}"), F.col("runs").alias("ra"))
        b = runs.select(F.col("vid").alias(f"e{k + 1}"), F.col("runs").alias("rb"))
        own = own.join(a, f"e{k}").join(b, f"e{k + 1}").where(f"e{k} = e{k + 1} OR ra[l{k}] = rb[l{k}]").drop("ra", "rb")
    return own.select(F.col("pid").alias("vid"), F.col("sid").cast("int").alias("site_id"), F.col("dist").alias("d"))


def region_jumped(voxels: DataFrame, core: DataFrame, shape: Shape) -> DataFrame:
    """(vid, site_id, d) after jumps down to two in the region of interest. core: certain voxels (vid, site_id, d), which send and stay as
    they are; only the others are asked."""
    own = core.select("vid", F.col("site_id").cast("bigint").alias("label"), "d")
    state = written(voxels.select("vid", "z", "y", "x").join(own, "vid", "left").withColumn("open", F.col("label").isNull()), "flood")
    state = jumped_down(state, voxels, shape, 2)
    return state.select("vid", F.col("label").cast("int").alias("site_id"), "d")


def region_settled(voxels: DataFrame, after: DataFrame, shape: Shape) -> DataFrame:
    """(vid, site_id, d) from the state after the jumps: layers for what none has reached, and relaxation until nothing changes."""
    filled = written(closure_fill(voxels, after.where("site_id IS NOT NULL"), shape, digits=None), "closed")
    return settled(voxels, filled, shape)
