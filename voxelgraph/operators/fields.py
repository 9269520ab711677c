"""Ownership, components, cells and faces on voxel domains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.memory import written
from ..plans.relaxation import relaxed, rooted
from .grid import CUBE, FACES, FORWARD, Shape, exposed, flat, neighbours

WEIGHTED = [(*o, float(sum(map(abs, o)) ** 0.5)) for o in CUBE]
UNIT = [(*o, 1.0) for o in FACES]
#: Layers of a fill that one job makes, in blocks with a rim as deep.
LAYERS = 8


def check_sites(pore: DataFrame, sites: DataFrame) -> None:
    """Raises on the first site (least id) that isn't a pore voxel."""
    bad = sites.join(pore.select("vid"), "vid", "left_anti").agg(F.min_by("site_id", "site_id")).first()[0]
    if bad is not None:
        raise ValueError(f"site {bad} is not in the pore space")


def ownership(pore: DataFrame, sites: DataFrame, shape: Shape, weighted: bool = False, periodic_x: bool = False, key: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """(vid, site_id, d): the nearest site by graph distance, the least by `key` (columns of sites) of equally near ones.

    Six unit steps, or 26 with the lengths 1, sqrt 2, sqrt 3. Two sites on one voxel: the lesser by key counts.
    """
    sites = numbered(sites, key) if key != ("site_id",) else sites.withColumn("rank", F.col("site_id").cast("bigint"))
    seeds = sites.groupBy("vid").agg(F.min("rank").alias("rank"))
    state = pore.join(seeds, "vid", "left").select("vid", "z", "y", "x", F.when(F.col("rank").isNotNull(), 0.0).alias("d"), F.col("rank").alias("label"))
    own = relaxed(state, WEIGHTED if weighted else UNIT, shape, periodic_x=periodic_x)
    own = own.select("vid", F.col("label").alias("rank"), F.col("d") if weighted else F.col("d").cast("int").alias("d"))
    own = own.join(sites.select("rank", "site_id"), "rank") if key != ("site_id",) else own.withColumn("site_id", F.col("rank"))
    return own.select("vid", F.col("site_id").cast("int").alias("site_id"), "d")


def numbered(rows: DataFrame, key: tuple[str, ...], name: str = "rank") -> DataFrame:
    """rows with a number from 0 in ascending order of key, by ranges: counts of ranges first, then ranks within them."""
    own = written(rows.repartitionByRange(*key).withColumn("range", F.spark_partition_id()), "ranges")
    counts = own.groupBy("range").count()
    base = counts.select("range", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("range").orderBy(*key)) - 1
    return own.withColumn("rank_in", rank).join(F.broadcast(base), "range").withColumn(name, (F.col("base") + F.col("rank_in")).cast("bigint")).drop("range", "rank_in", "base")


def components(voxels: DataFrame, shape: Shape, label: str | None = None, full: bool = False, periodic_x: bool = False) -> DataFrame:
    """(vid, root): the least vid of the face-connected (or 26-connected) part, of equal labels if one is named."""
    return rooted(voxels, CUBE if full else FACES, shape, label, periodic_x)


def split_cells(voxels: DataFrame, shape: Shape, label: str) -> DataFrame:
    """(vid, label, root, cell_id, cell_by_site): face-connected parts of each label, numbered by least vid, and by label first."""
    own = voxels.join(components(voxels, shape, label), "vid").select("vid", label, "root")
    roots = own.select(label, "root").distinct()
    roots = numbered(numbered(roots, ("root",), "cell_id"), (label, "root"), "cell_by_site")
    return own.join(roots.drop(label), "root").select("vid", label, "root", "cell_id", "cell_by_site")


def facelets(cells: DataFrame, shape: Shape, periodic_x: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Voxel faces between two cells, each once: (owner, neighbor, axis, sign, vid, nb, r_owner2, r_neighbor2).

    cells: vid, z, y, x, cell, d. owner < neighbor; sign is +1 if the owner stands on the lower side; r*2 are twice the
    distances to the sites from the face (2 d + 1), whole numbers.
    """
    pairs = neighbours(cells, cells, FORWARD, shape, periodic_x, ("cell", "d", *keep)).where("cell <> nb_cell")
    low = F.col("cell") < F.col("nb_cell")
    return pairs.select(F.least("cell", "nb_cell").alias("owner"), F.greatest("cell", "nb_cell").alias("neighbor"), F.when(F.col("dx") == 1, 2).when(F.col("dy") == 1, 1).otherwise(0).alias("axis"), F.when(low, 1).otherwise(-1).alias("sign"), "vid", "nb", (2 * F.when(low, F.col("d")).otherwise(F.col("nb_d")) + 1).alias("r_owner2"), (2 * F.when(low, F.col("nb_d")).otherwise(F.col("d")) + 1).alias("r_neighbor2"))


def cell_graph(faces: DataFrame) -> DataFrame:
    """(owner, neighbor, area, conductance, mean_geodesic_length): conductance is the sum of 1 / max(r_owner + r_neighbor, 1e-6)."""
    length = F.greatest((F.col("r_owner2") + F.col("r_neighbor2")) / 2, F.lit(1e-6))
    own = faces.groupBy("owner", "neighbor").agg(F.count("*").alias("area"), F.sum(1 / length).alias("conductance"))
    return own.withColumn("mean_geodesic_length", F.col("area") / F.col("conductance"))


def walls(cells: DataFrame, pore: DataFrame, shape: Shape) -> DataFrame:
    """(cell, wall_area): faces to solid or out of the domain."""
    return exposed(cells, pore, FACES, shape).join(cells.select("vid", "cell"), "vid").groupBy("cell").agg(F.count("*").alias("wall_area"))


def reached(voxels: DataFrame, shape: Shape, offsets: list[tuple] = FACES) -> DataFrame:
    """(vid, n): how many of the offsets lead to a voxel from one of `voxels`; one shuffle, summed before it."""
    moves = F.array(*(F.struct(F.lit(o[0]).alias("dz"), F.lit(o[1]).alias("dy"), F.lit(o[2]).alias("dx")) for o in offsets))
    a = voxels.select("z", "y", "x", F.explode(moves).alias("o")).select((F.col("z") + F.col("o.dz")).alias("z"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    a = a.where((F.col("y") >= 0) & (F.col("y") < shape.height) & (F.col("x") >= 0) & (F.col("x") < shape.width) & (F.col("z") >= 0))
    return a.groupBy(flat(F.col("z"), F.col("y"), F.col("x"), shape).alias("vid")).agg(F.count("*").alias("n"))


def dilated(voxels: DataFrame, every: DataFrame, shape: Shape) -> DataFrame:
    """vid, z, y, x of `every` that are in `voxels` or have a face neighbour there."""
    return every.select("vid", "z", "y", "x").join(reached(voxels, shape, [*FACES, (0, 0, 0)]).select("vid"), "vid", "left_semi")


def closed(pore: DataFrame, every: DataFrame, shape: Shape) -> DataFrame:
    """Binary closing by one face step; the border is background for the erosion: a voxel stays if all six sides are grown."""
    grown = dilated(pore, every, shape)
    return grown.select("vid").join(reached(grown, shape).where(f"n = {len(FACES)}").select("vid"), "vid", "left_semi")


def fill_cracks(labels: DataFrame, shape: Shape, most: int = 1000) -> DataFrame:
    """Unlabelled voxels take the label of their labelled face neighbours if those agree, until none changes.

    labels: vid, z, y, x, label (null: unlabelled).
    """
    state = labels
    for _ in range(most):
        near = neighbours(state.where("label IS NULL"), state.where("label IS NOT NULL").drop("n"), FACES, shape).select("vid", "nb")
        agreed = near.join(state.select(F.col("vid").alias("nb"), "label"), "nb").groupBy("vid").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a = b").select("vid", F.col("a").alias("fill"))
        agreed = written(agreed, "cracks")
        if agreed.isEmpty():
            return state
        state = written(state.join(agreed, "vid", "left").select("vid", "z", "y", "x", F.coalesce("label", "fill").alias("label")), "filled")
    raise RuntimeError("cracks don't settle")


def running(rows: DataFrame, key: str, sums: dict[str, str]) -> DataFrame:
    """rows with running sums in ascending order of key (names: columns), by ranges: sums of ranges first, then within them."""
    own = written(rows.repartitionByRange(key).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("range").agg(*(F.sum(c).alias(f"total_{n}") for n, c in sums.items()))
    base = totals.select("range", *(F.coalesce(F.sum(f"total_{n}").over(before), F.lit(0)).alias(f"base_{n}") for n in sums))  # a row for each partition
    inside = Window.partitionBy("range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({f"in_{n}": F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(base), "range")
    return own.withColumns({n: F.col(f"base_{n}") + F.col(f"in_{n}") for n in sums}).drop("range", *(f"{p}_{n}" for p in ("in", "base") for n in sums))


def moving_average(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(key, smooth): the sum over k rows on either side divided by the whole window, also at the ends."""
    own = numbered(rows.select(key, value), (key,))
    spread = own.select(F.explode(F.sequence(F.col("rank") - k, F.col("rank") + k)).alias("rank"), F.col(value).alias("v"))
    return own.select(key, "rank").join(spread.groupBy("rank").agg((F.sum("v") / (2 * k + 1)).alias("smooth")), "rank").select(key, "smooth")


def closure_fill(voxels: DataFrame, state: DataFrame, shape: Shape, most: int = 1000, digits: int | None = 6) -> DataFrame:
    """(vid, site_id, d): voxels without a label take that of the best neighbour of 26 (d + length, then least label), layer by
    layer, until none is left that touches a labelled one. state: (vid, site_id, d) of the labelled. digits: lengths are rounded to."""
    from .blocks import Frame, blockwise, shifted

    def run(frame: Frame, table: pa.Table) -> pa.Table:
        open_ = frame.dense(True, False)
        d = frame.dense(table.column("d").fill_null(np.inf).to_numpy(), np.inf)
        label = frame.dense(table.column("site_id").fill_null(-1).to_numpy().astype(np.int64), -1)
        for _ in range(LAYERS):
            best, own = np.full_like(d, np.inf), label
            for o in CUBE:
                got, of = shifted(d, o, np.inf) + sum(map(abs, o)) ** 0.5, shifted(label, o, -1)
                got = got if digits is None else np.floor(got * 10**digits + 0.5) / 10**digits
                nearer = (got < best) | (got == best) & (got < np.inf) & (of < own)
                best, own = np.where(nearer, got, best), np.where(nearer, of, own)
            asked = open_ & (label < 0) & (best < np.inf)
            if not asked.any():
                break
            d, label = np.where(asked, best, d), np.where(asked, own, label)
        at, inner = frame.at[frame.inner], table.filter(pa.array(frame.inner))
        d, label = d.reshape(-1)[at], label.reshape(-1)[at].astype(np.int32)
        return pa.table([*(inner.column(c) for c in ("vid", "z", "y", "x")), pa.array(label, mask=label < 0), pa.array(d, mask=label < 0)], ["vid", "z", "y", "x", "site_id", "d"])

    own = state.select("vid", F.col("site_id").cast("int").alias("site_id"), F.col("d").cast("double").alias("d"))
    now = written(voxels.select("vid", *(F.col(c).cast("int").alias(c) for c in "zyx")).join(own, "vid", "left"), "layers")
    open_ = now.where("site_id IS NULL").count()
    for _ in range(0, most, LAYERS):
        left = open_
        now = written(blockwise(now, LAYERS, run, "vid bigint, z int, y int, x int, site_id int, d double", shape=shape), "layers") if left else now
        open_ = now.where("site_id IS NULL").count()
        if open_ in (0, left):
            return now.where("site_id IS NOT NULL").select("vid", "site_id", "d")
    raise RuntimeError(f"not filled after {most} layers")


def free_parts(labels: DataFrame, every: DataFrame, shape: Shape) -> DataFrame:
    """(vid, label, root): parts of each label (vid, z, y, x, label) joined through voxels of `every` without a label."""
    from ..plans.relaxation import contracted

    own = written(labels.select("vid", "z", "y", "x", "label").join(components(labels, shape, "label"), "vid"), "label-parts")
    open_ = every.join(labels.select("vid"), "vid", "left_anti").select("vid", "z", "y", "x")
    open_ = written(open_.join(components(open_, shape), "vid"), "open-parts")
    touch = neighbours(own, open_, FACES, shape).select("vid", "nb").join(own.select("vid", "label", "root"), "vid").join(open_.select(F.col("vid").alias("nb"), F.col("root").alias("gap")), "nb")
    # a gap joins the parts of one label; for another label it is another node: the first part of that label that touches it
    touch = written(touch.select("label", "gap", "root").distinct(), "touch")
    hub = touch.groupBy("label", "gap").agg(F.min("root").alias("hub"))
    pairs = written(touch.join(hub, ["label", "gap"]).where("root <> hub").select(F.col("hub").alias("a"), F.col("root").alias("b")).distinct(), "free-pairs")
    if pairs.isEmpty():
        return own.select("vid", "label", "root")
    joined = contracted(pairs).withColumnRenamed("root", "least").withColumnRenamed("id", "root")
    return own.join(joined, "root", "left").select("vid", "label", F.coalesce("least", "root").alias("root"))


def rectangles(faces: DataFrame, plane: list[str], a: str, b: str) -> DataFrame:
    """(plane columns, a, b, width, height): unit faces of each plane covered greedily by rectangles, from the least (a, b) on,
    as wide as it goes along b, then as high as all of that width goes along a. One plane is held by a task at a time."""
    from ..functions.shipping import ship

    ship(faces.sparkSession)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        left = set(zip(table.column(a).to_pylist(), table.column(b).to_pylist(), strict=True))
        out = []
        for i, j in sorted(left):
            if (i, j) not in left:
                continue
            width, height = 1, 1
            while (i, j + width) in left:
                width += 1
            while all((i + height, j + k) in left for k in range(width)):
                height += 1
            left -= {(i + m, j + k) for m in range(height) for k in range(width)}
            out.append((*(k.as_py() for k in key), i, j, width, height))
        return pa.table([pa.array(c, pa.int32()) for c in zip(*out, strict=True)], [*plane, a, b, "width", "height"])

    return faces.select(*(F.col(c).cast("int").alias(c) for c in (*plane, a, b))).groupBy(*plane).applyInArrow(merge, ", ".join(f"{c} int" for c in (*plane, a, b, "width", "height")))


def placed(asked: DataFrame, bones: DataFrame, shape: Shape, most: int = 1000) -> DataFrame:
    """(site_id, vid): a voxel of the skeleton (vid, z, y, x) of its own for each site; asked: (site_id, vid), the voxel it wants.

    Of the sites that want one voxel the least gets it; the others look along the skeleton, ring by ring, for the nearest free
    voxel (the least of a ring), and again the least site gets it. Raises if a part has fewer voxels than sites.
    """
    spot = bones.select("vid", "z", "y", "x")
    got = written(asked.groupBy("vid").agg(F.min("site_id").alias("site_id")).select("site_id", "vid"), "placed")
    seen = written(asked.join(got.select("site_id"), "site_id", "left_anti").select("site_id", "vid", F.lit(0).alias("ring")), "asked")
    for ring in range(1, most):
        if seen.isEmpty():
            return got
        edge = seen.where(F.col("ring") == ring - 1)
        grown = neighbours(edge.select("vid").distinct().join(spot, "vid"), spot, CUBE, shape).select("vid", "nb").join(edge, "vid").select("site_id", F.col("nb").alias("vid")).distinct()
        seen = written(seen.unionByName(grown.join(seen, ["site_id", "vid"], "left_anti").withColumn("ring", F.lit(ring))), "asked")
        if seen.where(F.col("ring") == ring).isEmpty() and seen.join(got.select("vid"), "vid", "left_anti").isEmpty():
            raise ValueError("a part of the skeleton has fewer voxels than sites")
        bids = seen.join(got.select("vid"), "vid", "left_anti").groupBy("site_id").agg(F.min(F.struct("ring", "vid")).alias("b")).select("site_id", "b.vid")
        won = bids.groupBy("vid").agg(F.min("site_id").alias("site_id")).select("site_id", "vid")
        got = written(got.unionByName(won), "placed")
        seen = written(seen.join(got.select("site_id"), "site_id", "left_anti"), "asked")
    raise RuntimeError(f"sites are not placed after {most} rings")


def skeleton_ownership(pore: DataFrame, sites: DataFrame, shape: Shape) -> DataFrame:
    """(vid, site_id, d): sites (site_id, vid, z, y, x) go to the nearest skeleton voxel of their own 26-connected part, each to one of
    its own (see placed); the skeleton is owned by its neighbours' lengths, and the rest of the pore from there."""
    from .search import nearest
    from .thinning import thinned

    parts = written(components(pore, shape, full=True), "parts")
    bones = written(thinned(pore, shape).join(parts, "vid"), "bones")
    asked = sites.join(parts, "vid").select(F.col("site_id").alias("pid"), "z", "y", "x", "root")
    places = bones.select(F.col("vid").alias("sid"), "z", "y", "x", "root")
    put = placed(nearest(asked, places, "d2", 4, "root").select(F.col("pid").alias("site_id"), F.col("sid").alias("vid")), bones, shape)
    put = put.select("vid", F.col("site_id").cast("bigint").alias("label"))
    state = bones.join(put, "vid", "left").withColumn("d", F.when(F.col("label").isNotNull(), 0.0))
    owned = written(relaxed(state, WEIGHTED, shape), "bone-owners")
    state = pore.select("vid", "z", "y", "x").join(owned, "vid", "left")
    return relaxed(state, WEIGHTED, shape).select("vid", F.col("label").cast("int").alias("site_id"), "d")


def path_to(parents: DataFrame, target: DataFrame, most: int) -> DataFrame:
    """(vid) of the chain from `target` (vid) up the parents (vid, parent), at most `most` steps: jumps of doubling length, so the
    number of joins follows the logarithm of the path."""
    path, jump = target.select("vid"), parents.select("vid", F.col("parent").alias("far"))
    step = 1
    while step <= most:
        path = written(path.unionByName(path.join(jump, "vid").select(F.col("far").alias("vid"))), "path")
        jump = written(jump.join(jump.select(F.col("vid").alias("far"), F.col("far").alias("end")), "far").select("vid", F.col("end").alias("far")), "jumps")
        step *= 2
    return path
