"""Flooding, stamping, thinning, bridges, lines, quantiles and assertions against plain re-computation."""

from __future__ import annotations

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgraph.operators import bridging, checks, fields, flooding, thinning, tracing
from voxelgraph.operators.grid import CUBE, Shape
from voxelgraph.operators.quantiles import quantiles


def frame(spark, mask: np.ndarray, **columns):
    """Voxels of a mask as (vid, z, y, x, columns)."""
    z, y, x = np.nonzero(mask)
    vid = (z * mask.shape[1] + y) * mask.shape[2] + x
    rows = [tuple(r) for r in np.stack([vid, z, y, x], 1).tolist()]
    extra = [v[z, y, x].tolist() for v in columns.values()]
    schema = "vid bigint, z int, y int, x int" + "".join(f", {c} double" for c in columns)
    return spark.createDataFrame([(*r, *e) for r, *e in zip(rows, *extra, strict=True)], schema)


def random_mask(seed: int, size: tuple, share: float = 0.7) -> np.ndarray:
    return np.random.default_rng(seed).random(size) < share


def sites_in(spark, mask: np.ndarray, n: int, seed: int = 1):
    own = np.argwhere(mask)
    own = own[np.random.default_rng(seed).choice(len(own), n, replace=False)]
    h, w = mask.shape[1:]
    rows = [(i, int((z * h + y) * w + x), int(z), int(y), int(x)) for i, (z, y, x) in enumerate(own)]
    return rows, spark.createDataFrame(rows, "site_id int, vid bigint, z int, y int, x int")


def exact(mask: np.ndarray, rows: list) -> dict[int, tuple[float, int]]:
    h, w = mask.shape[1:]
    best: dict[int, tuple[float, int]] = {}
    heap = [(0.0, i, z, y, x) for i, _, z, y, x in rows]
    heapq.heapify(heap)
    while heap:
        d, i, z, y, x = heapq.heappop(heap)
        vid = (z * h + y) * w + x
        if vid in best and (best[vid][0] < d - 1e-9 or best[vid][1] <= i):
            continue
        best[vid] = (min(d, best.get(vid, (d, i))[0]), i)
        for dz, dy, dx in CUBE:
            a, b, c = z + dz, y + dy, x + dx
            if 0 <= a < mask.shape[0] and 0 <= b < h and 0 <= c < w and mask[a, b, c]:
                heapq.heappush(heap, (d + math.sqrt(abs(dz) + abs(dy) + abs(dx)), i, a, b, c))
    return best


def plain_flood(mask: np.ndarray, rows: list) -> dict[int, tuple[float, int]]:
    """Jumps of halving length over all voxels at once, with a test of every voxel between."""
    h, w = mask.shape[1:]
    state = {tuple(r[2:]): (0.0, r[0]) for r in rows}
    jump = 1 << (max(mask.shape).bit_length() - 1)
    while jump:
        now = dict(state)
        for z, y, x in np.argwhere(mask).tolist():
            best = state.get((z, y, x), (1e300, -1))
            for dz, dy, dx in CUBE:
                way = [(z + t * dz, y + t * dy, x + t * dx) for t in range(1, jump + 1)]
                if way[-1] in state and all(0 <= a < mask.shape[0] and 0 <= b < h and 0 <= c < w and mask[a, b, c] for a, b, c in way):
                    d, label = state[way[-1]]
                    step = d + jump * math.sqrt(abs(dz) + abs(dy) + abs(dx))
                    best = (step, label) if step < best[0] else best
            if best[1] >= 0:
                now[z, y, x] = best
        state, jump = now, jump // 2
    return {(z * h + y) * w + x: v for (z, y, x), v in state.items()}


def test_jump_flooding_step_by_step_and_relaxed(spark):
    mask = random_mask(3, (5, 9, 11), 0.6)
    shape = Shape(9, 11)
    rows, sites = sites_in(spark, mask, 6)
    voxels = frame(spark, mask)
    outside = sites.unionByName(spark.createDataFrame([(99, -1, 0, 0, 0)], sites.schema))
    flooded = flooding.flooded(voxels, outside, shape, relax=0)
    got = {r.vid: (r.d, r.site_id) for r in flooded.collect() if r.site_id is not None}
    assert got == plain_flood(mask, rows)
    want = exact(mask, rows)
    after = {r.vid: (r.d, r.site_id) for r in flooding.settled(voxels, flooded, shape).collect()}
    assert after.keys() == want.keys() and all(abs(after[v][0] - want[v][0]) < 1e-9 and after[v][1] == want[v][1] for v in want)


def test_stamped_cores_are_certain_and_bounded(spark):
    mask = random_mask(5, (6, 12, 14), 0.8)
    shape = Shape(12, 14)
    rows, sites = sites_in(spark, mask, 5)
    voxels = frame(spark, mask)
    free = lambda a, b: (lambda s: s[0] - s[1] + math.sqrt(2) * (s[1] - s[2]) + math.sqrt(3) * s[2])(sorted((abs(p - q) for p, q in zip(a, b, strict=True)), reverse=True))
    radius = [min(free(a[2:], b[2:]) for b in rows if b != a) / 2 - 0.25 for a in rows]
    radii = sites.join(spark.createDataFrame(list(enumerate(radius)), "site_id int, radius double"), "site_id")
    want = {v: x for v, x in exact(mask, rows).items() if x[0] <= max(radius[x[1]], 0.0)}
    got = {r.vid: (r.d, r.site_id) for r in flooding.stamped(voxels, radii, shape).collect()}
    assert got.keys() == want.keys() and all(abs(got[v][0] - want[v][0]) < 1e-9 and got[v][1] == want[v][1] for v in want)
    more = {r.vid: (r.d, r.site_id) for r in flooding.stamped(voxels, radii, shape, "D").collect()}
    every = exact(mask, rows)
    assert more.keys() > got.keys() and all(abs(more[v][0] - every[v][0]) < 1e-6 and more[v][1] == every[v][1] for v in more)
    after = flooding.region_jumped(voxels, flooding.stamped(voxels, radii, shape), shape)
    end = flooding.region_settled(voxels, after, shape)
    assert {r.vid: r.site_id for r in end.collect()} == {v: i for v, (_, i) in every.items()}
    kept = {r.vid: (r.d, r.site_id) for r in after.collect()}
    assert all(kept[v] == got[v] for v in got)


def test_fast_mode_stops_after_sixteen_steps(spark):
    voxels = frame(spark, np.ones((1, 1, 60), dtype=bool))
    radii = spark.createDataFrame([(0, 0, 0, 0, 0, 40.0)], "site_id int, vid bigint, z int, y int, x int, radius double")
    assert flooding.stamped(voxels, radii, Shape(1, 60), "A").agg(F.max("d")).first()[0] == 16
    assert flooding.stamped(voxels, radii, Shape(1, 60), "C").agg(F.max("d")).first()[0] == 40


def solids() -> list[tuple[str, np.ndarray, int]]:
    """Name, mask, Euler number: a ball, a ring, a shell around a cavity, two handles, all across tile borders, and noise."""
    z, y, x = np.mgrid[0:11, 0:40, 0:44]
    ring = (np.hypot(y - 20, x - 22) > 9) & (np.hypot(y - 20, x - 22) < 16) & (abs(z - 5) < 3)
    ball = (z - 5) ** 2 + (y - 31) ** 2 + (x - 32) ** 2 <= 25
    shell = ball & ((z - 5) ** 2 + (y - 31) ** 2 + (x - 32) ** 2 > 4)
    plate = (abs(z - 5) < 2) & (y > 5) & (y < 36) & (x > 5) & (x < 40) & ~((abs(y - 12) < 3) & (abs(x - 15) < 3)) & ~((abs(y - 27) < 3) & (abs(x - 31) < 3))
    return [("ball", ball, 1), ("ring", ring, 0), ("shell", shell, 2), ("plate", plate, -1)]


@pytest.mark.parametrize("name,mask,euler", solids(), ids=lambda x: x if isinstance(x, str) else "")
def test_thinning_keeps_components_tunnels_and_cavities(spark, name, mask, euler):
    shape = Shape(*mask.shape[1:])
    bones = thinning.thinned(frame(spark, mask), shape)
    own = bones.join(fields.components(bones, shape, full=True), "vid")
    assert [r.euler for r in thinning.euler_numbers(own).collect()] == [euler]
    assert 0 < bones.count() < (mask.sum() / 2 if name == "shell" else mask.sum() / 8)


def test_thinning_of_noise(spark):
    mask = random_mask(11, (6, 20, 35), 0.55)
    shape = Shape(20, 35)
    voxels = frame(spark, mask)
    parts = voxels.join(fields.components(voxels, shape, full=True), "vid")
    bones = thinning.thinned(voxels, shape)
    own = bones.join(parts.select("vid", "root"), "vid")
    numbers = lambda df: {r.root: r.euler for r in thinning.euler_numbers(df).collect()}
    assert numbers(own) == numbers(parts)
    pieces = fields.components(bones, shape, full=True).select("root").distinct().count()
    assert pieces == parts.select("root").distinct().count() and bones.count() < mask.sum()


def test_sites_get_voxels_of_their_own(spark):
    bones = frame(spark, np.ones((1, 1, 8), dtype=bool))
    asked = spark.createDataFrame([(3, 2), (1, 2), (2, 2), (0, 5)], "site_id int, vid bigint")
    got = {r.site_id: r.vid for r in fields.placed(asked, bones, Shape(1, 8)).collect()}
    assert got == {0: 5, 1: 2, 2: 1, 3: 3}
    with pytest.raises(ValueError, match="fewer voxels"):
        fields.placed(spark.createDataFrame([(i, 0) for i in range(9)], "site_id int, vid bigint"), bones, Shape(1, 8))


def test_bridges_join_the_parts_of_a_plane(spark):
    rng = random.Random(4)
    mask = np.zeros((2, 30, 60), dtype=bool)
    for plane in mask:
        for k in range(4):
            y, x = rng.randint(0, 22), 15 * k + rng.randint(0, 4)
            plane[y : y + 6, x : x + 7] = True
        plane[29, 59] = True  # a crumb, not bridged
    voxels, shape = frame(spark, mask), Shape(30, 60)
    out, pairs = bridging.bridged(voxels, shape, 2, least=20)
    parts = {r.vid: r.root for r in bridging.plane_parts(voxels, shape, 20).collect()}
    for r in pairs.collect():
        at = lambda v: divmod(v % 1800, 60)
        left, right = ([at(v) for v, p in parts.items() if p == side] for side in (r.left, r.right))
        assert r.d2 == min((a - c) ** 2 + (b - d) ** 2 for a, b in left for c, d in right)
        (a, b), (c, d) = at(r.a), at(r.b)
        assert (a - c) ** 2 + (b - d) ** 2 == r.d2
    assert pairs.count() == 6
    joined = bridging.plane_parts(out, shape, 20)
    assert [r["count"] for r in joined.select("z", "root").distinct().groupBy("z").count().collect()] == [1, 1]
    assert out.join(voxels, "vid").count() == voxels.count()


def plain_line(field: np.ndarray, start: tuple, steps: int) -> tuple[list, str]:
    path = [start]
    while True:
        z, y, x = path[-1]
        if x >= field.shape[2] - 2 or field[z, y, x] <= 0.02:
            return path, "reached"
        if len(path) > steps:
            return path, "long"
        near = [(field[p] - 0.015 * o[2], k, p) for k, o in enumerate(tracing.ORDER) for p in [(z + o[0], y + o[1], x + o[2])] if all(0 <= v < n for v, n in zip(p, field.shape, strict=True)) and not np.isnan(field[p]) and p not in path]
        if not near:
            return path, "stuck"
        to = min(near)[2]
        if field[to] > field[z, y, x] + 0.02:
            return path, "rises"
        path.append(to)


@pytest.mark.parametrize("steps", [1600, 20])
def test_streamlines_cross_tiles(spark, steps):
    rng = np.random.default_rng(2)
    field = 1 - np.mgrid[0:5, 0:40, 0:70][2] / 69 + rng.normal(0, 0.004, (5, 40, 70))
    field[rng.random(field.shape) < 0.15] = np.nan
    field[:, 5, 20:25] = np.nan
    field[2, 20, 10] = 0.0
    voxels = frame(spark, ~np.isnan(field), p=field)
    starts = [(z, y, x) for z, y, x in [(0, 3, 1), (2, 20, 3), (4, 39, 2), (1, 33, 31), (3, 31, 0), (2, 10, 68)] if not np.isnan(field[z, y, x])]
    ids = spark.createDataFrame([(i, (z * 40 + y) * 70 + x) for i, (z, y, x) in enumerate(starts)] + [(77, -5)], "line_id bigint, vid bigint")
    rows = tracing.streamlines(ids, voxels, "p", Shape(40, 70), steps).collect()
    for i, start in enumerate(starts):
        own = sorted((r.seq, r.vid, r.state) for r in rows if r.line_id == i)
        path, state = plain_line(field, start, steps)
        assert [v for _, v, _ in own] == [(z * 40 + y) * 70 + x for z, y, x in path] and {s for *_, s in own} == {state}
    assert {r.line_id for r in rows} == set(range(len(starts)))
    assert tracing.streamlines(ids, voxels, "p", Shape(40, 70), steps, least=10**6).count() == 0


@pytest.mark.parametrize("bins", [3, 1024])
def test_quantiles_by_counting(spark, bins):
    rng = np.random.default_rng(3)
    groups = {"one": [5.0], "tied": [1.0] * 900 + [2.0], "hot": [0.25] * 400 + rng.normal(0, 1e6, 300).tolist(), "near": (1 + np.arange(50) * 1e-15).tolist(), "low": (-rng.random(333)).tolist()}
    rows = [(g, v) for g, own in groups.items() for v in own] + [("one", None), ("none", None)]
    asked = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    got = {(r.g, r.fraction): r.quantile for r in quantiles(spark.createDataFrame(rows, "g string, v double"), "v", asked, ["g"], bins).collect()}
    assert got.keys() == {(g, f) for g in groups for f in asked}
    for (g, f), q in got.items():
        assert q == pytest.approx(np.quantile(groups[g], f), rel=1e-12, abs=1e-15)
    whole = quantiles(spark.createDataFrame(rows, "g string, v double"), "v", asked, bins=bins).collect()
    assert {r.fraction: pytest.approx(r.quantile, rel=1e-12) for r in whole} == {f: np.quantile([v for own in groups.values() for v in own], f) for f in asked}
    assert quantiles(spark.createDataFrame([], "v double"), "v", asked).count() == 0


def test_assertions_fail_with_the_first_offender(spark):
    rows = spark.createDataFrame([(1, 2, "a"), (5, 9, "b"), (4, 7, "c")], "owner int, neighbor int, v string")
    edges = spark.createDataFrame([(1, 2, 0.5)], "owner int, neighbor int, area double")
    with pytest.raises(Exception, match=r'faces without an edge: 2, first \{"owner":4,"neighbor":7\}'):
        checks.looked_up(rows, edges, ["owner", "neighbor"], "faces without an edge").collect()
    assert checks.looked_up(rows.limit(1), edges, ["owner", "neighbor"], "none").count() == 1
    with pytest.raises(Exception, match=r'off: 1, first \{"owner":5\}'):
        checks.every(rows, "owner < 5", ["owner"], "off").collect()
    with pytest.raises(Exception, match="nothing is left"):
        checks.some(rows.where("owner > 9"), "nothing is left").collect()
    assert checks.some(rows, "nothing is left").count() == 3


def test_direct_solution_takes_over(spark):
    """A random network across many tiles, badly scaled: few steps of conjugate gradients, the direct solution, dense algebra."""
    from voxelgraph.operators import dissection

    rng = np.random.default_rng(5)
    mask = random_mask(6, (7, 19, 21), 0.8)
    own = {tuple(p): i for i, p in enumerate(np.argwhere(mask).tolist())}
    dense = np.diag(rng.random(len(own)) * 1e-4)
    for (z, y, x), i in own.items():
        for o in ((0, 0, 1), (0, 1, 0), (1, 0, 0)):
            j = own.get((z + o[0], y + o[1], x + o[2]))
            if j is not None:
                t = 10 ** rng.uniform(-4, 4)
                dense[[i, j, i, j], [i, j, j, i]] += [t, t, -t, -t]
    b = rng.normal(size=len(own))
    at = np.argwhere(dense)
    matrix = spark.createDataFrame([(int(i), int(j), float(dense[i, j])) for i, j in at], "row bigint, col bigint, val double")
    rhs = spark.createDataFrame(list(enumerate(b.tolist())), "row bigint, rhs double")
    places = spark.createDataFrame([(i, *p) for p, i in own.items()], "row bigint, z int, y int, x int")
    x = {r.row: r.val for r in dissection.solved(matrix, rhs, places, most=3).collect()}
    got = np.array([x[i] for i in range(len(own))])
    assert np.abs(dense @ got - b).max() < 1e-6 and np.allclose(got, np.linalg.solve(dense, b), rtol=1e-6, atol=1e-6)
