"""Queries against DuckDB on the smallest tables, and literal fixtures."""

from __future__ import annotations

import os
import random
from collections import Counter, deque
from decimal import Decimal

import duckdb
import pytest

from voxelgraph import catalog
from voxelgraph.frames import FRAMES
from voxelgraph.operators import algebra, fields
from voxelgraph.operators.grid import Shape, with_coordinates
from voxelgraph.plans import relaxation
from voxelgraph.sources import tables

SF = "/root/testdata/sf0.001"
#: Statements that use each relation once or more, and every DataFrame query; with EVERY=1 in the environment all that are registered.
CORE = ["i1_geodesic_ownership", "i2_weighted_distances", "i3_coordinate_key_ownership", "i14_stamped_core", "i22_components", "i23_split_cells", "a1_bellman_certificate", "a8_accuracy", "a9_cut_rate", "a11_cut_breakdown", "a14_cell_graph", "a15_face_vectors", "a16_geodesic_metric", "a17_wall_facelets", "a18_wall_transmissibility", "a20_wall_contacts", "a29_projection_audit", "a30_stage_audit", "f11_label_boundary", "f24_best_wall_segment", "gn8_binary_closing", "j4_periodic_pairs", "j14_lattice_candidates", "l2_resistor_matrix", "l3_pressure_solution", "l8_conservative_projection", "l10_cell_velocity", "l12_lsq_gradient", "l13_scalar_stokes", "l15_monolithic_stokes", "l16_pressure_modes", "l17_momentum_predictor", "l18_block_cg", "l19_time_loop", "l21_flux_error", "w2_best_row", "w3_stratified_sample", "x1_selector", "x3_evidence_routing", "x8_wall_scale"]
NAMES = list(catalog.QUERIES) if os.environ.get("EVERY") else [*CORE, *FRAMES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    v = float(v) if isinstance(v, Decimal) else v
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_against_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = duck.sql(catalog.SQL[name])
    assert cols == sorted(want.columns), name
    assert got == Counter(tuple(plain(v) for _, v in sorted(zip(want.columns, r, strict=True))) for r in want.fetchall())


def box(spark, shape: Shape, solid: set[int]):
    n = shape.depth * shape.height * shape.width
    return with_coordinates(spark.createDataFrame([(v,) for v in range(n) if v not in solid], "vid bigint"), shape)


def test_graph_11_by_8(spark):
    """82 pore voxels; the coordinate as tie key owns 29 / 29 / 24, the site index 29 / 32 / 21."""
    shape = Shape(8, 11, 1)
    pore = box(spark, shape, {y * 11 + x for x, y in ((4, 4), (4, 5), (4, 6), (7, 0), (8, 0), (8, 1))})
    sites = with_coordinates(spark.createDataFrame([(i, y * 11 + x) for i, (x, y) in enumerate(((1, 1), (9, 1), (2, 6)))], "site_id int, vid bigint"), shape)
    fields.check_sites(pore, sites)
    own = fields.ownership(pore, sites, shape).collect()
    assert len(own) == 82 and max(r.d for r in own) == 7
    assert Counter(r.site_id for r in own) == {0: 29, 1: 32, 2: 21}
    by_place = fields.ownership(pore, sites, shape, key=("x", "y")).collect()
    assert Counter(r.site_id for r in by_place) == {0: 29, 1: 29, 2: 24} and {r.vid: r.d for r in by_place} == {r.vid: r.d for r in own}


def test_site_in_solid_is_refused(spark):
    shape = Shape(1, 4, 1)
    with pytest.raises(ValueError, match="site 3"):
        fields.check_sites(box(spark, shape, {2}), spark.createDataFrame([(3, 2)], "site_id int, vid bigint"))


def test_two_blocks_and_many_tiles(spark):
    """Two blocks share nine facelets; a serpentine path crosses tiles and is followed to its end."""
    shape = Shape(3, 6, 3)
    cells = box(spark, shape, set()).selectExpr("vid", "z", "y", "x", "CAST(x >= 3 AS INT) AS cell", "0 AS d")
    graph = fields.cell_graph(fields.facelets(cells, shape)).collect()
    assert [(r.owner, r.neighbor, r.area, r.conductance) for r in graph] == [(0, 1, 9, 9.0)]
    wide = Shape(4, 80, 1)
    solid = {1 * 80 + x for x in range(79)} | {2 * 80 + x for x in range(79)}
    pore = box(spark, wide, solid)
    site = with_coordinates(spark.createDataFrame([(0, 0)], "site_id int, vid bigint"), wide)
    got = {r.vid: r.d for r in fields.ownership(pore, site, wide).collect()}
    free, want, queue = set(range(320)) - solid, {0: 0}, deque([0])
    while queue:
        v = queue.popleft()
        for nb in [v - 80, v + 80] + ([v - 1] if v % 80 else []) + ([v + 1] if v % 80 < 79 else []):
            if nb in free and nb not in want:
                want[nb] = want[v] + 1
                queue.append(nb)
    assert got == want
    assert {r.root for r in fields.components(pore, wide).collect()} == {0}


def test_projection_of_seven_edges(spark):
    edges = [(0, 1, 0.66), (1, 2, -0.52), (0, 3, 0.59), (1, 4, 0.11), (3, 4, -0.11), (4, 5, 0.14), (2, 5, -0.11)]
    want = [0.0187, -0.2153, -0.0187, 0.2340, -0.0187, 0.2153, -0.2153]
    flux = spark.createDataFrame(edges, "owner int, neighbor int, q double")
    got = {(r.owner, r.neighbor): r.q_conservative for r in algebra.projected(flux).collect()}
    assert [round(got[a, b], 4) for a, b, _ in edges] == want


def plain_ownership(pore: set[int], sites: dict[int, int], shape: Shape, offsets, periodic: bool) -> dict[int, tuple[float, int]]:
    best = {v: (0.0, s) for s, v in sorted(sites.items(), reverse=True)}
    again = True
    while again:
        again = False
        for v, (d, s) in list(best.items()):
            z, y, x = v // (shape.height * shape.width), v // shape.width % shape.height, v % shape.width
            for dz, dy, dx, w in offsets:
                nx = (x + dx) % shape.width if periodic else x + dx
                if 0 <= y + dy < shape.height and 0 <= nx < shape.width and 0 <= z + dz < shape.depth:
                    nb = ((z + dz) * shape.height + y + dy) * shape.width + nx
                    if nb in pore and (nb not in best or d + w < best[nb][0] - 1e-9 or abs(d + w - best[nb][0]) <= 1e-9 and s < best[nb][1]):
                        best[nb] = (min(d + w, best.get(nb, (d + w,))[0]), s)
                        again = True
    return best


@pytest.mark.parametrize(("shape", "periodic"), [(Shape(4, 70, 2), True), (Shape(35, 20, 3), True), (Shape(34, 66, 2), False), (Shape(3, 64, 1), True)])
def test_fixpoints_across_tiles_and_ends(spark, shape, periodic):
    rng = random.Random(shape.width)
    n = shape.depth * shape.height * shape.width
    solid = set(rng.sample(range(n), n // 3))
    pore = box(spark, shape, solid)
    free = [v for v in range(n) if v not in solid]
    sites = dict(enumerate(rng.sample(free, 6)))
    seeds = with_coordinates(spark.createDataFrame([(s, v) for s, v in sites.items()], "site_id int, vid bigint"), shape)
    for weighted in (False, True):
        got = {r.vid: (round(r.d, 6), r.site_id) for r in fields.ownership(pore, seeds, shape, weighted, periodic).collect()}
        want = plain_ownership(set(free), sites, shape, fields.WEIGHTED if weighted else fields.UNIT, periodic)
        assert got == {v: (round(d, 6), s) for v, (d, s) in want.items()}
    roots = {r.vid: r.root for r in fields.components(pore, shape, periodic_x=periodic).collect()}
    flood: dict[int, int] = {}
    for v in free:
        if v not in flood:
            flood |= dict.fromkeys(plain_ownership(set(free), {0: v}, shape, fields.UNIT, periodic), v)
    assert roots == flood


def test_contraction_by_stars(spark):
    rng = random.Random(2)
    pairs = {tuple(sorted(rng.sample(range(200), 2))) for _ in range(150)}
    df = spark.createDataFrame(sorted(pairs), "a bigint, b bigint")
    few, many = ({r.id: r.root for r in relaxation.contracted(df, most).collect()} for most in (1000, 0))
    assert few == many and all(few[a] == few[b] for a, b in pairs)


def test_cracks(spark):
    shape = Shape(1, 5, 1)
    rows = [(0, 0, 0, 0, 7), (1, 0, 0, 1, None), (2, 0, 0, 2, None), (3, 0, 0, 3, 7), (4, 0, 0, 4, 9)]
    filled = fields.fill_cracks(spark.createDataFrame(rows, "vid bigint, z int, y int, x int, label bigint"), shape)
    assert [r.label for r in filled.orderBy("vid").collect()] == [7, 7, 7, 7, 9]
