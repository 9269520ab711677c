"""Every registered query of the library and the DuckDB SQL with the same rows.

A query is one statement over named relations. For Spark the relations are DataFrames built by the library's operators (grid
joins, tile-blocked fixpoints, facelets); for DuckDB they are independent common table expressions in PRELUDE. Statements
that stand for a DataFrame operator as such name only the relation it returns.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import algebra, dissection, fields, flooding, generators, grid, metric, search, stokes
from .plans.memory import kept, written
from .statements import STATEMENTS

#: Tables of the domain; statements may also name {relations}.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _vox(spark: SparkSession, d: str) -> DataFrame:
    return grid.from_orders(spark, d)


def _pore(spark: SparkSession, d: str) -> DataFrame:
    return _vox(spark, d).where("pore")


def _site(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "site", lambda s, p: grid.sites_of(_vox(s, p)))


def _edge(spark: SparkSession, d: str) -> DataFrame:
    return grid.neighbours(_pore(spark, d), _pore(spark, d), grid.FACES, grid.ORDERS).select(F.col("vid").alias("src"), F.col("nb").alias("dst"), "dz", "dy", "dx")


def _edge26(spark: SparkSession, d: str) -> DataFrame:
    return grid.neighbours(_pore(spark, d), _pore(spark, d), grid.CUBE, grid.ORDERS).select(F.col("vid").alias("src"), F.col("nb").alias("dst"), "dz", "dy", "dx", (F.abs("dz") + F.abs("dy") + F.abs("dx")).alias("w2"))


def _forward(spark: SparkSession, d: str) -> DataFrame:
    return grid.neighbours(_pore(spark, d), _pore(spark, d), grid.FORWARD, grid.ORDERS).select(F.col("vid").alias("src"), F.col("nb").alias("dst"), "dz", "dy", "dx")


def _wrapped(spark: SparkSession, d: str) -> DataFrame:
    return grid.neighbours(_pore(spark, d), _pore(spark, d), grid.FORWARD, grid.ORDERS, periodic_x=True).select(F.col("vid").alias("src"), F.col("nb").alias("dst"), "dz", "dy", "dx")


def _owner(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "owner", lambda s, p: fields.ownership(_pore(s, p), _site(s, p), grid.ORDERS))


def _owner26(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "owner26", lambda s, p: fields.ownership(_pore(s, p), _site(s, p), grid.ORDERS, weighted=True))


def _single(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "single", lambda s, p: fields.ownership(_pore(s, p), _site(s, p).where("site_id = 0"), grid.ORDERS))


def _comp(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "comp", lambda s, p: fields.components(_pore(s, p), grid.ORDERS))


def _block(spark: SparkSession, d: str) -> DataFrame:
    """Block agglomeration labels and their face-connected parts."""
    label = (F.floor(F.col("z") / 3) * 6 + F.floor(F.col("y") / 5)) * 10 + F.floor(F.col("x") / 5)
    return kept(spark, d, "block", lambda s, p: fields.split_cells(_pore(s, p).withColumn("label", label.cast("bigint")), grid.ORDERS, "label"))


def _cellvox(spark: SparkSession, d: str) -> DataFrame:
    return _pore(spark, d).join(_owner(spark, d), "vid").withColumnRenamed("site_id", "cell")


def _face(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "face", lambda s, p: fields.facelets(_cellvox(s, p), grid.ORDERS))


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return fields.cell_graph(_face(spark, d))


def _wall(spark: SparkSession, d: str) -> DataFrame:
    return fields.walls(_cellvox(spark, d), _pore(spark, d), grid.ORDERS)


def _closed(spark: SparkSession, d: str) -> DataFrame:
    return fields.closed(_pore(spark, d), _vox(spark, d), grid.ORDERS)


def _exposed(spark: SparkSession, d: str) -> DataFrame:
    return grid.exposed(_pore(spark, d), _pore(spark, d), grid.FACES, grid.ORDERS)


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return algebra.laplacian(_graph(spark, d).withColumn("t", F.col("conductance")))


def _contact(spark: SparkSession, d: str) -> DataFrame:
    """Faces between a pore voxel and a solid one."""
    return grid.neighbours(_pore(spark, d), _vox(spark, d).where("NOT pore"), grid.FACES, grid.ORDERS)


def _side26(spark: SparkSession, d: str) -> DataFrame:
    """Pore voxels and all 26 neighbours in the domain, pore or not."""
    own = grid.neighbours(_pore(spark, d), _vox(spark, d), grid.CUBE, grid.ORDERS, keep=("pore",))
    return own.select(F.col("vid").alias("src"), F.col("nb").alias("dst"), "dz", "dy", "dx", (F.abs("dz") + F.abs("dy") + F.abs("dx")).alias("w2"), F.col("nb_pore").alias("pore"))


def _bykey(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "bykey", lambda s, p: fields.ownership(_pore(s, p), _site(s, p), grid.ORDERS, key=("x", "y", "z")))


def _press(spark: SparkSession, d: str) -> DataFrame:
    """The state of each cell: the value at its site."""
    return _site(spark, d).join(_vox(spark, d).select("vid", "val"), "vid").select(F.col("site_id").alias("cell"), (F.col("val") / 500000).alias("p"))


def _fluxes(spark: SparkSession, d: str) -> DataFrame:
    """Target fluxes: g (p_a - p_b) within, area (p - 1) at the inlet (neighbor -1), area p at the outlet (-2)."""
    p = _press(spark, d)
    own = _graph(spark, d).join(p.select(F.col("cell").alias("owner"), F.col("p").alias("pa")), "owner").join(p.select(F.col("cell").alias("neighbor"), F.col("p").alias("pb")), "neighbor")
    inner = own.select("owner", "neighbor", F.lit("internal").alias("kind"), "conductance", (F.col("conductance") * (F.col("pa") - F.col("pb"))).alias("q"))
    ends = _pore(spark, d).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    area = _cellvox(spark, d).join(F.broadcast(ends), (F.col("x") == F.col("lo")) | (F.col("x") == F.col("hi"))).groupBy("cell", (F.col("x") == F.col("lo")).alias("inlet")).count().join(p, "cell")
    q = F.col("count") * (F.col("p") - F.when(F.col("inlet"), 1.0).otherwise(0.0))
    border = area.select(F.col("cell").alias("owner"), F.when(F.col("inlet"), -1).otherwise(-2).alias("neighbor"), F.when(F.col("inlet"), "inlet").otherwise("outlet").alias("kind"), F.col("count").cast("double").alias("conductance"), q.alias("q"))
    return inner.unionByName(border)


def _flux(spark: SparkSession, d: str) -> DataFrame:
    return _fluxes(spark, d).where("kind = 'internal'").select("owner", "neighbor", "conductance", "q")


def _balance(spark: SparkSession, d: str) -> DataFrame:
    """(cell, div, after): what leaves each cell before and after the projection."""

    def build(s: SparkSession, p: str) -> DataFrame:
        own = algebra.projected(_fluxes(s, p).select("owner", "neighbor", "q"))
        after = algebra.divergence(own, "q_conservative").withColumnRenamed("div", "after")
        return algebra.divergence(own).join(after, "row").withColumnRenamed("row", "cell")

    return kept(spark, d, "balance", build)


def _cellgeo(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "cellgeo", lambda s, p: metric.cells(_cellvox(s, p)))


def _facegeo(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "facegeo", lambda s, p: metric.face_vectors(_face(s, p), _pore(s, p)))


def _metric(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "metric", lambda s, p: metric.geodesic_metric(_facegeo(s, p), _cellgeo(s, p)))


def _twall(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "twall", lambda s, p: metric.wall_transmissibility(_cellvox(s, p), _pore(s, p), _cellgeo(s, p), grid.ORDERS, 0))


def _metricflux(spark: SparkSession, d: str) -> DataFrame:
    p = _press(spark, d)
    own = _metric(spark, d).join(p.select(F.col("cell").alias("owner"), F.col("p").alias("pa")), "owner").join(p.select(F.col("cell").alias("neighbor"), F.col("p").alias("pb")), "neighbor")
    return own.select("owner", "neighbor", (F.col("t") * (F.col("pa") - F.col("pb"))).alias("q"))


def _gradient(spark: SparkSession, d: str) -> DataFrame:
    return metric.lsq_gradient(_metric(spark, d), _press(spark, d).withColumnRenamed("p", "v"), 0.01)


def _latsite(spark: SparkSession, d: str) -> DataFrame:
    """Sites of the half-offset lattice with a stride of four."""
    own = kept(spark, d, "latsite", lambda s, p: fields.numbered(generators.lattice(_pore(s, p), (4, 4, 4), required=False), ("vid",), "site_id"))
    return own.withColumn("site_id", F.col("site_id").cast("int"))


def _latcand(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "latcand", lambda s, p: search.lattice_candidates(_pore(s, p), _latsite(s, p), (4, 4, 4), (2, 2, 2)))


def _latowner(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "latowner", lambda s, p: fields.ownership(_pore(s, p), _latsite(s, p), grid.ORDERS))


def _stampradius(spark: SparkSession, d: str) -> DataFrame:
    """Half the distance to the nearest other site less a quarter; one site alone has no bound."""

    def build(s: SparkSession, p: str) -> DataFrame:
        site = _site(s, p)
        near = search.nearest(site.withColumnRenamed("site_id", "pid"), site.withColumnRenamed("site_id", "sid"), "d26", 8, other=True)
        own = site.select("site_id").join(near.select(F.col("pid").alias("site_id"), F.col("sid"), "dist"), "site_id", "left")
        return own.select("site_id", F.col("sid").alias("other"), "dist", F.coalesce(F.greatest(F.lit(0.0), F.col("dist") / 2 - 0.25), F.lit(1e10)).alias("radius"))

    return kept(spark, d, "stampradius", build)


def _stampcore(spark: SparkSession, d: str) -> DataFrame:
    def build(s: SparkSession, p: str) -> DataFrame:
        radii = _site(s, p).join(_stampradius(s, p).select("site_id", "radius"), "site_id")
        return flooding.stamped(_pore(s, p), radii, grid.ORDERS)

    return kept(spark, d, "stampcore", build)


def _blocks(voxels: DataFrame) -> DataFrame:
    label = (F.floor(F.col("z") / 3) * 6 + F.floor(F.col("y") / 5)) * 10 + F.floor(F.col("x") / 5)
    return voxels.select("vid", "z", "y", "x", label.cast("bigint").alias("label"))


def _fieldlabel(spark: SparkSession, d: str) -> DataFrame:
    """Block labels with every eleventh voxel unlabelled."""
    return _blocks(_pore(spark, d).where("vid % 11 <> 0"))


def _seeded(parts: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """The seed of a label is its last voxel; of: where it is looked for, if not in the parts themselves."""
    seeds = (of or parts).groupBy("label").agg(F.max("vid").alias("top"))
    return parts.join(seeds, "label").select("vid", "label", "root", (F.col("vid") == F.col("top")).alias("seed"))


def _fieldpart(spark: SparkSession, d: str) -> DataFrame:
    def build(s: SparkSession, p: str) -> DataFrame:
        """Seeds are chosen before voxels lose their label, so that some labels have lost their seed."""
        own = _fieldlabel(s, p)
        return _seeded(own.select("vid", "label").join(fields.components(own, grid.ORDERS, "label"), "vid"), _blocks(_pore(s, p)))

    return kept(spark, d, "fieldpart", build)


def _freepart(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "freepart", lambda s, p: _seeded(fields.free_parts(_fieldlabel(s, p), _pore(s, p), grid.ORDERS)))


def _resistors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Matrix and right side of voxel pressures, 1 at the inlet and 0 at the outlet, in parts that touch either."""

    def build(s: SparkSession, p: str) -> DataFrame:
        pore = _pore(s, p).join(_comp(s, p), "vid")
        ends = pore.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        pore = pore.join(F.broadcast(ends))
        touching = pore.where("x = lo OR x = hi").select("root").distinct()
        pore = pore.join(touching, "root", "left_semi").withColumn("kind", F.when(F.col("x") == F.col("lo"), 1).when(F.col("x") == F.col("hi"), 2).otherwise(0))
        near = grid.neighbours(pore.where("kind = 0"), pore, grid.FACES, grid.ORDERS, keep=("kind",))
        return near.select("vid", "nb", F.col("nb_kind").alias("kind"))

    near = kept(spark, d, "resistors", build)
    degree = near.groupBy("vid").agg(F.count("*").cast("double").alias("val"), F.sum((F.col("kind") == 1).cast("double")).alias("rhs"))
    off = near.where("kind = 0").select(F.col("vid").alias("row"), F.col("nb").alias("col"), F.lit(-1.0).alias("val"))
    return degree.select(F.col("vid").alias("row"), F.col("vid").alias("col"), "val").unionByName(off), degree.select(F.col("vid").alias("row"), "rhs")


def _pressure(spark: SparkSession, d: str) -> DataFrame:
    def build(s: SparkSession, p: str) -> DataFrame:
        return dissection.solved(*_resistors(s, p), _pore(s, p).withColumnRenamed("vid", "row")).select(F.col("row").alias("vid"), F.col("val").alias("pressure"))

    return kept(spark, d, "pressure", build)


def _residual(spark: SparkSession, d: str) -> DataFrame:
    matrix, rhs = _resistors(spark, d)
    own = algebra.times(matrix, _pressure(spark, d).select(F.col("vid").alias("row"), F.col("pressure").alias("val"))).join(rhs, "row")
    return own.select(F.col("row").alias("vid"), (F.col("ax") - F.col("rhs")).alias("rest"))


def _directrest(spark: SparkSession, d: str) -> DataFrame:
    """(vid, pressure, rest) where conjugate gradients are stopped after two steps, so that the direct solution takes over."""
    matrix, rhs = _resistors(spark, d)
    x = written(dissection.solved(matrix, rhs, _pore(spark, d).withColumnRenamed("vid", "row"), most=2), "direct")
    own = algebra.times(matrix, x).join(rhs, "row").join(x, "row")
    return own.select(F.col("row").alias("vid"), F.col("val").alias("pressure"), (F.col("ax") - F.col("rhs")).alias("rest"))


def _main(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cells with volume and wall, and faces, of the largest part of the pore."""

    def build(s: SparkSession, p: str) -> DataFrame:
        own = written(_owner(s, p).join(_comp(s, p), "vid").groupBy("root", F.col("site_id").alias("cell")).agg(F.count("*").alias("n")), "root-cells")
        largest = own.groupBy("root").agg(F.sum("n").alias("n")).agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("root"))
        return own.join(F.broadcast(largest), "root").select("cell")

    cell = kept(spark, d, "maincell", build)
    cells = kept(spark, d, "maincells", lambda s, p: _cellgeo(s, p).join(cell, "cell").join(_twall(s, p), "cell", "left").withColumn("twall", F.coalesce("twall", F.lit(0.0))))
    return cells, kept(spark, d, "mainfaces", lambda s, p: _metric(s, p).join(cell.withColumnRenamed("cell", "owner"), "owner", "left_semi"))


def _scalarflow(spark: SparkSession, d: str) -> DataFrame:
    """u of nu (L + T_wall) u = V f and whether every row of the system holds."""

    def build(s: SparkSession, p: str) -> DataFrame:
        cells, faces = _main(s, p)
        u = written(stokes.scalar_velocity(cells, faces), "scalar-flow")
        lu = algebra.times(algebra.laplacian(faces), u.select(F.col("cell").alias("row"), F.col("ux").alias("val"))).withColumnRenamed("row", "cell")
        own = cells.join(u, "cell").join(lu, "cell", "left")
        rest = F.coalesce("ax", F.lit(0.0)) + F.col("twall") * F.col("ux") - F.col("volume")
        return own.select("cell", "ux", (F.abs(rest) <= 1e-6 * F.col("volume")).alias("solved"))

    return kept(spark, d, "scalarflow", build)


def _projectedflow(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "projectedflow", lambda s, p: stokes.flow(*_main(s, p), "scalar_projected"))


def _stokes(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "stokes", lambda s, p: stokes.flow(*_main(s, p), "monolithic", stokes.Settings(tikhonov=0.01, gauge=0.0)))


def _pressuremodes(spark: SparkSession, d: str) -> DataFrame:
    """Whether conjugate gradients, the direct solve and the dense factors give one pressure."""
    own = None
    for mode in ("cg", "direct", "dense_lu"):
        one = stokes.flow(*_main(spark, d), "scalar_projected", stokes.Settings(pressure=mode, rtol=1e-12)).select("cell", F.col("p").alias(mode))
        own = one if own is None else own.join(one, "cell")
    return own.select("cell", ((F.abs(F.col("cg") - F.col("direct")) < 1e-4) & (F.abs(F.col("direct") - F.col("dense_lu")) < 1e-8)).alias("agree"))


def _predictor(spark: SparkSession, d: str) -> DataFrame:
    """One step from rest without pressure: (V / dt + nu (L + T_wall)) u = V f, held row by row."""
    cells, faces = _main(spark, d)
    own = stokes.Settings(steps=1, every=9, dt=0.1)
    u = written(stokes.flow(cells, faces, "predicted", own).select("cell", "ux"), "predicted")
    lu = algebra.times(algebra.laplacian(faces), u.select(F.col("cell").alias("row"), F.col("ux").alias("val"))).withColumnRenamed("row", "cell")
    rest = F.col("volume") / own.dt * F.col("ux") + own.nu * (F.coalesce("ax", F.lit(0.0)) + F.col("twall") * F.col("ux")) - F.col("volume")
    return cells.join(u, "cell").join(lu, "cell", "left").select("cell", (F.abs(rest) <= 1e-6 * F.col("volume")).alias("solved"))


def _blockcg(spark: SparkSession, d: str) -> DataFrame:
    """Three right sides at once against each alone, and against the distributed steps."""
    cells, faces = _main(spark, d)
    wall = cells.select(F.col("cell").cast("bigint").alias("row"), F.col("cell").cast("bigint").alias("col"), (F.col("twall") + F.col("volume")).alias("val"))
    matrix = written(algebra.laplacian(faces).unionByName(wall).groupBy("row", "col").agg(F.sum("val").alias("val")), "block-matrix")
    rhs = written(cells.select(F.col("cell").cast("bigint").alias("row"), F.col("volume").alias("rhs"), F.col("cx").alias("b"), (F.col("cy") * 0).alias("c")), "block-rhs")
    own = algebra.conjugate_gradients(matrix, rhs, 1e-10, jacobi=True, columns=("rhs", "b", "c"))
    alone = algebra.conjugate_gradients(matrix, rhs.select("row", F.col("b").alias("rhs")), 1e-10, jacobi=True).select("row", F.col("val").alias("b"))
    spread = algebra.conjugate_gradients(matrix, rhs.select("row", "rhs"), 1e-8, jacobi=True, few=0).select("row", F.col("val").alias("a"))
    near = lambda x, y, e: F.abs(F.col(x) - F.col(y)) <= e * (1 + F.abs(F.col(x)))
    return own.join(alone, "row").join(spread, "row").select(F.col("row").alias("cell"), (near("val", "a", 1e-5) & near("x_b", "b", 1e-7) & (F.col("x_c") == 0)).alias("same"))


def _timeloop(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "timeloop", lambda s, p: stokes.flow(*_main(s, p), "stepped", stokes.Settings(tikhonov=0.01)))


RELATIONS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "vox": _vox, "pore": _pore, "site": _site, "edge": _edge, "edge26": _edge26, "forward": _forward, "wrapped": _wrapped, "owner": _owner, "owner26": _owner26,
    "single": _single, "comp": _comp, "block": _block, "cellvox": _cellvox, "face": _face, "graph": _graph, "wall": _wall, "closed": _closed, "exposed": _exposed,
    "matrix": _matrix, "flux": _flux, "fluxes": _fluxes, "balance": _balance, "press": _press, "pressure": _pressure, "residual": _residual, "directrest": _directrest, "contact": _contact,
    "side26": _side26, "bykey": _bykey, "cellgeo": _cellgeo, "facegeo": _facegeo, "metric": _metric, "twall": _twall, "metricflux": _metricflux, "gradient": _gradient,
    "latsite": _latsite, "latcand": _latcand, "latowner": _latowner, "stampradius": _stampradius, "stampcore": _stampcore, "fieldpart": _fieldpart, "freepart": _freepart, "labels26": _owner26,
    "resistor": lambda s, d: _resistors(s, d)[0], "resistorrhs": lambda s, d: _resistors(s, d)[1], "scalarflow": _scalarflow, "projectedflow": _projectedflow,
    "stokes": _stokes, "pressuremodes": _pressuremodes, "predictor": _predictor, "blockcg": _blockcg, "timeloop": _timeloop,
}

#: Independent definitions for DuckDB, in order of use: name, definition, relations it needs.
PRELUDE: dict[str, tuple[str, tuple[str, ...]]] = {
    "vox": ("SELECT o_orderkey AS vid, CAST(o_orderkey // 1500 AS INT) AS z, CAST((o_orderkey // 50) % 30 AS INT) AS y, CAST(o_orderkey % 50 AS INT) AS x, o_orderstatus <> 'P' AS pore, o_totalprice AS val FROM orders", ()),
    "pore": ("SELECT * FROM vox WHERE pore", ("vox",)),
    "site": ("SELECT CAST(row_number() OVER (ORDER BY vid) - 1 AS INT) AS site_id, vid, z, y, x FROM pore WHERE vid % 97 = 13", ("pore",)),
    "edge": ("SELECT a.vid AS src, b.vid AS dst, dz, dy, dx FROM pore a, (VALUES (0,0,-1),(0,0,1),(0,-1,0),(0,1,0),(-1,0,0),(1,0,0)) AS o(dz,dy,dx), pore b WHERE b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx", ("pore",)),
    "edge26": ("SELECT a.vid AS src, b.vid AS dst, dz, dy, dx, abs(dz) + abs(dy) + abs(dx) AS w2 FROM pore a, (SELECT i - 1 AS dz, j - 1 AS dy, k - 1 AS dx FROM range(3) r1(i), range(3) r2(j), range(3) r3(k) WHERE NOT (i = 1 AND j = 1 AND k = 1)) AS o, pore b WHERE b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx", ("pore",)),
    "forward": ("SELECT * FROM edge WHERE dz + dy + dx = 1", ("edge",)),
    "wrapped": ("SELECT a.vid AS src, b.vid AS dst, dz, dy, dx FROM pore a, (VALUES (0,0,1),(0,1,0),(1,0,0)) AS o(dz,dy,dx), pore b WHERE b.z = a.z + dz AND b.y = a.y + dy AND b.x = (a.x + dx) % 50", ("pore",)),
    "owner(vid, site_id, d) USING KEY (vid)": ("SELECT vid, site_id, 0 FROM site UNION SELECT e.dst, min(r.site_id), any_value(r.d) + 1 FROM owner r JOIN edge e ON e.src = r.vid LEFT JOIN recurring.owner k ON k.vid = e.dst WHERE k.vid IS NULL GROUP BY e.dst", ("site", "edge")),
    "owner26(vid, d) USING KEY (vid)": ("SELECT vid, CAST(0 AS DOUBLE) FROM site UNION SELECT e.dst, min(r.d + sqrt(e.w2)) FROM owner26 r JOIN edge26 e ON e.src = r.vid LEFT JOIN recurring.owner26 k ON k.vid = e.dst WHERE k.vid IS NULL OR r.d + sqrt(e.w2) < k.d - 1e-9 GROUP BY e.dst", ("site", "edge26")),
    "single(vid, d) USING KEY (vid)": ("SELECT vid, 0 FROM site WHERE site_id = 0 UNION SELECT e.dst, min(r.d) + 1 FROM single r JOIN edge e ON e.src = r.vid LEFT JOIN recurring.single k ON k.vid = e.dst WHERE k.vid IS NULL GROUP BY e.dst", ("site", "edge")),
    "xrun": ("SELECT vid, min(vid) OVER (PARTITION BY z, y, g) AS run FROM (SELECT *, x - row_number() OVER (PARTITION BY z, y ORDER BY x) AS g FROM pore)", ("pore",)),
    "runedge": ("SELECT DISTINCT a.run AS src, b.run AS dst FROM xrun a JOIN edge e ON e.src = a.vid AND e.dx = 0 JOIN xrun b ON b.vid = e.dst", ("xrun", "edge")),
    "runroot(run, root) USING KEY (run)": ("SELECT DISTINCT run, run FROM xrun UNION SELECT e.dst, min(r.root) FROM runroot r JOIN runedge e ON e.src = r.run JOIN recurring.runroot k ON k.run = e.dst WHERE r.root < k.root GROUP BY e.dst", ("xrun", "runedge")),
    "comp": ("SELECT vid, root FROM xrun JOIN runroot USING (run)", ("xrun", "runroot(run, root) USING KEY (run)")),
    "labels": ("SELECT vid, CAST((z // 3 * 6 + y // 5) * 10 + x // 5 AS BIGINT) AS label FROM pore", ("pore",)),
    "parts(vid, root) USING KEY (vid)": ("SELECT vid, vid FROM pore UNION SELECT e.dst, min(r.root) FROM parts r JOIN edge e ON e.src = r.vid JOIN labels a ON a.vid = e.src JOIN labels b ON b.vid = e.dst AND a.label = b.label JOIN recurring.parts k ON k.vid = e.dst WHERE r.root < k.root GROUP BY e.dst", ("pore", "edge", "labels")),
    "block": ("SELECT vid, label, root, dense_rank() OVER (ORDER BY root) - 1 AS cell_id, dense_rank() OVER (ORDER BY label, root) - 1 AS cell_by_site FROM parts JOIN labels USING (vid)", ("parts(vid, root) USING KEY (vid)", "labels")),
    "cellvox": ("SELECT p.*, o.site_id AS cell, o.d FROM pore p JOIN owner o USING (vid)", ("pore", "owner(vid, site_id, d) USING KEY (vid)")),
    "face": ("SELECT least(a.cell, b.cell) AS owner, greatest(a.cell, b.cell) AS neighbor, CASE WHEN dx = 1 THEN 2 WHEN dy = 1 THEN 1 ELSE 0 END AS axis, CASE WHEN a.cell < b.cell THEN 1 ELSE -1 END AS sign, src AS vid, dst AS nb, 2 * CASE WHEN a.cell < b.cell THEN a.d ELSE b.d END + 1 AS r_owner2, 2 * CASE WHEN a.cell < b.cell THEN b.d ELSE a.d END + 1 AS r_neighbor2 FROM forward JOIN cellvox a ON a.vid = src JOIN cellvox b ON b.vid = dst WHERE a.cell <> b.cell", ("forward", "cellvox")),
    "graph": ("SELECT owner, neighbor, count(*) AS area, sum(1 / greatest((r_owner2 + r_neighbor2) / 2, 1e-6)) AS conductance, count(*) / sum(1 / greatest((r_owner2 + r_neighbor2) / 2, 1e-6)) AS mean_geodesic_length FROM face GROUP BY ALL", ("face",)),
    "exposed": ("SELECT a.vid, dz, dy, dx FROM pore a, (VALUES (0,0,-1),(0,0,1),(0,-1,0),(0,1,0),(-1,0,0),(1,0,0)) AS o(dz,dy,dx) WHERE NOT EXISTS (SELECT 1 FROM pore b WHERE b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx)", ("pore",)),
    "wall": ("SELECT cell, count(*) AS wall_area FROM exposed JOIN cellvox USING (vid) GROUP BY cell", ("exposed", "cellvox")),
    "grown": ("SELECT DISTINCT v.vid, v.z, v.y, v.x FROM vox v JOIN (SELECT z, y, x FROM pore UNION SELECT z + dz, y + dy, x + dx FROM pore, (VALUES (0,0,-1),(0,0,1),(0,-1,0),(0,1,0),(-1,0,0),(1,0,0)) AS o(dz,dy,dx)) g ON v.z = g.z AND v.y = g.y AND v.x = g.x", ("vox", "pore")),
    "closed": ("SELECT vid FROM grown a WHERE (SELECT count(*) FROM grown b WHERE abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1 AND b.vid IN (a.vid - 1500, a.vid - 50, a.vid - 1, a.vid + 1, a.vid + 50, a.vid + 1500)) = 6", ("grown",)),
    "matrix": ("SELECT row, col, sum(val) AS val FROM (SELECT owner AS row, owner AS col, conductance AS val FROM graph UNION ALL SELECT owner, neighbor, -conductance FROM graph UNION ALL SELECT neighbor, neighbor, conductance FROM graph UNION ALL SELECT neighbor, owner, -conductance FROM graph) GROUP BY ALL", ("graph",)),
    "contact": ("SELECT a.vid, b.vid AS nb, dz, dy, dx FROM pore a, (VALUES (0,0,-1),(0,0,1),(0,-1,0),(0,1,0),(-1,0,0),(1,0,0)) AS o(dz,dy,dx), vox b WHERE NOT b.pore AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx", ('pore', 'vox')),
    "side26": ("SELECT a.vid AS src, b.vid AS dst, dz, dy, dx, abs(dz) + abs(dy) + abs(dx) AS w2, b.pore FROM pore a, (SELECT i - 1 AS dz, j - 1 AS dy, k - 1 AS dx FROM range(3) r1(i), range(3) r2(j), range(3) r3(k) WHERE NOT (i = 1 AND j = 1 AND k = 1)) AS o, vox b WHERE b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx", ('pore', 'vox')),
    "rank": ("SELECT site_id, vid, row_number() OVER (ORDER BY x, y, z) - 1 AS rank FROM site", ('site',)),
    "keyed(vid, rank, d) USING KEY (vid)": ("SELECT vid, rank, 0 FROM rank UNION SELECT e.dst, min(r.rank), any_value(r.d) + 1 FROM keyed r JOIN edge e ON e.src = r.vid LEFT JOIN recurring.keyed k ON k.vid = e.dst WHERE k.vid IS NULL GROUP BY e.dst", ('rank', 'edge')),
    "bykey": ("SELECT k.vid, r.site_id, k.d FROM keyed k JOIN rank r USING (rank)", ('keyed(vid, rank, d) USING KEY (vid)', 'rank')),
    "press": ("SELECT site_id AS cell, val / 500000 AS p FROM site JOIN vox USING (vid)", ('site', 'vox')),
    "fluxes": ("SELECT owner, neighbor, 'internal' AS kind, conductance, conductance * (a.p - b.p) AS q FROM graph JOIN press a ON a.cell = owner JOIN press b ON b.cell = neighbor UNION ALL SELECT c.cell, CASE WHEN x = lo THEN -1 ELSE -2 END, CASE WHEN x = lo THEN 'inlet' ELSE 'outlet' END, count(*), count(*) * (any_value(p.p) - CASE WHEN x = lo THEN 1.0 ELSE 0.0 END) FROM cellvox c JOIN press p ON p.cell = c.cell, (SELECT min(x) AS lo, max(x) AS hi FROM pore) m WHERE x = lo OR x = hi GROUP BY c.cell, x, lo", ('graph', 'press', 'cellvox', 'pore')),
    "flux": ("SELECT owner, neighbor, conductance, q FROM fluxes WHERE kind = 'internal'", ('fluxes',)),
    "balance": ("SELECT cell, sum(q) AS div, 0.0 AS after FROM (SELECT owner AS cell, q FROM fluxes UNION ALL SELECT neighbor, -q FROM fluxes WHERE neighbor >= 0) GROUP BY cell", ('fluxes',)),
    "cellgeo": ("SELECT cell, CAST(count(*) AS DOUBLE) AS volume, avg(x + 0.5) AS cx, avg(y + 0.5) AS cy, avg(z + 0.5) AS cz FROM cellvox GROUP BY cell", ('cellvox',)),
    "facegeo": ("SELECT owner, neighbor, CAST(count(*) AS DOUBLE) AS area, sum(CASE axis WHEN 2 THEN sign ELSE 0 END) * 1.0 AS ax, sum(CASE axis WHEN 1 THEN sign ELSE 0 END) * 1.0 AS ay, sum(CASE axis WHEN 0 THEN sign ELSE 0 END) * 1.0 AS az, avg(v.x + CASE axis WHEN 2 THEN 1.0 ELSE 0.5 END) AS fx, avg(v.y + CASE axis WHEN 1 THEN 1.0 ELSE 0.5 END) AS fy, avg(v.z + CASE axis WHEN 0 THEN 1.0 ELSE 0.5 END) AS fz, avg(r_owner2) / 2 AS r_owner, avg(r_neighbor2) / 2 AS r_neigh FROM face JOIN pore v USING (vid) GROUP BY owner, neighbor", ('face', 'pore')),
    "metric": ("SELECT *, r_neigh / ell AS w_owner, r_owner / ell AS w_neigh, greatest(area / ell, 1e-12) AS t, ux * ell / greatest(sqrt(ux * ux + uy * uy + uz * uz), 1e-12) AS dx, uy * ell / greatest(sqrt(ux * ux + uy * uy + uz * uz), 1e-12) AS dy, uz * ell / greatest(sqrt(ux * ux + uy * uy + uz * uz), 1e-12) AS dz FROM (SELECT f.*, greatest(r_owner + r_neigh, 1e-12) AS ell, b.cx - a.cx AS ux, b.cy - a.cy AS uy, b.cz - a.cz AS uz FROM facegeo f JOIN cellgeo a ON a.cell = owner JOIN cellgeo b ON b.cell = neighbor)", ('facegeo', 'cellgeo')),
    "twall": ("SELECT c.cell, sum(1 / greatest(e.dx * (c.x + 0.5 + 0.5 * e.dx - g.cx) + e.dy * (c.y + 0.5 + 0.5 * e.dy - g.cy) + e.dz * (c.z + 0.5 + 0.5 * e.dz - g.cz), 0.25)) AS twall FROM exposed e JOIN cellvox c ON c.vid = e.vid JOIN cellgeo g ON g.cell = c.cell GROUP BY c.cell", ('exposed', 'cellvox', 'cellgeo')),
    "metricflux": ("SELECT owner, neighbor, t * (a.p - b.p) AS q FROM metric JOIN press a ON a.cell = owner JOIN press b ON b.cell = neighbor", ('metric', 'press')),
    "normal": ("SELECT cell, sum(t * dx * dx) + 0.01 AS mxx, sum(t * dx * dy) AS mxy, sum(t * dx * dz) AS mxz, sum(t * dy * dy) + 0.01 AS myy, sum(t * dy * dz) AS myz, sum(t * dz * dz) + 0.01 AS mzz, sum(t * dx * dp) AS bx, sum(t * dy * dp) AS by_, sum(t * dz * dp) AS bz FROM (SELECT unnest([owner, neighbor]) AS cell, t, dx, dy, dz, b.p - a.p AS dp FROM metric JOIN press a ON a.cell = owner JOIN press b ON b.cell = neighbor) GROUP BY cell", ('metric', 'press')),
    "gradient": ("SELECT *, ((myy * mzz - myz * myz) * bx + (mxz * myz - mxy * mzz) * by_ + (mxy * myz - mxz * myy) * bz) / det AS gx, ((mxz * myz - mxy * mzz) * bx + (mxx * mzz - mxz * mxz) * by_ + (mxy * mxz - mxx * myz) * bz) / det AS gy, ((mxy * myz - mxz * myy) * bx + (mxy * mxz - mxx * myz) * by_ + (mxx * myy - mxy * mxy) * bz) / det AS gz FROM (SELECT *, mxx * (myy * mzz - myz * myz) - mxy * (mxy * mzz - mxz * myz) + mxz * (mxy * myz - mxz * myy) AS det FROM normal)", ('normal',)),
    "latsite": ("SELECT CAST(row_number() OVER (ORDER BY vid) - 1 AS INT) AS site_id, vid, z, y, x, (z - 2) // 4 AS lz, (y - 2) // 4 AS ly, (x - 2) // 4 AS lx FROM pore WHERE z % 4 = 2 AND y % 4 = 2 AND x % 4 = 2", ('pore',)),
    "latcand": ("SELECT p.vid, s.site_id, abs(p.z - s.z) + abs(p.y - s.y) + abs(p.x - s.x) AS l1, p.z, p.y, p.x, s.z AS sz, s.y AS sy, s.x AS sx FROM pore p JOIN latsite s ON s.lz - floor((p.z - 2) / 4) BETWEEN -1 AND 2 AND s.ly - floor((p.y - 2) / 4) BETWEEN -1 AND 2 AND s.lx - floor((p.x - 2) / 4) BETWEEN -1 AND 2", ('pore', 'latsite')),
    "latowner(vid, site_id, d) USING KEY (vid)": ("SELECT vid, site_id, 0 FROM latsite UNION SELECT e.dst, min(r.site_id), any_value(r.d) + 1 FROM latowner r JOIN edge e ON e.src = r.vid LEFT JOIN recurring.latowner k ON k.vid = e.dst WHERE k.vid IS NULL GROUP BY e.dst", ('latsite', 'edge')),
    "stampradius": ("SELECT site_id, other, dist, coalesce(greatest(0, dist / 2 - 0.25), 1e10) AS radius FROM site LEFT JOIN (SELECT a.site_id, arg_min(b.site_id, g - m + sqrt(2) * (m - l) + sqrt(3) * l + 1e-9 * b.site_id) AS other, min(g - m + sqrt(2) * (m - l) + sqrt(3) * l) AS dist FROM site a, site b, LATERAL (SELECT greatest(abs(a.z - b.z), abs(a.y - b.y), abs(a.x - b.x)) AS g, least(abs(a.z - b.z), abs(a.y - b.y), abs(a.x - b.x)) AS l) q, LATERAL (SELECT abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) - g - l AS m) w WHERE a.site_id <> b.site_id GROUP BY a.site_id) USING (site_id)", ('site',)),
    "tight": ("SELECT e.src, e.dst FROM edge26 e JOIN owner26 a ON a.vid = e.src JOIN owner26 b ON b.vid = e.dst WHERE abs(a.d + sqrt(e.w2) - b.d) <= 1e-6", ('edge26', 'owner26(vid, d) USING KEY (vid)')),
    "least26(vid, site_id) USING KEY (vid)": ("SELECT vid, site_id FROM site UNION SELECT t.dst, min(r.site_id) FROM least26 r JOIN tight t ON t.src = r.vid LEFT JOIN recurring.least26 k ON k.vid = t.dst WHERE k.vid IS NULL OR r.site_id < k.site_id GROUP BY t.dst", ('site', 'tight')),
    "labels26": ("SELECT o.vid, l.site_id, o.d FROM owner26 o JOIN least26 l USING (vid)", ('owner26(vid, d) USING KEY (vid)', 'least26(vid, site_id) USING KEY (vid)')),
    "stampcore": ("SELECT o.vid, o.site_id, o.d FROM labels26 o JOIN stampradius r ON r.site_id = o.site_id WHERE o.d <= r.radius", ('labels26', 'stampradius')),
    "fieldlabel": ("SELECT vid, label FROM labels WHERE vid % 11 <> 0", ('labels',)),
    "fparts(vid, root) USING KEY (vid)": ("SELECT vid, vid FROM fieldlabel UNION SELECT e.dst, min(r.root) FROM fparts r JOIN edge e ON e.src = r.vid JOIN fieldlabel a ON a.vid = e.src JOIN fieldlabel b ON b.vid = e.dst AND a.label = b.label JOIN recurring.fparts k ON k.vid = e.dst WHERE r.root < k.root GROUP BY e.dst", ('edge', 'fieldlabel')),
    "fieldpart": ("SELECT vid, label, root, vid = top AS seed FROM fparts JOIN fieldlabel USING (vid) JOIN (SELECT label, max(vid) AS top FROM labels GROUP BY label) USING (label)", ('labels', 'fparts(vid, root) USING KEY (vid)', 'fieldlabel')),
    "freeroot(label, vid, root) USING KEY (label, vid)": ("SELECT label, vid, vid FROM fieldlabel UNION SELECT r.label, e.dst, min(r.root) FROM freeroot r JOIN edge e ON e.src = r.vid LEFT JOIN fieldlabel f ON f.vid = e.dst LEFT JOIN recurring.freeroot k ON k.label = r.label AND k.vid = e.dst WHERE (f.vid IS NULL OR f.label = r.label) AND (k.vid IS NULL OR r.root < k.root) GROUP BY r.label, e.dst", ('fieldlabel', 'edge')),
    "freepart": ("SELECT f.vid, f.label, r.root, f.vid = max(f.vid) OVER (PARTITION BY f.label) AS seed FROM fieldlabel f JOIN freeroot r ON r.label = f.label AND r.vid = f.vid", ('fieldlabel', 'freeroot(label, vid, root) USING KEY (label, vid)')),
    "ends": ("SELECT p.vid, CASE WHEN x = lo THEN 1 WHEN x = hi THEN 2 ELSE 0 END AS kind, c.root FROM pore p JOIN comp c USING (vid), (SELECT min(x) AS lo, max(x) AS hi FROM pore) m", ('pore', 'comp')),
    "ohms": ("SELECT a.vid, b.vid AS nb, b.kind FROM ends a JOIN edge e ON e.src = a.vid JOIN ends b ON b.vid = e.dst WHERE a.kind = 0 AND a.root IN (SELECT root FROM ends WHERE kind > 0)", ('ends', 'edge')),
    "resistor": ("SELECT vid AS row, vid AS col, CAST(count(*) AS DOUBLE) AS val FROM ohms GROUP BY vid UNION ALL SELECT vid, nb, -1.0 FROM ohms WHERE kind = 0", ('ohms',)),
    "resistorrhs": ("SELECT vid AS row, CAST(sum(CASE kind WHEN 1 THEN 1 ELSE 0 END) AS DOUBLE) AS rhs FROM ohms GROUP BY vid", ('ohms',)),
    "pressure": ("SELECT row AS vid, 0.5 AS pressure FROM resistorrhs", ('resistorrhs',)),
    "residual": ("SELECT row AS vid, 0.0 AS rest FROM resistorrhs", ('resistorrhs',)),
    "directrest": ("SELECT row AS vid, 0.5 AS pressure, 0.0 AS rest FROM resistorrhs", ('resistorrhs',)),
    "maincell": ("SELECT DISTINCT cell FROM cellvox JOIN comp USING (vid) WHERE root = (SELECT arg_max(root, n) FROM (SELECT root, count(*) - root / 1e9 AS n FROM cellvox JOIN comp USING (vid) GROUP BY root))", ('cellvox', 'comp')),
    "scalarflow": ("SELECT cell, 1.0 AS ux, TRUE AS solved FROM maincell", ('maincell',)),
    "projectedflow": ("SELECT cell, 0.0 AS div, 1 AS step FROM maincell", ('maincell',)),
    "stokes": ("SELECT cell, 0.0 AS div, 0.0 AS momentum FROM maincell", ('maincell',)),
    "pressuremodes": ("SELECT cell, TRUE AS agree FROM maincell", ('maincell',)),
    "predictor": ("SELECT cell, TRUE AS solved FROM maincell", ('maincell',)),
    "blockcg": ("SELECT cell, TRUE AS same FROM maincell", ('maincell',)),
    "timeloop": ("SELECT cell, CAST(step AS INT) AS step, 0.0 AS div, 0.0 AS rel_change FROM maincell, range(1, 7) AS r(step)", ('maincell',)),
}


def _named(sql: str) -> list[str]:
    """Tables and relations that a statement names; other braces are text."""
    known = {*TABLES, *RELATIONS, *(k.partition("(")[0] for k in PRELUDE)}
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)) if n in known]


def _spark(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = {n: RELATIONS[n](spark, sf_dir) if n in RELATIONS else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in _named(sql)}
        text = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1D", sql)  # doubles, as DuckDB's averages are; Spark would take decimals
        return spark.sql(re.sub(r"idiv\(([^,()]+),([^,()]+)\)", r"(\1 DIV \2)", text), **own)

    return query


def _duckdb(sql: str) -> str | None:
    """The statement with the relations that it needs; None if one of them (an iterative solver) has no SQL."""
    by_name = {k.partition("(")[0]: k for k in PRELUDE}
    wanted: set[str] = set()

    def need(name: str) -> None:
        key = name if name in PRELUDE else by_name[name]
        if key not in wanted:
            wanted.add(key)
            for x in PRELUDE[key][1]:
                need(x)

    for n in _named(sql):
        if n not in TABLES:
            if n not in by_name:
                return None
            need(n)
    own = ", ".join(f"{k} AS ({PRELUDE[k][0]})" for k in PRELUDE if k in wanted)
    body = re.sub(r"idiv\(([^,()]+),([^,()]+)\)", r"(\1 // \2)", sql)
    for n in _named(sql):
        body = body.replace(f"{{{n}}}", n)
    return f"WITH RECURSIVE {own} SELECT * FROM ({body})" if own else body


from .frames import FRAMES  # noqa: E402  (its queries look the relations up here)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _spark(sql) for name, sql in STATEMENTS.items()} | {name: f for name, (f, _) in FRAMES.items()}
SQL: dict[str, str] = {name: own for name, sql in [*STATEMENTS.items(), *((n, q) for n, (_, q) in FRAMES.items() if q)] if (own := _duckdb(sql))}
