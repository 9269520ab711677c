"""Registered queries that are DataFrame operators as such, each with DuckDB SQL that states the wanted rows on its own.

The SQL may name the relations of catalog.PRELUDE as {relation}. Queries over files write small fixtures into the shared folder
first and read them back through the sources.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import blocks, bridging, checks, fields, flooding, generators, grid, search, thinning, tracing
from .operators.quantiles import quantiles
from .plans.config import RunConfig, coarse, value_list
from .plans.memory import folder, kept, written
from .plans.relaxation import contracted
from .sources import tables
from .statements import RUNS as RUN_ROWS

FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
ORDERS = grid.ORDERS


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        FRAMES[f.__name__] = (f, sql)
        return f

    return add


def rel(spark: SparkSession, d: str, name: str) -> DataFrame:
    from .catalog import RELATIONS

    return RELATIONS[name](spark, d)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def cells(depth: int, height: int, width: int) -> str:
    """DuckDB rows (z, y, x) of a box."""
    return f"(SELECT z, y, x FROM range({depth}) a(z), range({height}) b(y), range({width}) c(x))"


# ---------------------------------------------------------------- sources and sinks

BLOCK = "NOT (y BETWEEN 1 AND 6 AND x = 5 OR z < 2 AND y < 3 AND x BETWEEN 2 AND 3 OR z BETWEEN 4 AND 5 AND y BETWEEN 5 AND 7 AND x BETWEEN 8 AND 9) OR z BETWEEN 2 AND 3 AND y BETWEEN 3 AND 4 AND x = 5"


def block_mask() -> np.ndarray:
    shape, solid, opened = generators.FIXTURES["block"]
    mask = np.ones((shape.depth, shape.height, shape.width), dtype=bool)
    for boxes, value in ((solid, False), (opened, True)):
        for box in boxes:
            mask[tuple(slice(*r) for r in box)] = value
    return mask


@query(f"SELECT (z * 8 + y) * 11 + x AS vid, z, y, x, 6 AS depth FROM {cells(6, 8, 11)} WHERE {BLOCK}")
def s1_mask_archive(spark, d):
    data, path = io.BytesIO(), f"{fresh(spark, 'masks')}/mask.npz"
    np.savez_compressed(data, mask=block_mask(), other=np.zeros(3))
    tables.put(spark, path, data.getvalue())
    return tables.mask_archive(spark, path).where("pore").select("vid", "z", "y", "x", "depth")


@query("SELECT owner, neighbor, area, round(conductance, 6) AS conductance, n FROM {graph}, (SELECT count(*) AS n FROM {wall})")
def s2_stage_tables(spark, d):
    path = fresh(spark, "stage")
    tables.save_stage({"graph": rel(spark, d, "graph"), "wall": rel(spark, d, "wall")}, path)
    walls = tables.load_stage(spark, path, "wall").agg(F.count("*").alias("n"))
    return tables.load_stage(spark, path, "graph").join(F.broadcast(walls)).select("owner", "neighbor", "area", F.round("conductance", 6).alias("conductance"), "n")


@query("SELECT * FROM (VALUES ('duct', '(2, 4, 4)', '1.5'), ('maze', '[2, 4, 4]', NULL), ('rock', 'a \"b\"', 'nan')) AS t(\"case\", stride, beta)")
def s3_string_scan(spark, d):
    path = fresh(spark, "csv")
    tables.put(spark, f"{path}/a.csv", '﻿case," stride ","beta"\nduct,"(2, 4, 4)",1.5\nmaze,"[2, 4, 4]",\nrock,"a ""b""",nan\n'.encode())
    return tables.csv_strings(spark, path).select("case", "stride", "beta")


@query("SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS segment, '' AS name FROM {customer} UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), '', s_name FROM {supplier}")
def s4_row_union(spark, d):
    path = fresh(spark, "rows")
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    tables.write_csv(tables.union_rows(a, b), path)
    return tables.csv_strings(spark, path).drop("source_path").na.fill("")


@query("""SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS line FROM {nation}""")
def s5_json_rows(spark, d):
    path = fresh(spark, "json")
    tables.write_json(table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(f"SELECT (z * 4 + y) * 5 + x AS vid, z, y, x FROM {cells(3, 4, 5)} WHERE ((z + 1) * 7 + (y + 2) * 3 + x + 3) % 4 = 1")
def s6_crop_window(spark, d):
    path = f"{fresh(spark, 'tiff')}/stack.tif"
    z, y, x = np.indices((5, 7, 9))
    tables.put(spark, path, tables.tiff((z * 7 + y * 3 + x) % 4))
    return tables.tiff_window(spark, path, (1, 2, 3), (3, 4, 5), 1).where("pore").select("vid", "z", "y", "x")


@query("SELECT 'f' AS kind, count(*) AS n, count(*) AS distinct_lines FROM {exposed} UNION ALL SELECT 'v', count(*), count(*) FROM (SELECT DISTINCT CASE WHEN dz > 0 THEN z + 1 WHEN dz < 0 THEN z ELSE z + a END AS vz, CASE WHEN dy > 0 THEN y + 1 WHEN dy < 0 THEN y WHEN dz <> 0 THEN y + a ELSE y + b END AS vy, CASE WHEN dx > 0 THEN x + 1 WHEN dx < 0 THEN x ELSE x + b END AS vx FROM (SELECT * FROM {exposed} JOIN {pore} USING (vid)), range(2) r(a), range(2) s(b) WHERE dx = 0 UNION SELECT DISTINCT z + a, y + b, CASE WHEN dx > 0 THEN x + 1 ELSE x END FROM (SELECT * FROM {exposed} JOIN {pore} USING (vid)), range(2) r(a), range(2) s(b) WHERE dx <> 0)")
def s7_mesh_text(spark, d):
    """The surface as an OBJ text, counted after reading it back."""
    path = fresh(spark, "mesh")
    tables.mesh(blocks.exposed(rel(spark, d, "pore"), grid.ORDERS)).select("line").write.text(path)
    lines = spark.read.text(path).select(F.substring("value", 1, 1).alias("kind"), "value")
    return lines.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_lines"))


@query("SELECT 'md' AS kind, CAST(row_number() OVER (ORDER BY r_regionkey) + 1 AS INT) AS line_no, '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM {region} UNION ALL SELECT 'tex', CAST(row_number() OVER (ORDER BY r_regionkey) + 1 AS INT), r_regionkey || ' & ' || r_name || ' \\\\' FROM {region} UNION ALL SELECT * FROM (VALUES ('md', 0, '| r_regionkey | r_name |'), ('md', 1, '|---|---|'), ('tex', 0, '\\begin{tabular}{ll}'), ('tex', 1, 'r\\_regionkey & r\\_name \\\\')) UNION ALL SELECT 'tex', CAST(count(*) + 2 AS INT), '\\end{tabular}' FROM {region}")
def s8_report_tables(spark, d):
    own = table(spark, d, "region").select("r_regionkey", "r_name")
    a, b = tables.markdown(own, ["r_regionkey"]), tables.tex_table(own, ["r_regionkey"])
    return a.select(F.lit("md").alias("kind"), "line_no", "line").unionByName(b.select(F.lit("tex").alias("kind"), "line_no", "line"))


@query("SELECT * FROM (VALUES ('cells'), ('flux')) AS t(expected)")
def s9_missing_artifacts(spark, d):
    path = fresh(spark, "artifacts")
    for name in ("sites", "ownership", "graph"):
        tables.put(spark, f"{path}/{name}.bin", name.encode())
    found = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("expected"))
    return tables.missing(spark.createDataFrame([(x,) for x in ("sites", "ownership", "cells", "graph", "flux")], "expected string"), found, "expected")


@query("SELECT * FROM (VALUES ('duct', '1', 'a.csv'), ('maze', '2', 'a.csv'), ('rock', '3', 'deep/b.csv')) AS t(\"case\", v, source)")
def s10_csv_tree(spark, d):
    path = fresh(spark, "tree")
    tables.put(spark, f"{path}/a.csv", b"case,v\nduct,1\nmaze,2\n")
    tables.put(spark, f"{path}/deep/b.csv", b"case,v\nrock,3\n")
    return tables.csv_strings(spark, path).select("case", "v", F.element_at(F.split("source_path", path.rsplit("/", 1)[1] + "/"), 2).alias("source"))


@query("SELECT n_name || '.txt' AS name, CAST(length(n_name) + 1 AS BIGINT) AS bytes, sha256(n_name || chr(10)) AS sha256 FROM {nation}")
def s12_manifest(spark, d):
    path = fresh(spark, "files")
    for r in table(spark, d, "nation").select("n_name").collect():  # 25 rows
        tables.put(spark, f"{path}/{r[0]}.txt", f"{r[0]}\n".encode())
    return tables.manifest(spark, path).select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("name"), "bytes", "sha256")


@query("SELECT y, x, CASE WHEN y = 1 AND x = 2 THEN NULL ELSE CAST((x + y) % 3 AS INT) END AS label, CASE WHEN y = 1 AND x = 2 THEN NULL ELSE x + 0.5 * y END AS distance, 'areas' AS missing FROM range(3) a(y), range(4) b(x)")
def s13_json_scene(spark, d):
    path = fresh(spark, "scene")
    plane = spark.range(12).select(F.floor(F.col("id") / 4).cast("int").alias("y"), (F.col("id") % 4).cast("int").alias("x"))
    solid = "y = 1 AND x = 2"
    own = plane.select("y", "x", F.expr(f"CASE WHEN NOT ({solid}) THEN (x + y) % 3 END").alias("label"), F.expr(f"CASE WHEN NOT ({solid}) THEN x + 0.5D * y END").alias("distance"))
    tables.scene_text(own, spark.createDataFrame([(0, 1, 1), (1, 0, 3)], "site_id int, y int, x int"), 3, 4).write.text(path)
    read, missing = tables.scene(spark, path, ("shape", "sites", "labels", "distances", "areas"))
    return read.withColumn("missing", F.lit(",".join(missing)))


@query("SELECT * FROM (VALUES ('second', 'out_03')) AS t(found, free)")
def s14_paths(spark, d):
    path = fresh(spark, "paths")
    for name in ("second", "third", "out/x", "out_02/x"):
        tables.put(spark, f"{path}/{name}", b"x")
    found = tables.first_existing(spark, [f"{path}/{n}" for n in ("first", "second", "third")])
    return spark.createDataFrame([(found.rsplit("/", 1)[1], tables.next_free(spark, f"{path}/out").rsplit("/", 1)[1])], "found string, free string")


@query("SELECT c_name AS name, CAST(c_custkey AS VARCHAR) AS key FROM {customer}")
def s15_copies_agree(spark, d):
    """Rows through the CSV sink and through the JSON sink are the same."""
    a, b = fresh(spark, "copy"), fresh(spark, "copy")
    own = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("key"))
    tables.write_csv(own, a)
    tables.write_json(own, b)
    return tables.csv_strings(spark, a).drop("source_path").intersectAll(spark.read.schema("key string, name string").json(b).select("name", "key"))


# ---------------------------------------------------------------- generators

HASH = "(vid * 7919 + 13) % 10007, vid"
WALL = f"SELECT (z * 30 + y) * 50 + x AS vid, z, y, x, NOT (x BETWEEN 24 AND 25 AND NOT (z BETWEEN 2 AND 13 AND y BETWEEN 9 AND 20)) AS pore FROM {cells(16, 30, 50)}"


@query(f"WITH w AS ({WALL}) SELECT vid, 'mask' AS kind FROM w WHERE pore UNION ALL SELECT * FROM (SELECT vid, 'random' FROM w WHERE pore ORDER BY {HASH} LIMIT 40) UNION ALL SELECT * FROM (SELECT vid, 'two_sides_random' FROM w WHERE pore AND x <= 19 ORDER BY {HASH} LIMIT 20) UNION ALL SELECT * FROM (SELECT vid, 'two_sides_random' FROM w WHERE pore AND x >= 30 ORDER BY {HASH} LIMIT 20) UNION ALL SELECT * FROM (SELECT vid, 'two_sides_near_wall' FROM w WHERE pore AND x BETWEEN 20 AND 23 ORDER BY {HASH} LIMIT 20) UNION ALL SELECT * FROM (SELECT vid, 'two_sides_near_wall' FROM w WHERE pore AND x BETWEEN 26 AND 29 ORDER BY {HASH} LIMIT 20)")
def gn2_thin_wall(spark, d):
    own, x0, x1 = generators.thin_wall(spark, 16, ORDERS)
    pore = own.where("pore")
    out = pore.select("vid", F.lit("mask").alias("kind"))
    for mode in ("random", "two_sides_random", "two_sides_near_wall"):
        out = out.unionByName(generators.wall_seeds(pore, x0, x1, ORDERS.width, 40, mode).select("vid", F.lit(mode).alias("kind")))
    return out


CHANNEL = f"SELECT (z * 30 + y) * 50 + x AS vid, z, y, x FROM {cells(10, 30, 50)} WHERE sqrt(power((y + 0.5) / 30 - 0.5, 2) + power((z + 0.5) / 10 - 0.5, 2)) <= 0.5 * (0.7 + 0.3 * sin(6 * pi() * (x + 0.5) / 50))"


@query(f"WITH c AS ({CHANNEL}) SELECT vid, 'mask' AS kind FROM c UNION ALL SELECT vid, 'centre' FROM c JOIN (SELECT DISTINCT k, CAST(round_even((0.1 + 0.8 * k / 5) * 49, 0) AS INT) AS sx FROM range(6) r(k)) ON x = sx WHERE z = 5 AND y = 15 UNION ALL SELECT * FROM (SELECT vid, 'random' FROM c ORDER BY {HASH} LIMIT 12)")
def gn3_channel(spark, d):
    pore = generators.channel(spark, 10, ORDERS)
    centre = generators.centre_seeds(pore, 10, ORDERS, 6)
    return pore.select("vid", F.lit("mask").alias("kind")).unionByName(centre.select("vid", F.lit("centre").alias("kind"))).unionByName(generators.least_by_hash(pore, 12).select("vid", F.lit("random").alias("kind")))


@query("SELECT s.z, y, CAST(x + shift AS INT) AS x FROM {pore} p, (SELECT k AS z, CAST(round_even((k / 7 - 0.5) * 15, 0) AS INT) AS shift FROM range(8) r(k)) s WHERE p.z = 0 AND x + shift BETWEEN 0 AND 49")
def gn6_extrude_shear(spark, d):
    return generators.extruded(rel(spark, d, "pore").where("z = 0"), 8, 15, ORDERS.width)


@query("SELECT CAST(k AS INT) AS z, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, s.pore FROM range(4) a(k), range(20) b(ty), range(24) c(tx) JOIN {vox} s ON s.z = 0 AND s.y = CAST(floor(ty * 29 / 19 + 0.5) AS INT) AND s.x = CAST(floor(tx * 49 / 23 + 0.5) AS INT)")
def gn7_nearest_resize(spark, d):
    return generators.resized(rel(spark, d, "vox").where("z = 0"), (30, 50), (20, 24), 4)


def _smooth_sql() -> str:
    step = "SELECT z, (y + dy + 30) % 30 AS y, (x + dx + 50) % 50 AS x, sum(val) / 5 AS val FROM {0}, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(dy, dx) GROUP BY ALL"
    parts = ", ".join(f"s{k} AS MATERIALIZED ({step.format('s' + str(k - 1) if k > 1 else '{{vox}}')})" for k in range(1, 7)).replace("{{vox}}", "{vox}")
    return f"WITH {parts} SELECT CAST((z * 30 + y) * 50 + x AS BIGINT) AS vid, val > edge AS top FROM s6 JOIN (SELECT z, quantile_cont(val, 0.65) AS edge FROM s6 GROUP BY z) USING (z)"


@query(_smooth_sql())
def gn9_smoothed_texture(spark, d):
    return generators.texture(rel(spark, d, "vox"), ORDERS)


PLANE = "NOT (y BETWEEN 2 AND 9 AND x BETWEEN 8 AND 9 OR y < 2 AND x BETWEEN 3 AND 5 OR y BETWEEN 9 AND 11 AND x BETWEEN 13 AND 15) OR y BETWEEN 5 AND 6 AND x BETWEEN 8 AND 9"
GRAPH = "(x, y) NOT IN ((4, 4), (4, 5), (4, 6), (7, 0), (8, 0), (8, 1))"


@query(f"SELECT 'plane' AS name, z, y, x FROM {cells(1, 12, 18)} WHERE {PLANE} UNION ALL SELECT 'block', z, y, x FROM {cells(6, 8, 11)} WHERE {BLOCK} UNION ALL SELECT 'graph', z, y, x FROM {cells(1, 8, 11)} WHERE {GRAPH}")
def gn10_small_masks(spark, d):
    out = [generators.fixture(spark, n).where("pore").select(F.lit(n).alias("name"), "z", "y", "x") for n in generators.FIXTURES]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT n AS case_name, k AS mask_kind, s AS stride FROM (VALUES ('orthogonal_duct', 'procedural'), ('skewed_duct', 'procedural'), ('A_thin_wall', 'procedural'), ('B_narrow_throat', 'procedural'), ('C_maze', 'procedural')) AS c(n, k), (VALUES ('4x4x4'), ('2x4x4')) AS t(s) UNION ALL SELECT n, 'npz_mask', s FROM (VALUES ('bentheimer_sandstone_crop'), ('fibrous_filter_proxy')) AS c(n), (VALUES ('4x8x8'), ('2x6x6'), ('2x4x4')) AS t(s)")
def gn11_case_catalogue(spark, d):
    return generators.cases(spark, [(4, 4, 4), (2, 4, 4)]).select("case_name", "mask_kind", F.concat_ws("x", "sz", "sy", "sx").alias("stride"))


@query("SELECT 'half' AS family, '4x4x4' AS stride, vid FROM {pore} WHERE z % 4 = 2 AND y % 4 = 2 AND x % 4 = 2 UNION ALL SELECT 'half', '1x3x3', vid FROM {pore} WHERE y % 3 = 1 AND x % 3 = 1 UNION ALL SELECT 'origin', '2x4x4', vid FROM {pore} WHERE z % 2 = 0 AND y % 4 = 0 AND x % 4 = 0")
def gn12_lattice_seeds(spark, d):
    pore, parts = rel(spark, d, "pore"), []
    for name, family, stride in (("half", "STRIDE_HALF_ADMISSIBLE", (4, 4, 4)), ("half", "stride_half_admissible", (1, 3, 3)), ("origin", "stride_offset_origin", (2, 4, 4))):
        parts.append(generators.lattice(pore, stride, family, required=False).select(F.lit(name).alias("family"), F.lit("x".join(map(str, stride))).alias("stride"), "vid"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT 'npz_mask' AS kind, count(*) AS n FROM {cells(6, 8, 11)} WHERE {BLOCK} UNION ALL SELECT 'procedural', count(*) FROM ({WALL}) WHERE pore")
def gn13_mask_dispatch(spark, d):
    """A case's mask from its archive or from its procedure."""
    data, path, out = io.BytesIO(), f"{fresh(spark, 'masks')}/case.npz", None
    np.savez_compressed(data, mask=block_mask())
    tables.put(spark, path, data.getvalue())
    for kind, where in (("npz_mask", path), ("procedural", None)):
        mask = tables.mask_archive(spark, where) if kind == "npz_mask" else generators.thin_wall(spark, 16, ORDERS)[0]
        one = mask.where("pore").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT CAST((z * 3 + y) * 6 + x AS BIGINT) AS vid, dz, dy, dx, CASE WHEN x + dx BETWEEN 0 AND 5 AND y + dy BETWEEN 0 AND 2 AND z + dz BETWEEN 0 AND 2 THEN CAST(x + dx >= 3 AS INT) END AS nb_cell FROM {cells(3, 3, 6)}, (VALUES (0,0,-1),(0,0,1),(0,-1,0),(0,1,0),(-1,0,0),(1,0,0)) AS o(dz,dy,dx) WHERE NOT (x + dx BETWEEN 0 AND 5 AND y + dy BETWEEN 0 AND 2 AND z + dz BETWEEN 0 AND 2) OR (x >= 3) <> (x + dx >= 3)")
def gn14_cell_blocks(spark, d):
    return generators.surface(generators.blocks_demo(spark), grid.Shape(3, 6))


@query("SELECT * FROM (VALUES ('voxels', (6 * 10 * 9 + 59 * 2 * 3) * 26), ('parts', 1), ('seeds', 12), ('seeds in pore', 12)) AS t(what, n)")
def gn4_maze(spark, d):
    """A maze without loops: 60 rooms and 59 openings of 3 x 2, 26 high, in one part; seeds three rooms apart."""
    pore, centres = generators.maze(spark, 32, grid.Shape(30, 53), loops=0.0, seed=3)
    pore = written(pore, "maze")
    rooms = generators.spaced_rooms(6, 10, 12, 2, seed=3)
    seeds = centres.where(F.col("room").isin(rooms))
    parts = fields.components(pore, grid.Shape(30, 53)).select("root").distinct()
    count = lambda df, name: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    return count(pore, "voxels").unionByName(count(parts, "parts")).unionByName(count(seeds, "seeds")).unionByName(count(seeds.join(pore, ["z", "y", "x"], "left_semi"), "seeds in pore"))


#: Blocks of the pore as a mask of planes with many parts.
_LETTERS = "(floor(x / 6) + floor(y / 7)) % 2 = 0 AND x % 6 < 4"
_PARTS_SQL = f"""WITH RECURSIVE mask AS MATERIALIZED (SELECT vid, z, y, x FROM {{pore}} WHERE {_LETTERS}),
step AS MATERIALIZED (SELECT a.vid AS src, b.vid AS dst FROM mask a JOIN mask b ON b.z = a.z AND abs(a.y - b.y) + abs(a.x - b.x) = 1 AND b.vid IN (a.vid - 50, a.vid - 1, a.vid + 1, a.vid + 50)),
plane(vid, root) USING KEY (vid) AS (SELECT vid, vid FROM mask UNION SELECT e.dst, min(r.root) FROM plane r JOIN step e ON e.src = r.vid JOIN recurring.plane k ON k.vid = e.dst WHERE r.root < k.root GROUP BY e.dst),
part AS MATERIALIZED (SELECT m.*, root FROM mask m JOIN plane USING (vid) WHERE root IN (SELECT root FROM plane GROUP BY root HAVING count(*) >= 8)),
chain AS (SELECT z, root, lead(root) OVER (PARTITION BY z ORDER BY cx, root) AS next FROM (SELECT z, root, avg(x) AS cx FROM part GROUP BY z, root)),
pair AS (SELECT a.z, a.root AS l, c.next AS r, a.vid AS a, b.vid AS b, (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) AS d2 FROM chain c JOIN part a ON a.root = c.root JOIN part b ON b.root = c.next)"""


def _bridged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return bridging.bridged(rel(spark, d, "pore").where(_LETTERS), ORDERS, 1, least=8)


@query(f"{_PARTS_SQL} SELECT z, l AS \"left\", r AS \"right\", CAST(min(d2) AS BIGINT) AS d2, arg_min(a, (d2, a, b)) AS a, arg_min(b, (d2, a, b)) AS b FROM pair GROUP BY z, l, r")
def gn5_bridge_pairs(spark, d):
    """The closest voxels of neighbouring parts in each plane, against all pairs."""
    return _bridged(spark, d)[1]


@query(f"{_PARTS_SQL} SELECT z, count(DISTINCT root) AS parts_before, 1::BIGINT AS parts_after FROM part GROUP BY z")
def gn5_bridged_mask(spark, d):
    """The parts of a plane before thick lines join them, and after."""
    mask, _ = _bridged(spark, d)
    before = written(bridging.plane_parts(rel(spark, d, "pore").where(_LETTERS), ORDERS, 8), "before")
    after = bridging.plane_parts(mask, ORDERS, 1).select("vid", F.col("root").alias("joined"))
    return before.join(after, "vid").groupBy("z").agg(F.countDistinct("root").alias("parts_before"), F.countDistinct("joined").alias("parts_after"))


@query("SELECT CAST(r AS INT) AS room, TRUE AS reached, 59 AS openings FROM range(60) t(r)")
def i29_maze_edges(spark, d):
    """Every room is reached, by as many openings as rooms less one."""
    edges = generators.maze_edges(6, 10, 0.0, 5)
    own = spark.createDataFrame(edges, "a bigint, b bigint")
    root = contracted(own)
    return root.select(F.col("id").cast("int").alias("room"), (F.col("root") == 0).alias("reached"), F.lit(len(edges)).alias("openings"))


# ---------------------------------------------------------------- projections and text


@query("SELECT * FROM (VALUES ('body_force', '(2.5, 0.0, 0.0)'), ('dt', '0.1'), ('linear_solver_mode', 'direct'), ('n_steps', '900'), ('nu', '1.0'), ('periodic_x', 'True'), ('pressure_gauge_eps', '1e-12'), ('transmissibility_floor', '1e-12'), ('voxel_size', '1.0'), ('wall_distance_floor', '0.25')) AS t(name, value)")
def f25_overrides(spark, d):
    return spark.createDataFrame(RunConfig().overridden(periodic_x=True, nu=None, body_force_x=2.5, linear_solver_mode="direct").rows(), "name string, value string")


@query("SELECT vid, pore::INT AS as_byte, CAST(val AS FLOAT)::DOUBLE AS as_float, CAST(z AS BIGINT) * 4294967296 + site_id AS packed, CAST(z AS INT) AS high, CAST(site_id AS INT) AS low FROM {vox} JOIN {owner} USING (vid)")
def f26_casts(spark, d):
    """Storage types: bytes, floats, and two 32-bit numbers packed into one of 64 and taken apart."""
    own = rel(spark, d, "vox").join(rel(spark, d, "owner"), "vid")
    packed = own.withColumn("packed", F.shiftleft(F.col("z").cast("bigint"), 32).bitwiseOR(F.col("site_id").cast("bigint")))
    return packed.select("vid", F.col("pore").cast("int").alias("as_byte"), F.col("val").cast("float").cast("double").alias("as_float"), "packed", F.shiftright("packed", 32).cast("int").alias("high"), F.col("packed").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("low"))


@query("SELECT * FROM (VALUES ('dt', '0.05'), ('n_steps', '1800'), ('run_label', 'reference'), ('stride_zyx', '(2, 4, 4)')) AS t(name, value)")
def f30_kept_attributes(spark, d):
    base = RunConfig().overridden(run_label="reference", dt=0.05)
    steps = int(value_list(None, " , ", "1800, 900")[0])
    own = coarse(base, (2, 4, 4), n_steps=steps)
    return spark.createDataFrame([r for r in own.rows() if r[0] in ("dt", "n_steps", "run_label", "stride_zyx")], "name string, value string")



@query("SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS row_id FROM {pore}")
def f3_dense_renumber(spark, d):
    return fields.numbered(rel(spark, d, "pore").select("vid"), ("vid",), "row_id")


@query("SELECT vid, CAST(least(greatest(round_even(val / 5000 - 3, 0), 0), 49) AS INT) AS cx, CAST(least(greatest(round_even(vid / 2 , 0), 0), 29) AS INT) AS cy FROM {vox}")
def f6_clip_round(spark, d):
    clip = lambda c, top: F.least(F.greatest(F.rint(c), F.lit(0.0)), F.lit(float(top))).cast("int")
    return rel(spark, d, "vox").select("vid", clip(F.col("val") / 5000 - 3, 49).alias("cx"), clip(F.col("vid") / 2, 29).alias("cy"))


@query("SELECT p_partkey, CAST(p_size AS INT) AS z, CAST(p_size % 7 AS INT) AS y, CAST(2 * p_size AS INT) AS x, p_size / 4 + p_size % 7 AS total FROM {part}")
def f15_text_parsing(spark, d):
    own = table(spark, d, "part").select("p_partkey", F.format_string("(%d, %d,%d)", "p_size", F.col("p_size") % 7, F.col("p_size") * 2).alias("stride"), F.concat((F.col("p_size") / 4).cast("string"), F.lit(" , ,"), (F.col("p_size") % 7).cast("string")).alias("list"))
    total = F.aggregate(F.transform(text.values(F.col("list")), lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v)
    return own.select("p_partkey", text.triple(F.col("stride")).alias("t"), total.alias("total")).select("p_partkey", "t.*", "total")


@query("SELECT p_partkey, replace(replace(printf('%g', (p_size - 25) / 8), '-', 'm'), '.', 'p') AS number_token, coalesce(nullif(regexp_replace(trim(p_brand || ' '), '[^A-Za-z0-9]', '_', 'g'), ''), 'blank') AS text_token, CASE WHEN p_size % 5 = 0 THEN 'blank' ELSE 'a_b' END AS blank_token FROM {part}")
def f16_token_sanitising(spark, d):
    own = table(spark, d, "part")
    odd = F.when(F.col("p_size") % 5 == 0, " ").otherwise("a-b")
    return own.select("p_partkey", text.token_of_number((F.col("p_size") - 25) / 8).alias("number_token"), text.token_of_text(F.concat("p_brand", F.lit(" "))).alias("text_token"), text.token_of_text(odd).alias("blank_token"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN greatest(0, 0.5 * least(p_size % 7 + 1, p_size % 5 + 2, 6) - 1.0) END AS radius FROM {part}")
def f17_stride_radius(spark, d):
    name = F.concat(F.lit("case_stride_"), (F.col("p_size") % 7 + 1).cast("string"), F.lit("x"), (F.col("p_size") % 5 + 2).cast("string"), F.lit("x6"), F.when(F.col("p_size") % 4 > 0, "_half").otherwise("_origin"))
    own = table(spark, d, "part").select("p_partkey", name.alias("seed"))
    return own.select("p_partkey", F.when(text.stride_of(F.col("seed")).isNotNull(), text.protocol_radius(F.col("seed"))).alias("radius"))


@query("SELECT o_orderkey, CASE WHEN t >= 3600 THEN printf('%dh%02dm%02ds', t // 3600, t % 3600 // 60, t % 60) WHEN t >= 60 THEN printf('%dm%02ds', t // 60, t % 60) ELSE printf('%ds', t) END AS duration, replace(replace(printf('%.2e', v), 'e-0', 'e-'), 'e+0', 'e+') AS sci, printf('%.2f', v) AS fixed, replace(replace(o_orderpriority, '-', '\\_'), '_\\_', '\\_') AS dummy FROM (SELECT o_orderkey, o_orderpriority, CAST(floor(o_totalprice / 37) AS BIGINT) AS t, o_totalprice + 0.001234 AS v FROM {orders})".replace(", replace(replace(o_orderpriority, '-', '\\_'), '_\\_', '\\_') AS dummy", ", '50\\% of a\\_b \\& c\\#' AS escaped"))
def f18_formatting(spark, d):
    v = F.col("o_totalprice") + 0.001234
    return table(spark, d, "orders").select("o_orderkey", text.duration(F.floor(F.col("o_totalprice") / 37).cast("double")).alias("duration"), text.scientific(v).alias("sci"), F.format_string("%.2f", v).alias("fixed"), text.tex(F.lit("50% of a_b & c#")).alias("escaped"))


@query("SELECT l_returnflag AS case_name, CAST(min(l_quantity) AS INT) || '--' || CAST(max(l_quantity) AS INT) AS span, printf('%.2e', 1000 * max(l_quantity)) AS large, printf('%.3g', max(l_quantity) / 7) AS middle, printf('%.2e', min(l_quantity) / 7000) AS small, '$24\\times24\\times64$' AS grid FROM {lineitem} GROUP BY l_returnflag")
def f28_range_text(spark, d):
    own = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("case_name")).agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return own.select("case_name", text.span(F.col("lo"), F.col("hi")).alias("span"), text.compact(1000 * F.col("hi")).alias("large"), text.compact(F.col("hi") / 7).alias("middle"), text.compact(F.col("lo") / 7000).alias("small"), text.grid_text(F.lit("24x24x64")).alias("grid"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, '1') THEN '1' ELSE '' END || CASE WHEN contains(p_name, '1') AND contains(p_name, '23') THEN ',' ELSE '' END || CASE WHEN contains(p_name, '23') THEN '23' ELSE '' END AS found, replace(regexp_replace(p_name, '[0-9]+', 'N', 'g'), 'art', 'ART') AS patched FROM {part}")
def f29_forbidden_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.found_tokens(F.col("p_name"), ["1", "23"]), ",").alias("found"), text.patched(F.col("p_name"), [("[0-9]+", "N"), ("art", "ART")]).alias("patched"))


# ---------------------------------------------------------------- joins

D26 = "(greatest(abs(a.z - b.z), abs(a.y - b.y), abs(a.x - b.x)) - (abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) - greatest(abs(a.z - b.z), abs(a.y - b.y), abs(a.x - b.x)) - least(abs(a.z - b.z), abs(a.y - b.y), abs(a.x - b.x)))) + sqrt(2) * (abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) - greatest(abs(a.z - b.z), abs(a.y - b.y), abs(a.x - b.x)) - 2 * least(abs(a.z - b.z), abs(a.y - b.y), abs(a.x - b.x))) + sqrt(3) * least(abs(a.z - b.z), abs(a.y - b.y), abs(a.x - b.x))"
D2 = "((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))"


@query(f"SELECT a.vid, min({D2}) AS d2, arg_min(b.site_id, {D2} * 100000 + b.site_id) AS site_id FROM {{pore}} a, {{site}} b GROUP BY a.vid")
def j9_euclidean_nearest(spark, d):
    near = search.nearest(rel(spark, d, "pore").withColumnRenamed("vid", "pid"), rel(spark, d, "site").withColumnRenamed("site_id", "sid"), "d2", 8)
    return near.select(F.col("pid").alias("vid"), F.col("dist").cast("bigint").alias("d2"), F.col("sid").alias("site_id"))


@query("SELECT site_id, other, round(dist, 6) AS d26 FROM {stampradius}")
def j10_nearest_site_pair(spark, d):
    return rel(spark, d, "stampradius").select("site_id", "other", F.round("dist", 6).alias("d26"))


@query(f"SELECT a.vid AS solid, arg_min(b.vid, CAST({D2} AS BIGINT) * 10000000 + b.vid) AS nearest FROM {{vox}} a, {{pore}} b WHERE NOT a.pore AND a.vid < 900 GROUP BY a.vid".replace(" AND a.vid < 900", ""))
def j11_nearest_pore(spark, d):
    near = search.nearest(rel(spark, d, "vox").where("NOT pore").withColumnRenamed("vid", "pid"), rel(spark, d, "pore").withColumnRenamed("vid", "sid"), "d2", 3)
    return near.select(F.col("pid").alias("solid"), F.col("sid").alias("nearest"))


@query(f"WITH k AS (SELECT vid, z, y, x, root FROM {{pore}} JOIN {{comp}} USING (vid) WHERE vid % 13 = 5), s AS (SELECT site_id, z, y, x, root FROM {{site}} JOIN {{comp}} USING (vid)), i AS (SELECT a.site_id, arg_min(b.vid, CAST({D2} AS BIGINT) * 10000000 + b.vid) AS nearest FROM s a JOIN k b ON a.root = b.root GROUP BY a.site_id), g AS (SELECT a.site_id, arg_min(b.vid, CAST({D2} AS BIGINT) * 10000000 + b.vid) AS nearest FROM s a, k b GROUP BY a.site_id) SELECT g.site_id, coalesce(i.nearest, g.nearest) AS nearest, i.site_id IS NULL AS fallback FROM g LEFT JOIN i USING (site_id)")
def j12_nearest_in_component(spark, d):
    """The nearest of a given set of voxels in the site's own part, else anywhere."""
    pore = rel(spark, d, "pore").join(rel(spark, d, "comp"), "vid")
    chosen = pore.where("vid % 13 = 5").select(F.col("vid").alias("sid"), "z", "y", "x", "root")
    sites = rel(spark, d, "site").join(rel(spark, d, "comp"), "vid").select(F.col("site_id").alias("pid"), "z", "y", "x", "root")
    inside, anywhere = search.nearest(sites, chosen, "d2", 4, "root"), search.nearest(sites, chosen, "d2", 4)
    own = anywhere.select("pid", F.col("sid").alias("far")).join(inside.select("pid", "sid"), "pid", "left")
    return own.select(F.col("pid").alias("site_id"), F.coalesce("sid", "far").alias("nearest"), F.col("sid").isNull().alias("fallback"))


@query(f"SELECT a.vid, count(*) AS n, round(min({D26}), 6) AS nearest FROM {{pore}} a JOIN {{site}} b ON abs(a.z - b.z) <= 3 AND abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3 WHERE {D26} <= 3 GROUP BY a.vid")
def j13_candidate_ball(spark, d):
    own = search.ball(rel(spark, d, "site").withColumnRenamed("site_id", "sid"), rel(spark, d, "pore"), 3, ORDERS)
    return own.groupBy("vid").agg(F.count("*").alias("n"), F.round(F.min("dist"), 6).alias("nearest"))


# ---------------------------------------------------------------- iterative

@query("WITH RECURSIVE up AS (SELECT e.dst AS vid, min(e.src) AS parent FROM {single} a JOIN {edge} e ON e.src = a.vid JOIN {single} b ON b.vid = e.dst AND b.d = a.d + 1 GROUP BY e.dst), way(vid) AS (SELECT vid FROM (SELECT vid FROM {single} ORDER BY d DESC, vid LIMIT 1) UNION ALL SELECT u.parent FROM way w JOIN up u ON u.vid = w.vid) SELECT w.vid, s.d FROM way w JOIN {single} s ON s.vid = w.vid")
def i6_shortest_path(spark, d):
    """The path from the first site to the voxel farthest from it, by least parents."""
    single = rel(spark, d, "single").select("vid", "d")
    edge = rel(spark, d, "edge").select("src", "dst")
    before, after = single.withColumnRenamed("vid", "src"), single.select(F.col("vid").alias("dst"), (F.col("d") - 1).alias("d"))
    parents = written(edge.join(before, "src").join(after, ["dst", "d"]).groupBy(F.col("dst").alias("vid")).agg(F.min("src").alias("parent")), "parents")
    last = single.agg(F.max(F.struct("d", -F.col("vid"))).alias("m"), F.max("d").alias("most"))
    target = last.select((-F.col("m.col2")).alias("vid"))
    most = last.first()["most"]
    return fields.path_to(parents, target, int(most or 0)).join(single, "vid")


RUNS = "SELECT vid, z, y, x, min(vid) OVER (PARTITION BY y, x, iz) AS rz, min(vid) OVER (PARTITION BY z, x, iy) AS ry, min(vid) OVER (PARTITION BY z, y, ix) AS rx FROM (SELECT *, z - row_number() OVER (PARTITION BY y, x ORDER BY z) AS iz, y - row_number() OVER (PARTITION BY z, x ORDER BY y) AS iy, x - row_number() OVER (PARTITION BY z, y ORDER BY x) AS ix FROM {pore})"


def _clear_sql() -> str:
    """For every candidate, whether one of six paths by axes is free: corners by coordinates, pieces by runs."""
    corner = lambda k: [f"CASE WHEN {int(bool(k >> i & 1))} = 1 THEN c.{a} ELSE c.s{a} END" for i, a in enumerate("zyx")]
    joins = " ".join(f"LEFT JOIN runs k{k} ON k{k}.z = {corner(k)[0]} AND k{k}.y = {corner(k)[1]} AND k{k}.x = {corner(k)[2]}" for k in range(8))
    from itertools import permutations

    ways = []
    for order in permutations(range(3)):
        code, parts = 0, []
        for i in order:
            parts.append(f"coalesce(k{code}.r{'zyx'[i]} = k{code | 1 << i}.r{'zyx'[i]}, false)")
            code |= 1 << i
        ways.append("(" + " AND ".join(parts) + ")")
    return f"runs AS ({RUNS}), ways AS (SELECT c.vid, c.site_id, c.l1, {' OR '.join(ways)} AS clear, {ways[-1]} AS canonical FROM {{latcand}} c {joins})"


@query(f"WITH {_clear_sql()} SELECT vid, arg_min(CASE WHEN clear THEN site_id END, CASE WHEN clear THEN l1 * 100000 + site_id END) AS site_id, min(CASE WHEN clear THEN l1 END) AS l1, bool_or(clear) AS certified FROM ways GROUP BY vid")
def i8_clear_paths(spark, d):
    """The nearest lattice site with a free path along the axes; none is uncertified."""
    return _window_paths(spark, d).select("vid", F.col("clear_site").alias("site_id"), F.col("clear_l1").alias("l1"), F.col("clear_site").isNotNull().alias("certified"))


def _window_paths(spark: SparkSession, d: str) -> DataFrame:
    return search.window_paths(rel(spark, d, "pore"), rel(spark, d, "latsite"), (4, 4, 4), (2, 2, 2))


@query(f"WITH {_clear_sql()} SELECT vid, site_id, l1, clear FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY l1, site_id) AS r FROM ways) WHERE r = 1")
def i9_nearest_clearance(spark, d):
    """Only the nearest site of each voxel, and whether its path is free."""
    return _window_paths(spark, d).select("vid", "site_id", "l1", "clear")


@query("WITH f AS (SELECT vid, min(l1) AS d, arg_min(site_id, l1 * 100000 + site_id) AS site_id FROM {latcand} GROUP BY vid) SELECT vid, site_id, d, 'frontier' AS source, (SELECT count(*) = 0 FROM {edge} e LEFT JOIN f a ON a.vid = e.src LEFT JOIN f b ON b.vid = e.dst WHERE a.vid IS NULL OR b.vid IS NULL OR b.d > a.d + 1 OR b.d = a.d + 1 AND a.site_id < b.site_id) AS distance_certified FROM {latowner}")
def i10_certificate_or_fallback(spark, d):
    """The frontier's ownership, as the certificate of the lattice's says nothing of ties and isn't accepted by default."""
    own, source, certified = lattice_or_frontier(spark, d)
    return own.select("vid", "site_id", "d", F.lit(source).alias("source"), F.lit(certified).alias("distance_certified"))


def lattice_or_frontier(spark: SparkSession, d: str, accept: bool = False) -> tuple[DataFrame, str, bool]:
    """Lattice ownership if its certificate holds (no edge breaks d' <= d + 1, no tie goes to the greater site, no voxel is
    missing) and the caller accepts it, else the frontier's; which of them, and whether the certificate holds."""
    first = rel(spark, d, "latcand").groupBy("vid").agg(F.min(F.struct("l1", "site_id")).alias("b")).select("vid", "b.site_id", F.col("b.l1").alias("d"))
    edge = rel(spark, d, "edge").join(first.select(F.col("vid").alias("src"), F.col("d").alias("da"), F.col("site_id").alias("sa")), "src", "left").join(first.select(F.col("vid").alias("dst"), F.col("d").alias("db"), F.col("site_id").alias("sb")), "dst", "left")
    certified = edge.where("da IS NULL OR db IS NULL OR db > da + 1 OR db = da + 1 AND sa < sb").isEmpty()
    lattice = certified and accept
    return (first if lattice else rel(spark, d, "latowner")).select("vid", "site_id", F.col("d").cast("int").alias("d")), "lattice" if lattice else "frontier", certified


_AXES = ", ".join(f"({i}, {o[0]}, {o[1]}, {o[2]})" for i, o in enumerate(flooding.LINES))
_MOVES = ", ".join(f"({k}, {flooding.LINES.index(max(o, (-o[0], -o[1], -o[2])))}, {-o[0]}, {-o[1]}, {-o[2]}, {sum(map(abs, o))})" for k, o in enumerate(grid.CUBE))
#: The run of voxels through each voxel along 13 lines.
LINE_RUNS = f"axis AS (SELECT * FROM (VALUES {_AXES}) AS v(i, dz, dy, dx)), online AS (SELECT vid, i, t, z - t * dz AS lz, y - t * dy AS ly, x - t * dx AS lx FROM (SELECT *, CASE WHEN dz <> 0 THEN z WHEN dy <> 0 THEN y ELSE x END AS t FROM {{pore}}, axis)), gap AS (SELECT *, t - row_number() OVER (PARTITION BY i, lz, ly, lx ORDER BY t) AS island FROM online), run AS MATERIALIZED (SELECT vid, i, min(vid) OVER (PARTITION BY i, lz, ly, lx, island) AS run FROM gap)"


def _flood_sql(start: str, last: int, core: str = "SELECT NULL::BIGINT AS vid WHERE false") -> str:
    """Jumps from 256 down to `last` from the states of `start` (vid, site_id, d); voxels of `core` don't change."""
    parts = [LINE_RUNS, f"closed AS MATERIALIZED ({core})", f"begun AS MATERIALIZED ({start})", f"move AS (SELECT * FROM (VALUES {_MOVES}) AS v(ord, i, dz, dy, dx, n))", "f512 AS (SELECT p.vid, p.z, p.y, p.x, b.site_id, b.d FROM {pore} p LEFT JOIN begun b USING (vid))"]
    jump = 256
    while jump >= last:
        sent = f"SELECT p.vid, f.d + {jump} * sqrt(m.n) AS d, m.ord, f.site_id FROM f{2 * jump} f JOIN move m ON f.site_id IS NOT NULL JOIN {{pore}} p ON p.z = f.z + {jump} * m.dz AND p.y = f.y + {jump} * m.dy AND p.x = f.x + {jump} * m.dx JOIN run a ON a.vid = f.vid AND a.i = m.i JOIN run b ON b.vid = p.vid AND b.i = m.i AND b.run = a.run WHERE p.vid NOT IN (SELECT vid FROM closed)"
        parts.append(f"f{jump} AS MATERIALIZED (SELECT f.vid, f.z, f.y, f.x, CASE WHEN b.d < coalesce(f.d, 1e300) THEN b.site_id ELSE f.site_id END AS site_id, least(f.d, b.d) AS d FROM f{2 * jump} f LEFT JOIN (SELECT vid, min(d) AS d, arg_min(site_id, (d, ord)) AS site_id FROM ({sent}) GROUP BY vid) b USING (vid))")
        jump //= 2
    return ", ".join(parts)


SITE_STATES = "SELECT vid, site_id, 0.0::DOUBLE AS d FROM {site}"
CORE = "SELECT o.vid, o.site_id, o.d FROM {labels26} o JOIN {stampradius} r USING (site_id) WHERE o.d <= r.radius"


def _flooded(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "flooded", lambda s, p: flooding.flooded(rel(s, p, "pore"), rel(s, p, "site"), ORDERS, relax=0))


def _region(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "region", lambda s, p: flooding.region_jumped(rel(s, p, "pore"), rel(s, p, "stampcore"), ORDERS))


def _region_end(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "regionend", lambda s, p: flooding.region_settled(rel(s, p, "pore"), _region(s, p), ORDERS))


@query(f"WITH {_flood_sql(SITE_STATES, 1)} SELECT vid, site_id, round(d, 5) AS d FROM f1")
def i13_jump_flooding(spark, d):
    """Jump flooding over the whole domain, before any relaxation: its own labels, right or not."""
    return _flooded(spark, d).select("vid", "site_id", F.round("d", 5).alias("d"))


@query("SELECT vid, site_id, round(d, 5) AS d FROM {labels26}")
def i13_same_as_exact(spark, d):
    """Jump flooding relaxed until nothing changes is the exact ownership."""
    return flooding.settled(rel(spark, d, "pore"), _flooded(spark, d), ORDERS).select("vid", "site_id", F.round("d", 5).alias("d"))


def _mismatch(own: DataFrame, exact: DataFrame, stage: str) -> DataFrame:
    """Share of voxels whose label differs from the exact one; none on both sides is equal."""
    both = exact.select("vid", F.col("site_id").alias("want")).join(own.select("vid", "site_id"), "vid", "full")
    return both.agg(F.lit(stage).alias("stage"), F.count("*").alias("voxels"), F.sum(F.when(F.col("site_id").isNull(), 1).otherwise(0)).alias("unreached"), F.round(F.avg(F.when(F.col("site_id").eqNullSafe(F.col("want")), 0.0).otherwise(1.0)), 8).alias("mismatch"))


def _mismatch_sql(own: str, stage: str) -> str:
    return f"SELECT '{stage}' AS stage, count(*) AS voxels, sum(CASE WHEN o.site_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS unreached, round(avg(CASE WHEN o.site_id IS NOT DISTINCT FROM e.site_id THEN 0.0 ELSE 1.0 END), 8) AS mismatch FROM {own} o LEFT JOIN {{labels26}} e USING (vid)"


@query(f"WITH {_flood_sql(SITE_STATES, 1)} {_mismatch_sql('f1', 'jumps')} UNION ALL {_mismatch_sql('(SELECT p.vid, l.site_id FROM {{pore}} p LEFT JOIN {{labels26}} l USING (vid))'.replace('{{', '{').replace('}}', '}'), 'settled')}")
def i13_flood_audit(spark, d):
    """How many labels of jump flooding are wrong before relaxation, and after it."""
    pore = rel(spark, d, "pore")
    exact = pore.select("vid").join(rel(spark, d, "owner26"), "vid", "left")
    jumps = _flooded(spark, d)
    after = pore.select("vid").join(flooding.settled(pore, jumps, ORDERS), "vid", "left")
    return _mismatch(jumps, exact, "jumps").unionByName(_mismatch(after, exact, "settled"))


def _radii(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, "site").join(rel(spark, d, "stampradius").select("site_id", "radius"), "site_id")


@query("SELECT vid, site_id, round(d, 5) AS d FROM {labels26}")
def i11_same_as_exact(spark, d):
    """Stamped cores stay closed, the region around them is flooded by jumps, closed in layers and relaxed: the exact ownership."""
    return _region_end(spark, d).select("vid", "site_id", F.round("d", 5).alias("d"))


@query(f"WITH {_flood_sql(CORE, 2, 'SELECT vid FROM (' + CORE + ')')} SELECT vid, site_id, round(d, 5) AS d, vid NOT IN (SELECT vid FROM closed) AS open FROM f2")
def i11_region_jumps(spark, d):
    """The state after the jumps of the region's flooding, and which voxels were open to them."""
    core = rel(spark, d, "stampcore")
    return _region(spark, d).join(core.select("vid", F.lit(False).alias("open")), "vid", "left").select("vid", "site_id", F.round("d", 5).alias("d"), F.coalesce("open", F.lit(True)).alias("open"))


@query(f"WITH {_flood_sql(CORE, 2, 'SELECT vid FROM (' + CORE + ')')} SELECT count(*) AS voxels, round(avg(CASE WHEN vid IN (SELECT vid FROM closed) THEN 0.0 ELSE 1.0 END), 8) AS eta_roi, round(avg(CASE WHEN vid IN (SELECT vid FROM closed) THEN 1.0 ELSE 0.0 END), 8) AS eta_stamp, round(avg(CASE WHEN f2.site_id IS NULL THEN 1.0 ELSE 0.0 END), 8) AS left_open, round(avg(CASE WHEN f2.site_id IS NOT DISTINCT FROM l.site_id THEN 0.0 ELSE 1.0 END), 8) AS mismatch FROM f2 LEFT JOIN {{labels26}} l USING (vid)".replace("{{labels26}}", "{labels26}"))
def i12_active_share(spark, d):
    """The share of voxels that the jumps are run on, what they leave without a label, and what is still wrong after them."""
    core = rel(spark, d, "stampcore")
    own = _region(spark, d).join(_region_end(spark, d).select("vid", F.col("site_id").alias("want")), "vid", "left").join(core.select("vid", F.lit(1.0).alias("closed")), "vid", "left")
    closed = F.coalesce("closed", F.lit(0.0))
    return own.agg(F.count("*").alias("voxels"), F.round(F.avg(1 - closed), 8).alias("eta_roi"), F.round(F.avg(closed), 8).alias("eta_stamp"), F.round(F.avg(F.when(F.col("site_id").isNull(), 1.0).otherwise(0.0)), 8).alias("left_open"), F.round(F.avg(F.when(F.col("site_id").eqNullSafe(F.col("want")), 0.0).otherwise(1.0)), 8).alias("mismatch"))


@query("SELECT vid, site_id, round(d, 5) AS d FROM {labels26}")
def i12_same_as_exact(spark, d):
    """The variant that refines only the active list: cores certified by the second nearest site too, then jumps and relaxation."""
    pore = rel(spark, d, "pore")
    core = written(flooding.stamped(pore, _radii(spark, d), ORDERS, "D"), "core")
    return flooding.region_settled(pore, flooding.region_jumped(pore, core, ORDERS), ORDERS).select("vid", "site_id", F.round("d", 5).alias("d"))


@query("SELECT vid, site_id, round(d, 5) AS d FROM {labels26}")
def i31_same_as_exact(spark, d):
    """The single kernels in a row: stamped balls, closure by layers, relaxation, without jumps."""
    pore = rel(spark, d, "pore")
    filled = written(fields.closure_fill(pore, rel(spark, d, "stampcore"), ORDERS, digits=None), "closed")
    return flooding.settled(pore, filled, ORDERS).select("vid", "site_id", F.round("d", 5).alias("d"))


@query("SELECT vid, site_id, round(d, 5) AS d FROM {labels26}")
def i32_same_as_exact(spark, d):
    """Ownership from its seed states."""
    return rel(spark, d, "owner26").select("vid", "site_id", F.round("d", 5).alias("d"))


def _second_sql() -> str:
    """Voxels whose nearest site leads the second and is reached along its canonical path, by all pairs and runs."""
    free = "g - m + sqrt(2) * (m - l) + sqrt(3) * l"
    pairs = f"pair AS MATERIALIZED (SELECT p.vid, p.z, p.y, p.x, s.site_id, s.z AS sz, s.y AS sy, s.x AS sx, {free} AS dist, g, m, l FROM {{pore}} p, {{site}} s, LATERAL (SELECT greatest(abs(p.z - s.z), abs(p.y - s.y), abs(p.x - s.x)) AS g, least(abs(p.z - s.z), abs(p.y - s.y), abs(p.x - s.x)) AS l) q, LATERAL (SELECT abs(p.z - s.z) + abs(p.y - s.y) + abs(p.x - s.x) - g - l AS m) w)"
    two = "two AS (SELECT *, lead(dist) OVER (PARTITION BY vid ORDER BY dist, site_id) AS next, row_number() OVER (PARTITION BY vid ORDER BY dist, site_id) AS r FROM pair)"
    own = "best AS MATERIALIZED (SELECT *, CASE WHEN z >= sz THEN 1 ELSE -1 END AS gz, CASE WHEN y >= sy THEN 1 ELSE -1 END AS gy, CASE WHEN x >= sx THEN 1 ELSE -1 END AS gx, list_sort([{n: -abs(z - sz), a: 0}, {n: -abs(y - sy), a: 1}, {n: -abs(x - sx), a: 2}]) AS k FROM two WHERE r = 1 AND (next IS NULL OR dist + 1e-6 <= next))"
    steps = []
    for c, a in zip("zyx", range(3), strict=True):
        steps += [f"g{c} AS m1{c}", f"g{c} * CASE WHEN k[1].a = {a} OR k[2].a = {a} THEN 1 ELSE 0 END AS m2{c}", f"g{c} * CASE WHEN k[1].a = {a} THEN 1 ELSE 0 END AS m3{c}"]
    moves = f"moves AS (SELECT *, {', '.join(steps)} FROM best)"
    at = ", ".join(f"s{c} + l * m1{c} AS a{c}, s{c} + l * m1{c} + (m - l) * m2{c} AS b{c}" for c in "zyx")
    code = ", ".join(f"abs(m{j}z * 9 + m{j}y * 3 + m{j}x) AS c{j}" for j in (1, 2, 3))
    ends = f"ends AS (SELECT vid, site_id, dist, (sz * 30 + sy) * 50 + sx AS e0, (az * 30 + ay) * 50 + ax AS e1, (bz * 30 + by_) * 50 + bx AS e2, vid AS e3, {code} FROM (SELECT *, {at.replace('AS by,', 'AS by_,')} FROM moves))"
    named = "named AS MATERIALIZED (SELECT r.vid, r.run, abs(a.dz * 9 + a.dy * 3 + a.dx) AS code FROM run r JOIN axis a USING (i))"
    joins = " ".join(f"JOIN {{pore}} p{j} ON p{j}.vid = e.e{j}" for j in range(4)) + " " + " ".join(f"LEFT JOIN named a{j} ON a{j}.vid = e.e{j - 1} AND a{j}.code = e.c{j} LEFT JOIN named b{j} ON b{j}.vid = e.e{j} AND b{j}.code = e.c{j}" for j in (1, 2, 3))
    clear = " AND ".join(f"(e.e{j - 1} = e.e{j} OR a{j}.run = b{j}.run)" for j in (1, 2, 3))
    return f"{LINE_RUNS}, {pairs}, {two}, {own}, {moves}, {ends}, {named}, certain AS MATERIALIZED (SELECT e.vid, e.site_id, e.dist AS d FROM ends e {joins} WHERE {clear})"


@query(f"WITH {_second_sql()}, core AS MATERIALIZED ({CORE}) SELECT 'A' AS mode, vid, site_id, round(d, 5) AS d FROM core WHERE d <= greatest((SELECT radius FROM {{stampradius}} r WHERE r.site_id = core.site_id) - 1e-6, 0) UNION ALL SELECT 'C', vid, site_id, round(d, 5) FROM core UNION ALL SELECT 'D', vid, site_id, round(d, 5) FROM core UNION ALL SELECT 'D', vid, site_id, round(d, 5) FROM certain WHERE vid NOT IN (SELECT vid FROM core)")
def i14_stamp_modes(spark, d):
    """Cores by each mode: short of the radius, the whole radius, and what the second nearest site certifies besides."""
    own = None
    for mode in "ACD":
        one = flooding.stamped(rel(spark, d, "pore"), _radii(spark, d), ORDERS, mode).select(F.lit(mode).alias("mode"), "vid", "site_id", F.round("d", 5).alias("d"))
        own = one if own is None else own.unionByName(one)
    return own


@query(f"WITH runs AS MATERIALIZED ({RUNS}), r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY l1, site_id) AS k FROM {{latcand}}), ends AS (SELECT vid, site_id, l1, (sz * 30 + sy) * 50 + sx AS e0, (sz * 30 + sy) * 50 + x AS e1, (sz * 30 + y) * 50 + x AS e2, vid AS e3 FROM r WHERE k = 1), one AS (SELECT e.vid, e.site_id, e.l1, coalesce(a.rx = b.rx AND b.ry = c.ry AND c.rz = p.rz, false) AS canonical FROM ends e LEFT JOIN runs a ON a.vid = e0 LEFT JOIN runs b ON b.vid = e1 AND b.y = a.y LEFT JOIN runs c ON c.vid = e2 LEFT JOIN runs p ON p.vid = e3) SELECT a.vid, a.site_id, b.l1 - a.l1 AS lead, a.canonical AND coalesce(b.l1 - a.l1 >= 2, true) AS certified FROM one a LEFT JOIN (SELECT vid, l1 FROM r WHERE k = 2) b USING (vid)")
def i16_second_competitor(spark, d):
    """The nearest site holds for certain if the second is farther by a margin and the canonical path is free."""
    lead = F.col("next_l1") - F.col("l1")
    return _window_paths(spark, d).select("vid", "site_id", lead.alias("lead"), (F.col("canonical") & F.coalesce(lead >= 2, F.lit(True))).alias("certified"))


@query("SELECT o.vid, 2 * o.d < n.spacing AS core FROM {owner} o JOIN (SELECT site, min(spacing) AS spacing FROM (SELECT owner AS site, (r_owner2 + r_neighbor2) // 2 AS spacing FROM {face} UNION ALL SELECT neighbor, (r_owner2 + r_neighbor2) // 2 FROM {face}) GROUP BY site) n ON n.site = o.site_id")
def i17_certified_core(spark, d):
    """Voxels nearer than half the geodesic spacing of their site; the spacing is found at the faces of its cell."""
    face = rel(spark, d, "face").withColumn("spacing", F.floor((F.col("r_owner2") + F.col("r_neighbor2")) / 2))
    spacing = face.select(F.explode(F.array("owner", "neighbor")).alias("site_id"), "spacing").groupBy("site_id").agg(F.min("spacing").alias("spacing"))
    return rel(spark, d, "owner").join(spacing, "site_id").select("vid", (2 * F.col("d") < F.col("spacing")).alias("core"))


@query(f"WITH {LINE_RUNS}, span AS (SELECT vid, i, t, min(t) OVER w AS lo, max(t) OVER w AS hi FROM gap WINDOW w AS (PARTITION BY i, lz, ly, lx, island)) SELECT vid, s * dz AS dz, s * dy AS dy, s * dx AS dx, CAST(CASE WHEN n >= 32 THEN 5 WHEN n >= 16 THEN 4 WHEN n >= 8 THEN 3 WHEN n >= 4 THEN 2 WHEN n >= 2 THEN 1 WHEN n >= 1 THEN 0 ELSE -1 END AS INT) AS k FROM (SELECT vid, i, s, CASE WHEN s = 1 THEN hi - t ELSE t - lo END AS n FROM span, (VALUES (1), (-1)) AS v(s)) JOIN axis USING (i)")
def i18_line_of_sight(spark, d):
    return search.sight(rel(spark, d, "pore"), ORDERS, 5)


@query("WITH t AS (SELECT z // 4 AS tz, y // 4 AS ty, x // 4 AS tx, CASE WHEN bool_and(pore) THEN 'dense' WHEN bool_or(pore) THEN 'mixed' ELSE 'none' END AS kind, bool_or(vid % 97 = 13 AND pore) AS active FROM {vox} GROUP BY ALL) SELECT a.tz, a.ty, a.tx, a.kind, a.active, bool_or(b.active) AS dilated FROM t a JOIN t b ON abs(a.tz - b.tz) <= 1 AND abs(a.ty - b.ty) <= 1 AND abs(a.tx - b.tx) <= 1 GROUP BY ALL")
def i19_tile_classes(spark, d):
    """Tiles none, mixed or dense, those that hold a site, and those next to them."""
    tile = [F.floor(F.col(c) / 4).cast("bigint").alias(f"t{c}") for c in "zyx"]
    own = rel(spark, d, "vox").groupBy(*tile).agg(F.min("pore").alias("every"), F.max("pore").alias("some"), F.max((F.col("vid") % 97 == 13) & F.col("pore")).alias("active"))
    own = own.withColumn("kind", F.when(F.col("every"), "dense").when(F.col("some"), "mixed").otherwise("none"))
    around = own.where("active")
    for c in "zyx":
        around = around.withColumn(f"t{c}", F.explode(F.array(*(F.col(f"t{c}") + k for k in (-1, 0, 1)))))
    around = around.select("tz", "ty", "tx").distinct().withColumn("dilated", F.lit(True))
    return own.join(around, ["tz", "ty", "tx"], "left").select("tz", "ty", "tx", "kind", "active", F.coalesce("dilated", F.lit(False)).alias("dilated"))


@query("WITH RECURSIVE core AS (SELECT o.vid, o.site_id, round(o.d, 6) AS d FROM {labels26} o JOIN {stampradius} r USING (site_id) WHERE o.d <= r.radius), fill(vid, site_id, d) USING KEY (vid) AS (SELECT vid, site_id, d FROM core UNION SELECT dst, m.s, m.d FROM (SELECT e.dst, min({'d': round(r.d + sqrt(e.w2), 6), 's': r.site_id}) AS m FROM fill r JOIN {edge26} e ON e.src = r.vid LEFT JOIN recurring.fill k ON k.vid = e.dst WHERE k.vid IS NULL GROUP BY e.dst)) SELECT vid, site_id, round(d, 3) AS d FROM fill")
def i20_closure_fill(spark, d):
    """From the stamped cores, layer by layer, until every reachable voxel has a label."""
    core = rel(spark, d, "owner26").join(rel(spark, d, "stampradius").select("site_id", "radius"), "site_id").where("d <= radius").select("vid", "site_id", F.round("d", 6).alias("d"))
    return fields.closure_fill(rel(spark, d, "pore"), core, ORDERS).select("vid", "site_id", F.round("d", 3).alias("d"))


def _crack_sql(rounds: int) -> str:
    """Rounds of filling, written out: an unlabelled voxel whose labelled neighbours all agree takes their label."""
    step = "SELECT vid, label FROM {0} UNION ALL SELECT e.src, min(a.label) FROM {{edge}} e JOIN {0} a ON a.vid = e.dst WHERE e.src NOT IN (SELECT vid FROM {0}) GROUP BY e.src HAVING min(a.label) = max(a.label)"
    parts = ["c0 AS (SELECT vid, site_id AS label FROM {owner} WHERE vid % 5 <> 0 AND vid % 7 <> 0)"]
    parts += [f"c{k} AS MATERIALIZED ({step.format(f'c{k - 1}')})".replace("{{edge}}", "{edge}") for k in range(1, rounds + 1)]
    return f"WITH {', '.join(parts)} SELECT vid, label FROM c{rounds}"


@query(_crack_sql(8))
def i21_unique_crack_fill(spark, d):
    """Until nothing changes: an unlabelled voxel takes the label on which its labelled neighbours agree."""
    own = rel(spark, d, "pore").select("vid", "z", "y", "x").join(rel(spark, d, "owner").where("vid % 5 <> 0 AND vid % 7 <> 0").select("vid", F.col("site_id").alias("label")), "vid", "left")
    return fields.fill_cracks(own, ORDERS).where("label IS NOT NULL").select("vid", "label")


@query("WITH c AS MATERIALIZED (SELECT vid, root FROM {comp}) SELECT vid FROM c WHERE root = (SELECT root FROM c GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)")
def i26_largest_component(spark, d):
    comp = rel(spark, d, "comp")
    best = comp.groupBy("root").count().agg(F.max_by("root", F.struct("count", -F.col("root"))).alias("root"))
    return comp.join(F.broadcast(best), "root").select("vid")


#: A pressure that falls along x, uneven by the voxels' values.
SLOPE = "1 - x / 49.0 + (val - 250000) / 10000000.0"
_STEPS = ", ".join(f"({k}, {o[0]}, {o[1]}, {o[2]})" for k, o in enumerate(tracing.ORDER))
_LINES_SQL = f"""
WITH RECURSIVE f AS MATERIALIZED (SELECT vid, z, y, x, {SLOPE} AS p FROM {{pore}}),
near AS MATERIALIZED (SELECT a.vid AS src, b.vid AS dst, k, a.p AS here, b.p AS there, b.p - 0.015 * dx AS score FROM f a, (VALUES {_STEPS}) AS o(k, dz, dy, dx), f b WHERE b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx),
line(line_id, seq, vid, visited) AS (SELECT vid, 0, vid, [vid] FROM f WHERE p > 0.86 AND vid % 5 = 2
  UNION ALL SELECT l.line_id, l.seq + 1, n.dst, list_append(l.visited, n.dst) FROM line l JOIN f c ON c.vid = l.vid
  JOIN LATERAL (SELECT dst, there, here FROM near WHERE src = l.vid AND NOT list_contains(l.visited, dst) ORDER BY score, k LIMIT 1) n ON true
  WHERE c.x < 48 AND c.p > 0.02 AND l.seq < 1600 AND n.there <= n.here + 0.02)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    pore = rel(spark, d, "pore").withColumn("p", F.expr(SLOPE.replace("49.0", "49.0D").replace("10000000.0", "10000000.0D")))
    starts = pore.where("p > 0.86 AND vid % 5 = 2").select(F.col("vid").alias("line_id"), "vid")
    return tracing.streamlines(starts, pore, "p", ORDERS)


@query(f"{_LINES_SQL} SELECT line_id, CAST(seq AS INT) AS seq, vid FROM line")
def i27_streamlines(spark, d):
    """Lines from the inlet's high values down to the outlet: least value with a bias along x among the unvisited neighbours."""
    return _lines(spark, d).select("line_id", "seq", "vid")


@query(f"{_LINES_SQL}, own AS (SELECT line_id, count(*) AS n, arg_max(vid, seq) AS last FROM line GROUP BY line_id) SELECT count(*) AS requested, count(*) FILTER (n >= 5) AS saved, CAST(sum(n) FILTER (n >= 5) AS BIGINT) AS points, count(*) FILTER (f.x >= 48 OR f.p <= 0.02) AS reached, max(n) AS longest FROM own JOIN f ON f.vid = own.last")
def i27_line_audit(spark, d):
    """How many lines there are, how many of five voxels or more and with how many points, and how many reach the outlet."""
    own = _lines(spark, d).groupBy("line_id").agg(F.count("*").alias("n"), F.first("state").alias("state"))
    long = F.col("n") >= 5
    return own.agg(F.count("*").alias("requested"), F.sum(long.cast("bigint")).alias("saved"), F.sum(F.when(long, F.col("n"))).alias("points"), F.sum((F.col("state") == "reached").cast("bigint")).alias("reached"), F.max("n").alias("longest"))


#: Corners, edges, faces and cubes of the pore, each once, by 26-connected parts.
_EULER = "WITH RECURSIVE root26(vid, root) USING KEY (vid) AS (SELECT vid, vid FROM {pore} UNION SELECT e.dst, min(r.root) FROM root26 r JOIN {edge26} e ON e.src = r.vid JOIN recurring.root26 k ON k.vid = e.dst WHERE r.root < k.root GROUP BY e.dst), cells AS (SELECT DISTINCT root, 2 * z + 1 + a AS z, 2 * y + 1 + b AS y, 2 * x + 1 + c AS x, CASE WHEN (abs(a) + abs(b) + abs(c)) % 2 = 1 THEN 1 ELSE -1 END AS sign FROM {pore} JOIN root26 USING (vid), (SELECT i - 1 AS a, j - 1 AS b, l - 1 AS c FROM range(3) r1(i), range(3) r2(j), range(3) r3(l)))"


@query(f"{_EULER} SELECT root, 1::BIGINT AS parts, CAST(sum(sign) AS BIGINT) AS euler, TRUE AS has_skeleton, FALSE AS thicker FROM cells GROUP BY root")
def i28_thinning(spark, d):
    """Every part of the pore has a skeleton of one part with the pore's own Euler number (components, tunnels, cavities), and no larger."""
    pore = rel(spark, d, "pore")
    parts = written(pore.select("vid", "z", "y", "x").join(fields.components(pore, ORDERS, full=True), "vid"), "parts26")
    bones = thinning.thinned(pore, ORDERS)
    pieces = fields.components(bones, ORDERS, full=True).withColumnRenamed("root", "piece")
    own = bones.join(parts.select("vid", "root"), "vid")
    count = own.join(pieces, "vid").groupBy("root").agg(F.countDistinct("piece").alias("parts"), F.count("*").alias("n"))
    size = parts.groupBy("root").agg(F.count("*").alias("voxels"))
    return size.join(count, "root", "left").join(thinning.euler_numbers(own), "root", "left").select("root", F.coalesce("parts", F.lit(0)).alias("parts"), "euler", (F.coalesce("n", F.lit(0)) > 0).alias("has_skeleton"), (F.col("n") > F.col("voxels")).alias("thicker"))


@query("SELECT vid, TRUE AS assigned, TRUE AS owned_by_site FROM {labels26}")
def i28_skeleton_ownership(spark, d):
    """Ownership by way of a skeleton: every voxel that a site can reach gets one."""
    own = fields.skeleton_ownership(rel(spark, d, "pore"), rel(spark, d, "site"), ORDERS)
    sites = rel(spark, d, "site").select("site_id", F.lit(True).alias("known"))
    return own.join(sites, "site_id", "left").select("vid", F.col("d").isNotNull().alias("assigned"), F.coalesce("known", F.lit(False)).alias("owned_by_site"))


@query("SELECT dx, x, CAST(count(*) AS BIGINT) AS area FROM {exposed} JOIN {pore} USING (vid) WHERE dx <> 0 GROUP BY dx, x")
def i30_rectangle_merge(spark, d):
    """Faces across x merged into rectangles of their plane; the rectangles' areas are the faces'."""
    faces = rel(spark, d, "exposed").where("dx <> 0").join(rel(spark, d, "pore").select("vid", "z", "y", "x"), "vid")
    return fields.rectangles(faces, ["dx", "x"], "z", "y").groupBy("dx", "x").agg(F.sum(F.col("width") * F.col("height")).alias("area"))


# ---------------------------------------------------------------- assertions


@query("SELECT run_id, line, case_name FROM (SELECT l_orderkey AS run_id, l_linenumber AS line, l_returnflag AS case_name, l_linestatus AS method, l_quantity AS e_k, l_discount AS e_phi, l_tax AS e_u, l_extendedprice AS t_total FROM {lineitem}) AS r WHERE case_name IN ('A', 'R') AND line <= 2")
def f8_case_filter(spark, d):
    """Runs of named cases; a filter that leaves none is an error."""
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("case_name"))
    return checks.some(own.where("case_name IN ('A', 'R') AND line <= 2"), "no run is left by the case filter")


@query('SELECT f.vid, f.nb, g.area, g.owner IS NULL AS unmatched FROM {face} f LEFT JOIN {graph} g ON g.owner = f.owner AND g.neighbor = f.neighbor')
def j7_edge_key_lookup(spark, d):
    """Faces with their edge's area; a face whose pair of cells is no edge is an error."""
    graph = rel(spark, d, "graph").select("owner", "neighbor", "area")
    own = checks.looked_up(rel(spark, d, "face").select("owner", "neighbor", "vid", "nb"), graph, ["owner", "neighbor"], "faces without an edge")
    return own.select("vid", "nb", "area", F.lit(False).alias("unmatched"))


@query('SELECT site_id, lz, ly, lx, vid, (z - 2) % 4 = 0 AND (y - 2) % 4 = 0 AND (x - 2) % 4 = 0 AS on_lattice FROM {latsite}')
def j15_lattice_lut(spark, d):
    """Lattice indices of sites; a site off the lattice is an error."""
    return lattice_table(rel(spark, d, "latsite")).select("site_id", "lz", "ly", "lx", "vid", F.lit(True).alias("on_lattice"))


def lattice_table(sites: DataFrame, stride: int = 4, offset: int = 2) -> DataFrame:
    """(site_id, vid, lz, ly, lx) of sites (site_id, vid, z, y, x), all of which must stand on the lattice."""
    on = " AND ".join(f"pmod({c} - {offset}, {stride}) = 0" for c in "zyx")
    own = checks.every(sites, on, ["site_id"], "sites off the lattice")
    return own.select("site_id", "vid", *(F.floor((F.col(c) - offset) / stride).cast("int").alias(f"l{c}") for c in "zyx"))


@query('SELECT l.l_orderkey, l.l_linenumber, o.o_orderpriority, o.o_orderkey IS NULL AS missing FROM {lineitem} l LEFT JOIN {orders} o ON o.o_orderkey = l.l_orderkey')
def j16_key_lookup(spark, d):
    """Rows with what stands under their key; a key without a row is an error."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    own = checks.looked_up(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), orders, ["l_orderkey"], "lines without an order")
    return own.select("l_orderkey", "l_linenumber", "o_orderpriority", F.lit(False).alias("missing"))


@query("SELECT v.tag, p.p_partkey, p.p_name, p.p_partkey IS NULL AS missing FROM (VALUES (1, 'first'), (5, 'fifth'), (9, 'ninth'), (-4, 'none')) AS v(k, tag) LEFT JOIN {part} p ON p.p_partkey = v.k")
def j23_selection_join(spark, d):
    """A fixed selection with its rows; a selected key without a row stays, and is named missing."""
    chosen = spark.createDataFrame([(1, "first"), (5, "fifth"), (9, "ninth"), (-4, "none")], "k bigint, tag string")
    part = table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name")
    return chosen.join(part, F.col("k") == F.col("p_partkey"), "left").select("tag", "p_partkey", "p_name", F.col("p_partkey").isNull().alias("missing"))


# ---------------------------------------------------------------- exact quantiles


@query('SELECT min(n) AS min_voxels, median(n) AS median_voxels, max(n) AS max_voxels, count(*) AS cells, count(DISTINCT label) AS labels FROM (SELECT label, cell_id, count(*) AS n FROM {block} GROUP BY label, cell_id) AS c')
def a13_cell_stats(spark, d):
    cell = written(rel(spark, d, "block").groupBy("label", "cell_id").agg(F.count("*").alias("n")), "cells")
    own = cell.agg(F.min("n").alias("min_voxels"), F.max("n").alias("max_voxels"), F.count("*").alias("cells"), F.countDistinct("label").alias("labels"))
    return own.join(quantiles(cell, "n", [0.5]).select(F.col("quantile").alias("median_voxels")))


@query('SELECT count(*) AS faces, round(avg(ell), 6) AS ell_mean, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY ell), 6) AS ell_p90, round(avg(t), 6) AS t_mean FROM {metric}')
def a16_metric_summary(spark, d):
    face = rel(spark, d, "metric")
    own = face.agg(F.count("*").alias("faces"), F.round(F.avg("ell"), 6).alias("ell_mean"), F.round(F.avg("t"), 6).alias("t_mean"))
    return own.join(quantiles(face, "ell", [0.9]).select(F.round("quantile", 6).alias("ell_p90")))


@query('SELECT max(t.total) AS total_voxels, count(*) AS fluid_voxels, round(count(*) / CAST(max(t.total) AS DOUBLE), 8) AS porosity, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 8) AS near_wall, round(avg(n), 8) AS mean_solid, percentile_cont(0.9) WITHIN GROUP (ORDER BY n) AS p90_solid, percentile_cont(0.99) WITHIN GROUP (ORDER BY n) AS p99_solid, round(sum(n) / CAST(count(*) AS DOUBLE), 8) AS faces_per_fluid FROM (SELECT p.vid, coalesce(c.n, 0) AS n FROM {pore} p LEFT JOIN (SELECT vid, count(*) AS n FROM {contact} GROUP BY vid) c ON c.vid = p.vid) AS q CROSS JOIN (SELECT count(*) AS total FROM {vox}) AS t')
def a20_wall_contacts(spark, d):
    """Porosity, fluid voxels next to a wall, their solid neighbours (the domain's border is none), and faces to solid by fluid voxel."""
    solid = rel(spark, d, "contact").groupBy("vid").agg(F.count("*").alias("n"))
    fluid = written(rel(spark, d, "pore").select("vid").join(solid, "vid", "left").select("vid", F.coalesce("n", F.lit(0)).alias("n")), "contacts")
    total = rel(spark, d, "vox").agg(F.count("*").alias("total_voxels"))
    own = fluid.agg(F.count("*").alias("fluid_voxels"), F.round(F.avg((F.col("n") > 0).cast("double")), 8).alias("near_wall"), F.round(F.avg("n"), 8).alias("mean_solid"), F.round(F.sum("n") / F.count("*").cast("double"), 8).alias("faces_per_fluid"))
    q = quantiles(fluid, "n", [0.9, 0.99]).agg(F.max(F.when(F.col("fraction") == 0.9, F.col("quantile"))).alias("p90_solid"), F.max(F.when(F.col("fraction") == 0.99, F.col("quantile"))).alias("p99_solid"))
    return total.join(own).join(q).withColumn("porosity", F.round(F.col("fluid_voxels") / F.col("total_voxels").cast("double"), 8))


@query('SELECT round(percentile_cont(0.9) WITHIN GROUP (ORDER BY val), 4) AS p90, round(avg(val), 4) AS mean, min(val) AS lo, max(val) AS hi FROM {pore}')
def a23_percentiles(spark, d):
    own = rel(spark, d, "pore")
    base = own.agg(F.round(F.avg("val"), 4).alias("mean"), F.min("val").alias("lo"), F.max("val").alias("hi"))
    return base.join(quantiles(own, "val", [0.9]).select(F.round("quantile", 4).alias("p90")))


@query('SELECT g.owner, g.neighbor, g.area, median(v.z + CASE WHEN f.axis = 0 THEN 0.5 ELSE 0.0 END) AS mz, median(v.y + CASE WHEN f.axis = 1 THEN 0.5 ELSE 0.0 END) AS my, median(v.x + CASE WHEN f.axis = 2 THEN 0.5 ELSE 0.0 END) AS mx FROM (SELECT owner, neighbor, area FROM {graph} ORDER BY area DESC, owner, neighbor LIMIT 1) g JOIN {face} f ON f.owner = g.owner AND f.neighbor = g.neighbor JOIN {pore} v ON v.vid = f.vid GROUP BY g.owner, g.neighbor, g.area')
def w8_largest_edge(spark, d):
    """The edge of the largest area (then of the least cells) and the median of its facelets' midpoints."""
    best = rel(spark, d, "graph").agg(F.max_by(F.struct("owner", "neighbor", "area"), F.struct("area", -F.col("owner"), -F.col("neighbor"))).alias("b")).select("b.*")
    face = rel(spark, d, "face").join(F.broadcast(best), ["owner", "neighbor"]).join(rel(spark, d, "pore").select("vid", "z", "y", "x"), "vid")
    middle = written(face.select("owner", "neighbor", "area", *((F.col(c) + F.when(F.col("axis") == k, 0.5).otherwise(0.0)).alias(f"m{c}") for k, c in enumerate("zyx"))), "midpoints")
    own = best
    for c in "zyx":
        own = own.join(quantiles(middle, f"m{c}", [0.5], ["owner", "neighbor"]).select("owner", "neighbor", F.col("quantile").alias(f"m{c}")), ["owner", "neighbor"])
    return own


# ---------------------------------------------------------------- aggregations and windows


@query("SELECT l_returnflag AS paper_case, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) FILTER (l_linestatus = 'F') AS F, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) FILTER (l_linestatus = 'O') AS O FROM {lineitem} GROUP BY l_returnflag")
def a27_pivot(spark, d):
    """The first value (in the order of the rows) of each method by case, as columns."""
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("paper_case")).pivot("l_linestatus", ["F", "O"]).agg(F.min_by("l_quantity", F.struct("l_orderkey", "l_linenumber")))


@query("SELECT case_name, run_id, line, valid, rank FROM (SELECT a.case_name, a.run_id, a.line, a.valid, coalesce(o.k, 999) AS rank, row_number() OVER (PARTITION BY a.case_name ORDER BY coalesce(a.e_k, 1e9) + 0.25 * coalesce(a.e_phi, 0) + 0.1 * coalesce(a.e_u, 0), a.run_id, a.line) AS r FROM (SELECT *, max(valid) OVER (PARTITION BY case_name) AS any_valid FROM (SELECT *, CASE WHEN case_name <> 'N' AND method = 'O' THEN 1 ELSE 0 END AS valid FROM (" + RUN_ROWS + ") AS b) AS v) AS a LEFT JOIN (VALUES ('R', 0), ('A', 1)) AS o(name, k) ON o.name = a.case_name WHERE a.valid = a.any_valid) AS q WHERE r = 1 ORDER BY rank, case_name")
def w2_best_row(spark, d):
    """The best run of each case, by least score, run and line, among its valid ones if it has any. Least scores by hash first; only
    the runs that have a case's least score are compared by their ids."""
    run = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("case_name"), F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"), F.when((F.col("l_returnflag") != "N") & (F.col("l_linestatus") == "O"), 1).otherwise(0).alias("valid"), F.expr("coalesce(l_quantity, 1e9) + 0.25D * coalesce(l_discount, 0) + 0.1D * coalesce(l_tax, 0)").alias("score"))
    least = run.groupBy("case_name", "valid").agg(F.min("score").alias("least"))
    least = least.groupBy(F.col("case_name").alias("name")).agg(F.max(F.struct("valid", "least")).alias("b")).select("name", F.col("b.valid").alias("kind"), "b.least")  # two rows for each case
    tied = run.join(F.broadcast(least), F.col("case_name").eqNullSafe(F.col("name")) & (F.col("valid") == F.col("kind")) & (F.col("score") == F.col("least")))
    best = tied.groupBy("case_name", "valid").agg(F.min(F.struct("run_id", "line")).alias("b"))
    rank = F.when(F.col("case_name") == "R", 0).when(F.col("case_name") == "A", 1).otherwise(999)
    return best.select("case_name", "b.run_id", "b.line", "valid", rank.alias("rank")).orderBy("rank", "case_name")


@query("SELECT l_orderkey AS line_id, n, sum(n) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS start FROM (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey HAVING count(*) >= 5)")
def w6_ragged_offsets(spark, d):
    own = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("line_id")).agg(F.count("*").alias("n")).where("n >= 5")
    return fields.running(own, "line_id", {"end": "n"}).select("line_id", "n", (F.col("end") - F.col("n")).alias("start"))


@query("SELECT o_orderkey, n AS completed, cents / n / 100 AS mean_so_far, (total - n) * (cents / n / 100) AS eta FROM (SELECT o_orderkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS cents, count(*) OVER w AS n, count(*) OVER () AS total FROM {orders} WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")
def w13_eta(spark, d):
    """Completed units, mean seconds so far, and what is left at that rate."""
    own = table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c"), F.lit(1).cast("bigint").alias("one"))
    total = F.broadcast(own.agg(F.count("*").alias("total")))
    mean = F.col("cents") / F.col("n") / 100
    return fields.running(own, "o_orderkey", {"cents": "c", "n": "one"}).join(total).select("o_orderkey", F.col("n").alias("completed"), mean.alias("mean_so_far"), ((F.col("total") - F.col("n")) * mean).alias("eta"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 3) AS smooth FROM {orders}")
def w14_moving_average(spark, d):
    return fields.moving_average(table(spark, d, "orders"), "o_orderkey", "o_totalprice", 2).select("o_orderkey", F.round("smooth", 3).alias("smooth"))
