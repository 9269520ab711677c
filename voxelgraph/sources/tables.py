"""Sources and sinks: mask archives, TIFF windows, string CSV, JSON rows and scenes, stage tables, manifests, report tables, meshes.

Files are read by Spark's readers (binaryFile, csv, text, parquet), so any store that Spark knows will do.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..plans.memory import written

CHUNK = 1 << 18
VOXELS = "vid bigint, z int, y int, x int, pore boolean, depth int, height int, width int"


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a small file to any file system that Spark reaches."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def _voxels(mask: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
    flat, (depth, height, width) = mask.ravel(), mask.shape
    for a in range(0, len(flat), CHUNK):
        i = np.arange(a, min(a + CHUNK, len(flat)))
        columns = [i + first, i // (height * width), i // width % height, i % width]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:]), pa.array(flat[i]), *(pa.array(np.full(len(i), n), pa.int32()) for n in (depth, height, width))], [x.split()[0] for x in VOXELS.split(", ")])


def mask_archive(spark: SparkSession, path: str, member: str = "mask") -> DataFrame:
    """(vid, z, y, x, pore, depth, height, width) of the dense masks [z, y, x] in .npz archives, one archive a task."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                with np.load(io.BytesIO(content.as_py())) as archive:
                    yield from _voxels(archive[member].astype(bool))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, VOXELS)


def tiff_pages(data: bytes) -> Iterator[tuple[int, int, list[tuple[int, int]], int]]:
    """(height, width, strips as (place, bytes), bits) of the pages of an uncompressed grey TIFF."""
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", data, 4)[0]
    while at:
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            code, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("B", 1))
            place = at + 10 + 12 * k if size * count <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
        if tags.get(259, (1,))[0] != 1:
            raise ValueError("compressed TIFF")
        yield tags[257][0], tags[256][0], list(zip(tags[273], tags[279], strict=True)), tags.get(258, (8,))[0]
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def tiff_window(spark: SparkSession, path: str, start: tuple[int, int, int], size: tuple[int, int, int], pore_value: int) -> DataFrame:
    """(vid, z, y, x, pore, depth, height, width) of a window of a TIFF stack, counted from its corner; pages outside it are
    not decoded."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data, pages = content.as_py(), []
                for z, (height, width, strips, bits) in enumerate(tiff_pages(data)):
                    if start[0] <= z < start[0] + size[0]:
                        page = np.frombuffer(b"".join(data[a : a + n] for a, n in strips), np.uint8 if bits == 8 else np.uint16).reshape(height, width)
                        pages.append(page[start[1] : start[1] + size[1], start[2] : start[2] + size[2]] == pore_value)
                yield from _voxels(np.stack(pages))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, VOXELS)


def tiff(pages: np.ndarray) -> bytes:
    """An uncompressed 8-bit grey TIFF of the planes."""
    out, links = bytearray(struct.pack("<2sHI", b"II", 42, 0)), [4]
    for page in pages.astype(np.uint8):
        place = len(out)
        out += page.tobytes()
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, links[-1], len(out))
        tags = [(256, 4, page.shape[1]), (257, 4, page.shape[0]), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, place), (277, 3, 1), (278, 4, page.shape[0]), (279, 4, page.size)]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
        links.append(len(out))
        out += struct.pack("<I", 0)
    return bytes(out)


def save_stage(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables of a stage by name, one folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_stage(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def csv_strings(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """All columns as strings and the file that a row is from (source_path); a byte-order mark, quotes and blanks in the header
    are cleaned away. Files below the folder are found too."""
    own = spark.read.csv(path, header=True, inferSchema=False, recursiveFileLookup=True, pathGlobFilter=glob, quote='"', escape='"', multiLine=True)
    named = own.toDF(*(c.lstrip("﻿").strip().strip('"').strip() for c in own.columns))
    return named.select("*", F.col("_metadata.file_path").alias("source_path")) if own.columns else named


def union_rows(*tables: DataFrame) -> DataFrame:
    """Rows of heterogeneous tables; columns in first-seen order, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_csv(df: DataFrame, path: str) -> None:
    """A header, and missing values as empty cells."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", quote='"', escape='"')


def write_json(df: DataFrame, path: str) -> None:
    """A line a row, keys in ascending order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path, ignoreNullFields=False)


SCENE = "shape array<int>, sites array<array<int>>, labels array<array<int>>, distances array<array<double>>"


def scene(spark: SparkSession, path: str, required: tuple[str, ...] = ("shape", "sites", "labels", "distances")) -> tuple[DataFrame, list[str]]:
    """(y, x, label, distance) of the fields in a JSON scene, null for solid, and the required keys that are missing."""
    text = spark.read.text(path, wholetext=True)
    keys = text.select(F.json_object_keys("value").alias("keys"))
    missing = [k for k in required if not keys.where(F.array_contains("keys", k)).count()]
    own = text.select(F.from_json("value", SCENE).alias("s"))
    grid = lambda field, name: own.select(F.posexplode(f"s.{field}").alias("y", "row")).select("y", F.posexplode("row").alias("x", name))
    return grid("labels", "label").join(grid("distances", "distance"), ["y", "x"]), missing


def scene_text(fields: DataFrame, sites: DataFrame, height: int, width: int) -> DataFrame:
    """One JSON text of fields (y, x, label, distance) and sites (site_id, y, x); a report, as large as its plane."""
    rows = fields.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("x", "label", "distance"))).alias("r"))
    plane = rows.agg(F.array_sort(F.collect_list(F.struct("y", "r"))).alias("p"))
    points = sites.agg(F.transform(F.array_sort(F.collect_list(F.struct("site_id", "x", "y"))), lambda s: F.array(s["x"], s["y"])).alias("sites"))
    of = lambda name: F.transform("p", lambda r: F.transform(r["r"], lambda c: c[name]))
    return plane.crossJoin(points).select(F.to_json(F.struct(F.array(F.lit(height), F.lit(width)).alias("shape"), "sites", of("label").alias("labels"), of("distance").alias("distances")), {"ignoreNullFields": "false"}).alias("value"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below path."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return own.select("path", F.length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def missing(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    return expected.join(actual, key, "left_anti")


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first path of the list that exists."""
    jvm = spark.sparkContext._jvm
    for path in candidates:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return path
    return None


def next_free(spark: SparkSession, base: str) -> str:
    """base, or the first of base_02, base_03, ... that doesn't exist."""
    k, path = 1, base
    while first_existing(spark, [path]):
        k += 1
        path = f"{base}_{k:02d}"
    return path


def _ordered(df: DataFrame, order: list[str], line, first: int) -> DataFrame:
    """Lines of a report table: a few hundred rows, numbered in one partition."""
    return df.select((F.row_number().over(Window.orderBy(*order)) + first - 1).alias("line_no"), line.alias("line"))


def markdown(df: DataFrame, order: list[str]) -> DataFrame:
    """(line_no, line) of a Markdown table, rows in the given order."""
    cells = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "line_no int, line string")
    return head.unionByName(_ordered(df, order, F.concat(F.lit("| "), cells, F.lit(" |")), 2))


def tex_table(df: DataFrame, order: list[str]) -> DataFrame:
    """(line_no, line) of a TeX tabular, cells escaped."""
    from ..functions.text import tex

    cells = F.concat_ws(" & ", *(tex(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns))
    n = df.count()
    ends = [(0, f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}"), (1, " & ".join(c.replace("_", "\\_") for c in df.columns) + " \\\\"), (2 + n, "\\end{tabular}")]
    return df.sparkSession.createDataFrame(ends, "line_no int, line string").unionByName(_ordered(df, order, F.concat(cells, F.lit(" \\\\")), 2))


def mesh(faces: DataFrame, side: int = 64) -> DataFrame:
    """(kind, n, line) of an OBJ text: the corners (kind v, numbered from 1) and squares (kind f) of voxel faces (z, y, x, dz, dy,
    dx). A block of corners has all faces that touch it and numbers its own; only a row for each block meets in one place, and only
    faces across blocks are put together by a shuffle."""
    kinds = {"block": pa.int64(), "kind": pa.int32(), **{c: pa.int32() for c in ("z", "y", "x", "dz", "dy", "dx", *"abcd")}}

    def part(key: tuple, table: pa.Table) -> pa.Table:
        place, d = (np.stack([table.column(p + c).to_numpy() for c in "zyx"], axis=1).astype(np.int64) for p in ("", "d"))
        corner = np.repeat((place + (d > 0))[:, None, :], 4, axis=1)
        along = np.argsort(d != 0, axis=1, kind="stable")[:, :2]  # the two axes of a face, z before y before x
        for k, steps in enumerate(((0, 0), (0, 1), (1, 1), (1, 0))):
            for axis, step in zip(along.T, steps, strict=True):
                corner[np.arange(len(d)), k, axis] += step
        inside = (corner // side == np.array([v.as_py() for v in key[1:]])).all(axis=2)
        z, y, x = np.moveaxis(corner % side, 2, 0)
        own, rank = np.unique(((z * side + y) * side + x)[inside], return_inverse=True)
        of = np.zeros(inside.shape, np.int64)
        of[inside] = rank + 1
        whole = inside.all(axis=1)
        points = np.stack((own // side**2, own // side % side, own % side), axis=1) + side * np.array([v.as_py() for v in key[1:]])
        none = np.zeros
        columns = {
            "kind": np.concatenate((none(len(own)), np.where(whole, 1, 2))),
            **{c: np.concatenate((points[:, k], np.where(whole, 0, place[:, k]))) for k, c in enumerate("zyx")},
            **{f"d{c}": np.concatenate((none(len(own)), np.where(whole, 0, d[:, k]))) for k, c in enumerate("zyx")},
            **{c: np.concatenate((np.arange(1, len(own) + 1) if c == "a" else none(len(own)), of[:, k])) for k, c in enumerate("abcd")},
        }
        n = len(columns["kind"])
        return pa.table({"block": pa.array(np.full(n, key[0].as_py(), np.int64)), **{c: pa.array(columns[c].astype(np.int32)) for c in list(kinds)[1:]}})

    rows = faces.select(*(F.col(c).cast("int").alias(c) for c in ("z", "y", "x", "dz", "dy", "dx")))
    for c in "zyx":
        low = F.col(c) + (F.col(f"d{c}") > 0).cast("int")
        high = F.when(F.col(f"d{c}") != 0, low).otherwise(low + 1)
        rows = rows.withColumn(f"block_{c}", F.explode(F.sequence(F.floor(low / side), F.floor(high / side))))
    ship(rows.sparkSession)
    code = F.shiftleft("block_z", 42) + F.shiftleft("block_y", 21) + F.col("block_x")
    schema = ", ".join(f"{c} {'bigint' if c == 'block' else 'int'}" for c in kinds)
    own = written(rows.groupBy(code.alias("block"), "block_z", "block_y", "block_x").applyInArrow(part, schema), "mesh")
    counts = own.where("kind = 0").groupBy("block").count()
    base = counts.select("block", F.coalesce(F.sum("count").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each block
    own = own.join(F.broadcast(base), "block").select("kind", "z", "y", "x", "dz", "dy", "dx", *(F.when(F.col(c) > 0, F.col(c) + F.col("base")).alias(c) for c in "abcd"))
    points = own.where("kind = 0").select(F.lit("v").alias("kind"), F.col("a").alias("n"), F.concat_ws(" ", F.lit("v"), *(F.col(c).cast("string") for c in "xyz")).alias("line"))
    across = own.where("kind = 2").groupBy("z", "y", "x", "dz", "dy", "dx").agg(*(F.max(c).alias(c) for c in "abcd"))
    squares = own.where("kind = 1").select(*"abcd").unionByName(across.select(*"abcd"))
    return points.unionByName(squares.select(F.lit("f").alias("kind"), F.lit(None).cast("bigint").alias("n"), F.concat_ws(" ", F.lit("f"), *(F.col(c).cast("string") for c in "abcd")).alias("line")))
