"""What the fourth round's finding asked for: each failed, or held far more memory, before."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow.parquet as pq

from tests.test_findings_r03 import _network
from voxelgraph.operators import dissection, stokes


def test_a_front_has_a_row_group_of_its_own(spark, monkeypatch):
    """Else a task's writer or reader holds all fronts of a file, each of some MB."""
    seen = []

    def blobs(df, name, f=dissection.blobs):
        seen.append(f(df, name))
        return seen[-1]

    monkeypatch.setattr(dissection, "blobs", blobs)
    matrix, rhs, places, dense, b = _network(spark, np.random.default_rng(8))
    x = {r.row: r.val for r in dissection.direct(matrix, rhs, places, tile=4, leaf=2).collect()}
    assert np.allclose([x[i] for i in range(len(b))], np.linalg.solve(dense, b), rtol=1e-9, atol=1e-9)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for df in seen for f in df.inputFiles()]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert len(groups) > 8 and set(groups) == {1} and any(m.num_row_groups > 1 for m in files)


def test_leaves_of_a_tile_are_not_dense_at_once():
    """Ten leaves of 400 rows in a row: 1.28 MB each."""
    n = 10 * 400
    row = np.arange(n - 1)
    i, j = np.concatenate((np.arange(n), row, row + 1)), np.concatenate((np.arange(n), row + 1, row))
    v = np.concatenate((np.full(n, 3.0), np.full(2 * n - 2, -1.0)))
    place = np.stack((np.arange(n) // 20, np.arange(n) % 20, np.zeros(n, np.int64)))
    b = np.random.default_rng(1).normal(size=n)
    tracemalloc.start()
    *_, factors = dissection.nested(i, j, v, b, place, np.zeros(n, dtype=bool), 20, True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    x = dissection._back(factors, n)
    assert np.allclose(3 * x - np.append(x[1:], 0) - np.append(0, x[:-1]), b)
    assert most < 10 * 1.28e6


def test_long_domains_have_longer_tiles(spark):
    line = spark.range(0, 4000).selectExpr("id AS row", "CAST(id AS INT) AS z", "CAST(id % 30 AS INT) AS y", "CAST(id % 50 AS INT) AS x")
    assert stokes._long(line, 64) == 256
    assert stokes._long(line.selectExpr("row", "z", "z AS y", "x"), 64) == 64
    assert stokes._long(line, 32) == 32


def test_a_face_gives_its_entries_without_being_summed_with_others(spark):
    cells = spark.createDataFrame([(1, 8.0, 2.0), (2, 6.0, 1.0), (5, 4.0, 3.0), (9, 1.0, 7.0)], "cell bigint, volume double, twall double")
    names = "owner bigint, neighbor bigint, t double, w_owner double, w_neigh double, ax double, ay double, az double, dx double, dy double, dz double"
    rows = [(1, 2, 0.7, 0.4, 0.6, 2.0, 0.5, 0.1, 3.0, 1.0, 0.5), (2, 5, 0.9, 0.5, 0.5, 0.3, 2.0, -0.4, 0.2, 2.5, -1.0), (1, 5, 0.2, 0.3, 0.7, 1.0, 1.0, 1.0, 3.2, 3.5, -0.5)]
    own = stokes.Settings(tikhonov=0.01, gauge=0.0, nu=1.5, rho=2.0)
    saddle = stokes.saddle(cells, spark.createDataFrame(rows, names), own)
    got = np.zeros((16, 16))
    at = {c: k for k, c in enumerate((1, 2, 5, 9))}
    for r in saddle.collect():
        got[4 * at[r.row // 4] + r.row % 4, 4 * at[r.col // 4] + r.col % 4] += r.val
    f = np.array(rows)
    o, b = (np.array([at[int(c)] for c in f[:, k]]) for k in (0, 1))
    g = stokes.Coarse(np.array([8.0, 6, 4, 1]), np.array([2.0, 1, 3, 7]), o, b, f[:, 2], f[:, 3], f[:, 4], f[:, 5:8], f[:, 8:], own)
    want = np.zeros((16, 16))
    for j in range(16):
        e = np.zeros(16)
        e[j] = 1.0
        u, p = e.reshape(4, 4)[:, :3], e.reshape(4, 4)[:, 3]
        lead = own.nu * (g.laplace(u) + g.twall[:, None] * u) + g.volume[:, None] / own.rho * g.gradient(p)
        want[:, j] = np.column_stack((lead, g.divergence(g.flux(u)))).ravel()
    assert np.allclose(got, want)
    assert saddle.count() == 9 * (2 * len(rows) + 3) + 3 and "Exchange hashpartitioning(row" not in saddle._jdf.queryExecution().toString()


def test_what_is_left_of_a_saddle_system_is_solved_for_again(spark, monkeypatch):
    monkeypatch.setattr(stokes, "direct", lambda *a: dissection.direct(*a).withColumn("val", stokes.F.col("val") * (1 + 1e-5)))
    matrix, rhs, places, dense, b = _network(spark, np.random.default_rng(8))
    cells = spark.range(-(-len(b) // 4)).selectExpr("id AS cell", "1D AS volume")
    x = {r.row: r.val for r in stokes._refined(matrix, rhs, places, cells, 1.0, 64, 32).collect()}
    assert np.allclose([x[i] for i in range(len(b))], np.linalg.solve(dense, b), rtol=1e-8, atol=1e-8)
