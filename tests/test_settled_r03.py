"""What was left of the third round's findings: each failed, or moved far more, before."""

from __future__ import annotations

import numpy as np

from voxelgraph import catalog
from voxelgraph.operators import algebra, blocks, dissection, grid
from voxelgraph.sources import tables

SMALL = "/root/testdata/sf0.001"


def test_steps_do_not_grow_with_the_length_of_a_domain():
    n = 30_000
    o, b, i, t = np.arange(n - 1), np.arange(1, n), np.arange(n), np.ones(n - 1)
    row, col, val = np.concatenate((o, o, b, b, i)), np.concatenate((o, b, b, o, i)), np.concatenate((t, -t, t, -t, np.full(n, 1e-6)))
    rhs = np.random.default_rng(3).normal(size=n)
    x, steps = algebra.krylov(row, col, val, rhs[:, None], 1e-8, 600, True)
    rest = np.bincount(row, val * x[col, 0], n) - rhs
    assert steps < 600 and np.linalg.norm(rest) < 1e-7 * np.linalg.norm(rhs)


def test_long_systems_are_solved_in_slabs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    own = {tuple(p): i for i, p in enumerate(np.argwhere(rng.random((160, 4, 4)) < 0.8).tolist())}
    dense = np.diag(np.full(len(own), 0.05))
    for p, i in own.items():
        for o in grid.FORWARD:
            if (j := own.get(tuple(a + b for a, b in zip(p, o, strict=True)))) is not None:
                dense[[i, j, i, j], [i, j, j, i]] += [1, 1, -1, -1]
    b = rng.normal(size=len(own))
    matrix = spark.createDataFrame([(int(i), int(j), float(dense[i, j])) for i, j in np.argwhere(dense)], "row bigint, col bigint, val double")
    rhs, places = spark.createDataFrame(list(enumerate(b.tolist())), "row bigint, rhs double"), spark.createDataFrame([(i, *p) for p, i in own.items()], "row bigint, z int, y int, x int")

    def never(*_):
        raise AssertionError("a long system is eliminated")

    monkeypatch.setattr(dissection, "FEW", np.count_nonzero(dense) * 3 // 4)
    monkeypatch.setattr(dissection, "direct", never)
    x = {r.row: r.val for r in dissection.solved(matrix, rhs, places, 1e-10).collect()}
    assert np.allclose([x[i] for i in range(len(b))], np.linalg.solve(dense, b), rtol=1e-7, atol=1e-7)


def _never(*_):
    raise AssertionError("a row for each neighbour is made")


def test_mesh_text_takes_faces_from_blocks(spark, monkeypatch):
    monkeypatch.setitem(catalog.RELATIONS, "exposed", _never)
    assert all(r.n == r.distinct_lines > 0 for r in catalog.QUERIES["s7_mesh_text"](spark, SMALL).collect())


def test_faces_across_blocks_have_their_own_corners(spark):
    shape = grid.Shape(2, 5)
    own = grid.with_coordinates(spark.range(0, 1400, 1, 3).where("id % 7 <> 3 AND id % 11 <> 5").withColumnRenamed("id", "vid"), shape)
    faces = blocks.exposed(own, shape)
    want = {tuple(r) for r in grid.exposed(own, own, grid.FACES, shape).join(own, "vid").select("z", "y", "x", "dz", "dy", "dx").collect()}
    assert {tuple(r) for r in faces.collect()} == want and faces.count() == len(want)
    squares = set()
    for face in want:
        place, d = np.array(face[:3]), np.array(face[3:])
        first, second = np.eye(3, dtype=int)[d == 0]
        squares.add(tuple(tuple((place + (d > 0) + a * first + b * second).tolist()) for a, b in ((0, 0), (0, 1), (1, 1), (1, 0))))
    rows = tables.mesh(faces).collect()
    at = {r.n: tuple(int(v) for v in reversed(r.line.split()[1:])) for r in rows if r.kind == "v"}
    assert set(at) == set(range(1, len(at) + 1)) and set(at.values()) == {p for s in squares for p in s} and len(set(at.values())) == len(at)
    got = [tuple(at[int(n)] for n in r.line.split()[1:]) for r in rows if r.kind == "f"]
    assert len(got) == len(squares)
    assert set(got) == squares
