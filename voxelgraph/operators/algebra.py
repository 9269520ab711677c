"""Finite-volume algebra on (row, col, val) and (row, val) tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..plans.memory import written

#: Entries of a system that one task solves: 24 bytes each.
FEW = 8_000_000
#: Rows from which krylov also solves for sums over runs of rows, and the most runs.
LONG, RUNS = 20_000, 1000


def laplacian(faces: DataFrame, t: str = "t") -> DataFrame:
    """(row, col, val): +t on the diagonal of both ends of a face, -t between them; duplicates are summed."""
    def part(a: str, b: str, sign: int) -> DataFrame:
        return faces.select(F.col(a).cast("bigint").alias("row"), F.col(b).cast("bigint").alias("col"), (sign * F.col(t)).alias("val"))

    parts = part("owner", "owner", 1).unionByName(part("owner", "neighbor", -1)).unionByName(part("neighbor", "neighbor", 1)).unionByName(part("neighbor", "owner", -1))
    return parts.groupBy("row", "col").agg(F.sum("val").alias("val"))


def times(matrix: DataFrame, vector: DataFrame, name: str = "val") -> DataFrame:
    """(row, ax) of a sparse product: one join on columns, one aggregation on rows."""
    v = vector.select(F.col("row").alias("col"), F.col(name).alias("x"))
    return matrix.join(v, "col").groupBy("row").agg(F.sum(F.col("val") * F.col("x")).alias("ax"))


def krylov(row: np.ndarray, col: np.ndarray, val: np.ndarray, rhs: np.ndarray, rtol: float, most: int, jacobi: bool, strict: bool = True) -> tuple[np.ndarray, int]:
    """X with A X = rhs, a column of conjugate gradients for each column of rhs, which stop one by one. Columns that don't get there
    within `most` steps are an error, or NaN if not strict.

    With jacobi, more than LONG rows are also corrected by the solution for what is constant on runs of consecutive rows. As ids follow
    space, the number of steps then doesn't grow with a domain's length; where they don't, the correction does no harm."""
    n = len(rhs)
    order = np.argsort(row, kind="stable")
    row, col, val = row[order], col[order], val[order]
    coarse = None
    if jacobi and n > LONG:
        start = np.arange(RUNS) * n // RUNS
        size = np.diff(start, append=n)
        run = np.repeat(np.arange(RUNS), size)
        sums = np.bincount(run[row] * RUNS + run[col], val, RUNS * RUNS).reshape(RUNS, RUNS)
        coarse = np.linalg.inv(sums + 1e-12 * np.abs(sums).max() * np.eye(RUNS))
        coarse = (coarse + coarse.T) / 2

    def preconditioned(r: np.ndarray) -> np.ndarray:
        return r * scale if coarse is None else r * scale + np.repeat(coarse @ np.add.reduceat(r, start, axis=0), size, axis=0)

    diag = np.bincount(row[row == col], val[row == col], n) if jacobi else np.ones(n)
    scale = 1 / np.where(np.abs(diag) > 1e-300, diag, 1.0)[:, None]
    x, r = np.zeros_like(rhs), rhs.copy()
    goal = np.maximum(rtol * np.linalg.norm(rhs, axis=0), 1e-300)
    z = preconditioned(r)
    p, rz = z.copy(), (r * z).sum(axis=0)
    open_ = np.linalg.norm(r, axis=0) > goal
    steps = 0
    while open_.any() and steps < most:
        steps += 1
        ap = np.stack([np.bincount(row, val * p[col, k], n) for k in range(rhs.shape[1])], axis=1)
        alpha = np.where(open_, rz / np.where(np.abs(own := (p * ap).sum(axis=0)) > 1e-300, own, 1.0), 0.0)
        x += p * alpha
        r -= ap * alpha
        open_ = np.linalg.norm(r, axis=0) > goal
        z = preconditioned(r)
        new = (r * z).sum(axis=0)
        p = z + p * np.where(open_, new / np.where(np.abs(rz) > 1e-300, rz, 1.0), 0.0)
        rz = new
    if strict and open_.any():
        raise RuntimeError(f"no convergence in {most} steps")
    x[:, open_] = np.nan
    return x, steps


def conjugate_gradients(matrix: DataFrame, rhs: DataFrame, rtol: float = 1e-8, most: int = 4000, jacobi: bool = False, few: int = FEW, columns: tuple[str, ...] = ("rhs",), strict: bool = True) -> DataFrame:
    """(row, val, ...) with matrix * val = rhs for a symmetric positive definite matrix.

    If not strict, what isn't solved within `most` steps is NaN instead of an error. rhs: (row, the columns); the solution of the first is named val, the others as their column with x_ before it. With at
    most `few` entries (counted) one task holds the system and iterates in NumPy; beyond that every step is one pass over the
    distributed vectors (a product, a join and three sums that reach the driver), written so that lineage stays short.
    """
    names = ["val", *(f"x_{c}" for c in columns[1:])]
    ship(matrix.sparkSession)
    if matrix.count() <= few:

        def solve(entries: pa.Table, sides: pa.Table) -> pa.Table:
            ids = np.sort(sides.column("row").to_numpy())
            b = np.stack([sides.column(c).to_numpy() for c in columns], axis=1)[np.argsort(sides.column("row").to_numpy())]
            at = [np.searchsorted(ids, entries.column(c).to_numpy()) for c in ("row", "col")]
            x, _ = krylov(*at, entries.column("val").to_numpy(), b, rtol, most, jacobi, strict)
            return pa.table([pa.array(ids, pa.int64()), *x.T], ["row", *names])

        a, b = matrix.select(F.lit(0).alias("all"), F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("val").cast("double").alias("val")), rhs.select(F.lit(0).alias("all"), F.col("row").cast("bigint").alias("row"), *(F.col(c).cast("double").alias(c) for c in columns))
        return a.groupBy("all").cogroup(b.groupBy("all")).applyInArrow(solve, "row bigint, " + ", ".join(f"{n} double" for n in names))
    out = None
    for column, name in zip(columns, names, strict=True):
        own = _distributed(matrix, rhs.select("row", F.col(column).alias("rhs")), rtol, most, jacobi, strict).withColumnRenamed("val", name)
        out = own if out is None else out.join(own, "row")
    return out


def _distributed(matrix: DataFrame, rhs: DataFrame, rtol: float, most: int, jacobi: bool, strict: bool = True) -> DataFrame:
    """One column; the recurrences of Chronopoulos and Gear, so that a step has one product and one round of sums."""
    diag = matrix.where("row = col").select("row", F.col("val").alias("m")) if jacobi else rhs.select("row", F.lit(1.0).alias("m"))
    state = rhs.join(diag, "row").select("row", F.lit(0.0).alias("val"), F.col("rhs").cast("double").alias("r"), F.lit(0.0).alias("p"), F.lit(0.0).alias("s"), "m")
    gamma = alpha = 0.0
    goal = None
    for _ in range(most + 1):
        u = state.withColumn("u", F.col("r") / F.col("m"))
        now = written(u.join(times(matrix, u, "u"), "row", "left").withColumn("w", F.coalesce("ax", F.lit(0.0))).drop("ax"), "cg")
        norm, new, delta = now.agg(F.sqrt(F.sum(F.col("r") * F.col("r"))), F.sum(F.col("r") * F.col("u")), F.sum(F.col("w") * F.col("u"))).first()
        goal = (norm or 0.0) * rtol if goal is None else goal
        if not norm or norm <= goal:
            return now.select("row", "val")
        beta = new / gamma if gamma else 0.0
        alpha = new / (delta - beta * new / alpha) if alpha else new / delta
        gamma = new
        moved = now.withColumn("p", F.col("u") + beta * F.col("p")).withColumn("s", F.col("w") + beta * F.col("s"))
        state = moved.select("row", (F.col("val") + alpha * F.col("p")).alias("val"), (F.col("r") - alpha * F.col("s")).alias("r"), "p", "s", "m")
    if strict:
        raise RuntimeError(f"no convergence in {most} steps")
    return state.select("row", F.lit(float("nan")).alias("val"))


def divergence(flux: DataFrame, q: str = "q") -> DataFrame:
    """(row, div): flux leaves the owner and enters the neighbor (none if negative)."""
    out = flux.select(F.col("owner").cast("bigint").alias("row"), F.col(q).alias("q"))
    into = flux.where("neighbor >= 0").select(F.col("neighbor").cast("bigint").alias("row"), (-F.col(q)).alias("q"))
    return out.unionByName(into).groupBy("row").agg(F.sum("q").alias("div"))


def projected(flux: DataFrame, q: str = "q", gauge: float = 1e-10, rtol: float = 1e-12) -> DataFrame:
    """flux with q_conservative: the nearest flux without divergence, q - B^T lambda with (B B^T + gauge I) lambda = B q.

    flux: (edge, owner, neighbor, q); a negative neighbor is a boundary.
    """
    flux = written(flux, "flux")
    inner = flux.where("neighbor >= 0").withColumn("t", F.lit(1.0))
    border = flux.where("neighbor < 0").select(F.col("owner").cast("bigint").alias("row"), F.col("owner").cast("bigint").alias("col"), F.lit(1.0).alias("val"))
    cells = flux.select("owner").union(flux.where("neighbor >= 0").select("neighbor")).distinct().select(F.col("owner").cast("bigint").alias("row"))
    gauge_part = cells.select("row", F.col("row").alias("col"), F.lit(gauge).alias("val"))
    matrix = written(laplacian(inner).unionByName(border).unionByName(gauge_part).groupBy("row", "col").agg(F.sum("val").alias("val")), "bbt")
    rhs = written(divergence(flux, q).select("row", F.col("div").alias("rhs")), "rhs")
    lam = conjugate_gradients(matrix, rhs, rtol)
    a, b = lam.select(F.col("row").alias("owner"), F.col("val").alias("lo")), lam.select(F.col("row").alias("neighbor"), F.col("val").alias("ln"))
    return flux.join(a, "owner", "left").join(b, "neighbor", "left").withColumn("q_conservative", F.col(q) - F.coalesce("lo", F.lit(0.0)) + F.coalesce("ln", F.lit(0.0))).drop("lo", "ln")
