"""Direct solution of sparse systems by nested dissection over tiles, with fronts.

Unknowns have places in space. A row ends in its tile unless it is coupled to a greater tile, so what parts two tiles is one layer thick.
A task takes one tile of the first level, eliminates what ends in it by tiles of its own that double in memory (see nested), and leaves
a front: the ids of the tile's rim and a dense block of what the elimination does to them. On each further level tiles are twice as
wide; fronts that hold a row which ends there are added and eliminated in one task. When none is left the solution goes back down;
the first level's tiles are kept as their entries and eliminated once more, now for one right side, since their factors would be many
times as large. Every system ends after as many levels as it takes to double a tile to the whole, whatever its condition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..plans.memory import blobs, written
from ..plans.relaxation import pack, unpack
from .algebra import FEW, conjugate_gradients, krylov, times

#: Tiles within a task; rows of the largest front that a task of the first level should meet, were all places taken.
TILE, FRONT = 8, 10_000
#: Rows whose entries a task should sort.
ROWS = 20_000
#: Rows that would follow others by a larger factor wait for the next level.
GROWTH = 1e6
#: How many widths of a long domain a slab sees on each side, and how often what rests is solved for again.
REACH, PASSES = 6, 4
#: front: a name; ids: its rows; block, side: what is added to their matrix and right side; inner, map, base: rows that ended, and how
#: they follow the ids; tile: the entries of a first tile.
PART = "front string, ids array<bigint>, block binary, side binary, inner array<bigint>, map binary, base binary, tile binary, own binary"
_KINDS = [("front", pa.string()), ("ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("block", "side")), ("inner", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("map", "base", "tile", "own"))]


def _ended(ids: np.ndarray, whole: np.ndarray, b: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """A dense front without its inner rows: block and side of the others, and how the inner follow (base - map @ others). None if the
    inner rows can't be told apart without the others, as of a saddle system; they end on a later level."""
    a, c = np.flatnonzero(inner), np.flatnonzero(~inner)
    try:
        solved = np.linalg.solve(whole[np.ix_(a, a)], np.column_stack((whole[np.ix_(a, c)], b[a])))
    except np.linalg.LinAlgError:
        if len(c):
            return None
        raise
    if len(c) and not np.abs(solved[:, :-1]).max(initial=0.0) < GROWTH:
        return None
    low = whole[np.ix_(c, a)]
    return whole[np.ix_(c, c)] - low @ solved[:, :-1], b[c] - low @ solved[:, -1], solved[:, :-1], solved[:, -1]


def _added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of fronts (ids, block, side)."""
    every = np.unique(np.concatenate([p[0] for p in parts]))
    whole, b = np.zeros((len(every), len(every))), np.zeros(len(every))
    for ids, block, side in parts:
        at = np.searchsorted(every, ids)
        whole[np.ix_(at, at)] += block
        b[at] += side
    return every, whole, b


def nested(row: np.ndarray, col: np.ndarray, val: np.ndarray, b: np.ndarray, place: np.ndarray, keep: np.ndarray, width: int, factors: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """The front (ids, block, side) of the rows to keep after all others are eliminated, and if asked for (inner, rim, map, base) in
    order of elimination. row, col: numbers of rows; place: (3, rows). Rows that can't end here are kept as well."""
    keep = keep.copy()
    low = place[:, ~keep].min(axis=1, keepdims=True) if (~keep).any() else 0
    place, out, fronts = np.maximum(place - low, 0), [], []

    def tiles() -> np.ndarray:
        z, y, x = place // width
        return np.where(keep, -1, (z << 42) + (y << 21) + x)

    at = tiles()
    cut = keep.copy()
    cut[row[at[row] < at[col]]] = True
    cut[col[at[col] < at[row]]] = True
    home = np.maximum(at[row], at[col])
    order = np.argsort(home, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
        ids, to = np.unique(np.concatenate((row[part], col[part])), return_inverse=True)
        side = np.where((at[ids] == home[part[0]]) & ~keep[ids], b[ids], 0.0)
        fronts.append((ids, (to, part), side))

    def dense(ids: np.ndarray, block, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A front; those of the entries are filled only when they are taken up."""
        if isinstance(block, tuple):
            (to, part), block = block, np.zeros((len(ids), len(ids)))
            np.add.at(block, (to[: len(part)], to[len(part) :]), val[part])
        return ids, block, side

    left, late = ~keep, np.zeros(len(keep), dtype=bool)
    while True:
        groups: dict[int, list] = {}
        waiting = []
        for front in fronts:
            own = front[0][~cut[front[0]]]
            groups.setdefault(int(at[own[0]]), []).append(front) if len(own) else waiting.append(front)
        fronts = waiting
        for group in list(groups):
            ids, whole, side = _added([dense(*part) for part in groups.pop(group)])
            inner = ~cut[ids]
            if (ended := _ended(ids, whole, side, inner)) is None:
                fronts.append((ids, whole, side))
                if len(np.unique(at[left])) == 1:
                    stuck = ids[inner]
                    keep[stuck], left[stuck], late[stuck] = True, False, True
                continue
            block, side, way, base = ended
            left[ids[inner]] = False
            if factors:
                out.append((ids[inner], ids[~inner], way, base))
            if not inner.all():
                fronts.append((ids[~inner], block, side))
        if not left.any():
            break
        width *= 2
        at = tiles()
        cut = keep.copy()
        for ids, _, _ in fronts:
            cut[ids[at[ids] < at[ids].max()]] = True
    kept = np.flatnonzero(keep & ~late)
    fronts = [dense(*front) for front in fronts]
    fronts.append((kept, np.zeros((len(kept), len(kept))), b[kept]))
    return *_added(fronts), out


def _back(factors: list, n: int) -> np.ndarray:
    x = np.zeros(n)
    for inner, rim, way, base in reversed(factors):
        x[inner] = base - way @ x[rim]
    return x


def _part(**own) -> pa.Table:
    """One row of PART; columns that aren't given are null."""
    return pa.table({n: pa.array([own.get(n)], t) for n, t in _KINDS})


def _first(leaf: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        a = {c: table.column(c).to_numpy() for c in ("kind", "row", "col", "val", "own", "z", "y", "x")}
        e, s = a["kind"] == 0, a["kind"] == 2
        ids = np.unique(np.concatenate((a["row"][e], a["col"][e], a["row"][s])))
        row, col = np.searchsorted(ids, a["row"][e]), np.searchsorted(ids, a["col"][e])
        keep, place, b = np.ones(len(ids), dtype=bool), np.zeros((3, len(ids)), np.int64), np.zeros(len(ids))
        mine = e & (a["own"] == 1)
        keep[np.searchsorted(ids, a["row"][mine])] = False
        for k, c in enumerate("zyx"):
            place[k, np.searchsorted(ids, a["row"][mine])] = a[c][mine]
        keep[np.searchsorted(ids, a["row"][a["kind"] == 1])] = True
        np.add.at(b, np.searchsorted(ids, a["row"][s]), a["val"][s])
        at, block, side, _ = nested(row, col, a["val"][e], b, place, keep, leaf, False)
        keep[at] = True
        return _part(front=f"0-{key[0].as_py()}", ids=ids[at], block=block.tobytes(), side=side.tobytes(), tile=pack(row, col, a["val"][e]), own=pack(ids, b, *place, keep.astype(np.int64)))

    return run


def _merged(level: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts, ending = [], []
        for ids, block, side, cut in zip(*(table.column(c) for c in ("ids", "block", "side", "cut")), strict=True):
            own = np.array(ids.as_py(), np.int64)
            parts.append((own, np.frombuffer(block.as_buffer()).reshape(len(own), -1), np.frombuffer(side.as_buffer())))
            ending.append(own[~np.array(cut.as_py(), dtype=bool)])
        ids, whole, b = _added(parts)
        inner = np.isin(ids, np.concatenate(ending))
        if (ended := _ended(ids, whole, b, inner)) is None:
            return _part(front=f"{level}-{key[0].as_py()}", ids=ids, block=whole.tobytes(), side=b.tobytes(), inner=[])
        block, side, way, base = ended
        return _part(front=f"{level}-{key[0].as_py()}", ids=ids[~inner], block=block.tobytes(), side=side.tobytes(), inner=ids[inner], map=way.tobytes(), base=base.tobytes())

    return run


def _followed(table: pa.Table) -> pa.Table:
    """Rows that ended in one front, from the values of its ids."""
    inner, way, base, known = (table.column(c)[0] for c in ("inner", "map", "base", "known"))
    ids, x = np.array(inner.as_py(), np.int64), np.frombuffer(base.as_buffer()).copy()
    if known.is_valid:
        x -= np.frombuffer(way.as_buffer()).reshape(len(ids), -1) @ np.array(known.as_py(), float)
    return pa.table([ids, x], ["row", "val"])


def _leaves(leaf: int):
    def run(table: pa.Table) -> pa.Table:
        tile, own, rim, known = (table.column(c)[0].as_py() for c in ("tile", "own", "ids", "known"))
        (row, col, val), (ids, b, *place, keep) = unpack(tile, "iif"), unpack(own, "ifiiii")
        keep = keep.astype(bool)
        x = np.zeros(len(ids))
        x[np.searchsorted(ids, np.array(rim, np.int64))] = np.array(known or [], float)
        inner = ~keep
        b = b - np.bincount(row[keep[col]], val[keep[col]] * x[col[keep[col]]], len(ids))
        number = np.cumsum(inner) - 1
        both = inner[row] & inner[col]
        n = int(inner.sum())
        if not n:
            return pa.table([ids[:0], x[:0]], ["row", "val"])
        system = number[row[both]], number[col[both]], val[both]
        place = np.stack(place)[:, inner]
        found = _back(nested(*system, b[inner], place, np.zeros(n, dtype=bool), leaf, True)[3], n)
        return pa.table([ids[inner], found], ["row", "val"])

    return run


def width_of(extent: list[int]) -> int:
    """The widest tile, up to 64, whose largest front stays within FRONT rows were all places taken."""
    for width in (64, 32, 16):
        side = [min(e, width) for e in extent]
        area = [side[1] * side[2], side[0] * side[2], side[0] * side[1]]
        if sum(a * ((s > TILE) + 2 * (e > width)) for a, s, e in zip(area, side, extent, strict=True)) <= FRONT:
            return width
    return TILE


def direct(matrix: DataFrame, rhs: DataFrame, places: DataFrame, tile: int | None = None, leaf: int = TILE) -> DataFrame:
    """(row, val) with matrix (row, col, val) * val = rhs (row, rhs); places: (row, z, y, x) of every row, not negative. tile: the width of the first tiles; leaf: that of the tiles in a task."""
    ship(matrix.sparkSession)
    place = written(places.select(F.col("row").cast("bigint").alias("row"), *(F.col(c).cast("int").alias(c) for c in "zyx")), "places")
    if tile is None:
        low = place.agg(*(F.max(c) - F.min(c) + 1 for c in "zyx")).first()
        tile = width_of([v or 1 for v in low])

    def code(width: int):
        z, y, x = (F.floor(F.col(c) / width).cast("bigint") for c in "zyx")
        return F.shiftleft(z, 42) + F.shiftleft(y, 21) + x

    a = place.select("row", code(tile).alias("a"), "z", "y", "x")
    # as many tasks as rows ask for: sorts then hold a few tiles, whatever the session's number of partitions
    n = max(place.count() // ROWS, int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = matrix.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("val").cast("double").alias("val"))
    near = near.repartition(n, "row").join(a.repartition(n, "row").hint("merge"), "row")
    near = near.repartition(n, "col").join(a.select(F.col("row").alias("col"), F.col("a").alias("b")).repartition(n, "col").hint("merge"), "col")
    kinds = {"tile": "bigint", "kind": "int", "row": "bigint", "col": "bigint", "val": "double", "own": "int", "z": "int", "y": "int", "x": "int"}
    struct = lambda *v: F.struct(*(F.lit(c).cast(t).alias(n) if not hasattr(c, "cast") else c.cast(t).alias(n) for c, (n, t) in zip(v, kinds.items(), strict=True)))
    entry = struct(F.greatest("a", "b"), 0, F.col("row"), F.col("col"), F.col("val"), (F.col("a") >= F.col("b")).cast("int"), F.col("z"), F.col("y"), F.col("x"))
    less = F.col("a") < F.col("b")  # the lesser end of what crosses two tiles doesn't end in its own
    mark = struct(F.least("a", "b"), 1, F.when(less, F.col("row")).otherwise(F.col("col")), 0, 0.0, 0, 0, 0, 0)
    rows = near.select(F.inline(F.when(F.col("a") != F.col("b"), F.array(entry, mark)).otherwise(F.array(entry))))
    sides = rhs.select(F.col("row").cast("bigint").alias("row"), F.col("rhs").cast("double").alias("rhs")).join(a.select("row", "a"), "row").select(struct(F.col("a"), 2, F.col("row"), 0, F.col("rhs"), 0, 0, 0, 0).alias("s")).select("s.*")
    first = blobs(rows.unionByName(sides).repartition(n, "tile").groupBy("tile").applyInArrow(_first(leaf), PART), "eliminated")
    fronts = first.where("size(ids) > 0").select("front", "ids", "block", "side")
    place = written(place.join(first.select(F.explode("ids").alias("row")).distinct(), "row", "left_semi"), "places")
    factors, level = [], 0
    while not fronts.isEmpty():
        tile, level = tile * 2, level + 1
        at = written(fronts.select("front", F.posexplode("ids").alias("pos", "row")).join(place.select("row", code(tile).alias("tile")), "row"), "rows")
        most = at.groupBy("front").agg(F.max("tile").alias("most"))
        ends = at.join(most, "front").groupBy("row").agg(F.max("most").alias("most"))
        flagged = at.join(ends, "row").withColumn("cut", F.col("most") > F.col("tile"))
        flags = flagged.groupBy("front").agg(F.max(F.when(~F.col("cut"), F.col("tile"))).alias("to"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "cut"))), lambda s: s["cut"]).alias("cut"))
        flags = written(flags, "flags")
        done = blobs(fronts.join(flags.where("to IS NOT NULL"), "front").groupBy("to").applyInArrow(_merged(level), PART), "eliminated")
        factors.append(done.where("size(inner) > 0").select("front", "ids", "inner", "map", "base"))
        waiting = fronts.join(flags.where("to IS NULL").select("front"), "front", "left_semi")
        fronts = waiting.unionByName(done.where("size(ids) > 0").select("front", "ids", "block", "side"))
    x = None

    def known(own: DataFrame) -> DataFrame:
        if x is None:
            return own.withColumn("known", F.lit(None).cast("array<double>"))
        asked = own.select("front", F.posexplode("ids").alias("at", "row")).join(x, "row").groupBy("front").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "val"))), lambda s: s["val"]).alias("known"))  # a tile's rim
        return own.join(asked, "front", "left")

    for own in reversed(factors):
        found = known(own).groupBy("front").applyInArrow(_followed, "row bigint, val double")
        x = written(found if x is None else x.unionByName(found), "solution")
    found = known(first.select("front", "ids", "tile", "own")).groupBy("front").applyInArrow(_leaves(leaf), "row bigint, val double")
    return found if x is None else x.unionByName(written(found, "solution"))


def overlapped(matrix: DataFrame, rhs: DataFrame, places: DataFrame, rtol: float, most: int, jacobi: bool) -> DataFrame | None:
    """(row, val) of a symmetric positive definite system that is much longer than wide: a task solves one slab with REACH widths of its
    neighbours by conjugate gradients and keeps its own rows; what rest there is is solved for again until it is within rtol of the
    right side. None if the domain isn't so long, a slab has more than FEW entries, or a pass doesn't bring the rest down."""
    ship(matrix.sparkSession)
    own = rhs.select(F.col("row").cast("bigint").alias("row"), F.col("rhs").cast("double").alias("rhs")).join(places.select(F.col("row").cast("bigint").alias("row"), *"zyx"), "row")
    own = written(own, "sides")
    low = own.agg(*(F.min(c).alias(c) for c in "zyx"), *(F.max(c).alias(f"top_{c}") for c in "zyx"), F.sqrt(F.sum(F.col("rhs") * F.col("rhs"))).alias("norm")).first()
    if low["norm"] is None or not low["norm"]:
        return own.select("row", F.lit(0.0).alias("val"))
    extent = {c: low[f"top_{c}"] - low[c] + 1 for c in "zyx"}
    axis = max("zyx", key=lambda c: extent[c])
    reach = REACH * max(n for c, n in extent.items() if c != axis)
    slabs = -(-extent[axis] // (2 * reach))
    if extent[axis] < 3 * reach or most < reach:
        return None
    at = F.col(axis) - low[axis]
    near = F.sequence(F.greatest(F.floor((at - reach) / (2 * reach)), F.lit(0)), F.least(F.floor((at + reach) / (2 * reach)), F.lit(slabs - 1)))
    slab = own.select("row", "rhs", near.alias("near"), F.floor(at / (2 * reach)).alias("home"))
    entries = matrix.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("val").cast("double").alias("val"))
    entries = written(entries.join(slab.select("row", "near"), "row"), "entries")
    if entries.select(F.explode("near").alias("slab")).groupBy("slab").count().agg(F.max("count")).first()[0] > FEW:
        return None

    def run(goal: float):
        def part(batches):
            table = pa.Table.from_batches(batches)
            a = {c: table.column(c).to_numpy() for c in table.column_names}
            for s in np.unique(a["slab"]):
                e, b = (np.flatnonzero((a["slab"] == s) & (a["side"] == k)) for k in (0, 1))
                b = b[np.argsort(a["row"][b])]
                ids = a["row"][b]
                row, col = np.searchsorted(ids, a["row"][e]), np.searchsorted(ids, a["col"][e])
                known = ids[np.minimum(col, len(ids) - 1)] == a["col"][e]
                x, _ = krylov(row[known], col[known], a["val"][e][known], a["val"][b][:, None], goal, most, jacobi, strict=False)
                mine = a["col"][b] == s
                yield pa.RecordBatch.from_arrays([pa.array(ids[mine]), pa.array(x[mine, 0])], ["row", "more"])

        def whole(batches):
            batches = list(batches)
            if sum(len(b) for b in batches):
                yield from part(batches)

        return whole

    left = slab.select("row", F.col("rhs").alias("rest"), "near", "home")
    norm, x = low["norm"], None
    for _ in range(PASSES):
        rows = entries.select(F.explode("near").alias("slab"), "row", "col", "val", F.lit(0).alias("side")).unionByName(left.select(F.explode("near").alias("slab"), "row", F.col("home").cast("bigint").alias("col"), F.col("rest").alias("val"), F.lit(1).alias("side")))
        goal = max(rtol * low["norm"] / norm, rtol) / 4
        more = rows.repartitionById(slabs, F.col("slab").cast("int")).mapInArrow(run(goal), "row bigint, more double")
        x = written(more.withColumnRenamed("more", "val") if x is None else x.join(more, "row").select("row", (F.col("val") + F.col("more")).alias("val")), "solution")
        left = written(slab.join(times(entries, x), "row", "left").select("row", (F.col("rhs") - F.coalesce("ax", F.lit(0.0))).alias("rest"), "near", "home"), "rest")
        before, norm = norm, left.agg(F.sqrt(F.sum(F.col("rest") * F.col("rest")))).first()[0]
        if norm <= rtol * low["norm"]:
            return x
        if not norm < before / 10:  # or NaN
            return None
    return None


def solved(matrix: DataFrame, rhs: DataFrame, places: DataFrame, rtol: float = 1e-8, most: int = 4000, jacobi: bool = True) -> DataFrame:
    """(row, val): conjugate gradients where one task holds the system, or by overlapping slabs of a long one, and the direct solution if
    these don't get to rtol within `most` steps. Other large systems are solved directly: a job for each of hundreds of steps takes
    longer than the elimination."""
    if matrix.count() > FEW:
        own = overlapped(matrix, rhs, places, rtol, most, jacobi)
        return direct(matrix, rhs, places) if own is None else own
    own = written(conjugate_gradients(matrix, rhs, rtol, most, jacobi, strict=False), "solution")
    return own if own.where(F.isnan("val")).isEmpty() else direct(matrix, rhs, places)
