"""Array kernels over whole Arrow batches: words, rolling window hashes and window minimisers.

Every hash is a 64-bit polynomial hash over random symbol values (arithmetic modulo 2**64, odd base), finished with a
multiply-xorshift mix. Nothing here depends on how rows were batched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
#: Symbols handled at a time: keeps every temporary array near 2 MB, however long a text is.
SEGMENT = 1 << 18
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63 - 1, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the base and of its inverse, modulo 2**64; kept for the worker's life."""
    if len(_POWERS.get("up", ())) < n + 1:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            steps = np.full(max(n + 1, 4096), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][: n + 1], _POWERS["down"][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that low bits are as good as high ones."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def prefix(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def spans_hash(before: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of values[start:end], given prefix(values)."""
    return mix((before[ends] - before[starts]) * powers(len(before) - 1)[1][starts])


def windows_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of each k consecutive values, a segment at a time."""
    out = np.empty(max(len(values) - k + 1, 0), dtype=np.uint64)
    for a in range(0, len(out), SEGMENT):
        n = min(SEGMENT, len(out) - a)
        before = prefix(values[a : a + n + k - 1])
        out[a : a + n] = mix((before[k:] - before[:n]) * powers(n + k)[1][:n])
    return out


def texts(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text begins (n + 1 offsets); null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    blob = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return blob[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups_of(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` symbols; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(blob: np.ndarray, offsets: np.ndarray, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and the n + 1 offsets of each text's words."""
    inside = ~spaces[blob]
    first, last = inside.copy(), inside.copy()
    cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(blob))]
    first[1:] &= ~inside[:-1]
    first[cut] = inside[cut]
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words_hash(blob: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """A hash of each word; texts longer than a segment are hashed piece by piece at word ends. values: of each byte."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, side="right")))
        a = starts[i]
        out[i:j] = spans_hash(prefix(values[blob[a : ends[j - 1]]]), starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def minimisers(values: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of every `window` consecutive symbols of one text: the leftmost k-gram of least hash in it.

    Returns (anchor, first, last, hash): windows that start at first..last have that anchor; all count from the
    beginning of `values`. Equal windows have equal anchors at equal places, whatever stands around them, and every
    window has exactly one, so that equal windows always meet under one k-gram hash.
    """
    wide, found = window - k + 1, [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]]
    for i, j in groups_of(offsets, SEGMENT - window):
        lo, hi = int(offsets[i]), int(offsets[j])
        for a in range(lo, max(hi - window + 1, lo), SEGMENT - window + 1):
            b = min(hi, a + SEGMENT)
            n = b - a - window + 1
            if n <= 0:
                continue
            g = windows_hash(values[a:b], k)
            best = (g & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(g), dtype=np.uint64)
            span = 1
            while span * 2 <= wide:
                best = np.minimum(best[: len(best) - span], best[span:])
                span *= 2
            if span < wide:
                best = np.minimum(best[: len(best) - (wide - span)], best[wide - span :])
            at = (best[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
            valid = np.ones(n, dtype=bool)
            cuts = offsets[i + 1 : j] - a
            cuts = cuts[(cuts > 0) & (cuts < b - a)]
            if len(cuts):  # windows that start less than a window before a text's end cross it
                edge = np.zeros(n + 1, dtype=np.int32)
                np.add.at(edge, np.clip(cuts - window + 1, 0, n), 1)
                np.add.at(edge, np.clip(cuts, 0, n), -1)
                valid = np.cumsum(edge[:n]) == 0
            where = np.flatnonzero(valid)
            if not len(where):
                continue
            new = np.ones(len(where), dtype=bool)
            new[1:] = (at[where[1:]] != at[where[:-1]]) | (where[1:] != where[:-1] + 1)
            first = where[new]
            last = where[np.append(np.flatnonzero(new)[1:] - 1, len(where) - 1)]
            found.append([at[first] + a, first + a, last + a, g[at[first]]])
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    out = np.ones(total, dtype=np.int64)
    keep = counts > 0
    starts, counts = starts[keep].astype(np.int64), counts[keep].astype(np.int64)
    at = np.cumsum(counts)[:-1]
    out[0] = starts[0]
    out[at] = starts[1:] - starts[:-1] - counts[:-1] + 1
    return np.cumsum(out)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
