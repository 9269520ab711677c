"""Suffix-array deduplication on bytes by a common-prefix-aware distributed merge sort.

A sparse suffix array: every string of `window` bytes has one minimiser (kernels.minimisers), equal strings have equal
ones at equal places, so it is enough to sort the suffixes that start at minimisers, each with the bytes before it back
to the first string it stands for. Minimisers whose hash occurs once in the table can't begin a repeat and are left
out first. Each task sorts its suffixes into runs, front-codes them (length of the prefix shared with the one before,
then the rest) and sends each to the task of its minimiser's hash range; that task reads the runs one suffix at a time into
a loser tree in which a player carries the length of the prefix that it shares with the last winner, so that known prefixes
aren't compared again, and passes the common prefix on.

What repeats is read off these lengths. A string that starts L bytes before its minimiser ends window - L bytes after it:
neighbours in suffix order with a common prefix of window - L bytes or more have equal right parts, neighbours in the order
of what stands before the minimiser, read backwards, with L bytes in common have equal left parts, and strings alike in both
are equal. All but the first (smallest doc_id, then start) are spans to remove. Each task settles its own run in this way
before it sends those suffixes that hold a first string; the merged order is settled again. A minimiser with very many
suffixes is settled in pieces: only suffixes that hold a first string stay for the next piece.

Defined results: null text is empty; texts under `window` bytes keep all; equal rows and rows that share a doc_id are
one document (see exchange.unique_documents); an empty table gives an empty table; further columns are ignored.
Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .exchange import bucket_of, buckets, pack, repeated, rows, ship, unique_documents, unpack
from .substring_dedup import _columns

#: Suffixes that are sorted and settled at a time.
RUN, PIECE = 1 << 16, 1 << 14


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which the first `known` bytes are equal."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, hi = known, n
    while hi - lo > 8:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    while a[lo] == b[lo]:
        lo += 1
    return lo


def front_code(keys: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Lengths shared with the key before, and the rests, of sorted keys."""
    shared = [0, *(common(a, b, 0) for a, b in pairwise(keys))][: len(keys)]
    return shared, [k[n:] for k, n in zip(keys, shared, strict=True)]


def merge(runs: Iterable[Iterator[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """(key, common prefix with the one before, item) in ascending key order; ties by run.

    runs: sorted (key, length shared with the key before in the run, item), of which one at a time is held. A loser tree;
    each loser knows the prefix that it shares with the winner it lost to, so two players compare from there only if those
    lengths are equal.
    """
    runs = list(runs)
    k = 1
    while k < len(runs):
        k *= 2
    none = (None, 0, None)
    heads = [next(r, none) for r in runs] + [none] * (k - len(runs))
    current = [x[0] for x in heads]
    lcp = [0] * k
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's common prefix is with the winner from now on."""
        x, y = current[a], current[b]
        if y is None or x is None:
            return (a, b) if y is None and (x is not None or a < b) else (b, a)
        m, n = lcp[a], lcp[b]
        if m > n:
            return a, b
        if m < n:
            return b, a
        m = common(x, y, m)
        if (x[m:] < y[m:]) or (x[m:] == y[m:] and a < b):
            lcp[b] = m
            return a, b
        lcp[a] = m
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        w, lost = play(build(2 * node), build(2 * node + 1))
        losers[node] = lost
        return w

    winner = build(1) if k > 1 else 0
    while runs and current[winner] is not None:
        yield current[winner], lcp[winner], heads[winner][2]
        heads[winner] = x = next(runs[winner], none)
        current[winner], lcp[winner] = x[0], x[1]
        node, w = (winner + k) // 2, winner
        while node:
            w, losers[node] = play(w, losers[node])
            node //= 2
        winner = w


def left_order(lefts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings read backwards, and the length of each one's common ending with the one before it."""
    size = np.array([len(x) for x in lefts], dtype=np.int64)
    width = max(8, -(-int(size.max()) // 8) * 8)
    data = np.frombuffer(b"".join(lefts) + b"\0", dtype=np.uint8)
    at = np.cumsum(size)[:, None] - 1 - np.arange(width)
    grid = np.where(np.arange(width) < size[:, None], data[np.maximum(at, 0)], 0).astype(np.uint8)
    order = np.lexsort(grid.view(">u8").T[::-1])
    unlike = np.concatenate((grid[order[1:]] != grid[order[:-1]], np.ones((len(order) - 1, 1), dtype=bool)), axis=1)
    return order, np.concatenate(([0], unlike.argmax(axis=1)))


def settle(doc: np.ndarray, lo: np.ndarray, more: np.ndarray, lefts: list[bytes], lcp: np.ndarray, window: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Runs (doc, first, last) of strings that occur earlier, and which suffixes hold a first string.

    Suffixes in ascending order; lcp: the prefix that each shares with the one before. A suffix stands for the strings that
    start at bytes lo .. lo + more of doc; lefts: the bytes from lo to the suffix.
    """
    n = len(doc)
    left = np.array([len(x) for x in lefts], dtype=np.int64)
    order, ending = left_order(lefts)
    place = np.lexsort((lo + left, doc))
    back = np.empty(n, dtype=np.int64)
    least, deepest = left - more, int(left.max())
    gone = np.zeros((n, deepest + 2), dtype=bool)
    held = np.zeros(n, dtype=bool)
    for depth in range(int(least.min()), deepest + 1):
        own = place[(least[place] <= depth) & (left[place] >= depth)]
        if not len(own):
            continue
        back[order] = np.cumsum(ending < depth)
        kind = np.cumsum(lcp < window - depth)[own] * np.int64(n + 1) + back[own]
        by = np.argsort(kind, kind="stable")
        later = kind[by[1:]] == kind[by[:-1]]
        gone[own[by[1:][later]], depth] = True
        held[own[by[np.append(True, ~later)]]] = True
    begin, end = K.runs(gone.ravel())
    row, near = np.divmod(begin, deepest + 2)
    anchor = (lo + left)[row]
    return [doc[row], anchor - (near + end - begin - 1), anchor - near], held


def joined(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Runs of strings that follow each other in a document as one."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (first[1:] > last[:-1] + 1))[: len(doc)]
    begin = np.flatnonzero(new)
    return [doc[begin], first[begin], np.maximum.reduceat(last, begin) if len(begin) else last]


class Settled:
    """Takes suffixes in ascending order and settles them at the ends of groups that share a minimiser."""

    def __init__(self, window: int):
        self.window, self.held, self.found, self.most = window, [], [], 4 * PIECE

    def add(self, lcp: int, doc: int, lo: int, more: int, left: bytes) -> None:
        if lcp < self.window // 2:  # another minimiser: no string before it can be equal to one from here on
            if len(self.held) >= PIECE:
                self.end()
        elif len(self.held) >= self.most:
            kept = self._settle()
            low, out = self.window, []
            for row, keep in zip(self.held, kept.tolist(), strict=True):
                low = min(low, row[0])
                if keep:
                    out.append((low, *row[1:]))
                    low = self.window
            self.held, self.most = out, max(4 * PIECE, 2 * len(out))
            lcp = min(lcp, low)
        self.held.append((lcp, doc, lo, more, left))

    def _settle(self) -> np.ndarray:
        lcp, doc, lo, more = (np.array(x, dtype=np.int64) for x in list(zip(*self.held, strict=True))[:4])
        lcp[0] = 0
        k = self.window // 2
        follows = lcp >= k
        met = follows | np.append(follows[1:], False)  # the others hold strings that occur once
        out, held = np.zeros(len(doc), dtype=bool), np.flatnonzero(met)
        if len(held):
            spans, out[held] = settle(doc[held], lo[held], more[held], [self.held[i][4] for i in held.tolist()], np.where(follows, lcp, 0)[held], self.window)
            self.found.append(joined(*spans))
        out[~met] = True
        return out

    def end(self) -> np.ndarray:
        kept = self._settle() if self.held else np.zeros(0, dtype=bool)
        self.held, self.most = [], 4 * PIECE
        return kept

    def spans(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.found, strict=True)] if self.found else [np.zeros(0, np.int64)] * 3


def spans(docs: DataFrame, window: int = 100) -> DataFrame:
    """(doc_id, first, last): strings that start at bytes first..last of doc_id occur earlier; their bytes are
    first .. last + window - 1."""
    spark = docs.sparkSession
    ship(spark)
    k, n = max(window // 2, 1), buckets(spark)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part, ids, blob, offsets in _columns(batch):
                parts: list = [[np.zeros(0, np.int64)] for _ in range(3)] + [[np.zeros(0, np.uint64)]]
                for i, j in K.groups_of(offsets, K.SEGMENT):
                    top, at = int(offsets[j]), int(offsets[i])
                    while at < top:  # more than one step only within a text above a segment
                        end = min(top, at + K.SEGMENT + window) if j == i + 1 else top
                        own = K.minimisers(K.BYTE_VALUES[blob[at:end]], np.clip(offsets[i : j + 1], at, end) - at, window, k)
                        for held, x in zip(parts, (own[0] + at, own[1] + at, own[2] + at, own[3]), strict=True):
                            held.append(x)
                        at = top if end == top else end - window + 1
                found = [np.concatenate(x) for x in parts]
                yield part, ids, blob, offsets, found, np.searchsorted(offsets, found[0], side="right") - 1

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for _, ids, _, offsets, (anchor, _, _, h), row in anchors(batches):
            yield h, ids[row], anchor - offsets[row]

    def encode(own: list[tuple[bytes, int, int, int, bytes]]) -> bytes:
        """A sorted run, front-coded."""
        shared, rest = front_code([x[0] for x in own])
        size = lambda x: np.array([len(y) for y in x], dtype=np.uint32)
        data = lambda x: np.frombuffer(b"".join(x), np.uint8)
        before = [x[4] for x in own]
        doc, lo, more = (np.array([x[i] for x in own], dtype=np.int64) for i in (1, 2, 3))
        return pack(np.array(shared, np.uint32), size(rest), data(rest), doc, lo, more.astype(np.uint32), size(before), data(before))

    def decode(blob: bytes) -> Iterator[tuple[bytes, int, tuple]]:
        shared, size, data, doc, lo, more, lsize, ldata = unpack(blob)
        data, ldata, key, a, b = memoryview(data), memoryview(ldata), b"", 0, 0
        for i in range(len(shared)):
            s, r, m = int(shared[i]), int(size[i]), int(lsize[i])
            key = key[:s] + data[a : a + r]
            yield key, s, (int(doc[i]), int(lo[i]), int(more[i]), bytes(ldata[b : b + m]))
            a, b = a + r, b + m

    def run(own: list[tuple[bytes, int, int, int, bytes, int]]) -> Iterator[pa.RecordBatch]:
        """One sorted run: what it settles by itself, and a blob for each bucket of what holds a first string."""
        own.sort(key=lambda x: x[0])
        settled, kept, before = Settled(window), [], b""
        for x in own:
            lcp = common(before, x[0], 0)
            if lcp < k and len(settled.held) >= PIECE:
                kept.append(settled.end())
            settled.held.append((lcp, *x[1:5]))
            before = x[0]
        kept.append(settled.end())
        some = np.flatnonzero(np.concatenate(kept))
        bucket = bucket_of(np.array([own[i][5] for i in some.tolist()], dtype=np.uint64), n)
        order = np.argsort(bucket, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)]
        parts = [order[x:y] for x, y in zip(cuts, cuts[1:], strict=False) if y > x]
        yield rows([pa.array([int(bucket[x[0]]) for x in parts], pa.int32()), pa.array([encode([own[i] for i in some[x].tolist()]) for x in parts], pa.binary())], ["bucket", "run"])
        known = settled.spans()
        if len(known[0]):
            home = bucket_of(K.mix(known[0].astype(np.uint64)), n)
            order = np.argsort(home, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(home[order])) + 1).tolist(), len(order)]
            parts = [order[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
            yield rows([pa.array([int(home[x[0]]) for x in parts], pa.int32()), pa.array([pack(*(y[x] for y in known)) for x in parts], pa.binary())], ["bucket", "known"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            for b in run(held):
                blank = pa.nulls(b.num_rows, pa.binary())
                yield rows([b.column("bucket"), b.column("run") if "run" in b.schema.names else blank, b.column("known") if "known" in b.schema.names else blank], ["bucket", "run", "known"])
            held.clear()

        for part, ids, blob, offsets, (anchor, first, last, h), row in anchors(batches):
            where = part.column("pos")
            pos = where.flatten().to_numpy()
            owner = np.repeat(np.arange(len(ids)), np.diff(where.offsets.to_numpy()))
            keep = np.flatnonzero(np.isin(anchor, offsets[owner] + pos))
            data, base = memoryview(blob), offsets[row[keep]]
            for x in range(0, len(keep), RUN):
                s = keep[x : x + RUN]
                held += [(bytes(data[c : b + window]), d, a - o, b - a, bytes(data[a:c]), g) for c, a, b, d, o, g in zip(anchor[s].tolist(), first[s].tolist(), last[s].tolist(), ids[row[s]].tolist(), base[x : x + RUN].tolist(), h[s].tolist(), strict=True)]
                if len(held) >= RUN:
                    yield from out()
        if held:
            yield from out()

    def combine(table: pa.Table) -> pa.Table:
        settled = Settled(window)
        settled.found += [unpack(x.as_py()) for x in table.column("known") if x.is_valid]
        for _, lcp, item in merge(decode(x.as_py()) for x in table.column("run") if x.is_valid):
            settled.add(lcp, *item)
        settled.end()
        return pa.table([pa.array(x, pa.int64()) for x in joined(*settled.spans())], ["doc_id", "first", "last"])

    docs = unique_documents(docs)
    marked = repeated(docs, items).groupBy("doc_id").agg(F.collect_list("pos").alias("pos"))
    return docs.join(marked, "doc_id").mapInArrow(send, "bucket int, run binary, known binary").groupBy("bucket").applyInArrow(combine, "doc_id bigint, first bigint, last bigint")


def dedup(docs: DataFrame, window: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): kept is what stays of the UTF-8 bytes."""
    docs = unique_documents(docs)
    found = spans(docs, window).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids, blob, offsets in _columns(batch):
                data, listed = blob.tobytes(), part.column("spans")
                out: list[list] = [[] for _ in range(5)]
                for r in range(part.num_rows):
                    lo, hi = int(offsets[r]), int(offsets[r + 1])
                    gone = gaps = 0
                    text = data[lo:hi]
                    if listed[r].is_valid:
                        own = listed.slice(r, 1).flatten()
                        edge = np.zeros(hi - lo + 1, dtype=np.int32)
                        np.add.at(edge, own.field("first").to_numpy(), 1)
                        np.add.at(edge, own.field("last").to_numpy() + window, -1)
                        flags = np.cumsum(edge[:-1]) > 0
                        gone, gaps = int(flags.sum()), len(K.runs(flags)[0])
                        text = blob[lo:hi][~flags].tobytes()
                    for held, v in zip(out, (hi - lo, gone, gaps, hashlib.sha256(text).hexdigest(), text), strict=True):
                        held.append(v)
                yield rows([pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return docs.join(found, "doc_id", "left").mapInArrow(finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def digest(docs: DataFrame, window: int = 100) -> DataFrame:
    return dedup(docs, window).drop("kept")
