"""SimHash near-duplicates by a hierarchical index in Gray order.

A fingerprint has a bit set where over half of the text's shingle hashes have it; two link at `most` or fewer differing bits.
Equal fingerprints are one row from the start, under the least doc_id.

The 64 bits are cut into `most` + 1 bands, so that linked fingerprints agree in a whole band. For each band the fingerprints are
rotated until that band leads, ranked by Gray code and range-sorted by (band, rank): no key repeats, so a crowd of near copies
that shares bands is spread over as many blocks as any other rows. Each block is one task with an index of its own:

- The top nodes are the band's values: a difference there is not allowed, so values are searched one by one.
- Below, runs of FAN neighbours in Gray order are a node, runs of FAN nodes one above, and so on. A node holds the bits that all
  its fingerprints share and that no node above it holds: a mask and a pattern. What a fingerprint differs from the patterns on
  the way down adds up; once it passes `most` the whole group below is left out.
- All fingerprints of a value walk down together, one level of the index at a time, in chunks. A node whose fingerprints are all
  in the walker's component already is left out too, so a crowd costs little once it is joined: neighbours in Gray order are
  joined first, and every chunk's links before the next chunk walks.

A task returns one link for each fingerprint at most (to the root of its part), never pairs. A band value that is cut by the
end of a block is searched across: blocks are summed up by their shared bits, pairs of blocks of one value that differ too much in
them, or that stand whole in one component by now, are left out, and the rest is walked, one task for each pair of blocks.

Defined results: null and empty texts, and texts without words, have fingerprint zero and link like any other; a text of fewer than
four words is one shingle; rows without a doc_id are left out, rows that repeat a doc_id are one document
(exchange.unique_documents); ties at exactly half leave the bit clear; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .components import connected
from .exchange import rows, ship, unique_documents, written

#: Words of a shingle, differing bits of a link, seed of XXH64; fingerprints of an index node, walkers and frontier of a step.
WORDS, MOST, SEED = 4, 4, 42
FAN, WALKERS, FRONTIER = 8, 2048, 1 << 17
#: The eight bits of a byte as the eight bytes of a number, lowest first.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprint_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes; offsets: n + 1. Eight counters share a number, up to 255 hashes at a time."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    pieces = -(-sizes[some] // 255)
    first = np.cumsum(pieces) - pieces
    begin = np.repeat(offsets[some], pieces) + (np.arange(pieces.sum()) - np.repeat(first, pieces)) * 255
    planes = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        counts = np.add.reduceat(SPREAD[planes[:, byte]], begin).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(counts.astype(np.int64), first, axis=0)
        out[some] |= np.packbits(2 * total > sizes[some][:, None], axis=1, bitorder="little").reshape(-1).astype(np.uint64) << np.uint64(8 * byte)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, bits): the fingerprint of every text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blob, offsets = kernels.texts(batch.column("text"))
            found = []
            for i, j in kernels.groups_of(offsets, 1 << 20):
                low = kernels.LOWER[blob[offsets[i] : offsets[j]]]
                starts, ends, own = kernels.words(low, offsets[i : j + 1] - offsets[i])
                lengths = ends - starts + 1  # with one space behind each
                text = np.full(int(lengths.sum()), 32, np.uint8)
                place = np.cumsum(lengths) - lengths
                text[kernels.ranges(place, ends - starts)] = low[kernels.ranges(starts, ends - starts)]
                stop = place + lengths - 1
                n = np.diff(own)
                count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(n.dtype))
                head = kernels.ranges(own[:-1], count)
                tail = np.minimum(head + WORDS, np.repeat(own[1:], count)) - 1
                plain = text.tobytes()
                hashes = np.fromiter((xxhash.xxh64_intdigest(plain[a:b], SEED) for a, b in zip(place[head].tolist(), stop[tail].tolist(), strict=True)), np.uint64, len(head))
                found.append(fingerprint_bits(hashes, np.append(0, np.cumsum(count))))
            yield rows([batch.column("doc_id"), pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))], ["doc_id", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, bits bigint")


def bands(most: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of each of the most + 1 bands."""
    edges = [round(64 * k / (most + 1)) for k in range(most + 2)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a code in Gray order; its leading bits follow from the code's own leading bits."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


def roots(parent: np.ndarray) -> np.ndarray:
    while not (parent[parent] == parent).all():
        parent = parent[parent]
    return parent


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent (all roots) after joining a with b."""
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        if (low == high).all():
            return parent
        np.minimum.at(parent, high, low)
        parent = roots(parent)


class Index:
    """Levels of nodes over codes in Gray order, leaves first. A node: its codes' range, and the mask and pattern of the bits that its
    codes share beyond what the nodes above it hold."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        ones, zeros, starts = [codes], [~codes], [np.arange(len(codes) + 1)]
        while len(ones[-1]) > FAN:
            at = np.arange(0, len(ones[-1]), FAN)
            ones.append(np.bitwise_and.reduceat(ones[-1], at))
            zeros.append(np.bitwise_and.reduceat(zeros[-1], at))
            starts.append(np.append(starts[-1][at], len(codes)))
        shared = [o | z for o, z in zip(ones, zeros, strict=True)]
        self.starts, self.patterns = starts, ones
        self.masks = [own & ~np.repeat(above, FAN)[: len(own)] for own, above in zip(shared[:-1], shared[1:], strict=True)] + shared[-1:]

    def close(self, asked: np.ndarray, asked_part: np.ndarray, part: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(walker, code) of all pairs within `most` bits whose parts differ; part: of each code."""
        one = [np.minimum.reduceat(part, s[:-1]) for s in self.starts]
        many = [np.maximum.reduceat(part, s[:-1]) != low for s, low in zip(self.starts, one, strict=True)]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        top = len(self.masks) - 1
        walker = np.repeat(np.arange(len(asked)), len(self.masks[top]))
        todo = [(top, walker, np.tile(np.arange(len(self.masks[top])), len(asked)), np.zeros(len(walker), np.uint8))]
        while todo:
            level, walker, node, gone = todo.pop()
            if len(walker) > FRONTIER:
                half = len(walker) // 2
                todo += [(level, walker[:half], node[:half], gone[:half]), (level, walker[half:], node[half:], gone[half:])]
                continue
            gone = gone + np.bitwise_count((asked[walker] ^ self.patterns[level][node]) & self.masks[level][node])
            on = (gone <= most) & (many[level][node] | (one[level][node] != asked_part[walker]))
            walker, node, gone = walker[on], node[on], gone[on]
            if level == 0:
                found.append((walker, node))
            elif len(walker):
                n = len(self.masks[level - 1])
                child = (node[:, None] * FAN + np.arange(FAN)).reshape(-1)
                ok = child < n
                todo.append((level - 1, np.repeat(walker, FAN)[ok], child[ok], np.repeat(gone, FAN)[ok]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def settle(codes: np.ndarray, parent: np.ndarray, most: int, asked: np.ndarray | None = None, asked_at: int = 0) -> np.ndarray:
    """parent after joining all codes (in Gray order) within `most` bits; with `asked`: those with the codes that stand at asked_at and
    on in parent, in which the index's codes stand first."""
    index = Index(codes)
    n = len(codes)
    asked = codes if asked is None else asked
    for a in range(0, len(asked), WALKERS):
        own = np.arange(a, min(a + WALKERS, len(asked)))
        walker, code = index.close(asked[own], parent[asked_at + own], parent[:n], most)
        if len(walker):
            parent = joined(parent, asked_at + own[walker], code)
    return parent


def gray_sorted(docs: DataFrame, most: int) -> DataFrame:
    """(band, rank, code, doc_id, block): every fingerprint (bits, doc_id) once for each band, its bits turned until the band leads,
    in blocks that are ranges of (band, rank)."""
    own = None
    for band, (first, _) in enumerate(bands(most)):
        turned = F.shiftleft("bits", first).bitwiseOR(F.shiftrightunsigned("bits", 64 - first)) if first else F.col("bits")
        one = docs.select("doc_id", F.lit(band).alias("band"), turned.alias("code"))
        own = one if own is None else own.unionByName(one)
    rank = F.col("code")
    for k in (1, 2, 4, 8, 16, 32):
        own = own.withColumn("rank", rank.bitwiseXOR(F.shiftrightunsigned(rank, k)))
        rank = F.col("rank")
    own = own.withColumn("rank", F.col("rank").bitwiseXOR(F.lit(-(2**63))))  # signed order is the ranks' unsigned order
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.repartitionByRange(n, "band", "rank").sortWithinPartitions("band", "rank")
    return written(own.withColumn("block", F.spark_partition_id()), "gray")


def value_of(code: np.ndarray, band: np.ndarray, most: int) -> np.ndarray:
    width = np.array([w for _, w in bands(most)], np.uint64)[band]
    return (code >> (np.uint64(64) - width)).astype(np.int64)


def within(blocks: DataFrame, most: int) -> DataFrame:
    """(a, b): links inside blocks, at most one for each fingerprint and band."""

    def run(table: pa.Table) -> pa.Table:
        band, code, doc = (table.column(c).to_numpy() for c in ("band", "code", "doc_id"))
        code = code.view(np.uint64)
        order = np.lexsort((gray_rank(code), band))
        band, code, doc = band[order], code[order], doc[order]
        value = value_of(code, band, most)
        parent = np.arange(len(code))
        near = np.flatnonzero((np.bitwise_count(code[1:] ^ code[:-1]) <= most) & (band[1:] == band[:-1]) & (value[1:] == value[:-1]))
        parent = joined(parent, near, near + 1)
        edges = np.flatnonzero(np.append(True, (band[1:] != band[:-1]) | (value[1:] != value[:-1])))
        for a, b in zip(edges.tolist(), np.append(edges[1:], len(code)).tolist(), strict=True):
            if b - a > 1 and (parent[a:b] != parent[a]).any():
                parent[a:b] = settle(code[a:b], parent[a:b] - a, most) + a
        linked = np.flatnonzero(parent != np.arange(len(code)))
        return pa.table([pa.array(doc[linked], pa.int64()), pa.array(doc[parent[linked]], pa.int64())], ["a", "b"])

    return blocks.select("block", "band", "code", "doc_id").groupBy("block").applyInArrow(run, "a bigint, b bigint")


def across(blocks: DataFrame, parts: DataFrame, most: int) -> DataFrame:
    """(a, b): links between blocks that hold one value of a band; parts: (doc_id, component_id) known by now."""
    shift = f"element_at(array({', '.join(str(64 - w) for _, w in bands(most))}), band + 1)"
    ends = blocks.groupBy("block").agg(F.min(F.struct("band", "rank", "code")).alias("low"), F.max(F.struct("band", "rank", "code")).alias("high"))
    ends = ends.select("block", F.explode(F.array("low", "high")).alias("e")).select("block", "e.*").select("block", "band", F.expr(f"shiftrightunsigned(code, {shift})").alias("value"))
    cut = ends.distinct().groupBy("band", "value").agg(F.count("*").alias("blocks")).where("blocks > 1").select("band", "value")  # two for each block at most
    own = blocks.withColumn("value", F.expr(f"shiftrightunsigned(code, {shift})"))
    own = own.join(F.broadcast(cut), ["band", "value"]).join(parts, "doc_id", "left").select("band", "value", "block", "code", "doc_id", F.coalesce("component_id", "doc_id").alias("part"))
    own = written(own, "cut-values")
    nodes = own.groupBy("band", "value", "block").agg(F.expr("bit_and(code)").alias("ones"), F.expr("bit_and(~code)").alias("zeros"), F.min("part").alias("low"), F.max("part").alias("high"))
    nodes = written(nodes, "cut-nodes")
    other = nodes.select("band", "value", *(F.col(c).alias(f"{c}2") for c in ("block", "ones", "zeros", "low", "high")))
    pairs = nodes.join(other, ["band", "value"]).where(f"block < block2 AND bit_count((ones & zeros2) | (zeros & ones2)) <= {most} AND NOT (low = high AND low2 = high2 AND low = low2)")
    pairs = written(pairs.select("band", "value", "block", "block2"), "block-pairs")
    left = pairs.join(own, ["band", "value", "block"]).select("band", "value", "block", "block2", "code", "doc_id", "part", F.lit(False).alias("second"))
    right = pairs.join(own.withColumnRenamed("block", "block2"), ["band", "value", "block2"]).select("band", "value", "block", "block2", "code", "doc_id", "part", F.lit(True).alias("second"))

    def run(table: pa.Table) -> pa.Table:
        code, doc, part, second = (table.column(c).to_numpy() for c in ("code", "doc_id", "part", "second"))
        code = code.view(np.uint64)
        order = np.lexsort((gray_rank(code), second))
        code, doc, part, second = code[order], doc[order], part[order], second[order]
        n = int((~second).sum())
        _, first, known = np.unique(part, return_index=True, return_inverse=True)
        before = first[known]
        parent = settle(code[:n], before.copy(), most, code[n:], n)
        linked = np.flatnonzero(parent != before)
        return pa.table([pa.array(doc[linked], pa.int64()), pa.array(doc[parent[linked]], pa.int64())], ["a", "b"])

    return left.unionByName(right).groupBy("band", "value", "block", "block2").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, fingerprint, component_id): the fingerprint in 16 hexadecimal digits and the least doc_id that links reach."""
    own = written(fingerprints(unique_documents(docs.select("doc_id", "text"))), "fingerprints")
    each = own.groupBy("bits").agg(F.min("doc_id").alias("doc_id"))
    blocks = gray_sorted(each, most)
    inside = written(within(blocks, most).distinct(), "links-within")
    parts = connected(inside)
    outside = written(across(blocks, parts, most).distinct(), "links-across")
    if not outside.isEmpty():
        parts = connected(inside.unionByName(outside))
    reach = each.join(parts, "doc_id", "left").select("bits", F.coalesce("component_id", "doc_id").alias("component_id"))
    return own.join(reach, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
