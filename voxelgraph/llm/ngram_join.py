"""N-gram Jaccard join by parity sketches.

The set of a document: hashes (64 bits) of its distinct `words`-word shingles. Two sets link when
den * |A & B| >= num * |A | B|, that is when their symmetric difference is at most (|A| + |B|) * (den - num) // (den + num).

Sizes are cut into bands so that linked sets stand in one band or in neighbours; for each band that holds the smaller set
there is one bound D on the difference, its largest size times (den - num) / num. A set is XOR-hashed into D + s lanes of
64 bits: every shingle toggles bits of one lane, so the number of unequal lanes is at most the difference, and linked sets
have at least s equal lanes (pigeonhole). Sets meet under (band pair, lane, bits). A set with fewer than s empty lanes has
a full lane among the equal ones, so its empty lanes are no meeting places; s follows from the number of empty lanes that
chance leaves. Empty lanes count as places only for sets with s of them or more.

A document's places and its set are one row of a table; sweeps deal sketches out to places. A parity sketch has at least
a bit for each shingle of the band: its Hamming distance is at most the symmetric difference as well, and both are odd or
even with |A| + |B|, so pairs above the bound are dropped by popcounts. Within a meeting place no pairs are listed.

- The first sweep takes the places of the first EARLY lanes, where most near copies meet: each set is held against few
  leaders and linked to the first that passes. Links are verified on the sets, one for each document first, the others
  only between documents that still stand in different components.
- The second sweep takes every place of every lane and asks which documents pass the popcount with a document of another
  component there. Only these are swept again in those places, with sketches FINE times as long: the nearest pair of each
  two components of a place is verified. If any pair has been passed over, a last sweep of the same places takes every pair
  that passes and still stands in different components, and these are verified too, so no link between components is lost.

Defined results: null or empty text and text without words have an empty set, linked with nothing; with fewer words than a
shingle, the whole sequence is the one shingle; equal sets are one class; equal rows and rows that share a doc_id are one
document (see exchange.unique_documents); an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected
from .exchange import Sender, bucket_of, deltas, pack, release, repeated, rows, ship, unique_documents, unpack, written
from .substring_dedup import _columns

ORDER = np.uint64(0x9FB21C651E98DF25)
#: Longest parity sketch. Beyond that many shingles a sketch tells less and more pairs are verified on their sets.
MOST_BITS = 1 << 18
#: Words of sketches compared at a time.
COMPARED = 1 << 18
#: Bits for each shingle in the sketches of the later sweeps, where all pairs of unlinked sets count.
FINE = 4
#: Pairs and components that are broadcast, counted first: 16 bytes each.
FEW = 1 << 20
#: Lanes of each band pair that the first sweep takes. More or fewer give the same links.
EARLY = 8


class Rule:
    """Shingle length, threshold num / den, size bands."""

    def __init__(self, words: int, num: int, den: int):
        self.words, self.num, self.den = words, num, den
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append((self.edges[-1] - 1) * den // num + 1 if (self.edges[-1] - 1) * den // num >= self.edges[-1] else self.edges[-1] + 1)
        self.pairs = [self._lanes(g) for g in range(len(self.edges) - 1)]

    def _lanes(self, group: int) -> tuple[int, int]:
        """(number of lanes, equal lanes of linked sets) of a band pair; any number above the bound D gives the same links."""
        most = (self.edges[group + 1] - 1) * (self.den - self.num) // self.num
        m = most + 2
        for _ in range(8):
            m = most + 2 + int(1.5 * m * np.exp(-self.edges[group] / m))
        return m, m - most

    def lanes(self, n: int) -> list[tuple[int, int, int]]:
        """(band pair, number of lanes, equal lanes) for a set of n shingles."""
        band = int(np.searchsorted(self.edges, n, side="right")) - 1
        return [(g, *self.pairs[g]) for g in (band - 1, band) if g >= 0]

    def bits(self, group: int, fine: int = 1) -> int:
        """Bits of the parity sketches of a band pair: `fine` for each shingle; with one, unlike sets differ in about half."""
        return min(-(-fine * (self.edges[group + 1] - 1) // 64) * 64, MOST_BITS)

    def bound(self, total):
        """Largest symmetric difference of linked sets with `total` shingles together: as odd or even as the total."""
        most = total * (self.den - self.num) // (self.den + self.num)
        return most - (total - most) % 2


def sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Iterator[np.ndarray]]]:
    """For each part of a batch: rows, doc ids and, one at a time, each row's distinct shingle hashes in ascending order."""
    for batch in batches:
        for part, ids, blob, offsets in _columns(batch):
            blob = K.LOWER[blob]
            starts, ends, at = K.words(blob, offsets)
            w = K.words_hash(blob, starts, ends)
            g = K.windows_hash(w, words)
            del blob, starts, ends

            def each(w: np.ndarray = w, g: np.ndarray = g, at: np.ndarray = at) -> Iterator[np.ndarray]:
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = np.sort(g[a : b - words + 1]) if b - a >= words else K.mix(K.prefix(w[a:b])[-1:]) if b > a else w[:0]
                    yield own[np.append(True, own[1:] != own[:-1])] if len(own) > 1 else own

            yield part, ids, each()


def meeting_places(own: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a set, their numbers, band pairs and lanes, the same for every set with the same shingles."""
    keys, numbers, groups, lanes, before = [], [], [], [], 0
    for group, m, equal in rule.lanes(len(own)):
        lane = ((own >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)  # ascending, as own is
        begin = np.flatnonzero(np.append(True, lane[1:] != lane[:-1]))
        bits = np.zeros(m, dtype=np.uint64)
        bits[lane[begin]] = np.bitwise_xor.reduceat(K.mix(own ^ ORDER), begin)
        at = lane[begin] if m - len(begin) < equal else np.arange(m)
        keys.append(K.mix(bits[at] ^ K.mix(at.astype(np.uint64) + np.uint64(group) * np.uint64(1 << 40))))
        numbers.append(at + before)
        groups.append(np.full(len(at), group, np.uint8))
        lanes.append(at)
        before += m
    return np.concatenate(keys), np.concatenate(numbers), np.concatenate(groups), np.concatenate(lanes)


def sketch(own: np.ndarray, bits: int) -> np.ndarray:
    """One bit a shingle: parity of the shingles that hash to it."""
    odd = np.bincount(((K.mix(own + ORDER) >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


class Meetings:
    """Items (document, size, component, key, number) of the blobs of a bucket; those of a document and band pair share one sketch."""

    def __init__(self, blobs: pa.ChunkedArray, rule: Rule, fine: int):
        parts = [unpack(x.as_py()) for x in blobs]
        doc = np.concatenate([np.cumsum(x[0]) for x in parts])
        size, comp, each, self.key, self.at, group, self.sketches = (np.concatenate([x[i] for x in parts]) for i in range(1, 8))
        self.rule, self.doc, self.size, self.comp = rule, *(np.repeat(x, each) for x in (doc, size, comp))
        width = np.array([rule.bits(g, fine) // 64 for g in range(int(group.max()) + 1)])[group] if len(group) else np.zeros(0, np.int64)
        self.begin, self.width = np.repeat(np.cumsum(width) - width, each), np.repeat(width, each)

    def places(self) -> Iterator[np.ndarray]:
        """Items of each meeting place with at least two documents, the smallest doc_id first."""
        order = np.lexsort((self.doc, self.key))
        cut = np.flatnonzero(np.diff(self.key[order])) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(order)], strict=True):
            if b - a > 1:
                yield order[a:b]

    def apart(self, one: int, others: np.ndarray) -> np.ndarray:
        """How far the sketches of others of a place are from one's."""
        width, apart = int(self.width[one]), np.zeros(len(others), dtype=np.int64)
        mine, lanes = self.sketches[self.begin[one] : self.begin[one] + width], np.arange(width)
        step = max(1, COMPARED // width)
        for a in range(0, len(others), step):
            theirs = self.sketches[self.begin[others[a : a + step]][:, None] + lanes]
            apart[a : a + step] = np.bitwise_count(theirs ^ mine).sum(axis=1)
        return apart

    def near(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which others of a place pass the popcount."""
        return self.apart(one, others) <= self.rule.bound(self.size[others] + self.size[one])


def linked(docs: DataFrame, words: int, num: int, den: int, fine: int = FINE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: component_id is the smallest doc_id reachable by links."""
    spark = docs.sparkSession
    ship(spark)
    rule, n = Rule(words, num, den), int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = unique_documents(docs)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, own in sets(batches, words):
            found = [(len(x), x.sum(dtype=np.uint64), np.bitwise_xor.reduce(K.mix(x))) if len(x) else (0, np.uint64(0), np.uint64(0)) for x in own]
            size, total, other = zip(*found, strict=True)
            yield rows([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), np.array(total, np.uint64).view(np.int64), np.array(other, np.uint64).view(np.int64)], ["doc_id", "n_shingles", "p", "q"])

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for _, ids, own in sets(batches, words):
            found = [(i, *meeting_places(x, rule)) for i, x in zip(ids.tolist(), own, strict=True) if len(x)]
            if found:
                yield np.concatenate([x[1] for x in found]), np.repeat(np.array([x[0] for x in found]), [len(x[1]) for x in found]), np.concatenate([x[2] for x in found])

    ids = written(docs.mapInArrow(prints, "doc_id bigint, n_shingles bigint, p bigint, q bigint"), "sets", "n_shingles", "p", "q")
    classes = ids.where("n_shingles > 0").groupBy("n_shingles", "p", "q").agg(F.min("doc_id").alias("class_id"))
    first = classes.select(F.col("class_id").alias("doc_id"))
    marked = repeated(docs, items, np.uint32).join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list(F.col("pos").cast("int")).alias("pos"))
    marked = written(marked, "marked")
    release(spark)  # the hashes of all meeting places are gone before the texts are shuffled

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, own in sets(batches, words):
            listed = part.column("pos")
            out: list[list[bytes]] = [[] for _ in range(5)]
            for r, x in enumerate(own):
                key, at, group, lane = meeting_places(x, rule)
                known = np.isin(at, listed.slice(r, 1).flatten().to_numpy())
                for held, y in zip(out, (key[known], at[known].astype(np.uint32), group[known], lane[known].astype(np.uint32), x), strict=True):
                    held.append(y.tobytes())
            yield rows([pa.array(ids, pa.int64()), *(pa.array(x, pa.binary()) for x in out)], ["doc_id", "places", "numbers", "bands", "lanes", "shingles"])

    held = written(docs.join(marked, "doc_id").mapInArrow(places, "doc_id bigint, places binary, numbers binary, bands binary, lanes binary, shingles binary"), "places")
    release(spark)

    def encode(doc: np.ndarray, size: np.ndarray, comp: np.ndarray, key: np.ndarray, at: np.ndarray, group: np.ndarray, bits: np.ndarray) -> bytes:
        """The sketch of a document and band pair once for each blob, whatever the number of its keys in it."""
        new = np.append(True, (doc[1:] != doc[:-1]) | (group[1:] != group[:-1]))
        return pack(deltas(doc[new]), size[new], comp[new], np.diff(np.append(np.flatnonzero(new), len(doc))).astype(np.uint32), key, at, group[new], np.concatenate(bits[new]))

    def dealt(table: DataFrame, fine: int, lanes: int | None = None) -> GroupedData:
        """Blobs by bucket: places of the documents of `table` with sketches and components, all of them, those of the first
        `lanes` or, if it has a column pos, those numbers."""
        listed = "pos" in table.columns

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sender = Sender(n, encode, most=1 << 15)
            for batch in batches:
                for r, (doc, comp, key, at, group, lane, own) in enumerate(zip(*(batch.column(c) for c in ("doc_id", "comp", "places", "numbers", "bands", "lanes", "shingles")), strict=True)):
                    key, at, group, lane, own = (np.frombuffer(x.as_py(), t) for x, t in ((key, np.uint64), (at, np.uint32), (group, np.uint8), (lane, np.uint32), (own, np.uint64)))
                    some = np.isin(at, batch.column("pos").slice(r, 1).flatten().to_numpy()) if listed else lane < (lanes or 1 << 31)
                    key, at, group = key[some], at[some], group[some]
                    if not len(key):
                        continue
                    bits = np.empty(len(key), dtype=object)
                    for g in np.unique(group).tolist():
                        own_bits = sketch(own, rule.bits(g, fine))
                        for i in np.flatnonzero(group == g).tolist():
                            bits[i] = own_bits
                    yield from sender.add(bucket_of(key, n), np.full(len(key), doc.as_py()), np.full(len(key), len(own)), np.full(len(key), comp.as_py()), key, at, group, bits)
            yield from sender.flush()

        return table.mapInArrow(send, Sender.schema).groupBy("bucket")

    def hits(table: pa.Table) -> pa.Table:
        """(doc_id, pos): documents and numbers of their places where a near document of another component meets them."""
        met = Meetings(table.column("blob"), rule, 1)
        hit = np.zeros(len(met.doc), dtype=bool)
        for own in met.places():
            comp = met.comp[own]
            if (comp == comp[0]).all():
                continue
            for i, one in enumerate(own[:-1]):
                others = own[i + 1 :][comp[i + 1 :] != comp[i]]
                if len(others):
                    others = others[met.near(one, others)]
                    hit[others] = True
                    hit[one] |= len(others) > 0
        return pa.table([pa.array(met.doc[hit], pa.int64()), pa.array(met.at[hit].astype(np.int32), pa.int32())], ["doc_id", "pos"])

    def stars(table: pa.Table) -> pa.Table:
        met = Meetings(table.column("blob"), rule, 1)
        left, right = [met.doc[:0]], [met.doc[:0]]
        for own in met.places():
            while len(own) > 1:
                ok = met.near(own[0], own[1:])
                left.append(met.doc[own[1:][ok]])
                right.append(np.full(int(ok.sum()), met.doc[own[0]]))
                own = own[1:][~ok]
        return _pairs(left, right)

    def across(every: bool, table: pa.Table) -> pa.Table:
        """Near pairs of different components; unless `every`, the nearest of each two components of a place. The row
        (-1, -1) says that some were passed over."""
        met = Meetings(table.column("blob"), rule, fine)
        left, right = [met.doc[:0]], [met.doc[:0]]
        for own in met.places():
            comp = met.comp[own]
            if (comp == comp[0]).all():
                continue
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for i, one in enumerate(own[:-1]):
                others = own[i + 1 :][comp[i + 1 :] != comp[i]]
                apart = met.apart(one, others) if len(others) else others
                near = apart <= rule.bound(met.size[others] + met.size[one])
                others, apart = others[near], apart[near]
                if every:
                    left.append(met.doc[others])
                    right.append(np.full(len(others), met.doc[one]))
                    continue
                for other, d in zip(others.tolist(), apart.tolist(), strict=True):
                    two = (min(comp[i], met.comp[other]), max(comp[i], met.comp[other]))
                    if two in best:
                        best[None] = (0, -1, -1)
                    best[two] = min(best.get(two, (d, other, one)), (d, other, one))
            for _, a, b in best.values():
                left.append(met.doc[[a]] if a >= 0 else np.array([-1]))
                right.append(met.doc[[b]] if b >= 0 else np.array([-1]))
        return _pairs(left, right)

    def nearest(table: pa.Table) -> pa.Table:
        return across(False, table)

    def every_pair(table: pa.Table) -> pa.Table:
        return across(True, table)

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b), by the sets themselves."""

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = batch.column("shingles"), batch.column("other")
                ok = []
                for x, y in zip(a, b, strict=True):
                    x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    both = np.concatenate((x, y))
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    ok.append(den * shared >= num * (len(both) - shared))
                yield rows([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], ["a", "b"])

        few = F.broadcast if pairs.count() <= FEW else lambda x: x  # 16 bytes each
        left, right = (held.select(F.col("doc_id").alias(x), F.col("shingles").alias(y)) for x, y in (("a", "shingles"), ("b", "other")))
        right = right.join(few(pairs.select("b").distinct()), "b", "left_semi")
        return left.join(few(pairs), "a").join(right, "b").select("a", "b", "shingles", "other").mapInArrow(check, "a bigint, b bigint")

    def stated(links: DataFrame) -> DataFrame:
        """held with the component of each document so far."""
        found = connected(links).withColumnRenamed("component_id", "comp")
        few = F.broadcast if found.count() <= FEW else lambda x: x  # 16 bytes each
        return held.join(few(found), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))

    pairs = written(dealt(held.withColumn("comp", F.col("doc_id")), 1, EARLY).applyInArrow(stars, "a bigint, b bigint").distinct(), "pairs")
    release(spark)
    one = written(verified(written(pairs.groupBy("a").agg(F.min("b").alias("b")), "first-pairs")), "links", "a")
    found = connected(one).withColumnRenamed("component_id", "comp")
    side = lambda x: found.select(F.col("doc_id").alias(x), F.col("comp").alias(f"comp_{x}"))
    rest = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where("coalesce(comp_a, a) <> coalesce(comp_b, b)").select("a", "b")
    links = one.unionByName(written(verified(written(rest, "more-pairs")), "links", "a"))
    release(spark)
    hit = written(dealt(stated(links), 1).applyInArrow(hits, "doc_id bigint, pos int").groupBy("doc_id").agg(F.collect_list("pos").alias("pos")), "hits")
    release(spark)
    few = F.broadcast if hit.count() <= FEW else lambda x: x  # 8 bytes each
    for every in (False, True):
        some = stated(links).join(few(hit.select("doc_id")), "doc_id", "left_semi").join(hit, "doc_id")
        pairs = written(dealt(some, fine).applyInArrow(every_pair if every else nearest, "a bigint, b bigint").distinct(), "pairs")
        links = links.unionByName(written(verified(written(pairs.where("a >= 0"), "near-pairs")), "links", "a"))
        release(spark)
        if pairs.where("a < 0").isEmpty():
            break
    found = connected(links)
    reached = classes.join(found.withColumnRenamed("doc_id", "class_id"), "class_id", "left").select("n_shingles", "p", "q", F.coalesce("component_id", "class_id").alias("component_id"))
    return ids.join(reached, ["n_shingles", "p", "q"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _pairs(left: list[np.ndarray], right: list[np.ndarray]) -> pa.Table:
    pair = np.unique(np.stack((np.concatenate(left), np.concatenate(right)), axis=1), axis=0)
    return pa.table([pa.array(pair[:, 0], pa.int64()), pa.array(pair[:, 1], pa.int64())], ["a", "b"])


def stage(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id; documents without words stay, as each is
    its own component. lang and source stay beside the text."""
    first = linked(docs, words, num, den).where("doc_id = component_id").select("doc_id")
    return unique_documents(docs, "lang", "source").join(first, "doc_id", "left_semi").select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))
