"""Best-fit packing in bulk-synchronous rounds.

Pieces and gaps are kept range-sorted and run-length coded: pieces of one length are alike and so are sequences with one gap, so a
table of runs (at most `capacity` lengths, a few runs of gaps for each) stands for any number of documents. A class of lengths
(half of the longest left and more) is placed by rounds. In a round, all its pieces sweep the sorted gaps for their successor, the
least gap that holds them: in descending order of size gaps raise a balance and pieces lower it, so a piece meets the last gap
before it on its own level, and pieces that want the same gap are told apart by rank, longest first. What found a gap is placed,
the gaps are updated, and the next round follows until no gap holds any of the class; the rest opens sequences, and the next
class begins. A round is a sweep over at most `capacity` rows whatever the number of documents (a run for each length), so the
rounds are one task's; what grows with the corpus is spread: lengths are counted, and every piece finds its place from its rank
within its length, counted distributedly too (ranges first, then within ranges).

Defined results: null or empty text is the end id alone; texts above the capacity are cut into full pieces and a rest; equal rows
and rows that share a doc_id are one document (see exchange.unique_documents); an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import rows, ship, unique_documents, written
from .tokens import encoder

END = b"\0\0\0\0"
MOVE = "length bigint, first bigint, n bigint, each bigint, sequence bigint, at bigint"
#: Sequences opened at a time for pieces that don't fill one with their like, against what these fill together.
SPARE = 1.0


def moves(lengths: DataFrame, capacity: int) -> DataFrame:
    """(length, first, n, each, sequence, at) from (length, n): pieces of that length with ranks first .. first + n - 1 go to
    sequences sequence, sequence + 1, ..., `each` of them to one, from place `at` on."""

    def place(table: pa.Table) -> pa.Table:
        own = Rounds(dict(zip(table.column("length").to_pylist(), table.column("n").to_pylist(), strict=True)), capacity)
        return pa.table([pa.array(x, pa.int64()) for x in zip(*own.run(), strict=True)], [x.split()[0] for x in MOVE.split(", ")])

    ship(lengths.sparkSession)
    return lengths.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(place, MOVE)  # a row for each length up to the capacity


class Rounds:
    """The rounds over runs of pieces and gaps."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences, self.moves = capacity, 0, []
        self.left = {length: (0, n) for length, n in counts.items() if n}
        self.gaps: list[tuple[int, int, int]] = []

    def run(self) -> list[tuple[int, int, int, int, int, int]]:
        top = float(self.capacity)
        while top >= 1:
            low = top / 2 if 16 * top > self.capacity else 0
            own = sorted((x for x in self.left if low < x <= top), reverse=True)
            if not own:
                top = low
            elif max((g[0] for g in self.gaps), default=0) >= own[-1]:
                self.sweep(own)
            else:
                self.open(own)
        return self.moves

    def units(self, length: int, each: int) -> list[tuple[int, int, int]]:
        """(units, pieces, rank): units of `each` pieces and one of the rest."""
        first, n = self.left.pop(length)
        whole, rest = divmod(n, each)
        return [x for x in ((whole, each, first), (1, rest, first + whole * each)) if x[0] and x[1]]

    def sweep(self, lengths: list[int]) -> None:
        """Sizes in descending order: gaps are laid on a stack, pieces take them from its top, the least that hold them."""
        sizes = sorted({g[0] for g in self.gaps})
        asked = []
        for length in lengths:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                asked += [(length, 0, -pieces, units, rank) for units, pieces, rank in self.units(length, sizes[at] // length)]
        events = sorted([(-size, 0, 0, seq, n) for size, seq, n in self.gaps] + [(-length, 1, pieces, units, rank) for length, _, pieces, units, rank in asked])
        stack: list[list[int]] = []
        made: list[tuple[int, int, int]] = []
        for size, is_piece, pieces, a, b in events:
            if not is_piece:
                stack.append([-size, a, b])
                continue
            length, pieces, units, rank = -size, -pieces, a, b
            while units and stack:
                gap, seq, n = stack[-1]
                k = min(n, units)
                self.moves.append((length, rank, k * pieces, pieces, seq + n - k, self.capacity - gap))
                made.append((gap - pieces * length, seq + n - k, k))
                units, rank, stack[-1][2] = units - k, rank + k * pieces, n - k
                if n == k:
                    stack.pop()
            if units:
                first, more = self.left.get(length, (rank, 0))
                self.left[length] = (min(first, rank), more + units * pieces)
        self.gaps = [g for g in [*map(tuple, stack), *made] if g[0]]

    def open(self, lengths: list[int]) -> None:
        """Sequences that a length fills by itself, and some for the rests, the longest first; other rests go on sweeping."""
        rest = sum(self.left[x][1] % (self.capacity // x) * x for x in lengths)
        spare = max(1, int(SPARE * rest / self.capacity))
        for length in lengths:
            each = self.capacity // length
            for units, pieces, rank in self.units(length, each):
                if pieces < each and spare <= 0:
                    self.left[length] = (rank, pieces)
                    continue
                spare -= pieces < each
                self.moves.append((length, rank, units * pieces, pieces, self.sequences, 0))
                if self.capacity > pieces * length:
                    self.gaps.append((self.capacity - pieces * length, self.sequences, units))
                self.sequences += units


def pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32)."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer)
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = memoryview(ids(text.as_py()) + END)
                n = len(own) // 4
                out += [(doc, k, a, min(capacity, n - a), zlib.crc32(own[4 * a : 4 * (a + capacity)])) for k, a in enumerate(range(0, n, capacity))]
            if out:
                yield rows([pa.array(x, pa.int32() if i == 1 else pa.int64()) for i, x in enumerate(zip(*out, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return unique_documents(docs).mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    # written first: a range partitioning reads its input twice, and texts are to be tokenised once
    own = written(pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), capacity), "tokens", "doc_id")
    own = written(own.repartitionByRange("length", "doc_id", "piece").withColumn("range", F.spark_partition_id()), "pieces")
    shares = written(own.groupBy("length", "range").agg(F.count("*").alias("n")), "shares", "length")
    before = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placing = written(moves(shares.groupBy("length").agg(F.sum("n").alias("n")), capacity), "moves")
    base = shares.select("length", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = own.withColumn("own", F.row_number().over(Window.partitionBy("length", "range").orderBy("doc_id", "piece")) - 1).join(base, ["length", "range"])
    rank = F.col("base") + F.col("own") - F.col("first")
    # a row for each move: a few for each of at most `capacity` lengths
    placed = ranked.join(F.broadcast(placing), (ranked.length == placing.length) & (rank >= 0) & (rank < F.col("n"))).drop(placing.length)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(rank / F.col("each"))).cast("bigint").alias("sequence_id"), (F.col("at") + (rank % F.col("each")) * F.col("length")).cast("bigint").alias("offset"))
