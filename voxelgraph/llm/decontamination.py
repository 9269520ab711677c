"""Benchmark decontamination by template canonicalisation.

Words (letters and digits) become template symbols: a word with a digit is a number, a word of UNITS a unit, a capitalised
word inside a sentence a name; all others stand for themselves in lower case. Windows of WINDOW symbols, at least LITERAL of
them words, are hashed and joined with the windows of the benchmark. A document holds an item if at least SHARE percent of
the item's windows are found and the slots agree: one value of the item always became one value of the document. So questions
with other numbers, names or units are caught as well as copies. Both are judged for each occurrence, and one is enough: the
windows at one diagonal (place in the document less place in the item), then with windows of diagonals within DRIFT words
that stand in order and agree with them (values of more words, inserted words), and the windows of the whole document.

Windows of the benchmark are held by every task while there are at most SMALL of them (counted); beyond that all windows of
the documents are joined by a shuffle. Only hits are grouped.

Copies need no literal words: beside the symbols all windows are hashed by their plain words, and a document with at least
SHARE percent of these holds the item too, be it all numbers and names, unless the slots of its other windows disagree.

Defined results: null and empty texts hold nothing; items with fewer than WINDOW words are one window of all their words,
held against all windows of that length in the documents, by symbols if at least LITERAL of these are words and verbatim
always; items with fewer than ALONE words say too little inside a sentence and are held only by a line that has these words and no
others ("Yes" by a line or a document "yes", not by every text with that word); items without a word are never held;
equal rows and rows that share a doc_id are one document (see
exchange.unique_documents); null items are left out; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .exchange import rows, ship, unique_documents, written
from .substring_dedup import _columns
from .toxicity import Grammar, lowered, word_key

WINDOW, LITERAL, SHARE, SMALL, DRIFT = 8, 5, 40, 2_000_000, 16
#: Items with fewer words are held only by a line of their own.
ALONE = 5
#: Units; fixed values.
UNITS = "m cm mm km kg g mg lb lbs oz l ml s sec secs min mins h hr hrs hour hours day days week weeks month months year years percent dollar dollars usd euro euros eur mile miles meter meters metre metres gram grams liter liters litre litres inch inches foot feet".split()
PLAIN = np.ones(256, dtype=bool)
PLAIN[48:58] = False
PLAIN[97:123] = False
PLAIN[128:] = False
UNIT_KEYS = np.array(sorted(word_key(x) for x in UNITS), dtype=np.uint64)
NUMBER, UNIT, NAME, VERBATIM = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1))
STOPS = np.zeros(256, dtype=bool)
STOPS[list(b".!?:\n")] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True


def symbols(blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template symbols and plain hashes of all words, the offsets of each text's words, and the line of each word."""
    text = lowered(blob)
    starts, ends, at = K.words(text, offsets, PLAIN)
    plain = K.words_hash(text, starts, ends)
    if not len(starts):
        return plain, plain, at, starts
    line = np.cumsum(blob == 10)[starts] + np.repeat(np.arange(len(at) - 1), np.diff(at))  # a text's end ends a line
    digits = np.concatenate(([0], np.cumsum(DIGIT[blob])))
    stops = np.concatenate(([0], np.cumsum(STOPS[blob])))
    before = np.concatenate(([0], ends[:-1]))
    begins = stops[starts] > stops[np.minimum(before, starts)]
    begins[at[:-1][at[:-1] < len(starts)]] = True
    out = plain.copy()
    out[(blob[starts] != text[starts]) | ((blob[starts] == 0xC3) & (text[np.minimum(starts + 1, len(text) - 1)] != blob[np.minimum(starts + 1, len(text) - 1)]))] = NAME
    out[begins] = plain[begins]
    out[Grammar.among(plain, UNIT_KEYS)] = UNIT
    out[digits[ends] > digits[starts]] = NUMBER
    return out, plain, at, line


def windows(blob: np.ndarray, offsets: np.ndarray, short: list[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, pos, hash, number of words, verbatim) of windows; offsets, symbols and plain hashes of all words.

    Every window with enough literal words has a row by its symbols, and every window one by its plain words (verbatim).

    pos counts from the first word of all rows.

    short: lengths of the windows besides those of WINDOW words; if None, texts under WINDOW words are one window.
    """
    sym, plain, at, line = symbols(blob, offsets)
    begins, ends = np.append(True, line[1:] != line[:-1]), np.append(line[1:] != line[:-1], True)
    literal = np.concatenate(([0], np.cumsum(sym == plain)))
    n = np.diff(at)
    parts = []
    for k in [WINDOW, *(short or [])]:
        full = np.maximum(n - k + 1, 0)
        own, pos = np.repeat(np.arange(len(n)), full), K.ranges(at[:-1], full)
        if k < ALONE:
            whole = begins[pos] & ends[pos + k - 1] & (line[pos] == line[pos + k - 1])
            own, pos = own[whole], pos[whole]
        parts.append((own, pos, np.full(len(pos), k)))
    if short is None:
        few = np.flatnonzero((n > 0) & (n < WINDOW))
        parts.append((few, at[few], n[few]))
    row, pos, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    enough = literal[pos + size] - literal[pos] >= LITERAL
    verbatim = np.concatenate((np.zeros(int(enough.sum()), dtype=bool), np.ones(len(pos), dtype=bool)))
    exact = K.spans_hash(K.prefix(plain), pos, pos + size) ^ VERBATIM if len(pos) else plain[:0]
    like = K.spans_hash(K.prefix(sym), pos[enough], (pos + size)[enough]) if len(pos) else sym[:0]
    row, pos, size = (np.concatenate((x[enough], x)) for x in (row, pos, size))
    return row, pos, np.concatenate((like, exact)), size, verbatim, at, sym, plain


def lists(values: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(values, kind))


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_pos, hash, n_windows, verbatim, size, slots, item_words) of every window of the benchmark.

    n_windows counts an item's windows of the same kind; only windows by symbols have slots and words.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, blob, offsets in _columns(batch):
                row, pos, h, size, verbatim, at, sym, plain = windows(blob, offsets, None)
                shown = np.where(verbatim, 0, size)
                words = K.ranges(pos, shown)
                total = np.where(verbatim, np.bincount(row[verbatim], minlength=len(ids))[row], np.bincount(row[~verbatim], minlength=len(ids))[row])
                yield rows([pa.array(ids[row], pa.int64()), pa.array(pos - at[row], pa.int64()), pa.array(h.view(np.int64)), pa.array(total, pa.int64()), pa.array(verbatim), pa.array(size, pa.int32()), lists(sym[words] != plain[words], shown, pa.bool_()), lists(plain[words].view(np.int64), shown, pa.int64())], ["item_id", "item_pos", "hash", "n_windows", "verbatim", "size", "slots", "item_words"])

    own = unique_documents(benchmark.select(F.col("item_id").alias("doc_id"), "text"))
    return own.mapInArrow(cut, "item_id bigint, item_pos bigint, hash bigint, n_windows bigint, verbatim boolean, size int, slots array<boolean>, item_words array<bigint>")


def chained(own: int, around: dict[int, dict[int, list[tuple[int, int]]]]) -> dict[int, int]:
    """Places of the item and their diagonal: all of diagonal `own`, and the runs of others that fit in order and agree.

    around: the places on each diagonal and the values (item, document) of their slots.
    """
    taken = dict.fromkeys(around[own], own)
    values = {a: b for x in around[own].values() for a, b in x}
    runs = []
    for g, places in around.items():
        if g != own:
            order = sorted(places)
            cuts = [0, *(k for k in range(1, len(order)) if order[k] != order[k - 1] + 1), len(order)]
            runs += [(a - b, abs(g - own), g, order[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    for *_, g, run in sorted(runs):
        order = sorted(taken)
        fits = []
        for i in run:
            k = bisect_left(order, i)
            free = k == len(order) or order[k] != i
            if free and (k == 0 or order[k - 1] + taken[order[k - 1]] < i + g) and (k == len(order) or order[k] + taken[order[k]] > i + g):
                fits.append(i)
        more: dict[int, int] = {}
        if all(values.get(a, b) == b and more.setdefault(a, b) == b for i in fits for a, b in around[g][i]):
            taken |= dict.fromkeys(fits, g)
            values |= more
    return taken


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as of found() for diagonals that reach SHARE together with others near them."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            around = {s["diagonal"]: {x["item_pos"]: [(v["item_words"], v["words"]) for v in x["pairs"]] for x in s["places"]} for s in r["around"]}
            taken = chained(r["diagonal"], around)
            if len(taken) * 100 >= SHARE * r["n_windows"]:
                at = [i + g for i, g in taken.items()]
                out.append((r["doc_id"], r["item_id"], len(taken), r["n_windows"], min(at), max(at) + WINDOW - 1))
        yield rows([pa.array([x[k] for x in out], pa.int64()) for k in range(6)], ["doc_id", "item_id", "matched", "n_windows", "first_word", "last_word"])


def found(docs: DataFrame, benchmark: DataFrame, most: int = SMALL) -> DataFrame:
    """(doc_id, item_id, matched, n_windows, first_word, last_word) of every item that a document holds."""
    spark = docs.sparkSession
    ship(spark)
    own = written(items(benchmark), "benchmark-windows")
    small = own.count() <= most
    # at most WINDOW - 1 lengths
    short = sorted(r[0] for r in own.select("size").where(F.col("size") < WINDOW).distinct().collect())
    # besides these only hashes of at most `most` windows are collected, and broadcast as one array
    keys = spark.sparkContext.broadcast(np.unique(own.select("hash").distinct().toArrow().column("hash").to_numpy().view(np.uint64))) if small else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, blob, offsets in _columns(batch, K.SEGMENT):
                row, pos, h, size, verbatim, at, _, plain = windows(blob, offsets, short)
                size[verbatim] = 0  # their words are equal
                if keys is not None:
                    row, pos, h, size = (x[hit] for hit in [Grammar.among(h, keys.value)] for x in (row, pos, h, size))
                yield rows([pa.array(ids[row], pa.int64()), pa.array(pos - at[row], pa.int64()), pa.array(h.view(np.int64)), lists(plain[K.ranges(pos, size)].view(np.int64), size, pa.int64())], ["doc_id", "pos", "hash", "words"])

    pairs = F.filter(F.zip_with("slots", F.arrays_zip("item_words", "words"), lambda s, x: F.when(s, x)), lambda x: x.isNotNull())
    hits = unique_documents(docs).mapInArrow(cut, "doc_id bigint, pos bigint, hash bigint, words array<bigint>").join(own, "hash")
    hits = written(hits.select("doc_id", "item_id", "n_windows", "item_pos", "verbatim", "pos", (F.col("pos") + F.col("size") - 1).alias("end"), pairs.alias("pairs")), "benchmark-hits", "doc_id")
    ends = F.min("pos").alias("first_word"), F.max("end").alias("last_word")
    of = lambda kind, x: F.when(F.col("verbatim") == kind, x)
    totals = F.max(of(False, F.col("n_windows"))).alias("n_like"), F.max(of(True, F.col("n_windows"))).alias("n_same")
    slots = F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("slots")
    agree = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda x: x["item_words"])))
    like, same = (F.coalesce(F.col(x) * 100 >= SHARE * F.col(n), F.lit(False)) for x, n in (("like", "n_like"), ("same", "n_same")))
    distinct = lambda kind, name: F.size(F.collect_set(of(kind, F.col("item_pos")))).cast("bigint").alias(name)
    whole = hits.groupBy("doc_id", "item_id").agg(distinct(False, "like"), distinct(True, "same"), *totals, *ends, slots)
    # a place of the item stands once on a diagonal, so these groups are as large as an item at most
    number = lambda kind, name: F.count(of(kind, F.lit(1))).alias(name)
    places = F.collect_list(of(False, F.struct("item_pos", "pairs"))).alias("places")
    single = hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(number(False, "like"), number(True, "same"), *totals, *ends, slots, places)
    out = ["doc_id", "item_id", "matched", "n_windows", "first_word", "last_word"]
    found_in = lambda x: x.where((like | same) & agree).withColumn("matched", F.when(like, F.col("like")).otherwise(F.col("same"))).withColumn("n_windows", F.when(like, F.col("n_like")).otherwise(F.col("n_same"))).select(out)
    passed = written(found_in(whole).union(found_in(single)), "benchmark-found")
    near = Window.partitionBy("doc_id", "item_id").orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    left = single.where(agree & (F.col("like") > 0)).withColumnsRenamed({"like": "matched", "n_like": "n_windows"}).join(passed.select("doc_id", "item_id").distinct(), ["doc_id", "item_id"], "left_anti").select("doc_id", "item_id", "n_windows", "diagonal", "matched", "places")
    left = left.withColumn("total", F.sum("matched").over(near)).withColumn("around", F.collect_list(F.struct("diagonal", "places")).over(near))
    left = left.where((F.col("total") > F.col("matched")) & (F.col("total") * 100 >= SHARE * F.col("n_windows"))).select("doc_id", "item_id", "n_windows", "diagonal", "around")
    every = passed.union(left.mapInArrow(merged, passed.schema).select(out))
    best = F.max(F.struct("matched", (-F.col("first_word")).alias("back"), "last_word", "n_windows")).alias("best")
    return every.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.matched", "best.n_windows", (-F.col("best.back")).alias("first_word"), "best.last_word")


def judged(docs: DataFrame, benchmark: DataFrame, most: int = SMALL) -> DataFrame:
    """(doc_id, contaminated, n_items, items): items is the ascending list of item_ids that the document holds."""
    own = found(docs, benchmark, most).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    ids = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    out = ids.join(own, "doc_id", "left").withColumn("items", F.coalesce("items", F.array().cast("array<bigint>")))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("bigint").alias("n_items"), "items")


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return docs.join(found(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "text", "lang", "source", "n_chars")
