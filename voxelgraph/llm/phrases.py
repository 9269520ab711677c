"""Phrases of two to four words that stand together more often than their parts explain, for each language.

Counts come from suffix arrays of word ids. A shard (at most SHARD words of a task's texts) numbers its words, sorts its suffixes
by numpy prefix doubling (words, then pairs, then four words: no phrase is longer) and takes the common prefixes of neighbouring
suffixes; every LCP interval at depth d is a phrase of d words with its count in the shard. Shards are merged by key, so a phrase
reaches its bucket once for each shard however often it stands there, and no key is hot.

1. Words are counted by their own text; a word's key in later passes is a 64-bit hash of language and word. The whole vocabulary
   is looked through for two words with one key; if there are any, all is done again with the next hash function, so keys are
   exact.
2. Shards send a 64-bit hash and a count for each phrase, some five bytes; the sums of two phrases with one hash can only be too
   large. Hashes with LEAST or more set two bits each in a bitmap of fixed size (16 MB), the one thing that is broadcast.
3. Shards send the words' keys of those phrases that the bitmap lets through (all frequent ones, and fewer others the emptier the
   bitmap is), and these are counted exactly.

Frequent phrases are a table of rows from here on: parts are looked up by joins on their keys, the lowest cut is a minimum, phrases
inside a longer one are found by exploding the longer. Products are decimals of 38 digits, exact for any count of 64 bits.

Defined results: null and empty texts have no words; rows without a doc_id are left out, rows that repeat a doc_id are one
document (exchange.unique_documents), with the least of its languages; a null language is `und`, with the rows of that name; an
empty table, or one without a phrase of LEAST occurrences, gives an empty result; ties of score and count are settled by the
phrase's bytes; very long words are words; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .exchange import Sender, bucket_of, buckets, deltas, pack, release, rows, ship, unique_documents, unpack, written

#: The feature's own numbers: occurrences, words of a phrase, the share of a phrase inside a longer one, rows of a language.
LEAST, LONGEST, WITHIN, TOP = 30, 4, 80, 2000
#: Words whose suffixes are sorted at a time, bits of the bitmap, parts of a language's ranking that are cut to TOP first.
SHARD, BITS, PARTS = 1 << 20, 1 << 27, 64
ENDS = kernels.SPACES.copy()
ENDS[[ord(c) for c in ".,;:!?"]] = True
BREAKS = ENDS.copy()
BREAKS[[0x20, 0x09]] = False


def hashing(seed: int) -> np.ndarray:
    """Values of bytes for the hash function of this number."""
    return np.random.default_rng(seed).integers(1, 2**63 - 1, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shards(batches: Iterator[pa.RecordBatch], values: np.ndarray, size: int = SHARD) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each shard: the batch's lower-case bytes, begins and ends of the words, row of each, key of each (language and word), words
    left in its piece (itself included), and which words begin phrases of this shard (the others only end them)."""
    for batch in batches:
        names = batch.column("lang").to_pylist()
        seeds = {x: kernels.words_hash(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x.encode())]), values)[0] if x else np.uint64(0) for x in set(names)}
        blob, offsets = kernels.texts(batch.column("text"))
        for i, j in kernels.groups_of(offsets, 8 * SHARD):
            low = kernels.LOWER[blob[offsets[i] : offsets[j]]]
            starts, ends, own = kernels.words(low, offsets[i : j + 1] - offsets[i], ENDS)
            if not len(starts):
                continue
            row = np.repeat(np.arange(i, j), np.diff(own))
            piece = np.cumsum(BREAKS[low], dtype=np.int64)[starts]
            key = kernels.mix(kernels.words_hash(low, starts, ends, values) ^ kernels.mix(np.array([seeds[x] for x in names[i:j]], np.uint64))[row - i])
            last = np.flatnonzero(np.append((piece[1:] != piece[:-1]) | (row[1:] != row[:-1]), True))
            left = np.minimum(last[np.searchsorted(last, np.arange(len(starts)))] - np.arange(len(starts)) + 1, LONGEST)
            for a in range(0, len(starts), size):
                b = min(a + size, len(starts))
                c = min(b + LONGEST - 1, len(starts))
                yield batch, low, starts[a:c], ends[a:c], row[a:c], key[a:c], left[a:c], np.arange(c - a) < b - a


def intervals(key: np.ndarray, left: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length d > 1: d, where a phrase of d words begins (one place for each phrase), and how often it stands.

    Suffixes end with their piece, at most LONGEST words on; they are ranked by one word, then two, then four (prefix doubling).
    """
    n = len(key)
    vocabulary, word = np.unique(key, return_inverse=True)
    word = np.append(word + 1, np.zeros(LONGEST, np.int64))  # 0 stands beyond the end and sorts first
    after = lambda rank, k: np.where(left > k, rank[k : k + n], 0)
    pair = word[:n] * (len(vocabulary) + 1) + after(word, 1)
    ranks, two = np.unique(pair, return_inverse=True)
    two = np.append(two + 1, np.zeros(LONGEST, np.int64))
    four = (two[:n] * (len(ranks) + 1) + after(two, 2))[first]
    order = np.flatnonzero(first)[np.argsort(four, kind="stable")]
    common = np.zeros(len(order), np.int64)  # words that a suffix shares with the one before it
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    for k in range(LONGEST):
        own = np.where(left[order] > k, word[order + k], 0)
        same &= (own[1:] == own[:-1]) & (own[1:] > 0)
        common[1:] += same
    for d in range(2, LONGEST + 1):
        begin = np.flatnonzero(common < d)
        count = np.diff(np.append(begin, len(order)))
        whole = left[order[begin]] >= d  # a suffix shorter than d shares d words with none, and stands alone
        yield d, order[begin[whole]], count[whole]


def phrase_hash(key: np.ndarray, at: np.ndarray, d: int) -> np.ndarray:
    out = np.full(len(at), d, np.uint64)
    for k in range(d):
        out = kernels.mix(out * np.uint64(kernels.BASE) + key[at + k])
    return out


def vocabulary(docs: DataFrame, values: np.ndarray) -> DataFrame:
    """(lang, word, key, f) of every word; a shard's words are counted before they are sent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, low, starts, ends, row, key, _, first in shards(batches, values):
            own, at, n = np.unique(key[first], return_index=True, return_counts=True)
            names = batch.column("lang")
            yield rows([names.take(pa.array(row[at])), pa.array([low[a:b].tobytes() for a, b in zip(starts[at], ends[at], strict=True)], pa.binary()).cast(pa.string()), pa.array(own.view(np.int64)), pa.array(n)], ["lang", "word", "key", "n"])

    return docs.mapInArrow(count, "lang string, word string, key bigint, n bigint").groupBy("lang", "word", "key").agg(F.sum("n").alias("f"))


def bitmap_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(BITS - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(BITS - 1)).astype(np.int64)


def frequent_bitmap(docs: DataFrame, values: np.ndarray) -> Broadcast:
    """A bitmap in which both bits of every phrase that stands LEAST times or more are set."""
    spark = docs.sparkSession
    n = buckets(spark)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, key, left, first in shards(batches, values):
            sender = Sender(n, lambda h, c: pack(deltas(h), c))
            found = [(phrase_hash(key, at, d), c) for d, at, c in intervals(key, left, first)]
            h, c = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h)
            h, c = h[order], c[order].astype(np.uint32)
            yield from sender.add(bucket_of(h, n), h, c)
            yield from sender.flush()

    def settle(table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in table.column("blob")]
        h = np.concatenate([np.cumsum(x[0]) for x in parts])
        c = np.concatenate([x[1] for x in parts])
        order = np.argsort(h)
        h, c = h[order], c[order].astype(np.int64)
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        h = h[begin][np.add.reduceat(c, begin) >= LEAST] if len(begin) else h
        slots = np.unique(np.concatenate(bitmap_places(h)))
        return pa.table([slots >> 6, slots & 63], ["word", "bit"])

    slots = docs.mapInArrow(send, Sender.schema).groupBy("bucket").applyInArrow(settle, "word bigint, bit bigint")
    words = slots.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, CAST(bit AS INT)))").alias("bits")).toArrow()  # BITS / 64 rows at most
    bits = np.zeros(BITS // 64, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(bits)


def phrases(docs: DataFrame, values: np.ndarray) -> DataFrame:
    """(keys, f) of every phrase of 2 to LONGEST words that stands LEAST times or more; keys: its words'."""
    n = buckets(docs.sparkSession)
    frequent = frequent_bitmap(docs, values)
    release(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = frequent.value
        for *_, key, left, first in shards(batches, values):
            sender = Sender(n)
            for d, at, c in intervals(key, left, first):
                h = phrase_hash(key, at, d)
                ok = np.all([bits[x >> 6] >> (x & 63).astype(np.uint64) & np.uint64(1) for x in bitmap_places(h)], axis=0)
                h, at, c = h[ok], at[ok], c[ok]
                padded = [key[at + k] if k < d else np.zeros(len(at), np.uint64) for k in range(LONGEST)]
                yield from sender.add(bucket_of(h, n), *padded, np.full(len(at), d, np.uint8), c.astype(np.uint32))
            yield from sender.flush()

    def settle(table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in table.column("blob")]
        *key, d, c = (np.concatenate([x[i] for x in parts]) for i in range(LONGEST + 2))
        order = np.lexsort((*key[::-1], d))
        key, d, c = [k[order] for k in key], d[order], c[order].astype(np.int64)
        begin = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in (d, *key)], axis=0)))
        f = np.add.reduceat(c, begin)
        begin, f = begin[f >= LEAST], f[f >= LEAST]
        length = d[begin].astype(np.int64)
        flat = np.stack([k[begin] for k in key], axis=1).view(np.int64)[np.arange(LONGEST) < length[:, None]]
        return pa.table([pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(flat)), pa.array(f)], ["keys", "f"])

    return docs.mapInArrow(send, Sender.schema).groupBy("bucket").applyInArrow(settle, "keys array<bigint>, f bigint")


def exact(column: str):
    return F.col(column).cast("decimal(20,0)")


def lowest_cuts(found: DataFrame, words: DataFrame) -> DataFrame:
    """(keys, a, score, l, r) of each phrase (keys, f) at its lowest cut; words: (key, f) of single words."""
    parts = found.unionByName(words.select(F.array("key").alias("keys"), "f"))
    cut = found.select("keys", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("keys") - 1)).alias("k"))
    cut = cut.withColumns({"head": F.slice("keys", 1, F.col("k")), "tail": F.slice("keys", F.col("k") + 1, F.lit(LONGEST))})
    cut = cut.join(parts.select(F.col("keys").alias("head"), F.col("f").alias("l")), "head").join(parts.select(F.col("keys").alias("tail"), F.col("f").alias("r")), "tail")
    both = cut.withColumns({"product": (exact("a") * F.lit(2_000_000)).cast("decimal(38,0)"), "sum": (exact("l") + exact("r")).cast("decimal(38,0)")})
    best = both.withColumn("score", F.expr("product div sum")).groupBy("keys", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("keys", "a", "b.score", "b.l", "b.r")


def outer(found: DataFrame) -> DataFrame:
    """(keys, longer): the largest count of a longer phrase around each phrase of two words or more."""
    parts = lambda d: F.transform(F.sequence(F.lit(1), F.size("keys") - d + 1), lambda i: F.slice("keys", i, F.lit(d)))
    inner = [F.when(F.size("keys") > d, parts(d)).otherwise(F.array().cast("array<array<bigint>>")) for d in range(2, LONGEST)]
    return found.where(F.size("keys") > 2).select(F.explode(F.concat(*inner)).alias("keys"), "f").groupBy("keys").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first TOP phrases of each language."""
    spark = docs.sparkSession
    ship(spark)
    docs = unique_documents(docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")), "lang").select("text", "lang")
    seed = 0
    while True:
        values = hashing(seed)
        words = written(vocabulary(docs, values), "vocabulary")
        if words.groupBy("key").count().where("count > 1").isEmpty():
            break
        seed += 1
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = words.where(F.col("f") >= LEAST)
    found = written(phrases(docs, values), "phrases")
    kept = lowest_cuts(found, known.select("key", "f")).join(outer(found), "keys", "left")
    kept = kept.where(f"longer IS NULL OR CAST(longer AS DECIMAL(20,0)) * 100 < CAST(a AS DECIMAL(20,0)) * {WITHIN}")
    kept = kept.withColumn("of", F.get("keys", F.lit(0))).join(known.select(F.col("key").alias("of"), "lang"), "of")
    # what can't be among the first TOP of its language goes before words are looked up; ties of score and count stay
    order = [F.col("score").desc(), F.col("a").desc()]
    part = F.pmod(F.xxhash64("keys"), F.lit(PARTS))
    early = kept.withColumn("part", part).withColumn("place", F.rank().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= TOP)
    early = written(early.select("lang", "keys", "a", "score", "l", "r"), "collocations")
    spelt = early.select("*", F.posexplode("keys").alias("at", "key")).join(known.select("key", "word"), "key")
    spelt = spelt.groupBy("lang", "keys", "a", "score", "l", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = spelt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("bigint")).where(F.col("rank") <= TOP)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows by listing every phrase.
SQL = r"""
WITH pieces AS (SELECT row_number() OVER () AS piece, coalesce(lang, 'und') AS lang, p
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
words AS MATERIALIZED (SELECT piece, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT piece, lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces)),
more AS (SELECT lang, w AS w1, lead(w, 1) OVER q AS w2, lead(w, 2) OVER q AS w3, lead(w, 3) OVER q AS w4 FROM words WINDOW q AS (PARTITION BY piece ORDER BY i)),
f AS MATERIALIZED (SELECT lang, 1 AS d, w1 AS p, count(*) AS f, [w1] AS g FROM more GROUP BY lang, w1 HAVING count(*) >= 30
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*), [w1, w2] FROM more WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 30
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*), [w1, w2, w3] FROM more WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*), [w1, w2, w3, w4] FROM more WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
cut AS (SELECT lang, p, d, f, k, array_to_string(g[1:k], ' ') AS head, array_to_string(g[k + 1:d], ' ') AS tail FROM f, range(1, 4) AS q(k) WHERE k < d),
cuts AS (SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score FROM cut c JOIN f x ON x.lang = c.lang AND x.p = c.head JOIN f y ON y.lang = c.lang AND y.p = c.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
around AS (SELECT lang, p, max(f) AS longer FROM (SELECT lang, f, array_to_string(g[i:i + m - 1], ' ') AS p FROM f, range(2, 4) AS a(m), range(1, 4) AS b(i) WHERE m < d AND i + m - 1 <= d) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.p = b.p WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
