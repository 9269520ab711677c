"""Substring deduplication on words by relative Lempel-Ziv parsing.

Every document is factored against the text that stands earlier (smaller doc_id, or earlier in it). The reference
is indexed in blocks, one for each bucket of minimiser hashes; a block holds records (the phrases of `window` words around one
minimiser) and knows the earliest place of each phrase, the seeds. A document's records are parsed greedily against each block
that they fall in: a factor starts at the first phrase with an earlier place and is extended word by word while the source
goes on alike; the parse then jumps to its end, where the phrase that straddles the boundary is looked up next, so no
repeated phrase is lost between two factors. Factors have `window` words at least and are the duplicate spans. Before records
are sent to the blocks each task parses its own against each other, and only those with a phrase's first place are sent.

Defined results: null or empty text has no words, no factors; texts under `window` words have no factors; equal rows
and rows that share a doc_id are one document (see exchange.unique_documents); an empty table gives an empty table;
further columns are ignored. Words are `[^\\x20\\x09-\\x0D]+`, compared by 64-bit hashes of minimiser and phrase (128
bits together).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .exchange import Sender, bucket_of, buckets, deltas, pack, repeated, rows, ship, unique_documents, unpack

#: Phrases that a task parses at a time, against each other, before the others' blocks.
PARSED = 1 << 18
LISTS = "doc_id bigint, start array<bigint>, phrases array<bigint>, source_doc array<bigint>, source_start array<bigint>"


def _columns(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch: rows, doc ids, bytes and offsets."""
    if batch.num_rows:
        _, offsets = K.texts(batch.column("text"))
        for i, j in K.groups_of(offsets, most):
            part = batch.slice(i, j - i)
            blob, own = K.texts(part.column("text"))
            yield part, part.column("doc_id").to_numpy(), blob, own


def word_anchors(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[tuple]:
    """For each part: rows, doc ids, bytes, word starts, ends, offsets of words, word hashes, minimisers and their row."""
    for batch in batches:
        for part, ids, blob, offsets in _columns(batch):
            starts, ends, at = K.words(blob, offsets)
            values = K.words_hash(blob, starts, ends)
            found = K.minimisers(values, at, window, k)
            yield part, ids, values, at, found, np.searchsorted(at, found[0], side="right") - 1


def _first(key: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items in ascending place: the index of the first with the same key and head, for each."""
    order = np.argsort(key ^ K.mix(head), kind="stable")
    k, h = key[order], head[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    first = np.empty(len(key), dtype=np.int64)
    first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else 0
    return first


def _factor(doc: np.ndarray, lo: np.ndarray, n: np.ndarray, head: np.ndarray, phrase: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Greedy factors of records in ascending place; also which records hold the first place of any phrase.

    A record is a run of n phrases from word lo of doc, all with the minimiser hash head. All records are parsed side by
    side, a factor of each at a time: literals are passed over up to the next phrase with an earlier place, the factor that
    starts there is extended while the source goes on alike, and the parse goes on with the phrase that straddles its end.
    """
    of = np.repeat(np.arange(len(doc)), n)
    pos = K.ranges(lo, n)
    first = _first(phrase, head[of])
    own = first == np.arange(len(first))
    stop = np.cumsum(n)
    following = np.minimum.accumulate(np.where(own, len(own), np.arange(len(own)))[::-1])[::-1]
    at, record = stop - n, np.arange(len(doc))
    begins, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at):
        at = following[at]
        some = at < stop[record]
        at, record = at[some], record[some]
        source, size, grows = first[at], np.ones(len(at), np.int64), np.arange(len(at))
        ends, limit = stop[record], stop[of[source]]
        while len(grows):
            here, there = (at + size)[grows], (source + size)[grows]
            grows, here, there = (x[(here < ends[grows]) & (there < limit[grows])] for x in (grows, here, there))
            grows = grows[phrase[here] == phrase[there]]
            size[grows] += 1
        begins.append(at)
        lengths.append(size)
        at = at + size
        some = at < ends
        at, record = at[some], record[some]
    at, length = np.concatenate(begins), np.concatenate(lengths)
    order = np.argsort(at)
    at, length = at[order], length[order]
    found = [doc[of[at]], pos[at], doc[of[first[at]]], pos[first[at]]]
    needed = np.zeros(len(doc), dtype=bool)
    needed[of[own]] = True
    # a factor that goes on in the next record from where its source goes on
    new = np.ones(len(at), dtype=bool)
    if len(at) > 1:
        d, s, sd, sp = found
        new[1:] = (d[1:] != d[:-1]) | (sd[1:] != sd[:-1]) | (s[1:] != s[:-1] + length[:-1]) | (sp[1:] != sp[:-1] + length[:-1])
    begin = np.flatnonzero(new)
    d, s, sd, sp = (x[begin] for x in found)
    return [d, s, np.add.reduceat(length, begin) if len(begin) else length, sd, sp], needed


def factor_lists(docs: DataFrame, window: int = 20) -> DataFrame:
    """Factors of a document from one block as lists (see factors); a document has a row for each block it has factors in,
    and all that its own task has found are in one."""
    spark = docs.sparkSession
    ship(spark)
    k, n = max(window // 2, 1), buckets(spark)

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for _, ids, _, at, (anchor, _, _, h), row in word_anchors(batches, window, k):
            yield h, ids[row], anchor - at[row]

    def encode(kind: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, e: np.ndarray, *phrases: np.ndarray) -> bytes:
        return pack(kind, deltas(a), b, c, deltas(d), e, np.concatenate(phrases[0]) if len(phrases[0]) else np.zeros(0, np.uint64))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(n, encode, most=1 << 17)
        held: list[tuple] = []
        size = 0

        def parse() -> Iterator[pa.RecordBatch]:
            doc, lo, count, head, phrase = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            edges = np.cumsum(count) - count
            order = np.lexsort((lo, doc))
            phrase = phrase[K.ranges(edges[order], count[order])]
            doc, lo, count, head = doc[order], lo[order], count[order], head[order]
            f, needed = _factor(doc, lo, count, head, phrase)
            z = np.empty(len(f[0]), dtype=object)
            z[:] = [phrase[:0]] * len(z)
            yield from sender.add(bucket_of(K.mix(f[0].astype(np.uint64)), n), np.zeros(len(f[0]), np.uint8), *f, z)
            edges = np.concatenate(([0], np.cumsum(count)))
            some = np.flatnonzero(needed)
            z = np.empty(len(some), dtype=object)
            for i, r in enumerate(some):
                z[i] = phrase[edges[r] : edges[r + 1]]
            yield from sender.add(bucket_of(head[some], n), np.ones(len(some), np.uint8), doc[some], lo[some], count[some], head[some].view(np.int64), np.zeros(len(some), np.int64), z)
            yield from sender.flush()

        for part, ids, values, at, (anchor, first, last, h), row in word_anchors(batches, window, k):
            where = part.column("pos")
            pos = where.flatten().to_numpy()
            owner = np.repeat(np.arange(len(ids)), np.diff(where.offsets.to_numpy()))
            width = int(at[-1]) + 1
            keep = np.isin(row * width + anchor - at[row], owner * width + pos)
            first, last, h, row = first[keep], last[keep], h[keep], row[keep]
            if not len(first):
                continue
            count = last - first + 1
            starts = K.ranges(first, count)
            phrase = np.empty(len(starts), np.uint64)
            order = np.argsort(starts)
            for x in range(0, len(order), K.SEGMENT):  # ascending, so each step needs the prefix of a stretch of words only
                s = starts[order[x : x + K.SEGMENT]]
                phrase[order[x : x + K.SEGMENT]] = K.spans_hash(K.prefix(values[s[0] : s[-1] + window]), s - s[0], s - s[0] + window)
            held.append((ids[row], first - at[row], count, h, phrase))
            size += len(phrase)
            if size >= PARSED:
                yield from parse()
                size = 0
        if held:
            yield from parse()

    def settle(table: pa.Table) -> pa.Table:
        kinds, cols, phrases = [], [[] for _ in range(5)], []
        for x in table.column("blob"):
            kind, a, b, c, d, e, p = unpack(x.as_py())
            kinds.append(kind)
            for held, y in zip(cols, (np.cumsum(a), b, c, np.cumsum(d), e), strict=True):
                held.append(y)
            phrases.append(p)
        kind, phrase = np.concatenate(kinds), np.concatenate(phrases)
        cols = [np.concatenate(x) for x in cols]
        known = [x[kind == 0] for x in cols]
        doc, lo, count, head = (x[kind == 1] for x in cols[:4])
        order = np.lexsort((lo, doc))
        edges = np.concatenate(([0], np.cumsum(count)))[:-1]
        phrase = phrase[K.ranges(edges[order], count[order])]
        f, _ = _factor(doc[order], lo[order], count[order], head[order].view(np.uint64), phrase)
        doc, *more = (np.concatenate(x) for x in zip(known, f, strict=True))
        order = np.argsort(doc, kind="stable")
        begin = np.flatnonzero(np.append(True, np.diff(doc[order]) != 0)) if len(doc) else order
        edges = pa.array(np.append(begin, len(doc)), pa.int32())
        return pa.table([pa.array(doc[order][begin], pa.int64()), *(pa.ListArray.from_arrays(edges, pa.array(x[order], pa.int64())) for x in more)], [x.split()[0] for x in LISTS.split(", ")])

    docs = unique_documents(docs)
    marked = repeated(docs, items).groupBy("doc_id").agg(F.collect_list("pos").alias("pos"))
    return docs.join(marked, "doc_id").mapInArrow(send, Sender.schema).groupBy("bucket").applyInArrow(settle, LISTS)


def factors(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, start, phrases, source_doc, source_start): words start .. start + phrases + window - 2 of doc_id occur
    from source_start in source_doc, the earliest place of the first phrase in them."""
    names = [x.split()[0] for x in LISTS.split(", ")]
    return factor_lists(docs, window).select("doc_id", F.inline(F.arrays_zip(*names[1:]))).toDF(*names)


def _spans(listed: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    own = listed.slice(row, 1).flatten()
    return own.field("start").to_numpy(), own.field("phrases").to_numpy()


def dedup(docs: DataFrame, window: int = 20, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256, text) and the columns `more`: documents without duplicate spans.

    text keeps what stands between the kept words, but for the white space after a removed word. Spans are judged on
    the input, not on what is left.
    """
    docs = unique_documents(docs, *more)
    found = factor_lists(docs.select("doc_id", "text"), window).groupBy("doc_id").agg(F.flatten(F.collect_list(F.arrays_zip("start", "phrases"))).alias("spans"))
    names = ["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256", "text", *more]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids, blob, offsets in _columns(batch):
                starts, ends, at = K.words(blob, offsets)
                listed = part.column("spans")
                out: list[list] = [[] for _ in range(5)]
                data = blob.tobytes()
                for r in range(part.num_rows):
                    a, b = int(at[r]), int(at[r + 1])
                    gone, gaps = np.zeros(b - a, dtype=bool), 0
                    if listed[r].is_valid:
                        s, m = _spans(listed, r)
                        edge = np.zeros(b - a + 1, dtype=np.int64)
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + m + window - 1, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        gaps = len(K.runs(gone)[0])
                    lo, hi = int(offsets[r]), int(offsets[r + 1])
                    kept = np.flatnonzero(~gone) + a
                    digest = hashlib.sha256()
                    for i in range(0, len(kept), K.SEGMENT):
                        own = kept[i : i + K.SEGMENT]
                        digest.update(b" " * (i > 0) + b" ".join([data[s:e] for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]))
                    if gaps:
                        x, y = K.runs(gone)
                        edges = np.append(starts[a:b], hi)
                        cuts = np.concatenate(([lo], np.stack([edges[x], edges[y]], axis=1).ravel(), [hi])).tolist()
                        text = b"".join(data[s:e] for s, e in zip(cuts[::2], cuts[1::2], strict=True))
                    else:
                        text = data[lo:hi]
                    for held, v in zip(out, (b - a, int(gone.sum()), gaps, digest.hexdigest(), text.decode()), strict=True):
                        held.append(v)
                yield rows([pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.string()), *(part.column(c) for c in more)], names)

    kinds = ["bigint"] * 4 + ["string"] * 2 + [docs.schema[c].dataType.simpleString() for c in more]
    return docs.join(found, "doc_id", "left").mapInArrow(finish, ", ".join(f"`{c}` {t}" for c, t in zip(names, kinds, strict=True)))


def digest(docs: DataFrame, window: int = 20) -> DataFrame:
    return dedup(docs, window).select("doc_id", "n_words", "n_removed", "kept_sha256")


def stage(docs: DataFrame, window: int = 50) -> DataFrame:
    """Documents with their duplicate spans cut out; a document left without words goes. lang and source stay."""
    kept = dedup(docs, window, ("lang", "source")).where("n_words = 0 OR n_removed < n_words")
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


#: n_repeated words by brute force in SQL: for small inputs (windows as whole strings).
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
q AS (SELECT doc_id, i, hash(array_to_string(w[i:i+19], ' ')) AS h, md5_number(array_to_string(w[i:i+19], ' ')) AS m FROM p),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS r FROM q),
g AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS i FROM f WHERE r > 1),
e AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
o AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN e USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM o
"""
