"""Compact exchanges: arrays packed into one blob for each batch and bucket, instead of a JVM row for each item.

A bucket is a range of hash values; their number follows spark.sql.shuffle.partitions, so a bucket's size follows the
session's partition sizing, not the input. Items that repeat within a batch are settled there and spread by batch, so a
key with a third of all rows reaches its bucket once for each batch.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
BUCKETS_PER_PARTITION = 4
#: Largest Arrow batch that goes to a Python worker, and how its C allocator gives memory back: large arrays at once.
BATCH_BYTES = 8 << 20
ALLOCATOR = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed, and keeps them small.

    Arrow batches are held to BATCH_BYTES in the session, as a worker holds one whole and its executor another.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))) if x)
    for name, value in ALLOCATOR.items():
        env.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is set only where the session has none and is local."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    keys: for tables of few bytes a row made by many tasks; dealt by these columns first, they fill few files.
    """
    df = df.repartition(*keys) if keys else df
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of finished steps, which Spark keeps until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def buckets(spark: SparkSession) -> int:
    return BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def unique_documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the columns `more`, one row for each doc_id that isn't null; null text is empty.

    Rows that repeat whole are one document. Different texts under one doc_id are one document too: its texts in
    ascending order, joined by line feeds, with the least value of each further column. Rows without a doc_id can't be
    named in a result and are left out.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
    if docs.select("doc_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs
    return docs.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("text")), "\n").alias("text"), *(F.min(c).alias(c) for c in more))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal or different lengths as one compressed blob, integers by byte planes."""
    parts = []
    for x in arrays:
        x = np.ascontiguousarray(x)
        parts += [struct.pack("<cBI", x.dtype.kind.encode(), x.dtype.itemsize, len(x)), x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() if len(x) else b""]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        kind, width, n = struct.unpack_from("<cBI", data, at)
        at += 6
        out.append(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T.copy().reshape(-1).view(np.dtype(f"{kind.decode()}{width}")) if n else np.zeros(0, np.dtype(f"{kind.decode()}{width}")))
        at += n * width
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x[:1] * 0)


class Sender:
    """Collects items and yields Arrow batches of (bucket, blob)."""

    schema = "bucket int, blob binary"

    def __init__(self, n: int, encode: Callable[..., bytes] = pack, most: int = 1 << 19):
        self.n, self.encode, self.most, self.held, self.size = n, encode, most, [], 0

    def add(self, bucket: np.ndarray, *items: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            self.held.append((bucket, *items))
            self.size += len(bucket)
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            bucket, *items = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held, self.size = [], 0
            order = np.argsort(bucket, kind="stable")
            bucket, items = bucket[order], [x[order] for x in items]
            cut = np.flatnonzero(np.diff(bucket)) + 1
            edges = np.concatenate(([0], cut, [len(bucket)]))
            yield rows([pa.array(bucket[edges[:-1]], pa.int32()), pa.array([self.encode(*(x[a:b] for x in items)) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], ["bucket", "blob"])


def rows(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int32)


def repeated(source: DataFrame, items: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], sent: type = np.uint64) -> DataFrame:
    """(doc_id, pos) of every item whose 64-bit hash occurs at least twice in the whole table.

    items yields arrays (hash, doc_id, pos) from Arrow batches. Only the first of a hash in a batch goes to the hash's
    bucket; the others are known to repeat and go to buckets dealt round robin, marked as such. Where the result is only
    a filter, sent=np.uint32 halves what is shuffled: buckets then compare the low 32 bits, and few other items pass too.
    """
    n = buckets(source.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out() -> Iterator[pa.RecordBatch]:
            h, d, p = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(h, kind="stable")
            same = np.zeros(len(h), dtype=bool)
            s = h[order]
            later = s[1:] == s[:-1]
            same[order[1:]] = later
            many = np.zeros(len(h), dtype=np.uint8)
            many[order[1:]] |= later
            many[order[:-1]] |= later
            bucket = np.where(same, (np.arange(len(h)) >> 12) % n, bucket_of(h, n)).astype(np.int32)
            yield from sender.add(bucket, np.where(same, np.uint64(0), h).astype(sent), d, p.astype(np.uint32), many + same)
            yield from sender.flush()

        sender = Sender(n, lambda h, d, p, m: pack(h, deltas(d), p, m))
        size = 0
        for h, d, p in items(batches):
            held.append((h, d, p))
            size += len(h)
            if size >= sender.most:
                yield from out()
                size = 0
        if held:
            yield from out()

    def settle(table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in table.column("blob")]
        h, p, m = (np.concatenate([x[i] for x in parts]) for i in (0, 2, 3))
        d = np.concatenate([np.cumsum(x[1]) for x in parts])
        keep = m > 0
        ask = np.flatnonzero(m < 2)
        order = ask[np.argsort(h[ask], kind="stable")]
        s = h[order]
        later = s[1:] == s[:-1]
        keep[order[1:]] |= later
        keep[order[:-1]] |= later
        return pa.table([pa.array(d[keep], pa.int64()), pa.array(p[keep].astype(np.int64), pa.int64())], ["doc_id", "pos"])

    return source.mapInArrow(send, Sender.schema).groupBy("bucket").applyInArrow(settle, "doc_id bigint, pos bigint")
