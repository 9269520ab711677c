"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters on doc_id.

Documents are dealt by ranges of doc_id and sorted, so files hold disjoint ascending ranges, stripes can be read in
parallel, and stripe statistics and Bloom filters prune reads of single documents.

Defined results: null text is empty and has the end id alone; equal rows and rows that share a doc_id are one document
(see exchange.unique_documents); an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exchange import rows, shared_dir, ship, unique_documents, written
from .tokens import encoder

END = b"\0\0\0\0"
OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.compress": "LZ4", "orc.stripe.size": str(16 << 20)}


def write(docs: DataFrame, path: str, tokenizer: str, tokens: int = 1 << 20) -> None:
    """(doc_id bigint, ids array<int>) in ascending doc_id order; batches of about `tokens` ids."""
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer)
        for batch in batches:
            held, begin, size = [], 0, 0

            def out(end: int, batch: pa.RecordBatch = batch, held: list = held) -> pa.RecordBatch:
                lengths = np.cumsum([0, *(len(x) // 4 for x in held)])
                lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.frombuffer(b"".join(held), "<i4")))
                return rows([batch.column("doc_id").slice(begin, end - begin), lists], ["doc_id", "ids"])

            for i, text in enumerate(batch.column("text")):
                held.append(ids(text.as_py()) + END)
                size += len(held[-1]) // 4
                if size >= tokens:
                    yield out(i + 1)
                    held.clear()
                    begin, size = i + 1, 0
            if held:
                yield out(batch.num_rows)

    docs = unique_documents(docs)
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(encode, "doc_id bigint, ids array<int>").write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id bigint, ids array<int>").orc(path)


def places(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files. Prefix sums go by file, then within files; only a row for each
    file meets in one place."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            edges = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy())).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield rows([batch.column("doc_id"), batch.column("file"), pa.array(np.diff(edges).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "file", "n_tokens", "ids_crc32"])

    read_back = read(spark, path).select("doc_id", F.col("_metadata.file_name").alias("file"), "ids")
    own = written(read_back.mapInArrow(measure, "doc_id bigint, file string, n_tokens bigint, ids_crc32 bigint"), "token-places")
    files = own.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("first"))
    files = files.select("file", F.coalesce(F.sum("total").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("inside", inside).join(files, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write(docs, path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return places(spark, path)
