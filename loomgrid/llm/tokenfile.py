"""Token files: Parquet with one list column of ids, in ascending doc_id order.

Files hold doc_id, n_tokens, local_start (ids before the document in its file), shard and ids. Ids are dictionary encoded
and pages small, with page indexes, so a reader takes the numbers without the ids, or the ids of a few documents.
The ids before a document are its file's base and its local start; bases are sums of one number a file.

Defined results: null or empty text is the end id alone; a null doc_id sorts first; a repeated doc_id has a row each
time, one after the other in the table's order; other columns are dropped, also those named like a result; an empty table
writes no rows. A very long text is one row of one file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import gathered, new_path, partitions_for, tidy
from .tokens import encoder

FILE = "doc_id long, shard int, local_start long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0, bytes_each: int = 32 << 20, row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10, page_rows: int = 500) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for part in gathered(batches, most=4 << 20):
            ids, offs = enc.encode(part["text"].combine_chunks())
            n = np.diff(offs) + 1
            ends = np.cumsum(n)
            all_ids = np.insert(ids, offs[1:], np.uint32(end_id)).astype(np.int32)
            starts = before + ends - n
            before += int(ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(all_ids))
            yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks().cast(pa.int64()), pa.array(np.full(len(n), shard, np.int32)), pa.array(starts), pa.array(n), lists], ["doc_id", "shard", "local_start", "n_tokens", "ids"])

    # rows of one id keep the table's order, and many of them are cut into ranges as well
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(partitions_for(docs, bytes_each), "doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")
    out = ordered.mapInArrow(tidy(run), FILE).write.option("compression", "zstd").option("parquet.enable.dictionary", "true").option("parquet.block.size", row_group_bytes)
    out.option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows).option("parquet.dictionary.page.size", 4 << 20).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids; start counts the ids of all documents before."""
    files = spark.read.schema(FILE).parquet(path)
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    # one row a file
    return files.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            offs = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Writes token files and reads them back as token_digests."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_token_files(docs, path, tokenizer, **options)
    return token_digests(read_token_files(spark, path))
