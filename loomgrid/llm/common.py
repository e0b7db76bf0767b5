"""Pieces the training-data operators share: table access, shared-folder tables, Arrow text buffers."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgrid.plans.tables import drop_since, input_bytes, made, materialize, new_path  # noqa: F401

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The two characters beyond ASCII whose lower case holds an ASCII letter.
FOLDS_TO_ASCII = ("K", "İ")
#: Documents are handed to numpy in slices of about this many bytes, so a task's memory doesn't follow its input.
SLICE_BYTES = 2 << 20


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: What a Python worker drops when a task ends.
AT_END: list[Callable[[], None]] = []


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives its free memory back: workers outlive tasks, and the next may be another operator's."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for drop in AT_END:
                drop()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Partitions such that each gets about bytes_each of df's input, and no fewer than the session's own count."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(conf, -(-input_bytes(df) // bytes_each))


def bounded_rows(df: DataFrame, most: int, most_bytes: int = 1 << 40, text: str | None = None, stratum: str | None = None) -> list[Row]:
    """Rows of df, chosen and ordered by a hash of all their columns: at most `most`, of at most most_bytes in column text.

    Equal rows count once, so a table of few distinct rows gives each of them. With a stratum, its values take turns, so that
    a rare one has all its rows before a common one has more. What is too long for the bytes that are left is passed
    over. Only hashes and sizes of about `most` rows come to the driver before the rows themselves do.
    """
    hashed = df.withColumn("__h", F.xxhash64(*df.columns))
    size = F.octet_length(text) if text else F.lit(0)
    found = hashed.groupBy("__h").agg(F.max(size).alias("n"), F.min(stratum if stratum else F.lit(0)).alias("s"))
    if stratum:
        # counts by leading bits of the hash tell how far each value's least hashes reach, so that few rows of any are ranked
        found = materialize(found.withColumn("b", F.shiftright("__h", 48)), "hashes")
        counts = found.groupBy("s", "b").agg(F.count(F.lit(1)).alias("c"))
        near = counts.withColumn("to", F.sum("c").over(Window.partitionBy("s").orderBy("b"))).where(F.col("to") - F.col("c") < most).select(F.col("s").alias("ks"), F.col("b").alias("kb"))
        found = found.join(near, F.col("s").eqNullSafe(F.col("ks")) & (F.col("b") == F.col("kb")), "left_semi")
        found = found.withColumn("turn", F.row_number().over(Window.partitionBy("s").orderBy("__h"))).orderBy("turn", "__h")
    else:
        found = found.orderBy("__h")
    left, picked = most_bytes, []
    for r in found.limit(most).collect():
        if (r["n"] or 0) <= left:
            picked.append((r["__h"],))
            left -= r["n"] or 0
    if not picked:
        return []
    # at most `most` numbers
    chosen = hashed.join(F.broadcast(df.sparkSession.createDataFrame(picked, "__h long")), "__h", "left_semi").dropDuplicates(["__h"])
    return sorted(chosen.collect(), key=lambda r: r["__h"])


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row; a lambda would else compute it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case as far as an ASCII word can tell; other letters may change case, but none becomes ASCII."""
    odd = F.contains(text, F.lit(FOLDS_TO_ASCII[0])) | F.contains(text, F.lit(FOLDS_TO_ASCII[1]))
    return F.when(odd, F.translate(text, ASCII_UPPER, ASCII_LOWER)).otherwise(F.lower(text))


def fold(doc_id: Column) -> Column:
    """0 to 3; 2 is held out. A null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)).cast("int")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


#: Words are hashed eight bytes at a time up to this length; a longer one by a digest of its own.
LONG_WORD = 512


def word_hashes(raw: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the rows with A-Z lowered, and n + 1 offsets of the rows among the words.

    inside: by byte, whether it belongs to a word. A word's eight bytes at a time go through a mixing function, its length
    first, so words of like structure have unlike hashes.
    """
    n = len(raw)
    low = np.zeros(n + 8, np.uint8)
    low[:n] = _LOW[raw]
    own = inside[low[:n]]
    begin, stop = own.copy(), own.copy()
    begin[1:] &= ~own[:-1]
    stop[:-1] &= ~own[1:]
    full = np.diff(offs) > 0
    heads, tails = offs[:-1][full], offs[1:][full] - 1
    begin[heads], stop[tails] = own[heads], own[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    size = ends - starts
    eight = np.ndarray((n + 1,), "<u8", low.data, strides=(1,))
    h = mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x517CC1B727220A95))
    who = np.arange(len(size))
    for at in range(0, LONG_WORD, 8):
        part = eight[starts[who] + at] & _FIRST_BYTES[np.minimum(size[who] - at, 8)]
        h[who] = mixed((h[who] ^ part) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0xA0761D6478BD642F))
        who = who[size[who] > at + 8]
        if not len(who):
            break
    for k in who.tolist():
        h[k] = np.frombuffer(hashlib.blake2b(low[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return h, np.searchsorted(starts, offs)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of about `most` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1 if size.sum() > most else np.zeros(0, np.int64)
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def gathered(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Neighbouring batches joined up to about `most` bytes of text, and larger ones cut."""
    held, size = [], 0
    for part in slices(batches, text, most):
        held.append(part)
        size += part.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
