"""Best-fit packing of documents' tokens into sequences, with large-item matching.

Tokens never move: a piece's length decides its place. Lengths form a histogram of at most `capacity` counts, which is
packed on the driver in runs of equal bins: pieces above a third of the capacity are matched greedily, at most two in a
bin, the largest with the largest that still fits; smaller ones, longest first, go where the least gap remains. Runs of
equal bins stay together, so the plan's rows follow the capacity and not the input. A piece then finds its bin by its
length and its rank among pieces of that length. Ranks are counted in hash buckets of each length, so a length that
holds most pieces is not one task.

Defined results: null or empty text is one piece of the end id; a repeated row has its own pieces; null doc_id stays
null; other columns are dropped, also those named like a result; an empty table gives an empty result. Of pieces of one
length any may lie in any of that length's places. A very long text is encoded whole, in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import gathered, materialize, tidy
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A plan of more rows than this (40 bytes each) is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Ranks of a length that such a join puts together: 2 to this.
RANK_BITS = 16


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of at most capacity; the ids' checksum stands for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for part in gathered(batches):
            ids, offs = enc.encode(part["text"].combine_chunks())
            rows: list[tuple[int, int, int, int]] = []
            for r in range(part.num_rows):
                own = np.append(ids[offs[r] : offs[r + 1]], np.uint32(end_id)).astype("<u4")
                rows += [(r, k, len(own[k : k + capacity]), zlib.crc32(own[k : k + capacity].tobytes())) for k in range(0, len(own), capacity)]
            row, start, length, crc = (np.array(x, np.int64) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].combine_chunks().take(pa.array(row)).cast(pa.int64()), pa.array((start // capacity).astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), PIECES)


class _Stock:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int]):
        self.left = Counter({k: v for k, v in counts.items() if v > 0})
        self.used: Counter[int] = Counter()

    def take(self, length: int, n: int) -> int:
        """The first rank of n pieces of a length."""
        rank = self.used[length]
        self.used[length] += n
        self.left[length] -= n
        return rank


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, pieces, first sequence, offset): piece first + i lies in sequence first + i at offset.

    counts: pieces by length, each between 1 and capacity.
    """
    stock = _Stock(counts)
    third = capacity / 3
    groups: dict[int, list[list]] = {}  # by gap: [number of bins, [(length, first rank)...]], ranks running along the bins
    large = sorted((x for x in stock.left if x > third), reverse=True)

    def put(gap: int, bins: int, slots: list) -> None:
        if bins:
            groups.setdefault(gap, []).append([bins, slots])

    while large:
        top = large[0]
        mate = next((x for x in large if x <= capacity - top and (x != top or stock.left[x] >= 2)), None)
        if mate is None:
            n = stock.left[top]
            put(capacity - top, n, [(top, stock.take(top, n), 1)])
        elif mate == top:
            n = stock.left[top] // 2
            put(capacity - 2 * top, n, [(top, stock.take(top, n), 1), (top, stock.take(top, n), 1)])
        else:
            n = min(stock.left[top], stock.left[mate])
            put(capacity - top - mate, n, [(top, stock.take(top, n), 1), (mate, stock.take(mate, n), 1)])
        large = [x for x in large if stock.left[x] > 0]

    for length in sorted((x for x in stock.left if 0 < x <= third and stock.left[x]), reverse=True):
        while stock.left[length]:
            gap = min((g for g in groups if g >= length), default=None)
            if gap is None:
                fits = capacity // length
                bins = max(1, stock.left[length] // fits)
                put(capacity, bins, [])
                continue
            bins, slots = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
            fits = gap // length
            whole = min(bins, stock.left[length] // fits)
            if whole:
                # the pieces of one length in one bin are fits runs of ranks along the bins
                added = [(length, stock.take(length, whole), 1) for _ in range(fits)]
                put(gap - fits * length, whole, [*slots, *added] if whole == bins else [*[(a, b, c) for a, b, c in slots], *added])
            if whole < bins:
                rest = [(a, b + whole, c) for a, b, c in slots]
                k = stock.left[length]
                if whole and k >= fits or not k:
                    put(gap, bins - whole, rest)
                    continue
                k = min(k, fits)
                added = [(length, stock.take(length, 1), 1) for _ in range(k)]
                put(gap - k * length, 1, [*rest, *added])
                put(gap, bins - whole - 1, [(a, b + 1, c) for a, b, c in rest])

    rows, sequence = [], 0
    for gap in sorted(groups):
        for bins, slots in groups[gap]:
            if not slots:
                continue
            offset = 0
            for length, rank, _ in slots:
                rows.append((length, rank, bins, sequence, offset))
                offset += length
            sequence += bins
    return rows


def pack(pieces: DataFrame, capacity: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pieces with sequence_id and offset. pieces must read from a table (it is read twice) and have a unique key."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rows = plan(counts, capacity)
    slots = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "slot_length long, first_rank long, n long, first_sequence long, offset long")
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), sum(counts.values()) // 1_000_000)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    before = keyed.groupBy("length", "bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    own = keyed.withColumn("own", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("key")) - 1)
    ranked = own.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own"))
    same = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    if len(rows) <= broadcast_rows:
        placed = ranked.join(F.broadcast(slots), same)
    else:  # by length and block of ranks, so that no length is one task
        block = 1 << RANK_BITS
        slots = slots.withColumn("slot_block", F.explode(F.sequence(F.floor(F.col("first_rank") / block), F.floor((F.col("first_rank") + F.col("n") - 1) / block)))) if rows else slots.withColumn("slot_block", F.lit(0).cast("long"))
        placed = ranked.join(slots, same & (F.floor(F.col("rank") / block) == F.col("slot_block")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")


def best_fit_packing(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer, capacity, end_id).withColumn("key", F.monotonically_increasing_id())
    return pack(materialize(pieces, "pieces"), capacity)
