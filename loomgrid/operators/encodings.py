"""The cheapest encoding of a raster's blocks, by the bits that each coding would take in each scan order.

A block's cells are gathered into one row, from runs cut at the blocks' edges or from cells. Batches of blocks are then
squares of numbers: put into four scan orders, the runs of equal codes give the bits of run-length coding, beside those of
one value, plain values and palette indexes, which no order changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomgrid.functions.grid import VARINT_LIMITS, floor_div

#: Scan orders of run-length coding.
ORDERS = ("zigzag", "zigzag_mirror", "zigzag_transpose", "zigzag_transpose_mirror")
#: Bits that a run's palette index takes after the first, by the number of values, and whether the first is written as well.
INDEX_BITS = ((2, 0, False), (3, 1, False), (5, 2, False), (16, 4, True))
#: (order, coding) of the columns of block_costs().
CODINGS = ((None, "one"), (None, "plain"), (None, "palette"), *((o, "runs") for o in ORDERS))
#: Blocks that are squares of numbers at once, by their cells.
BATCH_CELLS = 1 << 20


def scan(order: str, size: int) -> np.ndarray:
    """Row-major cells in the order of a scan."""
    grid = np.arange(size * size).reshape(size, size)
    if "transpose" in order:
        grid = grid.T
    grid = grid.copy()
    back = 0 if "mirror" in order else 1  # the first row that runs backward
    grid[back::2] = grid[back::2, ::-1]
    return grid.ravel()


def bit_lengths(v: np.ndarray) -> np.ndarray:
    """Bits of whole numbers, one at least."""
    v, out = np.maximum(v, 0), np.ones(len(v), np.int64)
    for k in (32, 16, 8, 4, 2, 1):
        high = v >> k > 0
        out += np.where(high, k, 0)
        v = np.where(high, v >> k, v)
    return out


def square_costs(codes: np.ndarray, held: np.ndarray, size: int) -> list[np.ma.MaskedArray]:
    """Bits of CODINGS of blocks, masked where a coding can't hold one. codes, held: (blocks, size * size); cells not held are absent."""
    blocks, whole = len(codes), bool(held.all())
    area, top = held.sum(1), np.where(held, codes, np.iinfo(np.int64).min).max(1)
    filled = codes if whole else np.where(held, codes, top[:, None])
    ordered = np.sort(filled, 1)
    n = 1 + (ordered[:, 1:] != ordered[:, :-1]).sum(1)
    width = bit_lengths(top)
    sub = np.select([n <= 2, n <= 4, n <= 16], [1, 2, 4], 8)
    out = [np.ma.masked_array(width, n > 1), np.ma.masked_array(width * area, np.zeros(blocks, bool)), np.ma.masked_array(n * width + sub * area, n > 256)]
    for order in ORDERS:
        way = scan(order, size)
        line = codes[:, way].ravel()
        owner = np.repeat(np.arange(blocks), size * size)
        if not whole:
            there = held[:, way].ravel()
            line, owner = line[there], owner[there]
        head = np.ones(len(line), bool)
        head[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(head)
        bits = 8 * (1 + np.searchsorted(VARINT_LIMITS, np.diff(np.append(starts, len(line))), "right"))
        runs = np.bincount(owner[starts], minlength=blocks)
        lengths = np.bincount(owner[starts], bits, blocks).astype(np.int64)
        index = np.zeros(blocks, np.int64)
        for most, each, first in reversed(INDEX_BITS):
            index = np.where(n <= most, (runs - (0 if first else 1)) * each, index)
        out.append(np.ma.masked_array(n * width + lengths + index, n > INDEX_BITS[-1][0]))
    return out


def pieces_of_cells(cells: DataFrame, size: int, *keys: str) -> DataFrame:
    """(keys, bx, by, at, n, code): cells by block, at their row-major places."""
    at = F.pmod("y", F.lit(size)) * size + F.pmod("x", F.lit(size))
    return cells.select(*keys, floor_div(F.col("x"), size).alias("bx"), floor_div(F.col("y"), size).alias("by"), at.cast("int").alias("at"), F.lit(1).alias("n"), F.col("code").cast("bigint").alias("code"))


def pieces_of_runs(runs: DataFrame, size: int, *keys: str) -> DataFrame:
    """pieces_of_cells() of runs (keys, y, x0, len, code), which are cut at blocks and not made cells."""
    x1 = F.col("x0") + F.col("len")
    cut = runs.where("len > 0").select(*keys, "y", "x0", x1.alias("x1"), "code", F.explode(F.sequence(floor_div(F.col("x0"), size), floor_div(x1 - 1, size))).alias("bx"))
    a, z = F.greatest("x0", F.col("bx") * size), F.least("x1", (F.col("bx") + 1) * size)
    return cut.select(*keys, "bx", floor_div(F.col("y"), size).alias("by"), (F.pmod("y", F.lit(size)) * size + a - F.col("bx") * size).cast("int").alias("at"), (z - a).cast("int").alias("n"), F.col("code").cast("bigint").alias("code"))


def block_costs(pieces: DataFrame, size: int, *keys: str) -> DataFrame:
    """(keys, bx, by, c0 to c6): a block's bits by CODINGS, null where a coding can't hold it. Blocks are size * size pieces at most."""
    block = [*keys, "bx", "by"]
    grouped = pieces.groupBy(*block).agg(F.collect_list(F.struct("at", "n", "code")).alias("p"))
    grouped = grouped.select(*block, *[F.col(f"p.{c}").alias(c) for c in ("at", "n", "code")])
    fields = [StructField(f"c{k}", LongType()) for k in range(len(CODINGS))]
    schema = StructType([grouped.schema[c] for c in block] + fields)
    area = size * size

    def squares(part: pa.RecordBatch) -> pa.RecordBatch:
        at, n, code = (part.column(c).flatten().to_numpy() for c in ("at", "n", "code"))
        sizes = np.diff(part.column("at").offsets.to_numpy())
        first = np.repeat(np.arange(part.num_rows), sizes) * area + at
        ends = np.cumsum(n)
        cell = np.repeat(first - (ends - n), n) + np.arange(ends[-1])
        codes, held = np.zeros(part.num_rows * area, np.int64), np.zeros(part.num_rows * area, bool)
        codes[cell], held[cell] = np.repeat(code, n), True
        costs = square_costs(codes.reshape(-1, area), held.reshape(-1, area), size)
        columns = [part.column(c) for c in block] + [pa.array(c.data, pa.int64(), mask=np.ma.getmaskarray(c)) for c in costs]
        return pa.RecordBatch.from_arrays(columns, names=[*block, *(f.name for f in fields)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH_CELLS // area)
        for part in parts:
            for k in range(0, part.num_rows, step):
                yield squares(part.slice(k, step))

    return grouped.mapInArrow(run, schema)


def _each(name_none: Column) -> Column:
    """The codings of a row of block_costs() as an array of (bits, coding, order)."""
    named = [F.struct(F.col(f"c{k}").alias("bits"), F.lit(c).alias("coding"), (name_none if o is None else F.lit(o)).alias("order")) for k, (o, c) in enumerate(CODINGS)]
    return F.filter(F.array(*named), lambda c: c["bits"].isNotNull())


def listed(costs: DataFrame, *keys: str) -> DataFrame:
    """(keys, bx, by, order, coding, bits) of every coding that can hold a block; the order is null where none matters."""
    return costs.select(*keys, "bx", "by", F.explode(_each(F.lit(None).cast("string"))).alias("c")).select(*keys, "bx", "by", "c.order", "c.coding", "c.bits")


def least(costs: DataFrame, *keys: str) -> DataFrame:
    """cheapest() of block_costs()."""
    found = costs.select(*keys, "bx", "by", F.array_min(_each(F.lit(""))).alias("b"))
    return found.select(*keys, "bx", "by", F.nullif(F.col("b.order"), F.lit("")).alias("order"), "b.coding", "b.bits")


def codings(cells: DataFrame, size: int, *keys: str) -> DataFrame:
    """listed() of cells (keys, x, y, code)."""
    return listed(block_costs(pieces_of_cells(cells, size, *keys), size, *keys), *keys)


def cheapest(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, bx, by, order, coding, bits): the least bits; of equal ones the coding first by name, then the order."""
    best = F.min(F.struct("bits", "coding", F.coalesce("order", F.lit("")).alias("order")))
    return found.groupBy(*keys, "bx", "by").agg(best.alias("b")).select(*keys, "bx", "by", F.nullif(F.col("b.order"), F.lit("")).alias("order"), "b.coding", "b.bits")
