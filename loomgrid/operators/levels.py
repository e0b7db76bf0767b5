"""Coarser rasters: resampling between grids whose units don't divide, and levels each made from the one below."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.grid import floor_div
from loomgrid.plans.tables import materialize


def largest_share(shares: DataFrame, area: int, minimum_rate: float, *keys: str) -> DataFrame:
    """(keys, code) of shares (keys, code, n): the code of most n, the smaller on ties, if n reaches the rate of the area, else 0."""
    best = shares.groupBy(*keys).agg(F.max(F.struct(F.col("n").alias("n"), (-F.col("code")).alias("c"))).alias("b"))
    return best.select(*keys, F.when(F.col("b.n") >= minimum_rate * area, -F.col("b.c")).otherwise(0).cast("bigint").alias("code"))


def resample_area(runs: DataFrame, source: int, target: int, minimum_rate: float, *keys: str) -> DataFrame:
    """(keys, x, y, code) on a grid of `target` cells where the runs' has `source`, for any two: the code of the largest area.

    Both grids are whole numbers of a common finer unit, in which overlaps are exact. A run meets each target cell once, with
    the area that they share: runs aren't made cells.
    """
    if source <= 0 or target <= 0:
        raise ValueError("units must be over 0")
    a, b = target // gcd(source, target), source // gcd(source, target)  # a source cell is a fine units wide, a target cell b
    s = runs.where(F.col("len") > 0).select(*keys, "code", (F.col("x0") * a).alias("xa"), ((F.col("x0") + F.col("len")) * a).alias("xz"), (F.col("y") * a).alias("ya"), ((F.col("y") + 1) * a).alias("yz"))
    for axis in "xy":
        first, last = floor_div(F.col(f"{axis}a"), b), floor_div(F.col(f"{axis}z") - 1, b)
        s = s.withColumn(axis, F.explode(F.sequence(first, last)))
        s = s.withColumn(f"{axis}n", F.least(F.col(f"{axis}z"), (F.col(axis) + 1) * b) - F.greatest(F.col(f"{axis}a"), F.col(axis) * b))
    shares = s.groupBy(*keys, "x", "y", "code").agg(F.sum(F.col("xn") * F.col("yn")).alias("n"))
    return largest_share(shares, b * b, minimum_rate, *keys, "x", "y")


def pyramid(cells: DataFrame, levels: int, minimum_rate: float = 0.5) -> DataFrame:
    """(level, x, y, code) of levels 0 to `levels`; a cell of level k is 2**k cells wide. cells: x, y, code.

    A level holds how much of each cell every code fills, and is summed from the level below, so the finest raster is
    read once and each level costs a quarter of the last. Cells where no code is set are absent.
    """
    shares = materialize(cells.where("code <> 0").select("x", "y", "code", F.lit(1).cast("bigint").alias("n")), "level")
    out = None
    for level in range(levels + 1):
        drawn = largest_share(shares, 4**level, minimum_rate, "x", "y").select(F.lit(level).cast("bigint").alias("level"), "x", "y", "code")
        out = drawn if out is None else out.unionByName(drawn)
        if level < levels:
            shares = materialize(shares.groupBy(floor_div(F.col("x"), 2).alias("x"), floor_div(F.col("y"), 2).alias("y"), "code").agg(F.sum("n").alias("n")), "level")
    return out


def drawn_at(points: DataFrame, drawn: DataFrame, level: str = "level", x: str = "x", y: str = "y") -> DataFrame:
    """points (on the finest grid) with drawn: the code of the cell of their level, 0 where none is set."""
    side = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(level).cast("int"))
    placed = points.withColumn("__x", floor_div(F.col(x), side)).withColumn("__y", floor_div(F.col(y), side))
    cells = drawn.select(F.col("level").alias("__level"), F.col("x").alias("__cx"), F.col("y").alias("__cy"), F.col("code").alias("drawn"))
    j = placed.join(cells, (F.col(level) == F.col("__level")) & (F.col("__x") == F.col("__cx")) & (F.col("__y") == F.col("__cy")), "left")
    return j.withColumn("drawn", F.coalesce("drawn", F.lit(0)).cast("bigint")).drop("__x", "__y", "__level", "__cx", "__cy")
