"""An atlas in files that are clustered by place: a rectangle reads the files of its tiles and skips the others.

Pieces of runs lie in tiles of bucket x bucket cells. A tile's key interleaves the bits of its column and row, so tiles near
each other have near keys: rows are written in the order of keys, and folders are named by the keys' leading bits. A table of
requests prunes folders while the query runs, by the tiles that it meets; one rectangle is a few ranges of keys, which reach
the scan as filters on folders and on the row groups' bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.grid import floor_div
from loomgrid.plans.tables import materialize, partitions_for

from .atlas import Atlas

#: Added to a tile's column and row, so that keys of places west or south of the origin are positive too.
ORIGIN = 1 << 20
#: Steps of spreading the bits of a 32-bit number: (shift, mask).
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def tile_key(column: Column, row: Column) -> Column:
    def spread(v: Column) -> Column:
        for shift, mask in SPREAD:
            v = F.shiftleft(v, shift).bitwiseOR(v).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(spread(row + ORIGIN), 1).bitwiseOR(spread(column + ORIGIN))


def key_of(column: int, row: int) -> int:
    def spread(v: int) -> int:
        return sum((v >> k & 1) << 2 * k for k in range(32))

    return spread(row + ORIGIN) << 1 | spread(column + ORIGIN)


def key_ranges(west: int, south: int, east: int, north: int, most: int = 24) -> list[tuple[int, int]]:
    """Ranges of keys (first, last) that hold the tiles from west to east and south to north, both ends included.

    Squares of tiles that lie inside are a range each, others are cut in four; where that makes too many ranges, those
    with the smallest gaps between them are joined, so a range may hold tiles outside.
    """
    side = 1
    while side < 2 * ORIGIN:
        side *= 2
    found: list[tuple[int, int]] = []
    todo = [(-ORIGIN, -ORIGIN, side)]
    while todo:
        x, y, n = todo.pop()
        if x > east or y > north or x + n - 1 < west or y + n - 1 < south:
            continue
        first = key_of(x, y)
        if west <= x and x + n - 1 <= east and south <= y and y + n - 1 <= north:
            found.append((first, first + n * n - 1))
        else:
            todo += [(x + dx * n // 2, y + dy * n // 2, n // 2) for dx in (0, 1) for dy in (0, 1)]
    found.sort()
    joined: list[tuple[int, int]] = []
    for a, z in found:
        if joined and joined[-1][1] + 1 == a:
            joined[-1] = (joined[-1][0], z)
        else:
            joined.append((a, z))
    while len(joined) > most:
        k = min(range(len(joined) - 1), key=lambda i: joined[i + 1][0] - joined[i][1])
        joined[k : k + 2] = [(joined[k][0], joined[k + 1][1])]
    return joined


def write_clustered(atlas: Atlas, path: str, *, group: int = 2, files: int | None = None) -> None:
    """The atlas's runs as a table of pieces; a folder holds squares of 2**group tiles a side."""
    n = atlas.bucket
    pieces = atlas.global_runs().withColumn("z", tile_key(F.col("b"), floor_div(F.col("y"), n)))
    files = files or partitions_for(atlas.runs)
    ordered = pieces.withColumn("zp", F.shiftright("z", 2 * group)).repartitionByRange(files, "zp", "z", "map_ord", "y").sortWithinPartitions("zp", "z", "map_ord", "y", "x0")
    ordered.write.partitionBy("zp").option("compression", "zstd").parquet(path)


@dataclass(frozen=True)
class ClusteredAtlas(Atlas):
    """An atlas whose runs are read from a clustered table (write_clustered, with the same group)."""

    path: str = ""
    group: int = 2

    def stored(self) -> DataFrame:
        spark = self.maps.sparkSession
        return spark.read.schema("map_ord long, y long, b long, x0 long, x1 long, code long, z long, zp long").parquet(self.path)

    def global_runs(self, maps: DataFrame | None = None) -> DataFrame:
        found = self.stored().drop("z", "zp")
        return found if maps is None else found.join(maps.select("map_ord"), "map_ord", "left_semi")

    def tiles(self, rects: DataFrame) -> DataFrame:
        """(z, zp) of the tiles that rectangles meet, written: the scan is pruned by its values."""
        n = self.bucket
        some = rects.where((F.col("w") > 0) & (F.col("h") > 0))
        columns = some.select("y", "h", F.explode(F.sequence(floor_div(F.col("x"), n), floor_div(F.col("x") + F.col("w") - 1, n))).alias("c"))
        met = columns.select("c", F.explode(F.sequence(floor_div(F.col("y"), n), floor_div(F.col("y") + F.col("h") - 1, n))).alias("r")).distinct()
        return materialize(met.select(tile_key(F.col("c"), F.col("r")).alias("z")).withColumn("zp", F.shiftright("z", 2 * self.group)), "tiles")

    def pieces_for(self, rects: DataFrame) -> DataFrame:
        # the filter lets Spark take the tiles for a selective side, whose values prune the folders
        return self.stored().join(self.tiles(rects).where("z >= 0"), ["zp", "z"]).drop("z", "zp")

    def pieces_in(self, x: int, y: int, w: int, h: int) -> DataFrame:
        """Pieces of the tiles that one rectangle meets, by ranges of keys."""
        n, shift = self.bucket, 2 * self.group
        if w <= 0 or h <= 0:
            return self.stored().drop("z", "zp").where(F.lit(False))
        keep = F.lit(False)
        for a, z in key_ranges(x // n, y // n, (x + w - 1) // n, (y + h - 1) // n):
            keep = keep | (F.col("zp").between(a >> shift, z >> shift) & F.col("z").between(a, z))
        cut = (F.col("x0") < x + w) & (F.col("x1") > x) & (F.col("y") >= y) & (F.col("y") < y + h)
        return self.stored().where(keep).where(cut).drop("z", "zp")
