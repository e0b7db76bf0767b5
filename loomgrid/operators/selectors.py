"""What part of an atlas to draw: a rectangle at a point, one between coordinates, or all of it."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.grid import anchored, to_grid

from .atlas import Atlas


@dataclass(frozen=True)
class Selection:
    """cells: x and y from the rectangle's south-west corner, code; width and height of the rectangle."""

    cells: DataFrame
    width: int
    height: int


class Selector(Protocol):
    def rect(self, atlas: Atlas) -> DataFrame:
        """One row: x, y, w, h on the atlas's grid."""
        ...


def _one(atlas: Atlas) -> DataFrame:
    return atlas.maps.sparkSession.range(1)


@dataclass(frozen=True)
class PointRect:
    """w x h cells at a cell of the grid, which anchor tells the place of in them."""

    x: int
    y: int
    w: int
    h: int
    anchor: str = "SOUTHWEST"

    def rect(self, atlas: Atlas) -> DataFrame:
        size = F.lit(self.w).cast("bigint"), F.lit(self.h).cast("bigint")
        at = anchored(F.lit(self.x).cast("bigint"), F.lit(self.y).cast("bigint"), *size, F.lit(self.anchor))
        return _one(atlas).select(at.alias("p"), size[0].alias("w"), size[1].alias("h")).select("p.x", "p.y", "w", "h")


@dataclass(frozen=True)
class LonLatPointRect:
    """w x h cells at a coordinate."""

    lon: float
    lat: float
    w: int
    h: int
    anchor: str = "SOUTHWEST"

    def rect(self, atlas: Atlas) -> DataFrame:
        size = F.lit(self.w).cast("bigint"), F.lit(self.h).cast("bigint")
        at = anchored(to_grid(F.lit(self.lon), atlas.unit_x), to_grid(F.lit(self.lat), atlas.unit_y), *size, F.lit(self.anchor))
        return _one(atlas).select(at.alias("p"), size[0].alias("w"), size[1].alias("h")).select("p.x", "p.y", "w", "h")


@dataclass(frozen=True)
class LonLatBounds:
    """The cells from one coordinate to another, the latter's cell not included."""

    west: float
    south: float
    east: float
    north: float

    def rect(self, atlas: Atlas) -> DataFrame:
        x, y = to_grid(F.lit(self.west), atlas.unit_x), to_grid(F.lit(self.south), atlas.unit_y)
        x2, y2 = to_grid(F.lit(self.east), atlas.unit_x), to_grid(F.lit(self.north), atlas.unit_y)
        return _one(atlas).select(x.alias("x"), y.alias("y"), (x2 - x).alias("w"), (y2 - y).alias("h"))


@dataclass(frozen=True)
class Everything:
    """The rectangle around all maps."""

    def rect(self, atlas: Atlas) -> DataFrame:
        return atlas.bounds()


def select(atlas: Atlas, selector: Selector) -> Selection:
    """What the selector names, ready for fill(), edge_image() and image(); one row comes to the driver, the rectangle."""
    rect = selector.rect(atlas)
    r = rect.first()
    if r is None or r["w"] is None:
        return Selection(rect.select("x", "y", F.lit(0).cast("bigint").alias("code")).limit(0), 0, 0)
    if r["w"] < 0 or r["h"] < 0:
        raise ValueError("a rectangle's size is negative")
    cells = atlas.rect_codes(rect.withColumn("rect_id", F.lit(0)))
    return Selection(cells.select((F.col("x") - r["x"]).alias("x"), (F.col("y") - r["y"]).alias("y"), "code"), r["w"], r["h"])
