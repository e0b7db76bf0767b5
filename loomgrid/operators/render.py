"""Colours of rasters as pixel rows. Image row 0 is the northernmost, raster row 0 the southernmost.

keys tell rasters apart; widths and heights may then be columns of cells, which keys must name as well.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rgba = tuple[int, int, int, int]
Size = int | Column
#: Defaults of the renderers. Fixed values.
CLEAR: Rgba = (0, 0, 0, 0)
BLACK: Rgba = (0, 0, 0, 255)


def checked(color: Rgba) -> Rgba:
    if len(color) != 4 or any(not 0 <= c <= 255 for c in color):
        raise ValueError(f"a colour has four parts of 0 to 255: {color}")
    return color


@dataclass(frozen=True)
class Fill:
    """colors by code, then resolver(code, x, y) -> struct(r, g, b, a) or null, then default."""

    colors: Mapping[int, Rgba] = field(default_factory=dict)
    resolver: Callable[[Column, Column, Column], Column] | None = None
    default: Rgba = CLEAR


@dataclass(frozen=True)
class Edge:
    color: Rgba = BLACK
    background: Rgba = CLEAR
    width: int = 1
    include_zero: bool = False

    def __post_init__(self):
        if self.width < 1:
            raise ValueError("an edge is 1 wide at least")


def rgba(c: Rgba) -> Column:
    return F.struct(*[F.lit(v).alias(n) for v, n in zip(checked(c), "rgba")])


def fill(cells: DataFrame, height: Size, options: Fill, *keys: str) -> DataFrame:
    """(keys, img_x, img_y, r, g, b, a) of every cell (x, y, code)."""
    color = rgba(options.default)
    if options.resolver is not None:
        color = F.coalesce(options.resolver(F.col("code"), F.col("x"), F.col("y")), color)
    if options.colors:
        entries = [v for k, c in sorted(options.colors.items()) for v in (F.lit(k).cast("bigint"), rgba(c))]
        color = F.coalesce(F.try_element_at(F.create_map(*entries), F.col("code")), color)
    return cells.select(*keys, F.col("x").alias("img_x"), (F.lit(height) - 1 - F.col("y")).alias("img_y"), color.alias("c")).select(*keys, "img_x", "img_y", "c.*")


def dilate(mask: DataFrame, width: Size, height: Size, edge_width: int, *keys: str) -> DataFrame:
    """mask (x, y in image axes) grown to edge_width: even widths grow more to the right and down."""
    if edge_width == 1:
        return mask.select(*keys, "x", "y").distinct()
    steps = F.array(*[F.lit(d) for d in range(-((edge_width - 1) // 2), edge_width // 2 + 1)])
    grown = mask.select(*keys, F.explode(F.transform(steps, lambda d: F.col("x") + d)).alias("x"), "y").select(*keys, "x", F.explode(F.transform(steps, lambda d: F.col("y") + d)).alias("y"))
    return grown.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)).distinct()


def edge_mask(cells: DataFrame, width: Size, height: Size, options: Edge, *keys: str) -> DataFrame:
    """(keys, img_x, img_y) of edge pixels, dilated."""
    from .raster import edges

    found = edges(cells, *keys, include_zero=options.include_zero).select(*keys, "x", (F.lit(height) - 1 - F.col("y")).alias("y"))
    return dilate(found, width, height, options.width, *keys).select(*keys, F.col("x").alias("img_x"), F.col("y").alias("img_y"))


def edge_image(cells: DataFrame, width: Size, height: Size, options: Edge, *keys: str) -> DataFrame:
    mask = edge_mask(cells, width, height, options, *keys).withColumn("on", F.lit(True))
    grid = cells.select(*keys, F.col("x").alias("img_x"), (F.lit(height) - 1 - F.col("y")).alias("img_y"))
    c = F.when(F.col("on"), rgba(options.color)).otherwise(rgba(options.background))
    return grid.join(mask, [*keys, "img_x", "img_y"], "left").select(*keys, "img_x", "img_y", c.alias("c")).select(*keys, "img_x", "img_y", "c.*")


def over(bottom: DataFrame, top: DataFrame, *keys: str) -> DataFrame:
    """The top image composed over the bottom one, in whole numbers; opaque and clear pixels are exact."""
    t = top.select(*keys, "img_x", "img_y", *[F.col(c).alias(f"t{c}") for c in "rgba"])
    j = bottom.join(t, [*keys, "img_x", "img_y"])
    oa = F.col("ta") * 255 + F.col("a") * (255 - F.col("ta"))  # alpha times 255

    def mix(c: str) -> Column:
        top_part, under = F.col(f"t{c}") * F.col("ta") * 255, F.col(c) * F.col("a") * (255 - F.col("ta"))
        mixed = F.floor((top_part + under + F.floor(oa / 2)) / F.greatest(oa, F.lit(1)))
        return F.when(F.col("ta") == 255, F.col(f"t{c}")).when(F.col("ta") == 0, F.col(c)).otherwise(mixed).cast("int").alias(c)

    alpha = F.when(F.col("ta") == 255, F.lit(255)).when(F.col("ta") == 0, F.col("a")).otherwise(F.floor((oa + 127) / 255)).cast("int").alias("a")
    return j.select(*keys, "img_x", "img_y", mix("r"), mix("g"), mix("b"), alpha)


def image(cells: DataFrame, width: Size, height: Size, fill_options: Fill, edge_options: Edge | None, *keys: str) -> DataFrame:
    """Fill, with edges over it if any; the edge layer's background lets the fill through by its alpha."""
    base = fill(cells, height, fill_options, *keys)
    return base if edge_options is None else over(base, edge_image(cells, width, height, edge_options, *keys), *keys)


def to_ppm(pixels: DataFrame, width: int, height: int) -> bytes:
    """A binary PPM of a whole image (alpha dropped). The image is collected: it is a picture, not a table."""
    out = bytearray(width * height * 3)
    for r in pixels.select("img_x", "img_y", "r", "g", "b").toLocalIterator():
        at = 3 * (r["img_x"] + r["img_y"] * width)
        out[at : at + 3] = bytes((r["r"], r["g"], r["b"]))
    return f"P6 {width} {height} 255\n".encode() + bytes(out)
