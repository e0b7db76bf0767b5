"""Scalar column functions on grid points, rectangles and segments. Rectangles are half-open with a south-west origin."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

ROUNDINGS = ("half_even", "half_away", "half_up")
ANCHORS = ("SOUTHWEST", "CENTER", "NORTHWEST", "NORTHEAST", "SOUTHEAST")


def to_grid(degrees: Column, unit: int, rounding: str = "half_even") -> Column:
    """The grid index of a coordinate; ties by the rounding named."""
    v = degrees * F.lit(unit)
    if rounding == "half_even":
        return F.rint(v).cast("bigint")
    if rounding == "half_away":
        return F.when(v < 0, F.ceil(v - 0.5)).otherwise(F.floor(v + 0.5)).cast("bigint")
    if rounding == "half_up":
        return F.floor(v + 0.5).cast("bigint")
    raise ValueError(f"rounding is one of {ROUNDINGS}")


def to_degrees(index: Column, unit: int) -> Column:
    return index / F.lit(float(unit))


def contains(x: Column, y: Column, rx: Column, ry: Column, rw: Column, rh: Column) -> Column:
    return (x >= rx) & (x < rx + rw) & (y >= ry) & (y < ry + rh)


def floor_div(a: Column, b: Column | int) -> Column:
    """Integer division towards minus infinity."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.floor((a - F.pmod(a, b)) / b).cast("bigint")


def anchored(x: Column, y: Column, w: Column, h: Column, anchor: Column) -> Column:
    """struct(x, y): the south-west corner of a w x h rectangle placed by its anchor; a negative size is an error."""
    a = F.coalesce(anchor, F.lit("SOUTHWEST"))
    half = lambda v: F.floor(v / 2).cast("bigint")
    dx = F.when(a == "CENTER", half(w)).when(a.isin("NORTHEAST", "SOUTHEAST"), w).otherwise(0)
    dy = F.when(a == "CENTER", half(h)).when(a.isin("NORTHWEST", "NORTHEAST"), h).otherwise(0)
    bad = F.raise_error(F.lit("a rectangle's size is negative")).cast("bigint")
    fine = (w >= 0) & (h >= 0)
    return F.struct(F.when(fine, x - dx).otherwise(bad).alias("x"), F.when(fine, y - dy).otherwise(bad).alias("y"))


def rect_of_bounds(west: Column, south: Column, east: Column, north: Column, ux: int, uy: int) -> Column:
    """Corners are rounded; the size is their difference."""
    x, y = to_grid(west, ux), to_grid(south, uy)
    return F.struct(x.alias("x"), y.alias("y"), (to_grid(east, ux) - x).alias("w"), (to_grid(north, uy) - y).alias("h"))


def rect_of_floats(x: Column, y: Column, w: Column, h: Column, ux: int, uy: int) -> Column:
    """Place and size are rounded each on its own."""
    return F.struct(to_grid(x, ux).alias("x"), to_grid(y, uy).alias("y"), to_grid(w, ux).alias("w"), to_grid(h, uy).alias("h"))


def cross(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """The common rectangle, null where there is none (touching edges share nothing)."""
    left, bottom = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    right, top = F.least(a[0] + a[2], b[0] + b[2]), F.least(a[1] + a[3], b[1] + b[3])
    return F.when((left < right) & (bottom < top), F.struct(left.alias("x"), bottom.alias("y"), (right - left).alias("w"), (top - bottom).alias("h")))


def merged(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """The least rectangle around both."""
    x, y = F.least(a[0], b[0]), F.least(a[1], b[1])
    return F.struct(x.alias("x"), y.alias("y"), (F.greatest(a[0] + a[2], b[0] + b[2]) - x).alias("w"), (F.greatest(a[1] + a[3], b[1] + b[3]) - y).alias("h"))


def area_inside(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether b lies in a: lower edges may touch, upper edges may not, so no rectangle is inside itself."""
    return (a[0] <= b[0]) & (b[0] + b[2] < a[0] + a[2]) & (a[1] <= b[1]) & (b[1] + b[3] < a[1] + a[3])


def segment_of(start: Column, end: Column, unit: int) -> Column:
    """Centre-registered grid segment: first and last index, and the number of units."""
    first = F.floor(start * F.lit(unit) + 0.5).cast("bigint")
    last = F.ceil(end * F.lit(unit) - 0.5).cast("bigint")
    return F.struct(first.alias("first"), last.alias("last"), (last - first + 1).alias("n"))


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def bits_of(n: Column) -> Column:
    """Bits for n codes, one at least."""
    return F.when(n <= 1, 1).otherwise(F.length(F.bin(n - 1))).cast("bigint")


def sub_byte_width(n_values: Column) -> Column:
    """1, 2, 4 or 8 bits an entry, for that many values; null beyond."""
    return F.when(n_values <= 2, 1).when(n_values <= 4, 2).when(n_values <= 16, 4).when(n_values <= 256, 8).cast("bigint")


#: The first number that needs one byte more.
VARINT_LIMITS = (252, 508, 66044, 16843260)


def varint_size(n: Column) -> Column:
    out = F.lit(5)
    for size, limit in reversed(list(enumerate(VARINT_LIMITS, 1))):
        out = F.when(n < limit, size).otherwise(out)
    return out.cast("bigint")


def code_to_index(code: Column) -> Column:
    return F.when(code > 0, code - 1)


def display_path(parts: list[Column], missing: str = "(not found)") -> Column:
    """Non-empty parts joined; a path of none, or no path, reads as missing."""
    some = F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " / ")
    return F.when(some == "", F.lit(missing)).otherwise(some)


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """struct(r, g, b) of 0 to 255; hue 1.0 is grey, as the wheel has six sectors."""
    six = F.floor(h * 6.0).cast("int")
    f = h * 6.0 - six
    p, q, t = v * (1.0 - s), v * (1.0 - s * f), v * (1.0 - s * (1.0 - f))
    table = {"r": (v, q, p, p, t, v), "g": (t, v, v, q, p, p), "b": (p, p, t, v, v, q)}
    out = []
    for name, cases in table.items():
        c = v
        for k, value in enumerate(cases):
            c = F.when(six == k, value).otherwise(c)
        out.append(F.floor(c * 255.0).cast("bigint").alias(name))
    return F.struct(*out)


#: Names of encodings that Spark writes itself.
ENCODINGS = {"utf8": "UTF-8", "utf-8": "UTF-8", "utf-16-le": "UTF-16LE", "utf16le": "UTF-16LE"}
#: Names of the one that it doesn't.
CP932 = frozenset({"cp932", "shift_jis", "sjis", "windows-31j"})


@F.pandas_udf(BinaryType())
def _cp932(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t.encode("cp932"), na_action="ignore")


@F.pandas_udf(StringType())
def _from_cp932(data: pd.Series) -> pd.Series:
    return data.map(lambda b: bytes(b).decode("cp932"), na_action="ignore")


def encoded(text: Column, encoding: str) -> Column:
    """Bytes of a text; an error for a character that the encoding lacks (CP932) and for an unknown encoding."""
    name = encoding.lower()
    return _cp932(text) if name in CP932 else F.encode(text, ENCODINGS[name])


def decoded(data: Column, encoding: str) -> Column:
    name = encoding.lower()
    return _from_cp932(data) if name in CP932 else F.decode(data, ENCODINGS[name])


# ---- scan orders of a size x size square. NAME(i, size) is the scan position of row-major cell i; NAME_cell is the inverse.


def zigzag(i: Column, size: int) -> Column:
    """Every other row runs backward; its own inverse."""
    row, col = floor_div(i, size), i % size
    return F.when(row % 2 == 0, i).otherwise(row * size + (size - 1) - col).cast("bigint")


def mirror(i: Column, size: int, horizontal: bool = True, vertical: bool = False) -> Column:
    row, col = floor_div(i, size), i % size
    return ((size - 1 - row if vertical else row) * size + (size - 1 - col if horizontal else col)).cast("bigint")


def transpose(i: Column, size: int) -> Column:
    return ((i % size) * size + floor_div(i, size)).cast("bigint")


def chained(*maps):
    def run(i: Column, size: int) -> Column:
        for m in maps:
            i = m(i, size)
        return i

    return run


def _before_diagonal(d: Column, size: int) -> Column:
    """Cells on the diagonals before d."""
    rest = F.lit(2 * size - 1) - d
    return F.when(d < size, floor_div(d * (d + 1), 2)).otherwise(F.lit(size * size) - floor_div(rest * (rest + 1), 2))


def diagonal(i: Column, size: int) -> Column:
    """Diagonals from the origin, each upward from its lowest row."""
    col, row = i % size, floor_div(i, size)
    d = col + row
    return (_before_diagonal(d, size) + row - F.greatest(d - (size - 1), F.lit(0))).cast("bigint")


def diagonal_zigzag(i: Column, size: int) -> Column:
    """Diagonals from the origin, odd ones downward."""
    col, row = i % size, floor_div(i, size)
    d = col + row
    step = F.when(d % 2 == 0, row).otherwise(col) - F.greatest(d - (size - 1), F.lit(0))
    return (_before_diagonal(d, size) + step).cast("bigint")


def _diagonal_of(i: Column, size: int) -> tuple[Column, Column]:
    """The diagonal of a scan position and the place on it, by roots of triangular numbers."""

    def root(n: Column) -> Column:  # the square root may be off by one at the edge of a long
        g = F.floor((F.sqrt(n * 8.0 + 1.0) - 1.0) / 2.0)
        return F.when(floor_div(g * (g + 1), 2) > n, g - 1).when(floor_div((g + 1) * (g + 2), 2) <= n, g + 1).otherwise(g)

    back = F.lit(size * size - 1) - i
    d = F.when(i < size * (size + 1) // 2, root(i)).otherwise(F.lit(2 * size - 2) - root(F.greatest(back, F.lit(0))))
    return d, i - _before_diagonal(d, size)


def diagonal_cell(i: Column, size: int) -> Column:
    d, k = _diagonal_of(i, size)
    row = F.greatest(d - (size - 1), F.lit(0)) + k
    return (d - row + row * size).cast("bigint")


def diagonal_zigzag_cell(i: Column, size: int) -> Column:
    d, k = _diagonal_of(i, size)
    at = F.greatest(d - (size - 1), F.lit(0)) + k
    row = F.when(d % 2 == 0, at).otherwise(d - at)
    return (d - row + row * size).cast("bigint")


def spiral(i: Column, size: int) -> Column:
    """Rings inward; each along its lowest row, up, back along its highest row, and down."""
    col, row = i % size, floor_div(i, size)
    ring = F.least(col, row, size - 1 - col, size - 1 - row)
    last = F.lit(size - 1) - 2 * ring
    x, y = col - ring, row - ring
    k = F.when(y == 0, x).when(x == last, last + y).when(y == last, 3 * last - x).otherwise(4 * last - y)
    return (4 * ring * (size - ring) + k).cast("bigint")


def spiral_cell(i: Column, size: int) -> Column:
    left = F.lit(size * size) - i
    ring = floor_div(F.lit(size) - F.ceil(F.sqrt(left.cast("double"))), 2)
    last = F.greatest(F.lit(size - 1) - 2 * ring, F.lit(1))
    k = i - 4 * ring * (F.lit(size) - ring)
    leg, at = floor_div(k, last), k % last
    x = F.when(leg == 0, at).when(leg == 1, last).when(leg == 2, last - at).otherwise(0)
    y = F.when(leg == 0, 0).when(leg == 1, at).when(leg == 2, last).otherwise(last - at)
    return (x + ring + (y + ring) * size).cast("bigint")


#: name: (position of a cell, cell of a position)
SCANS = {
    "zigzag": (zigzag, zigzag),
    "mirror": (mirror, mirror),
    "transpose": (transpose, transpose),
    "mirror_zigzag": (chained(mirror, zigzag), chained(zigzag, mirror)),
    "zigzag_transpose": (chained(zigzag, transpose), chained(transpose, zigzag)),
    "diagonal": (diagonal, diagonal_cell),
    "diagonal_zigzag": (diagonal_zigzag, diagonal_zigzag_cell),
    "spiral": (spiral, spiral_cell),
}


def reordered(values: Column, position, size: int) -> Column:
    """An array of size * size values, element i taken from position(i)."""
    return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.get(values, position(i, size).cast("int")))
