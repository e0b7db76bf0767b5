"""Selectors against the rectangles that they name."""

import pytest
from test_stores import some_atlas

from loomgrid.operators import render as v
from loomgrid.operators.atlas import Atlas
from loomgrid.operators.selectors import Everything, LonLatBounds, LonLatPointRect, PointRect, select


def codes_of(maps, runs):
    """(x, y) to the last set code, on the grid."""
    at, own = {}, {m[0]: m for m in maps}
    for k, y, x0, n, c in sorted(runs):
        _, west, south, _, _ = own[k]
        for x in range(x0, x0 + n):
            if c:
                at[west + x, south + y] = c
    return at


def cells(s):
    return {(r.x, r.y): r.code for r in s.cells.collect()}


def test_selectors(spark):
    a, maps, runs = some_atlas(spark, 9, n=4, spread=60)
    at = codes_of(maps, runs)
    _, west, south, *_ = maps[1]
    for anchor, dx, dy in (("SOUTHWEST", 0, 0), ("CENTER", 7, 4), ("NORTHEAST", 15, 9), ("NORTHWEST", 0, 9), ("SOUTHEAST", 15, 0)):
        want = {(x, y): at.get((west - dx + x, south - dy + y), 0) for x in range(15) for y in range(9)}
        s = select(a, PointRect(west, south, 15, 9, anchor))
        assert (s.width, s.height) == (15, 9) and cells(s) == want
        assert cells(select(a, LonLatPointRect(west / 100, south / 100, 15, 9, anchor))) == want
    s = select(a, LonLatBounds(west / 100, south / 100, (west + 15) / 100, (south + 9) / 100))
    assert cells(s) == {(x, y): at.get((west + x, south + y), 0) for x in range(15) for y in range(9)}
    pixels = v.fill(s.cells, s.height, v.Fill({1: (9, 8, 7, 255)}, None, (0, 0, 0, 0))).collect()
    assert len(pixels) == 15 * 9 and all((r.r == 9) == (at.get((west + r.img_x, south + 8 - r.img_y), 0) == 1) for r in pixels)


def test_everything(spark):
    a, maps, runs = some_atlas(spark, 10, n=3, spread=30)
    at = codes_of(maps, runs)
    x0, y0 = min(m[1] for m in maps), min(m[2] for m in maps)
    s = select(a, Everything())
    assert (s.width, s.height) == (max(m[1] + m[3] for m in maps) - x0, max(m[2] + m[4] for m in maps) - y0)
    got = cells(s)
    assert len(got) == s.width * s.height and {(x + x0, y + y0): c for (x, y), c in got.items() if c} == at
    none = Atlas(a.maps.limit(0), a.runs.limit(0))
    assert (select(none, Everything()).width, select(none, Everything()).cells.count()) == (0, 0)


def test_sizes(spark):
    a, *_ = some_atlas(spark, 11, n=1)
    assert cells(select(a, PointRect(0, 0, 0, 5))) == {}
    with pytest.raises(Exception, match="negative"):
        select(a, PointRect(0, 0, -1, 5)).cells.count()
    with pytest.raises(ValueError, match="negative"):
        select(a, LonLatBounds(1.0, 0.0, 0.5, 1.0))
