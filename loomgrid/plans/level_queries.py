"""Queries of coarser rasters, levels with names, and the cheapest encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions.grid import display_path
from loomgrid.operators import encodings as e
from loomgrid.operators import levels as v
from loomgrid.operators.lexicon import LEVELS
from loomgrid.sources import domain as d

from .atlas_queries import FOUND, atlas
from .grid_queries import pt_project
from .registry import query

#: 100 units a degree to 30: a cell is 3 thirtieths of a target cell's ten.
AREA = "f AS (SELECT map_ord, code, 3*x AS xa, 3*x+3 AS xz, 3*y AS ya, 3*y+3 AS yz FROM cells), fx AS (SELECT *, unnest(generate_series(xa//10, (xz-1)//10)) AS tx FROM f), fy AS (SELECT *, unnest(generate_series(ya//10, (yz-1)//10)) AS ty FROM fx), s AS (SELECT map_ord, tx, ty, code, sum((least(xz, 10*tx+10) - greatest(xa, 10*tx)) * (least(yz, 10*ty+10) - greatest(ya, 10*ty))) AS n FROM fy GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY map_ord, tx, ty ORDER BY n DESC, code) AS k FROM s)"


@query("resample_units", "cells", f"WITH {AREA} SELECT map_ord, tx::BIGINT AS x, ty::BIGINT AS y, (CASE WHEN n >= 0.5::DOUBLE*100 THEN code ELSE 0 END)::BIGINT AS code FROM r WHERE k = 1")
def resample_units(spark, sf):
    """Maps of 100 units a degree on a grid of 30, by area."""
    return v.resample_area(d.runs(spark, sf), 100, 30, 0.5, "map_ord")


TOP = 4
WHOLE = "w AS (SELECT c.x + m.west AS x, c.y + m.south AS y, arg_max(code, map_ord) AS code FROM cells c JOIN maps m USING (map_ord) WHERE code <> 0 GROUP BY 1, 2)"
PYRAMID = f"{WHOLE}, lv AS (SELECT level, (x >> level)::BIGINT AS x, (y >> level)::BIGINT AS y, code, count(*) AS n FROM w, (SELECT unnest(generate_series(0, {TOP})) AS level) l GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY level, x, y ORDER BY n DESC, code) AS k FROM lv), dr AS (SELECT level, x, y, CASE WHEN n >= 0.5::DOUBLE * (1 << (2*level)::INT) THEN code ELSE 0 END AS code FROM rk WHERE k = 1)"


def drawn(spark, sf):
    return v.pyramid(atlas(spark, sf).full(), TOP)


@query("level_pyramid", "maps cells", f"WITH {PYRAMID} SELECT level::BIGINT AS level, x, y, code::BIGINT AS code FROM dr")
def level_pyramid(spark, sf):
    """Every level of the composed maps, each from the one below."""
    return drawn(spark, sf)


@query("level_names", "gpts maps runs cells paths", f"WITH {FOUND}, {PYRAMID} SELECT p.event_id, (p.event_id % {TOP + 1})::BIGINT AS level, coalesce(dr.code, 0)::BIGINT AS drawn, f.code, CASE WHEN l1 IS NULL THEN '(not found)' ELSE array_to_string(list_filter([l1, l2, l3, l4], lambda q: q <> ''), ' / ') END AS place FROM gpts p LEFT JOIN f USING (event_id) LEFT JOIN paths t ON t.code = f.code LEFT JOIN dr ON dr.level = p.event_id % {TOP + 1} AND dr.x = p.x >> (p.event_id % {TOP + 1})::INT AND dr.y = p.y >> (p.event_id % {TOP + 1})::INT")
def level_names(spark, sf):
    """What a level draws at each point, and the name that the finest map gives it."""
    asked = pt_project(spark, sf).withColumn("level", F.pmod("event_id", F.lit(TOP + 1)))
    named = atlas(spark, sf).named(asked, d.paths(spark, sf))
    seen = v.drawn_at(named, drawn(spark, sf))
    return seen.select("event_id", "level", "drawn", "code", display_path([F.col(c) for c in LEVELS]).alias("place"))


BLOCK = 8
SIDE = BLOCK - 1
POSITIONS = {
    "zigzag": f"y*{BLOCK} + CASE WHEN y % 2 = 0 THEN x ELSE {SIDE}-x END",
    "zigzag_mirror": f"y*{BLOCK} + CASE WHEN y % 2 = 0 THEN {SIDE}-x ELSE x END",
    "zigzag_transpose": f"x*{BLOCK} + CASE WHEN x % 2 = 0 THEN y ELSE {SIDE}-y END",
    "zigzag_transpose_mirror": f"x*{BLOCK} + CASE WHEN x % 2 = 0 THEN {SIDE}-y ELSE y END",
}
SCANNED = " UNION ALL ".join(f"SELECT map_ord, bx, bq, '{name}' AS o, {place} AS p, code FROM cb" for name, place in POSITIONS.items())
BITS = f"""cb AS (SELECT map_ord, x // {BLOCK} AS bx, y // {BLOCK} AS bq, x % {BLOCK} AS x, y % {BLOCK} AS y, code FROM cells),
sc AS ({SCANNED}),
hd AS (SELECT *, CASE WHEN code = lag(code) OVER w THEN 0 ELSE 1 END AS h FROM sc WINDOW w AS (PARTITION BY map_ord, bx, bq, o ORDER BY p)),
rn AS (SELECT *, sum(h) OVER (PARTITION BY map_ord, bx, bq, o ORDER BY p) AS r FROM hd),
rc AS (SELECT map_ord, bx, bq, o, r, count(*) AS c FROM rn GROUP BY ALL),
ro AS (SELECT map_ord, bx, bq, o, count(*) AS runs, sum(CASE WHEN c < 252 THEN 8 ELSE 16 END) AS lengths FROM rc GROUP BY ALL),
vb AS (SELECT map_ord, bx, bq, count(DISTINCT code) AS n, CASE WHEN max(code) = 0 THEN 1 ELSE length(bin(max(code)::BIGINT)) END AS w FROM cb GROUP BY ALL),
cd AS (SELECT map_ord, bx, bq, NULL AS o, 'one' AS coding, CASE WHEN n = 1 THEN w END AS bits FROM vb
UNION ALL SELECT map_ord, bx, bq, NULL, 'plain', w * {BLOCK * BLOCK} FROM vb
UNION ALL SELECT map_ord, bx, bq, NULL, 'palette', n*w + (CASE WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 WHEN n <= 16 THEN 4 WHEN n <= 256 THEN 8 END) * {BLOCK * BLOCK} FROM vb
UNION ALL SELECT map_ord, bx, bq, o, 'runs', n*w + lengths + CASE WHEN n <= 2 THEN 0 WHEN n <= 3 THEN runs-1 WHEN n <= 5 THEN (runs-1)*2 WHEN n <= 16 THEN runs*4 END FROM ro JOIN vb USING (map_ord, bx, bq))"""


def costs(spark, sf):
    return e.block_costs(e.pieces_of_runs(d.runs(spark, sf), BLOCK, "map_ord"), BLOCK, "map_ord")


@query("encoding_bits", "cells", f"WITH {BITS} SELECT map_ord, bx::BIGINT AS bx, bq::BIGINT AS \"by\", o AS \"order\", coding, bits::BIGINT AS bits FROM cd WHERE bits IS NOT NULL")
def encoding_bits(spark, sf):
    """Bits of every coding of every block, in four scan orders."""
    return e.listed(costs(spark, sf), "map_ord")


@query("encoding_cheapest", "cells", f"WITH {BITS}, k AS (SELECT *, row_number() OVER (PARTITION BY map_ord, bx, bq ORDER BY bits, coding, coalesce(o, '')) AS k FROM cd WHERE bits IS NOT NULL) SELECT map_ord, bx::BIGINT AS bx, bq::BIGINT AS \"by\", o AS \"order\", coding, bits::BIGINT AS bits FROM k WHERE k = 1")
def encoding_cheapest(spark, sf):
    """The coding of fewest bits of every block."""
    return e.least(costs(spark, sf), "map_ord")
