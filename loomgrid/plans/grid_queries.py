"""Queries of scalar functions: projections, rectangles, segments, sizes, colours, scan orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions import grid as g
from loomgrid.operators.atlas import Atlas
from loomgrid.operators.raster import cells_of
from loomgrid.operators.atlas import Atlas
from loomgrid.operators.raster import cells_of
from loomgrid.sources import domain as d

from .registry import query

U = d.UNIT


@query("pt_project", "gpts", "SELECT event_id, x, y FROM gpts")
def pt_project(spark, sf):
    return d.points(spark, sf).select("event_id", g.to_grid(F.col("lon"), U).alias("x"), g.to_grid(F.col("lat"), U).alias("y"))


@query("pt_unproject", "gpts", "SELECT event_id, x / 100.0::DOUBLE AS lon, y / 100.0::DOUBLE AS lat FROM gpts")
def pt_unproject(spark, sf):
    return pt_project(spark, sf).select("event_id", g.to_degrees(F.col("x"), U).alias("lon"), g.to_degrees(F.col("y"), U).alias("lat"))


@query(
    "pt_round_variants",
    "",
    "SELECT event_id, v, round_even(v*2, 0)::BIGINT AS half_even, (CASE WHEN v*2 < 0 THEN ceil(v*2 - 0.5) ELSE floor(v*2 + 0.5) END)::BIGINT AS half_away, floor(v*2 + 0.5)::BIGINT AS half_up FROM (SELECT event_id, (event_id % 201 - 100) / 4.0::DOUBLE AS v FROM events) a",
)
def pt_round_variants(spark, sf):
    v = d.read(spark, sf, "events").select("event_id", ((F.col("event_id") % 201 - 100) / 4.0).alias("v"))
    return v.select("event_id", "v", *[g.to_grid(F.col("v"), 2, r).alias(r) for r in g.ROUNDINGS])


BOUNDS = "bb AS (SELECT min(west) AS bx, min(south) AS by_, max(west+width) - min(west) AS bw, max(south+height) - min(south) AS bh FROM maps)"


@query("pt_contains", "gpts maps", f"WITH {BOUNDS} SELECT event_id, (x >= bx AND x < bx+bw AND y >= by_ AND y < by_+bh) AS inside FROM gpts, bb")
def pt_contains(spark, sf):
    b = Atlas(d.maps(spark, sf), d.runs(spark, sf)).bounds().select(*[F.col(c).alias(f"b{c}") for c in "xywh"])
    p = pt_project(spark, sf).join(F.broadcast(b))  # one row
    return p.select("event_id", g.contains(F.col("x"), F.col("y"), F.col("bx"), F.col("by"), F.col("bw"), F.col("bh")).alias("inside"))


@query("ds_bounds", "maps", f"WITH {BOUNDS} SELECT bx::BIGINT AS x, by_::BIGINT AS y, bw::BIGINT AS w, bh::BIGINT AS h, bx/100.0::DOUBLE AS west, by_/100.0::DOUBLE AS south, (bx+bw)/100.0::DOUBLE AS east, (by_+bh)/100.0::DOUBLE AS north FROM bb")
def ds_bounds(spark, sf):
    b = Atlas(d.maps(spark, sf), d.runs(spark, sf)).bounds()
    x, y, w, h = (F.col(c) for c in "xywh")
    return b.select("x", "y", "w", "h", g.to_degrees(x, U).alias("west"), g.to_degrees(y, U).alias("south"), g.to_degrees(x + w, U).alias("east"), g.to_degrees(y + h, U).alias("north"))


@query("ds_props", "maps", "SELECT count(*)::BIGINT AS n_maps, 100::BIGINT AS unit_inv_x, 100::BIGINT AS unit_inv_y, CAST(NULL AS VARCHAR) AS metadata FROM maps")
def ds_props(spark, sf):
    return d.maps(spark, sf).agg(F.count(F.lit(1)).alias("n_maps")).select("n_maps", F.lit(U).cast("bigint").alias("unit_inv_x"), F.lit(U).cast("bigint").alias("unit_inv_y"), F.lit(None).cast("string").alias("metadata"))


def sw_rects(spark, sf):
    r = d.req_rects(spark, sf).withColumn("p", g.anchored(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("anchor")))
    return r.select("rect_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "w", "h")


@query("rect_anchor", "sw_rects", "SELECT rect_id, x, y, w, h FROM sw_rects")
def rect_anchor(spark, sf):
    return sw_rects(spark, sf)


PTS2 = "b AS (SELECT event_id, lon, lat, lon + (event_id % 37)/250.0::DOUBLE AS east, lat + (event_id % 23)/125.0::DOUBLE AS north, (event_id % 37)/250.0::DOUBLE AS fw, (event_id % 23)/125.0::DOUBLE AS fh FROM pts)"


def boxes(spark, sf):
    e = F.col("event_id")
    p = d.points(spark, sf).withColumn("fw", (e % 37) / 250.0).withColumn("fh", (e % 23) / 125.0)
    return p.withColumn("east", F.col("lon") + F.col("fw")).withColumn("north", F.col("lat") + F.col("fh"))


@query("rect_from_bounds", "pts", f"WITH {PTS2} SELECT event_id, round_even(lon*100,0)::BIGINT AS x, round_even(lat*100,0)::BIGINT AS y, (round_even(east*100,0) - round_even(lon*100,0))::BIGINT AS w, (round_even(north*100,0) - round_even(lat*100,0))::BIGINT AS h FROM b")
def rect_from_bounds(spark, sf):
    return boxes(spark, sf).select("event_id", g.rect_of_bounds(F.col("lon"), F.col("lat"), F.col("east"), F.col("north"), U, U).alias("r")).select("event_id", "r.*")


@query("rect_from_float", "pts", f"WITH {PTS2} SELECT event_id, round_even(lon*100,0)::BIGINT AS x, round_even(lat*100,0)::BIGINT AS y, round_even(fw*100,0)::BIGINT AS w, round_even(fh*100,0)::BIGINT AS h FROM b")
def rect_from_float(spark, sf):
    return boxes(spark, sf).select("event_id", g.rect_of_floats(F.col("lon"), F.col("lat"), F.col("fw"), F.col("fh"), U, U).alias("r")).select("event_id", "r.*")


#: Rectangles are paired with the maps that come this near to them.
NEAR = 8


def rects_and_places(spark, sf):
    """Each rectangle beside the places of maps that it meets or nearly meets."""
    r = sw_rects(spark, sf)
    own = F.struct("x", "y", "w", "h").alias("own")
    wide = r.select("rect_id", own, (F.col("x") - NEAR).alias("x"), (F.col("y") - NEAR).alias("y"), (F.col("w") + 2 * NEAR).alias("w"), (F.col("h") + 2 * NEAR).alias("h"))
    return Atlas(d.maps(spark, sf), d.runs(spark, sf)).meeting(wide).select("rect_id", "own.*", "west", "south", "width", "height", "maps")


def of_each_map(pairs):
    """Pairs of a rectangle and a place, once for each map of the place; what is told of a pair is worked out before."""
    return pairs.select(*[c for c in pairs.columns if c != "maps"], F.explode("maps").alias("map_ord"))


RM = f"rm AS (SELECT r.*, m.map_ord, m.west, m.south, m.width, m.height FROM sw_rects r JOIN maps m ON m.west < r.x+r.w+{NEAR} AND r.x-{NEAR} < m.west+m.width AND m.south < r.y+r.h+{NEAR} AND r.y-{NEAR} < m.south+m.height)"


def sides():
    return tuple(F.col(c) for c in "xywh"), tuple(F.col(c) for c in ("west", "south", "width", "height"))


@query(
    "rect_cross",
    "sw_rects maps",
    f"WITH {RM} SELECT rect_id, map_ord, greatest(x,west)::BIGINT AS cx, greatest(y,south)::BIGINT AS cy, (least(x+w,west+width) - greatest(x,west))::BIGINT AS cw, (least(y+h,south+height) - greatest(y,south))::BIGINT AS ch FROM rm WHERE greatest(x,west) < least(x+w,west+width) AND greatest(y,south) < least(y+h,south+height)",
)
def rect_cross(spark, sf):
    c = rects_and_places(spark, sf).withColumn("c", g.cross(*sides())).where("c is not null")
    return of_each_map(c.select("rect_id", "maps", *[F.col(f"c.{k}").alias(f"c{k}") for k in "xywh"])).select("rect_id", "map_ord", "cx", "cy", "cw", "ch")


@query("rect_union", "sw_rects maps", f"WITH {RM} SELECT rect_id, map_ord, least(x,west)::BIGINT AS mx, least(y,south)::BIGINT AS my, (greatest(x+w,west+width) - least(x,west))::BIGINT AS mw, (greatest(y+h,south+height) - least(y,south))::BIGINT AS mh FROM rm")
def rect_union(spark, sf):
    c = rects_and_places(spark, sf).withColumn("c", g.merged(*sides()))
    return of_each_map(c.select("rect_id", "maps", *[F.col(f"c.{k}").alias(f"m{k}") for k in "xywh"])).select("rect_id", "map_ord", "mx", "my", "mw", "mh")


@query("rect_inside", "sw_rects maps", f"WITH {RM} SELECT rect_id, map_ord, (west <= x AND x < west+width AND south <= y AND y < south+height) AS point_inside, (west <= x AND x+w < west+width AND south <= y AND y+h < south+height) AS area_inside FROM rm")
def rect_inside(spark, sf):
    a, b = sides()
    c = rects_and_places(spark, sf)
    return of_each_map(c.select("rect_id", "maps", g.contains(a[0], a[1], *b).alias("point_inside"), g.area_inside(b, a).alias("area_inside"))).select("rect_id", "map_ord", "point_inside", "area_inside")


@query("rect_scale", "sw_rects", "SELECT rect_id, x+7 AS moved_x, y-3 AS moved_y, x/100.0::DOUBLE AS fx, y/100.0::DOUBLE AS fy, w/100.0::DOUBLE AS fw, h/100.0::DOUBLE AS fh, round_even(x/100.0::DOUBLE*25, 0)::BIGINT AS ix, round_even(y/100.0::DOUBLE*25, 0)::BIGINT AS iy, round_even(w/100.0::DOUBLE*25, 0)::BIGINT AS iw, round_even(h/100.0::DOUBLE*25, 0)::BIGINT AS ih FROM sw_rects")
def rect_scale(spark, sf):
    f = {c: g.to_degrees(F.col(c), U) for c in "xywh"}
    return sw_rects(spark, sf).select("rect_id", (F.col("x") + 7).alias("moved_x"), (F.col("y") - 3).alias("moved_y"), *[v.alias(f"f{c}") for c, v in f.items()], *[g.to_grid(v, 25).alias(f"i{c}") for c, v in f.items()])


@query("rect_props", "sw_rects", "SELECT rect_id, w*h AS area, x+w AS east, y+h AS north, x AS west, y AS south, x + w/2.0::DOUBLE AS cx, y + h/2.0::DOUBLE AS cy FROM sw_rects")
def rect_props(spark, sf):
    x, y, w, h = (F.col(c) for c in "xywh")
    return sw_rects(spark, sf).select("rect_id", (w * h).alias("area"), (x + w).alias("east"), (y + h).alias("north"), x.alias("west"), y.alias("south"), (x + w / 2.0).alias("cx"), (y + h / 2.0).alias("cy"))


SEG = "s AS (SELECT event_id, floor(lon*100 + 0.5)::BIGINT AS first, ceil(east*100 - 0.5)::BIGINT AS last FROM (SELECT event_id, lon, lon + (event_id % 37)/250.0::DOUBLE AS east FROM pts) a)"


@query("seg_grid", "pts", f"WITH {SEG} SELECT event_id, first, last, last - first + 1 AS n, (first - 0.5::DOUBLE)/100 AS start, (last + 0.5::DOUBLE)/100 AS stop FROM s")
def seg_grid(spark, sf):
    s = boxes(spark, sf).select("event_id", g.segment_of(F.col("lon"), F.col("east"), U).alias("s")).select("event_id", "s.*")
    return s.select("event_id", "first", "last", "n", ((F.col("first") - 0.5) / 100).alias("start"), ((F.col("last") + 0.5) / 100).alias("stop"))


@query("seg_split", "pts", f"WITH {SEG} SELECT event_id, k, first + k*4 AS part_first, least(first + k*4 + 3, last) AS part_last FROM (SELECT event_id, first, last, unnest(generate_series(0, (last-first+1+3)//4 - 1)) AS k FROM s WHERE last >= first) a")
def seg_split(spark, sf):
    s = seg_grid(spark, sf).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(n + 3) div 4 - 1"))))
    return s.select("event_id", "k", (F.col("first") + F.col("k") * 4).alias("part_first"), F.least(F.col("first") + F.col("k") * 4 + 3, F.col("last")).alias("part_last"))


@query("seg_float_split", "pts", "WITH s AS (SELECT event_id, lon AS a, lon + (event_id % 37)/250.0::DOUBLE AS z FROM pts) SELECT event_id, k, a + k*0.05::DOUBLE AS part_start, least(a + (k+1)*0.05::DOUBLE, z) AS part_end, z - a AS size, (a + z)/2 AS center FROM (SELECT event_id, a, z, unnest(generate_series(0, ceil((z-a)/0.05::DOUBLE)::BIGINT - 1)) AS k FROM s WHERE z > a) b")
def seg_float_split(spark, sf):
    s = boxes(spark, sf).select("event_id", F.col("lon").alias("a"), F.col("east").alias("z")).where("z > a")
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil((F.col("z") - F.col("a")) / 0.05) - 1)))
    return s.select("event_id", "k", (F.col("a") + F.col("k") * 0.05).alias("part_start"), F.least(F.col("a") + (F.col("k") + 1) * 0.05, F.col("z")).alias("part_end"), (F.col("z") - F.col("a")).alias("size"), ((F.col("a") + F.col("z")) / 2).alias("center"))


@query("bit_widths", "", "SELECT p_partkey, (CASE WHEN p_partkey <= 1 THEN 1 ELSE length(bin(p_partkey - 1)) END)::BIGINT AS code_bits, (CASE WHEN p_size <= 2 THEN 1 WHEN p_size <= 4 THEN 2 WHEN p_size <= 16 THEN 4 WHEN p_size <= 256 THEN 8 END)::BIGINT AS sub_byte FROM part")
def bit_widths(spark, sf):
    return d.read(spark, sf, "part").select("p_partkey", g.bits_of(F.col("p_partkey")).alias("code_bits"), g.sub_byte_width(F.col("p_size")).alias("sub_byte"))


@query("varint_size", "", "SELECT p_partkey, n, (CASE WHEN n < 252 THEN 1 WHEN n < 508 THEN 2 WHEN n < 66044 THEN 3 WHEN n < 16843260 THEN 4 ELSE 5 END)::BIGINT AS size FROM (SELECT p_partkey, p_partkey * p_partkey * 97 AS n FROM part) a")
def varint_size(spark, sf):
    p = d.read(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * F.col("p_partkey") * 97).alias("n"))
    return p.select("p_partkey", "n", g.varint_size(F.col("n")).alias("size"))


@query("pow2_check", "", "SELECT p_partkey, (p_partkey > 0 AND (p_partkey & (p_partkey - 1)) = 0) AS pow2 FROM part")
def pow2_check(spark, sf):
    return d.read(spark, sf, "part").select("p_partkey", g.is_power_of_two(F.col("p_partkey")).alias("pow2"))


@query("code_index", "code_requests", "SELECT seq, code, CASE WHEN code > 0 THEN code - 1 END AS idx FROM code_requests")
def code_index(spark, sf):
    return d.code_requests(spark, sf).select("seq", "code", g.code_to_index(F.col("code")).alias("idx"))


@query("path_format", "paths", "SELECT code, array_to_string(list_filter([l1, l2, l3, l4], lambda p: p <> ''), ' / ') AS path FROM paths")
def path_format(spark, sf):
    return d.paths(spark, sf).select("code", g.display_path([F.col(c) for c in ("l1", "l2", "l3", "l4")]).alias("path"))


@query(
    "hsv_ramp",
    "runs",
    """WITH v AS (SELECT map_ord, y, x0, (code % 61)/60.0::DOUBLE AS h, 0.5::DOUBLE + (map_ord % 4)/8.0::DOUBLE AS s, 1.0::DOUBLE - (y % 5)/10.0::DOUBLE AS v FROM runs),
w AS (SELECT *, floor(h*6)::INT AS i, v*(1-s) AS p, v*(1-s*(h*6-floor(h*6))) AS q, v*(1-s*(1-(h*6-floor(h*6)))) AS t FROM v)
SELECT map_ord, y, x0, floor(255*CASE i WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END)::BIGINT AS r,
floor(255*CASE i WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q WHEN 4 THEN p WHEN 5 THEN p ELSE v END)::BIGINT AS g,
floor(255*CASE i WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v WHEN 5 THEN q ELSE v END)::BIGINT AS b FROM w""",
)
def hsv_ramp(spark, sf):
    """Every run in a colour: its code is the hue, its map the saturation, its row the brightness."""
    r = d.runs(spark, sf)
    hue, full, bright = (F.col("code") % 61) / 60.0, F.lit(0.5) + (F.col("map_ord") % 4) / 8.0, F.lit(1.0) - (F.col("y") % 5) / 10.0
    return r.select("map_ord", "y", "x0", g.hsv_to_rgb(hue, full, bright).alias("c")).select("map_ord", "y", "x0", "c.*")


#: Characters beyond ASCII that names end in here, and their bytes in CP932 and UTF-16. Fixed values.
TAILS = (("", "", ""), ("京", "8B9E", "AC4E"), ("ア", "8341", "A230"), ("ｱ±", "B1817D", "71FFB100"))
NAME = "l4 || CASE code % 4 " + " ".join(f"WHEN {k} THEN '{t}'" for k, (t, _, _) in enumerate(TAILS)) + " END"
WIDE = "regexp_replace(hex(encode(l4)), '(..)', '\\100', 'g') || CASE code % 4 " + " ".join(f"WHEN {k} THEN '{t}'" for k, (_, _, t) in enumerate(TAILS)) + " END"
NARROW = "hex(encode(l4)) || CASE code % 4 " + " ".join(f"WHEN {k} THEN '{t}'" for k, (_, t, _) in enumerate(TAILS)) + " END"


@query("text_encoding", "paths", f"SELECT code, strlen({NAME})::BIGINT AS utf8_bytes, (length({NAME})*2)::BIGINT AS utf16_bytes, hex(encode({NAME})) AS utf8_hex, {WIDE} AS utf16_hex, {NARROW} AS cp932_hex, {NAME} AS back FROM paths")
def text_encoding(spark, sf):
    """Names in three encodings, and read back from the third; three in four end in characters beyond ASCII."""
    tail = F.get(F.array(*[F.lit(t) for t, _, _ in TAILS]), (F.col("code") % 4).cast("int"))
    p, l4 = d.paths(spark, sf).withColumn("l4", F.concat("l4", tail)), F.col("l4")
    sizes = [F.length(g.encoded(l4, e)).cast("bigint").alias(n) for e, n in (("utf8", "utf8_bytes"), ("utf-16-le", "utf16_bytes"))]
    return p.select("code", *sizes, *[F.hex(g.encoded(l4, e)).alias(n) for e, n in (("utf8", "utf8_hex"), ("utf-16-le", "utf16_hex"), ("cp932", "cp932_hex"))], g.decoded(g.encoded(l4, "cp932"), "cp932").alias("back"))


@query("block_index", "gpts", "SELECT event_id, (x//16)::BIGINT AS bx, (y//16)::BIGINT AS by_, (x//16 + (y//16)*1000)::BIGINT AS block FROM gpts")
def block_index(spark, sf):
    bx, by = g.floor_div(F.col("x"), 16), g.floor_div(F.col("y"), 16)
    return pt_project(spark, sf).select("event_id", bx.alias("bx"), by.alias("by_"), (bx + by * 1000).alias("block"))


SIZE = 16
CELL = f"c AS (SELECT map_ord, x AS cx, y AS cy, (y % {SIZE}) * {SIZE} + x % {SIZE} AS i, x % {SIZE} AS x, y % {SIZE} AS y, {SIZE} AS n FROM cells)"
DIAG = "CASE WHEN x+y < n THEN (x+y)*(x+y+1)//2 ELSE n*n - (2*n-1-x-y)*(2*n-x-y)//2 END"
SCAN_SQL = {
    "zigzag": "CASE WHEN y % 2 = 0 THEN i ELSE y*n + n-1-x END",
    "mirror": "y*n + n-1-x",
    "transpose": "x*n + y",
    "mirror_zigzag": "CASE WHEN y % 2 = 0 THEN y*n + n-1-x ELSE i END",
    "zigzag_transpose": "CASE WHEN y % 2 = 0 THEN x*n + y ELSE (n-1-x)*n + y END",
    "diagonal": f"{DIAG} + y - greatest(x+y-n+1, 0)",
    "diagonal_zigzag": f"{DIAG} + CASE WHEN (x+y) % 2 = 0 THEN y ELSE x END - greatest(x+y-n+1, 0)",
    "spiral": "n*n - (n-2*least(x,y,n-1-x,n-1-y))*(n-2*least(x,y,n-1-x,n-1-y)) + CASE WHEN y = least(x,y,n-1-x,n-1-y) THEN x - least(x,y,n-1-x,n-1-y) WHEN x = n-1-least(x,y,n-1-x,n-1-y) THEN n-1-2*least(x,y,n-1-x,n-1-y) + y - least(x,y,n-1-x,n-1-y) WHEN y = n-1-least(x,y,n-1-x,n-1-y) THEN 2*(n-1-2*least(x,y,n-1-x,n-1-y)) + n-1-x - least(x,y,n-1-x,n-1-y) ELSE 3*(n-1-2*least(x,y,n-1-x,n-1-y)) + n-1-y - least(x,y,n-1-x,n-1-y) END",
}


def _scan(name):
    forward, back = g.SCANS[name]

    @query(f"scan_{name}", "cells", f"WITH {CELL} SELECT map_ord, cx AS x, cy AS y, ({SCAN_SQL[name]})::BIGINT AS position, i::BIGINT AS cell FROM c")
    def scan(spark, sf):
        """Every cell's place in the scan of its block, and the cell that the place leads back to."""
        i = F.pmod("y", F.lit(SIZE)) * SIZE + F.pmod("x", F.lit(SIZE))
        p = cells_of(d.runs(spark, sf), "map_ord").select("map_ord", "x", "y", forward(i, SIZE).alias("position"))
        return p.withColumn("cell", back(F.col("position"), SIZE))


for _name in g.SCANS:
    _scan(_name)


@query("scan_reorder", "maps", "SELECT map_ord, array_to_string(list_transform(generate_series(0, 15), lambda i: (map_ord*100 + CASE WHEN (i//4) % 2 = 0 THEN i ELSE (i//4)*4 + 3 - i % 4 END)::VARCHAR), ',') AS reordered FROM maps")
def scan_reorder(spark, sf):
    values = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.col("map_ord") * 100 + i)
    return d.maps(spark, sf).select("map_ord", F.array_join(g.reordered(values, g.zigzag, 4).cast("array<string>"), ",").alias("reordered"))
