"""Queries of colours and of the JSON formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.operators import raster as r
from loomgrid.operators import render as v
from loomgrid.operators.atlas import small
from loomgrid.operators.selectors import LonLatBounds, LonLatPointRect, select
from loomgrid.sources import domain as d
from loomgrid.sources import rasterjson as j

from .atlas_queries import OVER, atlas
from .grid_queries import sw_rects
from .registry import query

COLORS = {0: (0, 0, 255, 255), 12: (10, 20, 30, 255), 27: (200, 100, 50, 128)}
DEFAULT = (60, 160, 60, 255)


def _fill_sql(k: int) -> str:
    return "CASE code " + " ".join(f"WHEN {c} THEN {rgba[k]}" for c, rgba in COLORS.items()) + f" ELSE {DEFAULT[k]} END"


FILL_COLS = ", ".join(f"({_fill_sql(k)})::INTEGER AS {c}" for k, c in enumerate("rgba"))


@query("edge_overlay", "sw_rects maps cells", f"WITH {OVER}, en AS (SELECT rect_id, x, y, code, lead(code) OVER (PARTITION BY rect_id, y ORDER BY x) AS e, lead(code) OVER (PARTITION BY rect_id, x ORDER BY y) AS n FROM ov) SELECT rect_id, x, y FROM en WHERE coalesce(e <> code, false) OR coalesce(n <> code, false)")
def edge_overlay(spark, sf):
    return r.edges(atlas(spark, sf).rect_codes(sw_rects(spark, sf)), "rect_id")


def resolve(code, x, y):
    """A callback that makes columns of code, x and y stands between the palette and the default."""
    return F.when(code % 2 == 0, F.struct(((code + x) % 256).cast("int").alias("r"), y.cast("int").alias("g"), F.lit(7).alias("b"), F.lit(255).alias("a")))


SIZED = ("map_ord", "width", "height")
ALL = "one AS (SELECT map_ord, width, height, x, y, code FROM cells JOIN maps USING (map_ord))"
EDGE = "en AS (SELECT *, lead(code) OVER (PARTITION BY map_ord, y ORDER BY x) AS e, lead(code) OVER (PARTITION BY map_ord, x ORDER BY y) AS n FROM one)"
MASK_OF = "mask AS (SELECT map_ord, width, height, x AS img_x, height - 1 - y AS img_y FROM en WHERE "
MASK = f"{ALL}, {EDGE}, {MASK_OF}coalesce(e <> code, false) OR coalesce(n <> code, false))"
MASK0 = f"{ALL}, {EDGE}, {MASK_OF}coalesce(e <> code AND e <> 0 AND code <> 0, false) OR coalesce(n <> code AND n <> 0 AND code <> 0, false))"


def every(spark, sf):
    return r.cells_of(d.runs(spark, sf), "map_ord").join(small(d.maps(spark, sf).select(*SIZED)), "map_ord")


def _grown(width: int) -> str:
    steps = f"generate_series({-((width - 1) // 2)}, {width // 2})"
    return f"grown AS (SELECT DISTINCT map_ord, img_x + dx AS img_x, img_y + dy AS img_y FROM (SELECT *, unnest({steps}) AS dy FROM (SELECT *, unnest({steps}) AS dx FROM mask) a) b WHERE img_x + dx BETWEEN 0 AND width - 1 AND img_y + dy BETWEEN 0 AND height - 1)"


def _masks(spark, sf, options):
    return v.edge_mask(every(spark, sf), F.col("width"), F.col("height"), options, *SIZED).drop("width", "height")


@query("edge_mask", "maps cells", f"WITH {MASK} SELECT map_ord, img_x, img_y FROM mask")
def edge_mask(spark, sf):
    return _masks(spark, sf, v.Edge(include_zero=True))


@query("edge_nozero", "maps cells", f"WITH {MASK0} SELECT map_ord, img_x, img_y FROM mask")
def edge_nozero(spark, sf):
    return _masks(spark, sf, v.Edge())


for _w in (2, 3):

    def _dilated(spark, sf, w=_w):
        return _masks(spark, sf, v.Edge(width=w, include_zero=True))

    query(f"edge_dilate_{_w}", "maps cells", f"WITH {MASK}, {_grown(_w)} SELECT map_ord, img_x, img_y FROM grown")(_dilated)


ON = f"{ALL}, {EDGE}, m0 AS (SELECT *, coalesce(e <> code, false) OR coalesce(n <> code, false) AS m FROM en)"
#: An edge two wide grows to the right and down: a pixel is on if it, its left neighbour or one of the row above is.
ON2 = f"{ON}, m1 AS (SELECT *, m OR coalesce(lag(m) OVER (PARTITION BY map_ord, y ORDER BY x), false) AS mx FROM m0), m2 AS (SELECT *, mx OR coalesce(lead(mx) OVER (PARTITION BY map_ord, x ORDER BY y), false) AS mxy FROM m1)"


@query("edge_image", "maps cells", f"WITH {ON} SELECT map_ord, x AS img_x, height - 1 - y AS img_y, 0::INTEGER AS r, 0::INTEGER AS g, 0::INTEGER AS b, (CASE WHEN m THEN 255 ELSE 0 END)::INTEGER AS a FROM m0")
def edge_image(spark, sf):
    return v.edge_image(every(spark, sf), F.col("width"), F.col("height"), v.Edge(include_zero=True), *SIZED).drop("width", "height")


@query("fill_color", "maps cells", f"WITH {ALL} SELECT map_ord, x AS img_x, height - 1 - y AS img_y, {FILL_COLS} FROM one")
def fill_color(spark, sf):
    return v.fill(every(spark, sf), F.col("height"), v.Fill(COLORS, None, DEFAULT), "map_ord")


@query("fill_resolver", "maps cells", f"WITH {ALL} SELECT map_ord, x AS img_x, height - 1 - y AS img_y, (CASE WHEN code = 0 THEN 0 WHEN code % 2 = 0 THEN (code + x) % 256 ELSE 60 END)::INTEGER AS r, (CASE WHEN code = 0 THEN 0 WHEN code % 2 = 0 THEN y ELSE 160 END)::INTEGER AS g, (CASE WHEN code = 0 THEN 255 WHEN code % 2 = 0 THEN 7 ELSE 60 END)::INTEGER AS b, 255::INTEGER AS a FROM one")
def fill_resolver(spark, sf):
    return v.fill(every(spark, sf), F.col("height"), v.Fill({0: (0, 0, 255, 255)}, resolve, DEFAULT), "map_ord")


@query("image_compose", "maps cells", f"WITH {ON2} SELECT map_ord, x AS img_x, height - 1 - y AS img_y, " + ", ".join(f"(CASE WHEN mxy THEN {e} ELSE {_fill_sql(k)} END)::INTEGER AS {c}" for k, (c, e) in enumerate(zip("rgba", (64, 64, 64, 255)))) + " FROM m2")
def image_compose(spark, sf):
    options = v.Fill(COLORS, None, DEFAULT), v.Edge((64, 64, 64, 255), v.CLEAR, 2, True)
    return v.image(every(spark, sf), F.col("width"), F.col("height"), *options, *SIZED).drop("width", "height")


LEVELS_SQL = ", ".join(f"({n}, {u}, {s})" for n, u, s in d.ZOOM_LEVELS)


@query("zoom_levels", "pts", f"SELECT event_id, level_id::BIGINT AS level_id, round_even(lon*unit, 0)::BIGINT AS x, round_even(lat*unit, 0)::BIGINT AS y, scale::BIGINT AS scale FROM pts JOIN (VALUES {LEVELS_SQL}) v(level_id, unit, scale) ON level_id = event_id % 9")
def zoom_levels(spark, sf):
    """Each point on the grid of the zoom level that is asked for."""
    levels = spark.createDataFrame([(n, u, s) for n, u, s in d.ZOOM_LEVELS], "level_id long, unit long, scale long")
    p = d.points(spark, sf).withColumn("level_id", F.col("event_id") % 9).join(F.broadcast(levels), "level_id")  # nine rows
    return p.select("event_id", "level_id", F.rint(F.col("lon") * F.col("unit")).cast("bigint").alias("x"), F.rint(F.col("lat") * F.col("unit")).cast("bigint").alias("y"), "scale")


def documents(spark, sf):
    return j.raster_documents(d.runs(spark, sf), d.maps(spark, sf), d.UNIT, d.UNIT, F.lit("2026-01-02 03:04:05").cast("timestamp"), F.format_string("00000000-0000-4000-8000-%012d", "map_ord"), "derived")


@query("json_raster", "runs", "SELECT map_ord, y, x0, len, code FROM runs")
def json_raster(spark, sf):
    """Runs written as documents, parsed and checked, and laid out as runs again."""
    return j.runs_of(j.parse_documents(documents(spark, sf)))


@query("json_raster_rows", "runs", "SELECT map_ord, y, array_to_string(flatten(list([len, code] ORDER BY x0)), ',') AS line FROM runs GROUP BY map_ord, y")
def json_raster_rows(spark, sf):
    return j.raster_rows(d.runs(spark, sf), "map_ord").select("map_ord", "y", F.array_join(F.transform("line", lambda n: n.cast("string")), ",").alias("line"))


@query("json_location", "maps", "SELECT map_ord, 100::BIGINT AS unit_x, west AS lon, south AS lat, width AS lwidth, height AS lheight, 1::BIGINT AS quadrant, 'WGS84' AS coordsystem, '20260102T030405Z' AS created FROM maps")
def json_location(spark, sf):
    p = j.parse_documents(documents(spark, sf)).select("map_ord", "doc.location", "doc.metadata")
    b = [F.col(f"location.bounds.{c}").alias(c) for c in ("lon", "lat", "lwidth", "lheight", "quadrant")]
    return p.select("map_ord", F.col("location.unit-inv.x").alias("unit_x"), *b, F.col("location.sampling.coordsystem").alias("coordsystem"), F.col("metadata.created-date").alias("created"))


BOX = f"sel AS (SELECT x - 12590 AS x, y - 2190 AS y, coalesce(arg_max(code, map_ord) FILTER (code <> 0), 0)::BIGINT AS code FROM (SELECT 12590 + i % 80 AS x, 2190 + i // 80 AS y FROM (SELECT unnest(generate_series(0, 3999)) AS i) a) p LEFT JOIN (SELECT c.map_ord, c.x + m.west AS x, c.y + m.south AS y, c.code FROM cells c JOIN maps m USING (map_ord)) gc USING (x, y) GROUP BY ALL)"


@query("select_bounds", "maps cells", f"WITH {BOX} SELECT x AS img_x, 49 - y AS img_y, {FILL_COLS} FROM sel")
def select_bounds(spark, sf):
    """A picture of the cells between two coordinates."""
    s = select(atlas(spark, sf), LonLatBounds(125.9, 21.9, 126.7, 22.4))
    return v.fill(s.cells, s.height, v.Fill(COLORS, None, DEFAULT))


@query("select_point", "maps cells", f"WITH {BOX} SELECT x AS img_x, 49 - y AS img_y, {FILL_COLS} FROM sel")
def select_point(spark, sf):
    """The same picture, asked for by its middle."""
    s = select(atlas(spark, sf), LonLatPointRect(126.3, 22.15, 80, 50, "CENTER"))
    return v.fill(s.cells, s.height, v.Fill(COLORS, None, DEFAULT))
