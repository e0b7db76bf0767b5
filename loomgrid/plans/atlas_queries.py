"""Queries of lookups in overlapping maps, raster algebra and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions import grid as g
from loomgrid.operators import raster as r
from loomgrid.operators.atlas import Atlas, union
from loomgrid.operators.lexicon import LEVELS
from loomgrid.sources import domain as d

from .grid_queries import BOUNDS, pt_project, sw_rects
from .registry import query
from .tables import materialize


def atlas(spark, sf) -> Atlas:
    return Atlas(d.maps(spark, sf), d.runs(spark, sf), d.UNIT, d.UNIT)


COVER = "cov AS (SELECT p.event_id, p.x, p.y, m.map_ord, r.code FROM gpts p JOIN maps m ON p.x >= m.west AND p.x < m.west + m.width AND p.y >= m.south AND p.y < m.south + m.height JOIN runs r ON r.map_ord = m.map_ord AND r.y = p.y - m.south AND p.x - m.west >= r.x0 AND p.x - m.west < r.x0 + r.len)"
FOUND = f"{COVER}, f AS (SELECT event_id, count(*) AS cover, coalesce(arg_min(code, map_ord) FILTER (code <> 0), 0) AS code FROM cov GROUP BY event_id)"


@query("rg_flagship", "gpts maps runs paths", f"WITH {FOUND} SELECT p.event_id, f.code, CASE WHEN l1 IS NULL THEN '(not found)' ELSE array_to_string(list_filter([l1, l2, l3, l4], lambda q: q <> ''), ' / ') END AS place FROM gpts p LEFT JOIN f USING (event_id) LEFT JOIN paths t ON t.code = f.code")
def rg_flagship(spark, sf):
    """Reverse geocoding: coordinates to codes to place names."""
    named = atlas(spark, sf).named(pt_project(spark, sf), d.paths(spark, sf))
    return named.select("event_id", "code", g.display_path([F.col(c) for c in LEVELS]).alias("place"))


@query("pt_cover", "gpts maps runs", f"WITH {COVER} SELECT event_id, map_ord, code FROM cov")
def pt_cover(spark, sf):
    return atlas(spark, sf).covering(pt_project(spark, sf), "event_id")


@query("pt_overlay", "gpts maps runs", f"WITH {FOUND} SELECT p.event_id, coalesce(f.cover, 0)::BIGINT AS cover, f.code FROM gpts p LEFT JOIN f USING (event_id)")
def pt_overlay(spark, sf):
    return atlas(spark, sf).point_codes(pt_project(spark, sf)).select("event_id", "cover", "code")


@query("pt_single_map", "gpts maps runs", f"WITH {COVER} SELECT p.event_id, c.code FROM gpts p LEFT JOIN (SELECT event_id, code FROM cov WHERE map_ord = 3) c USING (event_id)")
def pt_single_map(spark, sf):
    one = Atlas(d.maps(spark, sf).where("map_ord = 3"), d.runs(spark, sf).where("map_ord = 3"))
    return one.point_codes(pt_project(spark, sf)).select("event_id", "code")


RECT = "px AS (SELECT rect_id, x, y FROM (SELECT rect_id, x, w, unnest(generate_series(y, y+h-1)) AS y FROM sw_rects WHERE w > 0 AND h > 0) a, LATERAL (SELECT unnest(generate_series(a.x, a.x+a.w-1)) AS x) b(x)), gc AS (SELECT c.map_ord, c.x + m.west AS x, c.y + m.south AS y, c.code FROM cells c JOIN maps m USING (map_ord))"
RECT = RECT.replace("SELECT rect_id, x, y FROM (SELECT rect_id, x, w,", "SELECT rect_id, b.px AS x, y FROM (SELECT rect_id, x, w,").replace("AS x) b(x))", "AS px) b)")
OVER = f"{RECT}, ov AS (SELECT p.rect_id, p.x, p.y, coalesce(arg_max(code, map_ord) FILTER (code <> 0), 0)::BIGINT AS code FROM px p LEFT JOIN gc USING (x, y) GROUP BY ALL)"


@query("rect_overlay", "sw_rects maps cells", f"WITH {OVER} SELECT rect_id, x, y, code FROM ov")
def rect_overlay(spark, sf):
    return atlas(spark, sf).rect_codes(sw_rects(spark, sf))


@query("rect_wgs", "sw_rects maps cells", f"WITH {OVER} SELECT rect_id, (x/100.0::DOUBLE) AS lon, (y/100.0::DOUBLE) AS lat, code FROM ov WHERE code > 0")
def rect_wgs(spark, sf):
    """Rectangles given as coordinates, projected and read."""
    r0 = d.req_rects(spark, sf)
    lonlat = r0.select("rect_id", g.to_degrees(F.col("x"), d.UNIT).alias("lon"), g.to_degrees(F.col("y"), d.UNIT).alias("lat"), "w", "h", "anchor")
    placed = lonlat.withColumn("p", g.anchored(g.to_grid(F.col("lon"), d.UNIT), g.to_grid(F.col("lat"), d.UNIT), F.col("w"), F.col("h"), F.col("anchor"))).select("rect_id", "p.x", "p.y", "w", "h")
    c = atlas(spark, sf).rect_codes(placed).where("code > 0")
    return c.select("rect_id", g.to_degrees(F.col("x"), d.UNIT).alias("lon"), g.to_degrees(F.col("y"), d.UNIT).alias("lat"), "code")


@query("rect_local", "maps cells", f"WITH {BOUNDS}, gc AS (SELECT c.map_ord, c.x + m.west AS x, c.y + m.south AS y, c.code FROM cells c JOIN maps m USING (map_ord)), px AS (SELECT i % 40 AS lx, i // 40 AS ly FROM (SELECT unnest(generate_series(0, 1199)) AS i) a) SELECT lx, ly, coalesce(arg_max(code, map_ord) FILTER (code <> 0), 0)::BIGINT AS code FROM px CROSS JOIN bb LEFT JOIN gc ON gc.x = bx + 100 + lx AND gc.y = by_ + 90 + ly GROUP BY ALL")
def rect_local(spark, sf):
    """A rectangle in the set's own coordinates, from the corner of all maps."""
    a = atlas(spark, sf)
    b = a.bounds().select(F.lit(0).alias("rect_id"), (F.col("x") + 100).alias("x"), (F.col("y") + 90).alias("y"), F.lit(40).cast("bigint").alias("w"), F.lit(30).cast("bigint").alias("h"))
    corner = F.broadcast(b.select("rect_id", F.col("x").alias("ox"), F.col("y").alias("oy")))  # one row
    return a.rect_codes(b).join(corner, "rect_id").select((F.col("x") - F.col("ox")).alias("lx"), (F.col("y") - F.col("oy")).alias("ly"), "code")


@query("rect_full", "maps cells", f"WITH {BOUNDS}, gc AS (SELECT c.map_ord, c.x + m.west AS x, c.y + m.south AS y, c.code FROM cells c JOIN maps m USING (map_ord)), w AS (SELECT x, y, arg_max(code, map_ord) FILTER (code <> 0) AS code FROM gc GROUP BY x, y), s AS (SELECT code, count(*) AS n FROM w WHERE code IS NOT NULL GROUP BY code) SELECT code, n::BIGINT AS n FROM s UNION ALL SELECT 0, (bw*bh - (SELECT sum(n) FROM s))::BIGINT FROM bb")
def rect_full(spark, sf):
    """The whole set as one raster, counted by code."""
    return atlas(spark, sf).full().groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("rect_prune", "sw_rects maps", "SELECT rect_id, map_ord FROM maps JOIN sw_rects ON west < x + w AND x < west + width AND south < y + h AND y < south + height WHERE w > 0 AND h > 0")
def rect_prune(spark, sf):
    """The maps that each request meets."""
    return atlas(spark, sf).touching_each(sw_rects(spark, sf))


@query("chunk_padded_rect", "maps cells", "SELECT g.map_ord, g.x, g.y, coalesce(c.code, 0)::BIGINT AS code, (g.x >= width OR g.y >= height) AS padding FROM (SELECT map_ord, width, height, x, unnest(generate_series(0, (height + 31)//32*32 - 1)) AS y FROM (SELECT map_ord, width, height, unnest(generate_series(0, (width + 31)//32*32 - 1)) AS x FROM maps) a) g LEFT JOIN cells c ON c.map_ord = g.map_ord AND c.x = g.x AND c.y = g.y")
def chunk_padded_rect(spark, sf):
    """Every map's image with its edge blocks of 32 filled up, as the chunk level reads it."""
    return r.blocks_filled(d.runs(spark, sf), d.maps(spark, sf), 32)


@query("map_union", "maps", "SELECT (map_ord % 2) * 4294967296 + map_ord AS map_ord, west, south FROM maps")
def map_union(spark, sf):
    m, n = d.maps(spark, sf), d.runs(spark, sf)
    parts = [Atlas(m.where(F.col("map_ord") % 2 == k), n.where(F.col("map_ord") % 2 == k)) for k in (0, 1)]
    return union(*parts).maps.select("map_ord", "west", "south")


@query("raster_equal", "cells", "WITH n AS (SELECT map_ord, count(*) AS n FROM cells GROUP BY 1), s AS (SELECT a.map_ord, b.map_ord - a.map_ord AS step, count(*) AS k FROM cells a JOIN cells b ON b.map_ord - a.map_ord IN (0, 1) AND a.x = b.x AND a.y = b.y AND a.code = b.code GROUP BY ALL) SELECT n.map_ord, coalesce(s0.k = n.n, false) AS same, coalesce(s1.k = n.n AND n.n = n1.n, false) AS other FROM n LEFT JOIN s s0 ON s0.map_ord = n.map_ord AND s0.step = 0 LEFT JOIN s s1 ON s1.map_ord = n.map_ord AND s1.step = 1 LEFT JOIN n n1 ON n1.map_ord = n.map_ord + 1")
def raster_equal(spark, sf):
    """Every map against itself and against the map of the next number; a missing one has no cells."""
    c = materialize(r.row_lines(d.runs(spark, sf), "map_ord"), "lines")
    own = c.select("map_ord").distinct()
    same, other = (r.same_lines(c, c.withColumn("map_ord", F.col("map_ord") - k), "map_ord").withColumnRenamed("equal", name) for k, name in enumerate(("same", "other")))
    # a row a map on each side, which no estimate tells
    return own.join(same.hint("merge"), "map_ord").join(other.hint("merge"), "map_ord").select("map_ord", "same", "other")


ZONE = "floor(sum(x)/count(*))::BIGINT AS cx, floor(sum(y)/count(*))::BIGINT AS cy, min(x)::BIGINT AS x, min(y)::BIGINT AS y, (max(x)-min(x))::BIGINT AS width, (max(y)-min(y))::BIGINT AS height"


@query("zonal_stats", "cells", f"SELECT map_ord, code, count(*)::BIGINT AS n, {ZONE} FROM cells GROUP BY map_ord, code")
def zonal_stats(spark, sf):
    return r.zonal(r.cells_of(d.runs(spark, sf), "map_ord"), "map_ord")


@query("zonal_stats_runs", "cells", f"SELECT map_ord, code, count(*)::BIGINT AS n, {ZONE} FROM cells GROUP BY map_ord, code")
def zonal_stats_runs(spark, sf):
    return r.zonal_of_runs(d.runs(spark, sf), "map_ord")


@query("value_set", "cells", "SELECT DISTINCT map_ord, code FROM cells WHERE x >= 8 AND x < 40 AND y >= 4 AND y < 30")
def value_set(spark, sf):
    return r.cells_of(d.runs(spark, sf), "map_ord").where("x >= 8 AND x < 40 AND y >= 4 AND y < 30").select("map_ord", "code").distinct()


@query("run_value_set", "runs", "SELECT DISTINCT code FROM runs")
def run_value_set(spark, sf):
    return d.runs(spark, sf).select("code").distinct()


@query("code_semi", "runs paths", "SELECT code, l1 FROM paths WHERE code IN (SELECT code FROM runs)")
def code_semi(spark, sf):
    return d.paths(spark, sf).join(d.runs(spark, sf).select("code").distinct(), "code", "left_semi").select("code", "l1")


@query("code_anti", "runs paths", "SELECT code, l1 FROM paths WHERE code NOT IN (SELECT code FROM runs)")
def code_anti(spark, sf):
    return d.paths(spark, sf).join(d.runs(spark, sf).select("code").distinct(), "code", "left_anti").select("code", "l1")


@query("resample_max_area", "cells", "WITH g AS (SELECT map_ord, (x//5)::BIGINT AS x, (y//5)::BIGINT AS y, code, count(*) AS n FROM cells GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY map_ord, x, y ORDER BY n DESC, code) AS k FROM g) SELECT map_ord, x, y, (CASE WHEN n >= 0.5::DOUBLE*25 THEN code ELSE 0 END)::BIGINT AS code FROM f WHERE k = 1")
def resample_max_area(spark, sf):
    return r.resample_max_area(r.cells_of(d.runs(spark, sf), "map_ord"), 5, 0.5, "map_ord")


@query("resample_center", "cells", "SELECT map_ord, (x//5)::BIGINT AS x, (y//5)::BIGINT AS y, code FROM cells WHERE x % 5 = 2 AND y % 5 = 2")
def resample_center(spark, sf):
    return r.resample_center(r.cells_of(d.runs(spark, sf), "map_ord"), 5, "map_ord")


RLE = "m AS (SELECT *, CASE WHEN val IS DISTINCT FROM lag(val) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS n FROM seq_vals WINDOW w AS (PARTITION BY seq_id ORDER BY pos)), k AS (SELECT *, sum(n) OVER (PARTITION BY seq_id ORDER BY pos) - 1 AS run FROM m), e AS (SELECT seq_id, run::BIGINT AS run, min(pos) AS start, count(*)::BIGINT AS count, min(val) AS val FROM k GROUP BY seq_id, run)"


@query("rle_encode", "seq_vals", f"WITH {RLE} SELECT seq_id, run, start, count, val FROM e")
def rle_encode(spark, sf):
    return r.encode_runs(d.seq_vals(spark, sf), ["seq_id"], "pos", "val")


@query("rle_lists", "seq_vals", f"WITH {RLE} SELECT seq_id, array_to_string(list(count ORDER BY run), ',') AS counts, array_to_string(list(val ORDER BY run), ',') AS vals FROM e GROUP BY seq_id")
def rle_lists(spark, sf):
    runs = F.sort_array(F.collect_list(F.struct("run", "count", "val")))
    e = rle_encode(spark, sf).groupBy("seq_id").agg(runs.alias("r"))
    return e.select("seq_id", F.array_join(F.transform("r", lambda x: x["count"].cast("string")), ",").alias("counts"), F.array_join(F.transform("r", lambda x: x["val"]), ",").alias("vals"))


@query("rle_decode", "seq_vals", "SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY pos) - 1 AS i, val FROM seq_vals")
def rle_decode(spark, sf):
    e = rle_encode(spark, sf).groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("run", "count", "val"))).alias("r"))
    flat = F.flatten(F.transform("r", lambda x: F.array_repeat(x["val"], x["count"].cast("int"))))
    return e.select("seq_id", F.posexplode(flat).alias("i", "val")).withColumn("i", F.col("i").cast("bigint"))


@query("rle_clip", "runs", "SELECT map_ord, (y-5)::BIGINT AS y, (greatest(x0, 10) - 10)::BIGINT AS x0, (least(x0+len, 50) - greatest(x0, 10))::BIGINT AS len, code FROM runs WHERE y >= 5 AND y < 25 AND greatest(x0, 10) < least(x0+len, 50)")
def rle_clip(spark, sf):
    return r.clip_runs(d.runs(spark, sf), 10, 5, 40, 20)


@query("rle_validate", "maps runs", "WITH b AS (SELECT * FROM runs WHERE NOT (map_ord = 2 AND y = 7)), g AS (SELECT map_ord, width, unnest(generate_series(0, height-1)) AS y FROM maps), s AS (SELECT map_ord, y, sum(len) AS total, sum(CASE WHEN len <= 0 THEN 1 ELSE 0 END) AS bad FROM b GROUP BY map_ord, y) SELECT map_ord, y, coalesce(total, 0)::BIGINT AS total, width, coalesce(bad, 0)::BIGINT AS bad_runs FROM g FULL JOIN s USING (map_ord, y) WHERE width IS NULL OR coalesce(total, 0) <> width OR coalesce(bad, 0) > 0")
def rle_validate(spark, sf):
    """Finds the one row that is taken out here."""
    return r.violations(d.runs(spark, sf).where("NOT (map_ord = 2 AND y = 7)"), d.maps(spark, sf))


@query("raster_dense", "cells", "SELECT map_ord, y, array_to_string(list(code ORDER BY x), ',') AS codes FROM cells GROUP BY map_ord, y")
def raster_dense(spark, sf):
    runs = d.runs(spark, sf).groupBy("map_ord", "y").agg(F.sort_array(F.collect_list(F.struct("x0", "len", "code"))).alias("r"))
    flat = F.flatten(F.transform("r", lambda x: F.array_repeat(x["code"].cast("string"), x["len"].cast("int"))))
    return runs.select("map_ord", "y", F.array_join(flat, ",").alias("codes"))


@query("raster_sub", "cells", "SELECT map_ord, x - 10 AS x, y - 5 AS y, code FROM cells WHERE x >= 10 AND x < 50 AND y >= 5 AND y < 25")
def raster_sub(spark, sf):
    return r.cells_of(r.clip_runs(d.runs(spark, sf), 10, 5, 40, 20), "map_ord")


@query("raster_pad", "cells maps", "SELECT g.map_ord, g.x, g.y, coalesce(c.code, 7)::BIGINT AS code FROM (SELECT map_ord, x, unnest(generate_series(0, height + 2)) AS y FROM (SELECT map_ord, height, unnest(generate_series(0, width + 4)) AS x FROM maps) a) g LEFT JOIN (SELECT map_ord, x+2 AS x, y+1 AS y, code FROM cells) c ON c.map_ord = g.map_ord AND c.x = g.x AND c.y = g.y")
def raster_pad(spark, sf):
    return r.padded_maps(d.runs(spark, sf), d.maps(spark, sf), 2, 1, 3, 2, 7)


@query("raster_tiles", "cells", "SELECT map_ord, (x//10)::BIGINT AS tx, (y//10)::BIGINT AS ty, (x % 10)::BIGINT AS x, (y % 10)::BIGINT AS y, code FROM cells")
def raster_tiles(spark, sf):
    return r.tiles(r.cells_of(d.runs(spark, sf), "map_ord"), 10, "map_ord")


def _quad_sql(levels: int) -> str:
    ctes = [f"q0 AS (SELECT map_ord, x AS qx, y AS qy, code FROM cells)"]
    out = []
    for k in range(levels):
        ctes.append(f"g{k} AS (SELECT map_ord, qx//2 AS px, qy//2 AS py, min(code) AS code FROM q{k} GROUP BY 1, 2, 3 HAVING count(*) = 4 AND min(code) = max(code))")
        ctes.append(f"q{k + 1} AS (SELECT map_ord, px AS qx, py AS qy, code FROM g{k})")
        out.append(f"SELECT q.map_ord, {k} AS level, q.qx::BIGINT AS qx, q.qy::BIGINT AS qy, q.code FROM q{k} q LEFT JOIN g{k} g ON g.map_ord = q.map_ord AND g.px = q.qx//2 AND g.py = q.qy//2 WHERE g.map_ord IS NULL")
    out.append(f"SELECT map_ord, {levels} AS level, qx::BIGINT AS qx, qy::BIGINT AS qy, code FROM q{levels}")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(out)


#: Maps are 128 wide at most, by their definition; in a larger one the squares would just stop growing there.
QUAD_LEVELS = 7


@query("quad_build", "cells", _quad_sql(QUAD_LEVELS))
def quad_build(spark, sf):
    """All cells of every map; squares that a map's edge cuts stay apart."""
    return r.quadtree(r.cells_of(d.runs(spark, sf), "map_ord"), QUAD_LEVELS, "map_ord")


@query("quad_expand", "cells", "SELECT map_ord, x, y, code FROM cells")
def quad_expand(spark, sf):
    return r.quad_cells(quad_build(spark, sf), "map_ord")


@query("encoding_choice", "runs", "WITH s AS (SELECT map_ord, y, 2*count(*) AS rle, sum(len) AS raw, 1 + count(DISTINCT code) + (sum(len)+1)//2 AS pal FROM runs GROUP BY map_ord, y), c AS (SELECT map_ord, y, 'raw' AS kind, 0 AS t, raw AS size FROM s UNION ALL SELECT map_ord, y, 'rle', 1, rle FROM s UNION ALL SELECT map_ord, y, 'palette', 2, pal FROM s) SELECT map_ord, y, arg_min(kind, size*10 + t) AS kind, min(size)::BIGINT AS size FROM c GROUP BY map_ord, y")
def encoding_choice(spark, sf):
    """The smallest of a row's encodings, the simpler on ties."""
    s = d.runs(spark, sf).groupBy("map_ord", "y").agg((2 * F.count(F.lit(1))).alias("rle"), F.sum("len").alias("raw"), (1 + F.count_distinct("code") + F.expr("(sum(len) + 1) div 2")).alias("pal"))
    best = F.least(*[F.struct(F.col(c).alias("size"), F.lit(t).alias("t"), F.lit(k).alias("kind")) for t, (c, k) in enumerate([("raw", "raw"), ("rle", "rle"), ("pal", "palette")])])
    return s.withColumn("b", best).select("map_ord", "y", "b.kind", "b.size")
