"""Queries in plain SQL, through the session's table functions and a colour callback."""

from __future__ import annotations

import pandas as pd

from loomgrid.functions import sqlfunctions
from loomgrid.sources import domain as d

from .grid_queries import SEG, boxes, seg_grid
from .registry import query


@query("sql_seg_split", "pts", f"WITH {SEG} SELECT event_id, k, first + k*4 AS part_first, least(first + k*4 + 3, last) AS part_last FROM (SELECT event_id, first, last, unnest(generate_series(0, (last-first+1+3)//4 - 1)) AS k FROM s WHERE last >= first) a")
def sql_seg_split(spark, sf):
    sqlfunctions.register(spark)
    return spark.sql("SELECT s.event_id, p.* FROM {segments} s, LATERAL segment_parts(s.first, s.last, 4L) p", segments=seg_grid(spark, sf))


@query("sql_interval_split", "pts", "WITH s AS (SELECT event_id, lon AS a, lon + (event_id % 37)/250.0::DOUBLE AS z FROM pts) SELECT event_id, k, a + k*0.05::DOUBLE AS part_start, least(a + (k+1)*0.05::DOUBLE, z) AS part_end FROM (SELECT event_id, a, z, unnest(generate_series(0, ceil((z-a)/0.05::DOUBLE)::BIGINT - 1)) AS k FROM s WHERE z > a) b")
def sql_interval_split(spark, sf):
    sqlfunctions.register(spark)
    return spark.sql("SELECT b.event_id, p.* FROM {boxes} b, LATERAL interval_parts(b.lon, b.east, 0.05D) p", boxes=boxes(spark, sf))


@query("sql_run_cells", "cells", "SELECT map_ord, x, y, code FROM cells")
def sql_run_cells(spark, sf):
    sqlfunctions.register(spark)
    return spark.sql("SELECT r.map_ord, c.x, r.y, r.code FROM {runs} r, LATERAL run_cells(r.x0, r.len) c", runs=d.runs(spark, sf))


def even_codes(code: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
    """Colours of even codes; others have none."""
    out = pd.DataFrame({"r": (code + x) % 256, "g": y, "b": 7, "a": 255}).astype("Int32")
    return out.where(code % 2 == 0)


@query("sql_resolver", "cells", "SELECT map_ord, x, y, (CASE WHEN code % 2 = 0 THEN (code + x) % 256 ELSE 60 END)::INTEGER AS r, (CASE WHEN code % 2 = 0 THEN y ELSE 160 END)::INTEGER AS g, (CASE WHEN code % 2 = 0 THEN 7 ELSE 60 END)::INTEGER AS b FROM cells")
def sql_resolver(spark, sf):
    sqlfunctions.register(spark)
    sqlfunctions.register_resolver(spark, "even_codes", even_codes)
    cells = sql_run_cells(spark, sf)
    return spark.sql("SELECT map_ord, x, y, coalesce(c.r, 60) AS r, coalesce(c.g, 160) AS g, coalesce(c.b, 60) AS b FROM (SELECT map_ord, x, y, even_codes(code, x, y) AS c FROM {cells}) s", cells=cells)
