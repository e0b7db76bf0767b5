"""Domain tables derived from the supplied parquet: maps, runs, points, paths, requests. The same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.plans.ranks import with_global_index

UNIT = 100


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("map_ord"), (12200 + (k * 331) % 600).alias("west"), (2000 + (k * 197) % 400).alias("south"), (64 + (k % 5) * 16).alias("width"), (48 + (k % 3) * 16).alias("height"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # maps are a small file and their runs many rows: dealt by map first, and so grouped by map without another shuffle
    m = maps(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "map_ord")
    rows = m.select("map_ord", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    rows = rows.select("map_ord", "y", F.explode(F.sequence(F.lit(0), F.expr("width div 16 - 1"))).alias("k"))
    v = F.col("map_ord") * 37 + F.col("k") * 11 + F.expr("y div 8") * 7
    return rows.select("map_ord", F.col("y").cast("bigint").alias("y"), (F.col("k") * 16).cast("bigint").alias("x0"), F.lit(16).cast("bigint").alias("len"), F.when(v % 6 == 0, 0).otherwise(1 + v % 150).cast("bigint").alias("code"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return read(spark, sf_dir, "events").select(e, ((121950000 + (e * 7919 + u * 104729) % 7400000) / 1e6).alias("lon"), ((19950000 + (e * 1299709 + u * 15485863) % 5200000) / 1e6).alias("lat"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    n = F.broadcast(read(spark, sf_dir, "nation"))  # 25 rows by definition of the table
    r = F.broadcast(read(spark, sf_dir, "region"))  # 5 rows
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    p = j.select(F.col("r_name").alias("l1"), F.col("n_name").alias("l2"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment")).alias("l3"), F.col("c_name").alias("l4"), "c_custkey")
    return with_global_index(p, ["l1", "l2", "l3", "c_custkey"]).select((F.col("idx") + 1).alias("code"), "l1", "l2", "l3", "l4")


def req_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    anchors = F.array(*[F.lit(a) for a in ("SOUTHWEST", "CENTER", "NORTHWEST", "NORTHEAST", "SOUTHEAST")])
    return read(spark, sf_dir, "part").select(k.alias("rect_id"), (12150 + (k * 37) % 700).alias("x"), (1960 + (k * 53) % 480).alias("y"), (F.col("p_size") % 17).cast("bigint").alias("w"), (F.col("p_size") % 13).cast("bigint").alias("h"), F.get(anchors, (k % 5).cast("int")).alias("anchor"))


def seq_vals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("seq_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("val"))


def code_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    numbered = with_global_index(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "seq")
    # all codes are asked for, and a few that no path has
    n = read(spark, sf_dir, "customer").count()
    return numbered.select((F.col("seq") + 1).alias("seq"), ((F.col("l_partkey") * 7919 + F.col("l_orderkey")) % (n + 20) - 10).alias("code"))


#: The zoom levels of the multi-resolution viewer: level, grid units a degree, display scale. Fixed values.
ZOOM_LEVELS = tuple((n, unit, scale) for n, (unit, scale) in enumerate([(100, 1), (100, 2), (100, 4), (1000, 1), (1000, 2), (1000, 4), (10000, 1), (10000, 2), (10000, 4)]))

SQL = {
    "maps": "SELECT s_suppkey::BIGINT AS map_ord, (12200 + (s_suppkey*331) % 600)::BIGINT AS west, (2000 + (s_suppkey*197) % 400)::BIGINT AS south, (64 + (s_suppkey % 5)*16)::BIGINT AS width, (48 + (s_suppkey % 3)*16)::BIGINT AS height FROM supplier",
    "runs": "SELECT map_ord, y, (16*k)::BIGINT AS x0, 16::BIGINT AS len, (CASE WHEN v % 6 = 0 THEN 0 ELSE 1 + v % 150 END)::BIGINT AS code FROM (SELECT map_ord, y, k, map_ord*37 + k*11 + (y//8)*7 AS v FROM (SELECT map_ord, width, unnest(generate_series(0, height-1)) AS y FROM maps) a, LATERAL (SELECT unnest(generate_series(0, width//16 - 1)) AS k) b) c",
    "cells": "SELECT map_ord, (x0 + d)::BIGINT AS x, y, code FROM (SELECT map_ord, y, x0, code, unnest(generate_series(0, len-1)) AS d FROM runs) a",
    "pts": "SELECT event_id, (121950000 + (event_id*7919 + user_id*104729) % 7400000) / 1000000.0::DOUBLE AS lon, (19950000 + (event_id*1299709 + user_id*15485863) % 5200000) / 1000000.0::DOUBLE AS lat FROM events",
    "gpts": "SELECT event_id, round_even(lon*100, 0)::BIGINT AS x, round_even(lat*100, 0)::BIGINT AS y FROM pts",
    "paths": "SELECT row_number() OVER (ORDER BY l1, l2, l3, c_custkey) AS code, l1, l2, l3, l4 FROM (SELECT r_name AS l1, n_name AS l2, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS l3, c_name AS l4, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) a",
    "req_rects": "SELECT p_partkey AS rect_id, (12150 + (p_partkey*37) % 700)::BIGINT AS x, (1960 + (p_partkey*53) % 480)::BIGINT AS y, (p_size % 17)::BIGINT AS w, (p_size % 13)::BIGINT AS h, CASE p_partkey % 5 WHEN 0 THEN 'SOUTHWEST' WHEN 1 THEN 'CENTER' WHEN 2 THEN 'NORTHWEST' WHEN 3 THEN 'NORTHEAST' ELSE 'SOUTHEAST' END AS anchor FROM part",
    "sw_rects": "SELECT rect_id, (x - CASE anchor WHEN 'CENTER' THEN w//2 WHEN 'NORTHEAST' THEN w WHEN 'SOUTHEAST' THEN w ELSE 0 END)::BIGINT AS x, (y - CASE anchor WHEN 'CENTER' THEN h//2 WHEN 'NORTHWEST' THEN h WHEN 'NORTHEAST' THEN h ELSE 0 END)::BIGINT AS y, w, h FROM req_rects",
    "seq_vals": "SELECT o_custkey AS seq_id, o_orderkey AS pos, o_orderstatus AS val FROM orders",
    "code_requests": "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq, ((l_partkey*7919 + l_orderkey) % ((SELECT count(*) FROM customer) + 20) - 10)::BIGINT AS code FROM lineitem",
}
NEEDS = {"runs": ["maps"], "cells": ["runs"], "gpts": ["pts"], "sw_rects": ["req_rects"]}


def with_tables(names: str, body: str) -> str:
    """body under CTEs of the named tables and what they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    if body.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body.lstrip()[15:]}"
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes}, {body.lstrip()[5:]}"
    return f"WITH {ctes} {body}"
