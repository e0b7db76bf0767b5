"""Tiles of an atlas as folders of JSON rows, beside a manifest that names those that are there.

A tile without a set code has no folder, and reads as 0. A scan opens the folders that the manifest names, and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.grid import floor_div
from loomgrid.operators.atlas import Atlas, small

from .rasterjson import manifest, parse_manifest

ROW = "map_ord long, y long, x0 long, x1 long, code long"


def tile_grid(atlas: Atlas) -> DataFrame:
    """One row: the column and row of the first tile, and the number of both."""
    n = atlas.bucket
    b = atlas.bounds().select(floor_div(F.col("x"), n).alias("c0"), floor_div(F.col("y"), n).alias("r0"), floor_div(F.col("x") + F.col("w") - 1, n).alias("c1"), floor_div(F.col("y") + F.col("h") - 1, n).alias("r1"))
    return b.select("c0", "r0", (F.col("c1") - F.col("c0") + 1).alias("columns"), (F.col("r1") - F.col("r0") + 1).alias("rows"))


def write_tiles(atlas: Atlas, path: str) -> None:
    """Pieces of runs in tiles of bucket x bucket cells, counted from the atlas's corner."""
    grid = tile_grid(atlas)
    pieces = atlas.global_runs().where("code <> 0").join(F.broadcast(grid))  # one row
    placed = pieces.withColumn("tile", F.format_string("%03d_%03d", F.col("b") - F.col("c0"), floor_div(F.col("y"), atlas.bucket) - F.col("r0")))
    ordered = placed.select("map_ord", "y", "x0", "x1", "code", "tile").repartition("tile").sortWithinPartitions("tile", "map_ord", "y", "x0")
    ordered.write.partitionBy("tile").json(f"{path}/tiles")
    there = atlas.maps.sparkSession.read.schema(f"{ROW}, tile string").json(f"{path}/tiles").select("tile").distinct()
    every = grid.select("columns", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)).alias("gy")).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("columns") - 1)).alias("gx"), "gy")
    known = every.join(there.withColumn("present", F.lit(True)), F.format_string("%03d_%03d", "gx", "gy") == F.col("tile"), "left").select("gx", "gy", F.coalesce("present", F.lit(False)).alias("present"))
    manifest(known, "json").coalesce(1).write.text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(gx, gy, file); file is null for a tile that isn't there."""
    return parse_manifest(spark.read.text(f"{path}/manifest").withColumnRenamed("value", "json"))


def read_tiles(spark: SparkSession, path: str, tiles: DataFrame | None = None) -> DataFrame:
    """(gx, gy, map_ord, y, x0, x1, code) of tiles (gx, gy; all of them if none are named) that the manifest has.

    The manifest is one document, so its names are few: they are the paths that the scan is given.
    """
    known = read_manifest(spark, path)
    if tiles is not None:
        known = known.join(small(tiles.select("gx", "gy").distinct()), ["gx", "gy"], "left_semi")
    names = [r["file"].rsplit(".", 1)[0] for r in known.where("file is not null").select("file").collect()]
    schema = f"{ROW}, tile string"
    if not names:
        found = spark.createDataFrame([], schema)
    else:
        found = spark.read.schema(schema).option("basePath", f"{path}/tiles").json([f"{path}/tiles/tile={n}" for n in names])
    place = F.split("tile", "_")
    return found.select(F.get(place, 0).cast("bigint").alias("gx"), F.get(place, 1).cast("bigint").alias("gy"), "map_ord", "y", "x0", "x1", "code")
