"""Points that arrive as a stream, named as they come. Maps and dictionary are static sides of the join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.grid import display_path, to_grid
from loomgrid.operators.atlas import Atlas
from loomgrid.operators.lexicon import LEVELS

SCHEMA = "event_id long, ts timestamp, lon double, lat double"


def read_points(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of point files that land in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def named(points: DataFrame, atlas: Atlas, paths: DataFrame) -> DataFrame:
    """(event_id, code, place); stateless, so any trigger and restart point will do."""
    grid = points.select("event_id", to_grid(F.col("lon"), atlas.unit_x).alias("x"), to_grid(F.col("lat"), atlas.unit_y).alias("y"))
    return atlas.named(grid, paths).select("event_id", "code", display_path([F.col(c) for c in LEVELS]).alias("place"))


def name_stream(points: DataFrame, atlas: Atlas, paths: DataFrame, out: str, checkpoint: str):
    """Names all that is there, in batches, and ends; files are written once even if a batch is run again."""
    return named(points, atlas, paths).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
