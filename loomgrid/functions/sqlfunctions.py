"""Functions for SQL: table functions written in SQL, and a colour callback over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

TABLE_FUNCTIONS = {
    "segment_parts(first BIGINT, last BIGINT, size BIGINT)": (
        "k BIGINT, part_first BIGINT, part_last BIGINT",
        "SELECT k, first + k * size, least(first + (k + 1) * size - 1, last) FROM (SELECT explode(CASE WHEN last >= first THEN sequence(0L, (last - first) div size) ELSE array() END) AS k)",
    ),
    "interval_parts(a DOUBLE, z DOUBLE, size DOUBLE)": (
        "k BIGINT, part_start DOUBLE, part_end DOUBLE",
        "SELECT k, a + k * size, least(a + (k + 1) * size, z) FROM (SELECT explode(CASE WHEN z > a THEN sequence(0L, ceil((z - a) / size) - 1) ELSE array() END) AS k)",
    ),
    "run_cells(x0 BIGINT, len BIGINT)": ("x BIGINT", "SELECT explode(CASE WHEN len > 0 THEN sequence(x0, x0 + len - 1) ELSE array() END)"),
}
COLOR = "r int, g int, b int, a int"
#: code, x and y of a batch to a frame of r, g, b and a; a row of nulls leaves the colour to the default.
Resolver = Callable[[pd.Series, pd.Series, pd.Series], pd.DataFrame]


def register(spark: SparkSession) -> None:
    """Temporary table functions of the session: segment_parts, interval_parts and run_cells."""
    for head, (columns, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE({columns}) RETURN {body}")


def register_resolver(spark: SparkSession, name: str, resolver: Resolver) -> None:
    """name(code, x, y) for SQL: struct(r, g, b, a), or null where the resolver leaves a row without one."""

    def run(code: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return resolver(code, x, y)

    spark.udf.register(name, F.pandas_udf(run, COLOR))
