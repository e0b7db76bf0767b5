"""Named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgrid.sources.domain import with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql runs over the supplied tables and the derived ones named."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_tables(tables, sql) if tables else sql
        return f

    return add
