"""Every registered query; importing the modules registers them."""

from . import atlas_queries, file_queries, grid_queries, level_queries, lexicon_queries, picture_queries, sql_queries, store_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
