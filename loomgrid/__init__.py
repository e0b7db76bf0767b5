"""loomgrid: gridded region maps and place-name dictionaries as Spark DataFrames."""

__version__ = "0.1.0"
