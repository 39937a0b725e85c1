"""Tessera: indicator integration, data quality and panel analytics on Spark DataFrames."""

__version__ = "0.1.0"
