"""Reference dimensions, read by Spark from plain CSV files with declared schemas.

The files in reference/ travel with the package. A folder of files of the same names and columns, in any store
that Spark reads, may take their place. All these tables are small and fixed.
"""

from __future__ import annotations

import csv
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "countries": "iso3 string, iso2 string, name string, un_subregion string",
    "aliases": "alias string, iso3 string, alias_type string",
    "indicators": "ordinal int, concept string, name string, unit string, domain string, valid_min double, valid_max double, unicef_headline_age string, who_series string, worldbank_series string, unicef_series string",
    "vocabulary": "dimension string, source string, source_value string, canonical string",
    "sources": "source string, priority int",
}


def _lines(name: str) -> list[str]:
    """The packaged file without its comment, header first."""
    text = (files(__package__) / "reference" / f"{name}.csv").read_text(encoding="utf-8")
    return [line for line in text.splitlines() if line and not line.startswith("#")]


def dimension(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """One reference table; a header that isn't that of the schema raises ValueError."""
    schema = SCHEMAS[name]
    if folder is not None:
        return spark.read.schema(schema).csv(f"{folder}/{name}.csv", header=True, enforceSchema=False, comment="#", escape='"')
    header, *rows = _lines(name)
    if header.split(",") != [column.split()[0] for column in schema.split(", ")]:
        raise ValueError(f"{name}.csv has the columns {header}")
    parsed = F.from_csv("line", schema, {"escape": '"'}).alias("r")
    return spark.createDataFrame([(row,) for row in rows], "line string").select(parsed).select("r.*")


def countries(spark: SparkSession, folder: str | None = None) -> DataFrame:
    return dimension(spark, "countries", folder)


def aliases(spark: SparkSession, folder: str | None = None) -> DataFrame:
    return dimension(spark, "aliases", folder)


def indicators(spark: SparkSession, folder: str | None = None) -> DataFrame:
    return dimension(spark, "indicators", folder)


def vocabulary(spark: SparkSession, folder: str | None = None) -> DataFrame:
    return dimension(spark, "vocabulary", folder)


def sources(spark: SparkSession, folder: str | None = None) -> DataFrame:
    return dimension(spark, "sources", folder)


def indicator_rows() -> list[dict[str, str]]:
    """The packaged indicators without Spark, for fetchers."""
    return list(csv.DictReader(_lines("indicators")))
