"""Typed staging tables with lineage, and the schema contract that guards them.

Values are typed, never cleaned: what can't be typed is null beside its raw text. Every row carries run_id,
source_file and row_num (from 1, in file order).
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import clean_text, typed_double, typed_long, year_of
from tessera.sources.snapshot import SnapshotIntegrityError, manifest_files, read_manifest, relative_path, verify_snapshot

# Fields that a source must deliver in every row, and further fields that are known.
REQUIRED = {
    "who": ("IndicatorCode", "SpatialDim", "TimeDim", "NumericValue", "Value"),
    "worldbank": ("indicator.id", "country.id", "countryiso3code", "date", "value"),
    "unicef": ("REF_AREA", "INDICATOR", "TIME_PERIOD", "OBS_VALUE"),
}
KNOWN = {
    "who": "Id SpatialDimType ParentLocationCode ParentLocation TimeDimType Dim1Type Dim1 Dim2Type Dim2 Dim3Type Dim3 DataSourceDimType DataSourceDim Low High Comments Date TimeDimensionValue TimeDimensionBegin TimeDimensionEnd".split(),
    "worldbank": "indicator.value country.value unit obs_status decimal".split(),
    "unicef": "SEX AGE AGE_AT_BIRTH WEALTH_QUINTILE RESIDENCE MOTHER_EDUCATION DATA_SOURCE UNIT_MULTIPLIER UNIT_MEASURE SERIES_FOOTNOTE SUB_SECTOR SOWC_FLAG_A DATA_SOURCE_PRIORITY OBS_STATUS OBS_CONF LOWER_BOUND UPPER_BOUND WGTD_SAMPL_SIZE UNWGTD_SAMPL_SIZE OBS_FOOTNOTE SOURCE_LINK TIME_PERIOD_METHOD COVERAGE_TIME COUNTRY_NOTES REF_PERIOD VACCINE FREQ_COLL MATERNAL_EDU_LVL HEAD_OF_HOUSE REPORTING_LVL INDICATOR_METADATA CUSTODIAN PUBLICATION_DATE STD_ERR".split(),
}
UNREADABLE = "<unreadable structure>"

#: Typed columns by source: name, raw field, kind.
WHO = [("who_id", "Id", "long"), ("indicator_code", "IndicatorCode", "text"), ("spatial_dim_type", "SpatialDimType", "text"), ("spatial_dim", "SpatialDim", "text"), ("parent_location_code", "ParentLocationCode", "text"), ("parent_location", "ParentLocation", "text"), ("time_dim_type", "TimeDimType", "text"), ("time_dim", "TimeDim", "int"), ("dim1_type", "Dim1Type", "text"), ("dim1", "Dim1", "text"), ("dim2_type", "Dim2Type", "text"), ("dim2", "Dim2", "text"), ("dim3_type", "Dim3Type", "text"), ("dim3", "Dim3", "text"), ("data_source_dim_type", "DataSourceDimType", "text"), ("data_source_dim", "DataSourceDim", "text"), ("value_text", "Value", "text"), ("numeric_value", "NumericValue", "double"), ("low", "Low", "double"), ("high", "High", "double"), ("comments", "Comments", "text"), ("source_modified_at", "Date", "timestamp")]
WORLDBANK = [("indicator_id", "indicator.id", "text"), ("indicator_name", "indicator.value", "text"), ("country_id", "country.id", "text"), ("country_name", "country.value", "text"), ("country_iso3", "countryiso3code", "text"), ("date_text", "date", "text"), ("year", "date", "int"), ("value", "value", "double"), ("unit", "unit", "text"), ("obs_status", "obs_status", "text"), ("decimals", "decimal", "int")]
UNICEF = [("ref_area", "REF_AREA", "text"), ("indicator", "INDICATOR", "text"), ("sex", "SEX", "text"), ("age", "AGE", "text"), ("wealth_quintile", "WEALTH_QUINTILE", "text"), ("residence", "RESIDENCE", "text"), ("data_source", "DATA_SOURCE", "text"), ("unit_measure", "UNIT_MEASURE", "text"), ("time_period", "TIME_PERIOD", "text"), ("year", "TIME_PERIOD", "year"), ("value_text", "OBS_VALUE", "text"), ("obs_value", "OBS_VALUE", "double"), ("lower_bound", "LOWER_BOUND", "double"), ("upper_bound", "UPPER_BOUND", "double"), ("obs_status", "OBS_STATUS", "text"), ("obs_conf", "OBS_CONF", "text"), ("series_footnote", "SERIES_FOOTNOTE", "text"), ("obs_footnote", "OBS_FOOTNOTE", "text")]
_KINDS = {"text": clean_text, "double": typed_double, "long": typed_long, "int": lambda c: typed_long(c).try_cast("int"), "year": year_of, "timestamp": lambda c: F.try_to_timestamp(clean_text(c))}


class SchemaError(Exception):
    """A raw file lacks a required field; nothing of its snapshot is loaded."""


def raw_files(spark: SparkSession, run_dir: str, files: DataFrame, source: str) -> DataFrame:
    """(run_id, source_file, content) of a source's files, read by Spark."""
    listed = files.where(F.col("source") == source).select("run_id", "path")
    paths = [f"{run_dir}/{r.path}" for r in listed.collect()]
    if not paths:
        return spark.createDataFrame([], "run_id string, source_file string, content binary")
    stored = spark.read.format("binaryFile").load(paths).select(relative_path(F.col("path"), run_dir).alias("source_file"), "content")
    return stored.join(listed.withColumnRenamed("path", "source_file"), "source_file").select("run_id", "source_file", "content")


def json_rows(raw: DataFrame, source: str) -> DataFrame:
    """(run_id, source_file, row_num, row): the rows of JSON files as JSON text; unreadable files give a null row."""
    text = F.decode("content", "UTF-8")
    rows = F.from_json(text, "value array<string>")["value"] if source == "who" else F.from_json(F.get_json_object(text, "$[1]"), "array<string>")
    return raw.select("run_id", "source_file", F.posexplode_outer(rows).alias("p", "row")).select("run_id", "source_file", (F.col("p") + 1).alias("row_num"), "row")


def csv_rows(raw: DataFrame) -> DataFrame:
    """(run_id, source_file, row_num, row map, columns): rows of CSV files whose headers differ from file to file.

    A file is parsed whole, in one place, so row numbers follow the file; files are parsed in parallel.
    """
    schema = pa.schema([("run_id", pa.string()), ("source_file", pa.string()), ("row_num", pa.int64()), ("row", pa.map_(pa.string(), pa.string())), ("columns", pa.list_(pa.string()))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run_id, name, content in zip(*[batch.column(c).to_pylist() for c in ("run_id", "source_file", "content")], strict=True):
                reader = csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""))
                header = next(reader, [])
                rows = [[(h, v) for h, v in zip(header, line, strict=False)] for line in reader if line]
                for a in range(0, max(1, len(rows)), 5000):
                    part = rows[a : a + 5000] or [None]
                    yield pa.RecordBatch.from_arrays([pa.array([run_id] * len(part)), pa.array([name] * len(part)), pa.array([a + i + 1 if r is not None else 0 for i, r in enumerate(part)], pa.int64()), pa.array(part, schema.field("row").type), pa.array([header] * len(part), pa.list_(pa.string()))], schema=schema)

    return raw.mapInArrow(parse, "run_id string, source_file string, row_num bigint, row map<string,string>, columns array<string>")


def typed_rows(rows: DataFrame, plan: list[tuple[str, str, str]], field) -> DataFrame:
    return rows.select("run_id", "source_file", F.col("row_num").cast("int").alias("row_num"), *[_KINDS[kind](field(raw)).alias(name) for name, raw, kind in plan])


def json_field(name: str) -> Column:
    return F.get_json_object("row", "$." + name if "." in name else f"$['{name}']")


def read_who(spark: SparkSession, run_dir: str, files: DataFrame) -> DataFrame:
    return typed_rows(json_rows(raw_files(spark, run_dir, files, "who"), "who").where(F.col("row").isNotNull()), WHO, json_field)


def read_worldbank(spark: SparkSession, run_dir: str, files: DataFrame) -> DataFrame:
    return typed_rows(json_rows(raw_files(spark, run_dir, files, "worldbank"), "worldbank").where(F.col("row").isNotNull()), WORLDBANK, json_field)


def read_unicef(spark: SparkSession, run_dir: str, files: DataFrame) -> DataFrame:
    rows = csv_rows(raw_files(spark, run_dir, files, "unicef")).where("row_num > 0")
    taken = {raw for _, raw, _ in UNICEF}
    extra = F.map_filter("row", lambda k, v: ~k.isin(*taken) & clean_text(v).isNotNull())
    kept = F.when(F.size(extra) > 0, F.transform_values(extra, lambda _, v: clean_text(v)))
    typed = [_KINDS[kind](F.col("row")[raw]).alias(name) for name, raw, kind in UNICEF]
    return rows.select("run_id", "source_file", F.col("row_num").cast("int").alias("row_num"), *typed, kept.alias("extra"))


READERS = {"who": read_who, "worldbank": read_worldbank, "unicef": read_unicef}


def schema_reports(spark: SparkSession, run_dir: str, files: DataFrame) -> DataFrame:
    """(source, source_file, missing, unexpected) of every file.

    In JSON a required field must be in all rows and a field of any row may be unexpected; nested names are
    joined by dots. A file without rows is in order; one that can't be read misses everything.
    """
    out = None
    for source in ("who", "worldbank"):
        rows = json_rows(raw_files(spark, run_dir, files, source), source)
        nested = lambda parent: F.transform(F.coalesce(F.json_object_keys(F.get_json_object("row", f"$.{parent}")), F.array().cast("array<string>")), lambda k: F.concat(F.lit(parent + "."), k))
        plain = F.filter(F.json_object_keys("row"), lambda k: ~k.isin("indicator", "country"))
        names = F.json_object_keys("row") if source == "who" else F.concat(plain, nested("indicator"), nested("country"))
        keyed = rows.select("source_file", "row", names.alias("names"))
        required = F.array(*[F.lit(x) for x in REQUIRED[source]])
        by_file = keyed.groupBy("source_file").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_except(required, "names"))))).alias("missing"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("all"),
        )
        text = F.decode("content", "UTF-8")
        parsed = F.from_json(text, "value array<string>")["value"] if source == "who" else F.from_json(F.get_json_object(text, "$[1]"), "array<string>")
        good = raw_files(spark, run_dir, files, source).select("source_file", parsed.isNotNull().alias("readable"))
        own = by_file.join(good, "source_file").withColumn("missing", F.when(F.col("readable"), F.col("missing")).otherwise(F.array(F.lit(UNREADABLE))))
        out = _report(own, source) if out is None else out.unionByName(_report(own, source))
    rows = csv_rows(raw_files(spark, run_dir, files, "unicef")).groupBy("source_file").agg(F.first("columns").alias("all"))
    own = rows.withColumn("missing", F.array_except(F.array(*[F.lit(x) for x in REQUIRED["unicef"]]), "all"))
    return out.unionByName(_report(own, "unicef"))


def _report(df: DataFrame, source: str) -> DataFrame:
    known = F.array(*[F.lit(x) for x in (*REQUIRED[source], *KNOWN[source])])
    return df.select(F.lit(source).alias("source"), "source_file", "missing", F.array_sort(F.array_except(F.coalesce("all", F.array().cast("array<string>")), known)).alias("unexpected"))


def stage_snapshot(spark: SparkSession, run_dir: str) -> dict[str, DataFrame]:
    """The three typed tables and the load log of a verified snapshot that keeps the schema contract."""
    problems = verify_snapshot(spark, run_dir).orderBy("path").limit(20).collect()
    if problems:
        raise SnapshotIntegrityError("; ".join(f"{r.path}: {r.problem}" for r in problems))
    files = manifest_files(spark, read_manifest(spark, run_dir))
    reports = schema_reports(spark, run_dir, files).cache()
    broken = reports.where(F.size("missing") > 0).orderBy("source_file").limit(20).collect()
    if broken:
        raise SchemaError("; ".join(f"{r.source_file}: {', '.join(r.missing)}" for r in broken))
    tables = {source: reader(spark, run_dir, files) for source, reader in READERS.items()}
    counts = None
    for source, df in tables.items():
        n = df.groupBy("source_file").agg(F.count("*").alias("rows_loaded"))
        counts = n if counts is None else counts.unionByName(n)
    log = files.select("run_id", F.col("path").alias("source_file"), "source", "series", "concept", "sha256").join(counts, "source_file", "left").na.fill(0, ["rows_loaded"]).join(reports.select("source_file", F.col("unexpected").alias("unexpected_columns")), "source_file", "left")
    return tables | {"load_log": log}


def load_snapshot(spark: SparkSession, run_dir: str, warehouse: str) -> dict[str, int]:
    """Replace the run's partitions of the staging tables; the load log is written last, as the mark of success."""
    staged = stage_snapshot(spark, run_dir)
    for name in (*READERS, "load_log"):
        staged[name].write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{warehouse}/staging/{name}")
    run_id = read_manifest(spark, run_dir)["run_id"]
    return {name: spark.read.parquet(f"{warehouse}/staging/{name}").where(F.col("run_id") == run_id).count() for name in READERS}
