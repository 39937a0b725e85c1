"""Registered queries of staging, classification and accounting on staged tables made from orders, with their SQL.

An order's key decides its source, series, country, year and defects, so the same rows follow from the orders in
Spark and in SQL. Every 29th order is staged twice. The raw scans read payloads of the three formats, one file for
each customer, which the query writes as text columns.
"""

from __future__ import annotations

import csv
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import core, experiments, quality
from tessera.params import CoreParams
from tessera.plans.build import Core, purge_run, write_run
from tessera.plans.api import Reader
from tessera.plans.queries import register, rounded, table
from tessera.session import cut
from tessera.sources import dimensions, staging

PARAMS = CoreParams(year_min=1996, year_max=2000, dependence_min_shared=5)
AGES = (None, None, "_T", "Y15T49", "M12T23", "M12T23", "_T")


def _values(name: str, columns: tuple[str, ...]) -> str:
    """A packaged dimension as VALUES of SQL, numbered in file order."""
    rows = list(csv.DictReader(dimensions._lines(name)))
    quote = lambda v: "NULL" if v == "" else "'" + v.replace("'", "''") + "'"
    return f"{name}(n, {', '.join(columns)}) AS (VALUES " + ", ".join(f"({i + 1}, {', '.join(quote(r[c]) for c in columns)})" for i, r in enumerate(rows)) + ")"


def _rows(spark, sf_dir) -> DataFrame:
    """(k, row_num, source, n, iso3, iso2, name, concept, year, period, value): what the three shapes have in common."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("y"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    both = orders.withColumn("row_num", F.col("k").cast("int")).unionByName(orders.where("k % 29 = 0").withColumn("row_num", (F.col("k") + 10_000_000).cast("int")))
    places = dimensions.countries(spark).select((F.row_number().over(core.Window.orderBy(F.monotonically_increasing_id()))).alias("c"), "iso3", "iso2", "name")
    series = dimensions.indicators(spark).select(F.col("ordinal").alias("n"), "concept")
    k = F.col("k")
    value = F.when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, 250000.0).otherwise((k * 37 % 1000) / 10.0)
    keyed = both.select("*", (k % 7 + 1).cast("int").alias("n"), (F.floor(k / 21) % 56 + 1).cast("int").alias("c"), F.element_at(F.array(F.lit("who"), F.lit("worldbank"), F.lit("unicef")), (k % 3 + 1).cast("int")).alias("source"), F.when(k % 97 != 0, F.col("y")).alias("year"), value.cast("double").alias("value"))
    return keyed.join(places, "c", "left").join(series, "n").withColumn("source_file", F.concat("source", F.lit("/s"), F.col("n").cast("string"), F.lit("/page-0001"))).withColumn("run_id", F.lit("r1"))


def _place() -> F.Column:
    form, iso3 = F.floor(F.col("k") / 5) % 4, F.coalesce("iso3", F.lit("XXX"))
    return F.when(F.col("iso3").isNull() | (form == 0), iso3).when(form == 1, F.concat(F.lit(" "), F.lower(iso3), F.lit(" "))).when(form == 2, F.col("iso2")).otherwise(F.col("name"))


def staged(spark, sf_dir) -> dict[str, DataFrame]:
    """The four staged tables."""
    rows, k = _rows(spark, sf_dir), F.col("k")
    text = F.when(F.col("value").isNull(), F.when(k % 26 == 0, "n/a")).otherwise(F.col("value").cast("string"))
    none = lambda kind: F.lit(None).cast(kind)
    base = ["run_id", "source_file", "row_num"]
    sex = F.when(k % 4 == 0, "SEX_MLE").when(k % 4 == 2, None).when(k % 40 == 3, "SEX_WEIRD").otherwise("SEX_BTSX")
    who = rows.where("source = 'who'").select(
        *base, _place().alias("spatial_dim"), F.col("year").alias("time_dim"), F.col("value").alias("numeric_value"), text.alias("value_text"), none("double").alias("low"), none("double").alias("high"),
        F.when(k % 23 == 0, "OTHER").otherwise("SEX").alias("dim1_type"), sex.alias("dim1"), none("string").alias("dim2_type"), none("string").alias("dim2"), F.lit("WEALTHQUINTILE").alias("dim3_type"), F.when(k % 19 == 0, "WEALTHQUINTILE_WQ1").alias("dim3"), none("string").alias("data_source_dim"),
        F.when(F.col("iso3").isNotNull(), "AFR").alias("parent_location_code"), F.lit("Africa").alias("parent_location"),
    )
    worldbank = rows.where("source = 'worldbank'").select(*base, F.coalesce("iso3", F.lit("XXX")).alias("country_iso3"), F.col("iso2").alias("country_id"), F.col("name").alias("country_name"), F.col("year").cast("string").alias("date_text"), "year", "value")
    extra = F.create_map(F.lit("DATA_SOURCE_PRIORITY"), (k % 5).cast("string"), F.lit("MATERNAL_EDU_LVL"), F.when(k % 37 == 0, "EDU1").otherwise("_T"))
    ages = F.element_at(F.array(*[F.lit(a).cast("string") for a in AGES]), F.col("n"))
    unicef = rows.where("source = 'unicef'").select(
        *base, _place().alias("ref_area"), "year", F.when(k % 2 == 0, F.col("month")).otherwise(F.substring("month", 1, 4)).alias("time_period"), F.col("value").alias("obs_value"), text.alias("value_text"), none("double").alias("lower_bound"), none("double").alias("upper_bound"),
        F.when(k % 6 == 2, "F").otherwise("_T").alias("sex"), F.when(k % 19 == 1, "Q5").alias("wealth_quintile"), F.when(k % 31 == 0, "U").alias("residence"), F.when(k % 4 < 2, ages).otherwise("Y0T4").alias("age"), F.concat(F.lit("S"), (k % 3).cast("string")).alias("data_source"), extra.alias("extra"),
    )
    log = rows.groupBy("run_id", "source_file", "source", "concept").agg(F.count("*").alias("rows_loaded"))
    return {"who": who, "worldbank": worldbank, "unicef": unicef, "load_log": log}


_STD = f"""{_values("countries", ("iso3", "iso2", "name"))}, {_values("indicators", ("concept", "valid_min", "valid_max", "unicef_headline_age"))}, {_values("aliases", ("alias", "iso3"))},
twice AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y, strftime(o_orderdate, '%Y-%m') AS month, CAST(o_orderkey AS INTEGER) AS row_num FROM orders
  UNION ALL SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER), strftime(o_orderdate, '%Y-%m'), CAST(o_orderkey + 10000000 AS INTEGER) FROM orders WHERE o_orderkey % 29 = 0),
r AS (SELECT b.*, ['who', 'worldbank', 'unicef'][CAST(k % 3 + 1 AS INTEGER)] AS source, i.n, i.concept, c.iso3, c.iso2, c.name, CASE WHEN k % 97 <> 0 THEN y END AS year,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN 250000.0::DOUBLE ELSE (k * 37 % 1000) / 10.0::DOUBLE END AS value, CAST(i.valid_min AS DOUBLE) AS valid_min, CAST(i.valid_max AS DOUBLE) AS valid_max, i.unicef_headline_age
  FROM twice b JOIN indicators i ON i.n = b.k % 7 + 1 LEFT JOIN countries c ON c.n = (b.k // 21) % 56 + 1),
std AS (SELECT *, source || '/s' || n || '/page-0001' AS source_file,
  CASE WHEN iso3 IS NULL THEN 'XXX' WHEN source = 'worldbank' OR (k // 5) % 4 = 0 THEN iso3 WHEN (k // 5) % 4 = 1 THEN ' ' || lower(iso3) || ' ' WHEN (k // 5) % 4 = 2 THEN iso2 ELSE name END AS place,
  CASE WHEN source = 'unicef' THEN CASE WHEN k % 2 = 0 THEN month ELSE month[1:4] END ELSE CAST(year AS VARCHAR) END AS period_text,
  CASE WHEN source = 'worldbank' THEN CAST(value AS VARCHAR) WHEN value IS NULL THEN CASE WHEN k % 26 = 0 THEN 'n/a' END ELSE CAST(value AS VARCHAR) END AS value_text,
  CASE source WHEN 'who' THEN CASE WHEN k % 23 = 0 THEN NULL WHEN k % 4 = 0 THEN 'SEX_MLE' WHEN k % 4 = 2 THEN NULL WHEN k % 40 = 3 THEN 'SEX_WEIRD' ELSE 'SEX_BTSX' END WHEN 'unicef' THEN CASE WHEN k % 6 = 2 THEN 'F' ELSE '_T' END END AS sex_raw,
  CASE source WHEN 'who' THEN CASE WHEN k % 19 = 0 THEN 'WEALTHQUINTILE_WQ1' END WHEN 'unicef' THEN CASE WHEN k % 19 = 1 THEN 'Q5' END END AS wealth_raw, CASE WHEN source = 'unicef' AND k % 31 = 0 THEN 'U' END AS residence_raw,
  CASE WHEN source = 'unicef' THEN CASE WHEN k % 37 = 0 THEN 'EDU1' ELSE '_T' END END AS maternal_edu_raw, CASE WHEN source = 'unicef' THEN CASE WHEN k % 4 < 2 THEN unicef_headline_age ELSE 'Y0T4' END END AS age_raw,
  CASE WHEN source = 'unicef' THEN 'S' || k % 3 END AS upstream_label, CASE WHEN source = 'unicef' THEN CAST(k % 5 AS INTEGER) END AS priority, source = 'who' AND k % 23 = 0 AND k % 4 <> 2 AS unexpected_dim FROM r)"""
_NORM = "regexp_replace(translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]', '', 'g')"
_CLASSIFIED = f"""{_STD}, names AS (SELECT lookup, min(iso3) AS iso3 FROM (SELECT {_NORM.format("name")} AS lookup, iso3 FROM countries UNION ALL SELECT {_NORM.format("alias")}, iso3 FROM aliases) GROUP BY lookup),
resolved AS (SELECT s.* EXCLUDE (iso3, iso2, name), coalesce(a.iso3, b.iso3, c.iso3, d.iso3) AS country, CASE WHEN a.iso3 IS NOT NULL THEN 'exact' WHEN b.iso3 IS NOT NULL THEN 'normalized' WHEN c.iso3 IS NOT NULL THEN 'iso2' WHEN d.iso3 IS NOT NULL THEN 'alias' END AS country_resolution,
  CASE sex_raw WHEN 'SEX_MLE' THEN 'male' WHEN 'SEX_BTSX' THEN 'total' WHEN 'F' THEN 'female' WHEN '_T' THEN 'total' WHEN 'SEX_WEIRD' THEN NULL ELSE 'total' END AS sex, CASE wealth_raw WHEN 'WEALTHQUINTILE_WQ1' THEN 'q1' WHEN 'Q5' THEN 'q5' ELSE 'total' END AS wealth_quintile,
  CASE residence_raw WHEN 'U' THEN 'urban' ELSE 'total' END AS residence, CASE WHEN coalesce(maternal_edu_raw, '_T') = '_T' THEN 'total' ELSE maternal_edu_raw END AS maternal_education
  FROM std s LEFT JOIN countries a ON a.iso3 = s.place LEFT JOIN countries b ON b.iso3 = upper(trim(s.place)) LEFT JOIN countries c ON c.iso2 = upper(trim(s.place)) LEFT JOIN names d ON d.lookup = {_NORM.format("s.place")}),
reasoned AS (SELECT *, CASE WHEN country IS NULL THEN 'unknown_country' WHEN year IS NULL OR year NOT BETWEEN 1996 AND 2000 THEN 'invalid_year' WHEN value IS NULL AND value_text IS NOT NULL THEN 'unparseable_value' WHEN value IS NULL THEN 'no_value'
  WHEN value < valid_min OR value > valid_max THEN 'out_of_range' WHEN unexpected_dim OR sex IS NULL THEN 'unmapped_vocabulary' END AS reason FROM resolved),
classified AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL, source, concept, country, year, period_text, sex, wealth_quintile, residence, maternal_education, age_raw, upstream_label, value, priority, maternal_edu_raw ORDER BY source_file, row_num) > 1 THEN 'exact_duplicate' ELSE reason END AS reject_reason FROM reasoned)"""
_FACTS = f"""{_CLASSIFIED}, accepted AS (SELECT *, sex = 'total' AND wealth_quintile = 'total' AND residence = 'total' AND maternal_education = 'total' AND (source <> 'unicef' OR age_raw IS NOT DISTINCT FROM unicef_headline_age) AS is_headline FROM classified WHERE reject_reason IS NULL),
facts AS (SELECT *, is_headline AND row_number() OVER (PARTITION BY source, country, concept, year ORDER BY CASE WHEN is_headline THEN 0 ELSE 1 END, priority DESC NULLS LAST, period_text DESC NULLS FIRST, source_file, row_num) = 1 AS is_selected, CAST(count(*) FILTER (WHERE is_headline) OVER (PARTITION BY source, country, concept, year) AS BIGINT) AS n_candidates FROM accepted)"""


def _core(spark, sf_dir) -> Core:
    return Core(spark, staged(spark, sf_dir), PARAMS)


@register("stage_standardize", f"WITH {_STD} SELECT source, source_file, row_num, concept, place, year, period_text, value, sex_raw, wealth_raw, residence_raw, maternal_edu_raw, age_raw, upstream_label, priority, unexpected_dim FROM std")
def stage_standardize(spark, sf_dir):
    t = staged(spark, sf_dir)
    return core.standardize(t["who"], t["worldbank"], t["unicef"], t["load_log"]).select("source", "source_file", "row_num", "concept", "place", "year", "period_text", "value", "sex_raw", "wealth_raw", "residence_raw", "maternal_edu_raw", "age_raw", "upstream_label", "priority", "unexpected_dim")


@register("stage_classify", f"WITH {_CLASSIFIED} SELECT source_file, row_num, country, country_resolution, sex, wealth_quintile, residence, maternal_education, unicef_headline_age, reject_reason FROM classified")
def stage_classify(spark, sf_dir):
    return _core(spark, sf_dir).classified.select("source_file", "row_num", "country", "country_resolution", "sex", "wealth_quintile", "residence", "maternal_education", "unicef_headline_age", "reject_reason")


@register("stage_rejects", f"WITH {_CLASSIFIED} SELECT source, concept, source_file, row_num, reject_reason AS reason, place AS raw_iso3, CAST(year AS VARCHAR) AS raw_year, sex_raw AS raw_sex FROM classified WHERE reject_reason IS NOT NULL")
def stage_rejects(spark, sf_dir):
    raw = lambda field: F.get_json_object("detail", f"$.{field}")
    return _core(spark, sf_dir).rejected.select("source", "concept", "source_file", "row_num", "reason", raw("iso3").alias("raw_iso3"), raw("year").alias("raw_year"), raw("sex_raw").alias("raw_sex"))


@register("stage_facts", f"WITH {_FACTS} SELECT source_file, row_num, country, year, period_text, value, age_raw AS age_group, is_headline, is_selected, n_candidates, CASE WHEN NOT is_headline THEN NULL WHEN n_candidates = 1 THEN 'single_candidate' ELSE 'source_priority_then_latest_period' END AS selection_rule FROM facts")
def stage_facts(spark, sf_dir):
    return core.facts(_core(spark, sf_dir).classified).select("source_file", "row_num", "country", "year", "period_text", "value", "age_group", "is_headline", "is_selected", "n_candidates", "selection_rule")


_ACCOUNTING = "SELECT CAST((SELECT count(*) FROM std) AS BIGINT) AS staged, CAST((SELECT count(*) FROM classified WHERE reject_reason IS NOT NULL) AS BIGINT) AS rejected, CAST(count(*) AS BIGINT) AS loaded, CAST(count(*) FILTER (WHERE is_headline) AS BIGINT) AS headline, CAST(count(*) FILTER (WHERE is_selected) AS BIGINT) AS selected FROM facts"


@register("build_accounting", f"WITH {_FACTS} {_ACCOUNTING}")
def build_accounting(spark, sf_dir):
    """The whole build, stored twice under two runs; one is purged, and the accounting of the other is read from its log."""
    built = _core(spark, sf_dir)
    folder = f"{cut(spark.range(1)).sparkSession.sparkContext.getCheckpointDir()}/warehouse"
    log = PARAMS.as_dict() | built.accounting()
    for run in ("r0", "r1"):
        write_run({"fact_observation": built.fact, "rejected_record": built.rejected, "fact_reconciled": built.reconciled}, folder, "core", run, log)
        write_run({"country_indicator_year": built.reconciled}, folder, "marts", run, {})
    purge_run(spark, folder, "r1")
    reader = Reader(spark, folder)
    if reader.latest_run() != "r0":
        raise LookupError("the purged run is still there")
    summary = reader.pipeline_summary()
    return spark.createDataFrame([tuple(summary[c] for c in ("staged", "rejected", "loaded", "headline", "selected"))], "staged bigint, rejected bigint, loaded bigint, headline bigint, selected bigint")


@register(
    "core_accounting",
    f"""WITH {_FACTS}, s AS (SELECT source, concept, count(*) AS n FROM std GROUP BY ALL), j AS (SELECT source, concept, count(*) AS rejected FROM classified WHERE reject_reason IS NOT NULL GROUP BY ALL), f AS (SELECT source, concept, count(*) AS loaded, count(*) FILTER (WHERE is_selected) AS selected FROM facts GROUP BY ALL)
SELECT s.source, s.concept, CAST(s.n AS BIGINT) AS n_staged, CAST(coalesce(rejected, 0) AS BIGINT) AS n_rejected, CAST(coalesce(loaded, 0) AS BIGINT) AS n_loaded, CAST(coalesce(selected, 0) AS BIGINT) AS n_selected, round(coalesce(rejected, 0) / s.n, 6) + 0.0 AS reject_rate FROM s LEFT JOIN j USING (source, concept) LEFT JOIN f USING (source, concept)""",
)
def core_accounting(spark, sf_dir):
    built = _core(spark, sf_dir)
    metrics = quality.core_metrics(built.staged["load_log"], built.rejected, core.facts(built.classified), built.reconciled, built.groups).where("scope = 'series'")
    of = lambda metric, column: F.max(F.when(F.col("metric") == metric, F.col(column)))
    wide = metrics.groupBy("source", "concept").agg(of("records_staged", "value").cast("bigint").alias("n_staged"), of("records_rejected", "numerator").cast("bigint").alias("n_rejected"), of("records_loaded", "value").cast("bigint").alias("n_loaded"), of("records_selected", "value").cast("bigint").alias("n_selected"), of("records_rejected", "value").alias("reject_rate"))
    return rounded(wide)


@register(
    "dq_vocabulary",
    f"""WITH {_STD}, v AS (SELECT source, 'distinct_sex_values' AS metric, sex_raw AS v FROM std WHERE source <> 'worldbank' UNION ALL SELECT source, 'distinct_wealth_values', wealth_raw FROM std WHERE source <> 'worldbank')
SELECT source, metric, CAST(count(DISTINCT v) AS DOUBLE) AS value, '[' || string_agg(DISTINCT '"' || v || '"', ',' ORDER BY '"' || v || '"') || ']' AS details FROM v GROUP BY ALL""",
)
def dq_vocabulary(spark, sf_dir):
    t = staged(spark, sf_dir)
    return quality.vocabulary(t["who"], t["unicef"]).where("metric like 'distinct%'").select("source", "metric", F.col("value").cast("double").alias("value"), "details")


@register(
    "dq_schema_variants",
    "WITH h AS (SELECT o_custkey AS series, list_sort(list(DISTINCT o_orderpriority)) AS columns FROM orders GROUP BY o_custkey) SELECT 'distinct_column_sets' AS metric, CAST(count(DISTINCT columns) AS BIGINT) AS numerator, CAST(count(*) AS BIGINT) AS denominator FROM h UNION ALL SELECT 'columns_shared_by_all_series', CAST((SELECT count(*) FROM (SELECT c FROM (SELECT unnest(columns) AS c FROM h) GROUP BY c HAVING count(*) = (SELECT count(*) FROM h))) AS BIGINT), CAST((SELECT count(DISTINCT c) FROM (SELECT unnest(columns) AS c FROM h)) AS BIGINT)",
)
def dq_schema_variants(spark, sf_dir):
    headers = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("series")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("columns"))
    return quality.schema_variants(headers).select("metric", F.col("numerator").cast("bigint").alias("numerator"), F.col("denominator").cast("bigint").alias("denominator"))


@register("reference_check", f"WITH {_STD} SELECT c.iso3, c.iso2, CASE WHEN s.place IS NOT NULL THEN 'AFR' END AS who_region_code FROM countries c LEFT JOIN (SELECT DISTINCT place FROM std WHERE source = 'who' AND iso3 IS NOT NULL) s ON s.place = c.iso3")
def reference_check(spark, sf_dir):
    t = staged(spark, sf_dir)
    return core.check_reference(t["worldbank"], t["who"], dimensions.countries(spark)).select("iso3", "iso2", "who_region_code")


@register("learned_aliases", f"WITH {_STD} SELECT alias, iso3, CASE WHEN min(kind) = 0 THEN 'reference' ELSE 'world_bank_name' END AS kind FROM (SELECT alias, iso3, 0 AS kind FROM aliases UNION ALL SELECT DISTINCT name, iso3, 1 FROM std WHERE source = 'worldbank' AND name IS NOT NULL) GROUP BY alias, iso3")
def learned_aliases(spark, sf_dir):
    found = core.learned_aliases(staged(spark, sf_dir)["worldbank"], dimensions.countries(spark), dimensions.aliases(spark))
    return found.select("alias", "iso3", F.when(F.col("alias_type") == "world_bank_name", "world_bank_name").otherwise("reference").alias("kind"))


# --- raw scans -----------------------------------------------------------------------------------------------------


def _payloads(spark, sf_dir, line: F.Column, head: str, between: str, tail: str) -> DataFrame:
    """(run_id, source_file, content): one payload for each customer, its orders by key."""
    lines = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("source_file"), F.struct(F.col("o_orderkey").alias("k"), line.alias("line")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), between)
    return lines.groupBy("source_file").agg(F.concat(F.lit(head), joined, F.lit(tail)).cast("binary").alias("content")).withColumn("run_id", F.lit("r1"))


_ROW = "CAST(o_custkey AS VARCHAR) AS source_file, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS row_num"


@register("scan_who_json", f"SELECT {_ROW}, o_orderpriority AS indicator_code, o_orderstatus AS spatial_dim, CAST(year(o_orderdate) AS INTEGER) AS time_dim, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS numeric_value, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS value_text FROM orders")
def scan_who_json(spark, sf_dir):
    k = F.col("o_orderkey")
    row = F.to_json(F.struct(F.col("o_orderpriority").alias("IndicatorCode"), F.concat(F.lit(" "), "o_orderstatus").alias("SpatialDim"), F.year("o_orderdate").alias("TimeDim"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("NumericValue"), F.when(k % 5 != 0, k.cast("string")).otherwise(" ").alias("Value")), {"ignoreNullFields": "false"})
    raw = _payloads(spark, sf_dir, row, '{"@odata.context":"x","value":[', ",", "]}")
    return staging.typed_rows(staging.json_rows(raw, "who").where(F.col("row").isNotNull()), staging.WHO, staging.json_field).select("source_file", "row_num", "indicator_code", "spatial_dim", "time_dim", "numeric_value", "value_text")


@register("scan_worldbank_json", f"SELECT {_ROW}, o_orderpriority AS indicator_id, o_orderstatus AS country_iso3, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS value FROM orders")
def scan_worldbank_json(spark, sf_dir):
    k = F.col("o_orderkey")
    row = F.to_json(F.struct(F.struct(F.col("o_orderpriority").alias("id"), F.lit("n").alias("value")).alias("indicator"), F.struct(F.lit("XX").alias("id")).alias("country"), F.col("o_orderstatus").alias("countryiso3code"), F.date_format("o_orderdate", "yyyy").alias("date"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("value")), {"ignoreNullFields": "false"})
    raw = _payloads(spark, sf_dir, row, '[{"page":1,"pages":1},[', ",", "]]")
    return staging.typed_rows(staging.json_rows(raw, "worldbank").where(F.col("row").isNotNull()), staging.WORLDBANK, staging.json_field).select("source_file", "row_num", "indicator_id", "country_iso3", "year", "value")


@register("scan_unicef_csv", f"SELECT {_ROW}, o_orderpriority AS indicator, 'a, ' || o_orderstatus AS ref_area, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS obs_value, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' END AS odd_text, CAST(o_orderkey % 4 AS VARCHAR) AS vaccine FROM orders")
def scan_unicef_csv(spark, sf_dir):
    k = F.col("o_orderkey")
    value = F.when(k % 7 != 0, F.col("o_totalprice").cast("string")).otherwise("n/a")
    line = F.concat_ws(",", F.concat(F.lit('"a, '), "o_orderstatus", F.lit('"')), F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM"), value, (k % 4).cast("string"))
    rows = staging.csv_rows(_payloads(spark, sf_dir, line, "﻿REF_AREA,INDICATOR,TIME_PERIOD,OBS_VALUE,VACCINE\n", "\n", "\n")).where("row_num > 0")
    cell = lambda raw, kind: staging._KINDS[kind](F.col("row")[raw])
    number = cell("OBS_VALUE", "double")
    return rows.select("source_file", F.col("row_num").cast("int").alias("row_num"), cell("INDICATOR", "text").alias("indicator"), cell("REF_AREA", "text").alias("ref_area"), cell("TIME_PERIOD", "year").alias("year"), number.alias("obs_value"), F.when(number.isNull(), cell("OBS_VALUE", "text")).alias("odd_text"), cell("VACCINE", "text").alias("vaccine"))


# --- faults --------------------------------------------------------------------------------------------------------


def _pool(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    built = _core(spark, sf_dir)
    pool = cut(experiments.build_pool(built.fact, built.groups, built.reconciled).withColumn("quality_flags", F.array().cast("array<string>")).withColumn("cell_flagged", F.lit(False)))
    ranges = built.indicators.select("concept", F.col("valid_min").alias("lo"), F.col("valid_max").alias("hi"))
    return pool, built.standard, ranges


@register("fault_plan_validity", f"SELECT fault_type, CAST(10 AS BIGINT) AS n, CAST(10 AS BIGINT) AS n_rows FROM (VALUES {', '.join(f'({t!r})' for t in experiments.VALIDITY)}) t(fault_type)")
def fault_plan_validity(spark, sf_dir):
    """Ten faults of each type, of rows of their own; the plan holds as long as there are enough clean rows."""
    pool, standard, ranges = _pool(spark, sf_dir)
    # A wealth code would make a row no headline; a sex code of the total is what categorical faults replace.
    faults = cut(experiments.plan_validity(pool, standard, dimensions.countries(spark), ranges, 7, 10))
    return faults.groupBy("fault_type").agg(F.count("*").alias("n"), F.count_distinct("source_file", "row_num").alias("n_rows"))


@register("fault_plan_magnitude", "SELECT variant, CAST(5 AS BIGINT) AS n, true AS in_range, true AS of_size FROM (VALUES ('10%'), ('25%'), ('50%'), ('100%'), ('300%')) t(variant)")
def fault_plan_magnitude(spark, sf_dir):
    """Five changes of each size; the changed values lie in the range and are off by the size."""
    pool, _, ranges = _pool(spark, sf_dir)
    pool = pool.withColumn("n_neighbours", F.lit(4))
    faults = cut(experiments.plan_magnitude(pool, ranges, 3, 5, experiments.MIXED_MAGNITUDES, isolate=False).join(ranges, "concept"))
    size = F.regexp_extract("variant", r"(\d+)", 1).cast("double") / 100
    up = F.abs(F.col("new_value") / F.col("original_value") - 1 - size) < 1e-4
    down = F.when(size >= 1, F.abs(F.col("original_value") / F.col("new_value") - 1 - size) < 1e-2).otherwise(F.abs(1 - F.col("new_value") / F.col("original_value") - size) < 1e-4)
    return faults.groupBy("variant").agg(F.count("*").alias("n"), F.min(F.col("new_value").between(F.col("lo"), F.col("hi"))).alias("in_range"), F.min(up | down).alias("of_size"))


@register("log_parameters", "SELECT 'r1' AS run_id, CAST(1996 AS BIGINT) AS year_min, CAST(5 AS BIGINT) AS dependence_min_shared")
def log_parameters(spark, sf_dir):
    """Parameters come back from a build log as they went in."""
    folder = f"{cut(spark.range(1)).sparkSession.sparkContext.getCheckpointDir()}/logged"
    write_run({"country_indicator_year": table(spark, sf_dir, "region")}, folder, "marts", "r1", PARAMS.as_dict())
    info = Reader(spark, folder).snapshot_info()
    stored = json.loads(json.dumps(info["parameters"]))
    return spark.createDataFrame([(info["run_id"], stored["year_min"], stored["dependence_min_shared"])], "run_id string, year_min bigint, dependence_min_shared bigint")
