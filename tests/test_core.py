"""Hand-counted snapshot, end to end: raw files -> staging -> core -> marts -> quality -> read API."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import core
from tessera.params import CoreParams, MartParams
from tessera.plans.api import Reader
from tessera.plans.build import Core, Marts, build_all, core_observations, observations, quality_baseline
from tessera.sources import staging
from tessera.sources.snapshot import RawPage, SnapshotIntegrityError, SnapshotWriter, verify_snapshot
from tessera.streaming.snapshots import watch_quality

PARAMS = CoreParams(year_min=2019, year_max=2021, dependence_min_shared=1)


def who(iso, year, value, sex=None, wealth=None, **more):
    row = {"Id": 1, "IndicatorCode": "X", "SpatialDim": iso, "ParentLocationCode": "AFR", "ParentLocation": "Africa", "TimeDim": year, "Value": None if value is None else str(value), "NumericValue": value, "Low": None, "High": None, "Date": "2026-08-05T14:54:28.66+02:00"}
    if sex:
        row |= {"Dim1Type": "SEX", "Dim1": sex}
    if wealth:
        row |= {"Dim3Type": "WEALTHQUINTILE", "Dim3": wealth}
    return row | more


def bank(iso, year, value, iso2="NG"):
    return {"indicator": {"id": "S", "value": "s"}, "country": {"id": iso2, "value": {"NG": "Nigeria", "KE": "Kenya", "GH": "Ghana", "XX": "Nigeria"}[iso2]}, "countryiso3code": iso, "date": str(year), "value": value, "unit": "", "obs_status": "", "decimal": 1}


def csv_page(rows):
    header = "REF_AREA,INDICATOR,SEX,AGE,DATA_SOURCE,DATA_SOURCE_PRIORITY,TIME_PERIOD,OBS_VALUE"
    return ("﻿" + "\n".join([header, *rows]) + "\n").encode()


def write(root, run_id, under5_bank=None):
    w = SnapshotWriter(root, run_id, {"countries": ["NGA", "KEN", "GHA"], "years": [2019, 2021]})
    js = lambda x: [RawPage("u", 200, "application/json", json.dumps(x).encode())]
    w.write_pages("who", "A", "under5_mortality", js({"value": [who("NGA", 2019, 100.0, "SEX_BTSX"), who("NGA", 2019, 110.0, "SEX_MLE"), who("NGA", 2019, 130.0, None, "WEALTHQUINTILE_WQ1"), who("KEN", 2019, 50.0), who("XXX", 2019, 50.0), who("GHA", 2020, 5000.0), who("GHA", 2021, 40.0, "SEX_WEIRD"), who("NGA", 2019, 100.0, "SEX_BTSX")]}))
    w.write_pages("worldbank", "B", "under5_mortality", js([{"page": 1, "pages": 1}, under5_bank or [bank("NGA", 2019, 100.4), bank("KEN", 2019, 50.2, "KE"), bank("GHA", 2019, None, "GH")]]))
    w.write_pages("unicef", "C", "under5_mortality", [RawPage("u", 200, "text/csv", csv_page(["NGA,X,_T,,S,,2019,100.1", "NGA,X,F,,S,,2019,95", "KEN,X,_T,,S,,2019,50.1"]))])
    w.write_pages("who", "D", "stunting_prevalence", js({"value": [who("KEN", 2019, 40.0)]}))
    w.write_pages("worldbank", "E", "stunting_prevalence", js([{"page": 1}, [bank("KEN", 2019, 30.3, "KE")]]))
    w.write_pages("unicef", "F", "stunting_prevalence", [RawPage("u", 200, "text/csv", csv_page(["KEN,X,_T,_T,Survey B,1,2019-10,30", "KEN,X,_T,_T,Survey A,0,2019-06,35", "NGA,X,_T,_T,Survey C,,2019-03,25", "NGA,X,_T,M0T23,Survey C,,2019-03,20", "GHA,X,M,_T,Survey C,,2019-03,22"]))])
    return str(w.finalize())


@pytest.fixture(scope="module")
def run_dir(tmp_path_factory):
    return write(tmp_path_factory.mktemp("raw"), "20260101T000000Z")


@pytest.fixture(scope="module")
def built(spark, run_dir):
    return Core(spark, staging.stage_snapshot(spark, run_dir), PARAMS)


def test_snapshot_is_immutable_and_verified(spark, run_dir, tmp_path):
    assert verify_snapshot(spark, run_dir).count() == 0
    other = write(tmp_path, "r1")
    with pytest.raises(FileExistsError):
        SnapshotWriter(tmp_path, "r1", {})
    (tmp_path / "r1/who/A/page-0001.json").write_text("{}")
    (tmp_path / "r1/who/D/page-0001.json").unlink()
    (tmp_path / "r1/extra.txt").write_text("x")
    assert {(r.path, r.problem) for r in verify_snapshot(spark, other).collect()} == {("who/A/page-0001.json", "checksum mismatch"), ("who/D/page-0001.json", "missing"), ("extra.txt", "unlisted")}
    with pytest.raises(SnapshotIntegrityError):
        staging.stage_snapshot(spark, other)


def test_staging_types_without_cleaning(spark, built):
    unicef = built.staged["unicef"].where("source_file like '%/F/%'").orderBy("row_num").collect()
    assert [(r.row_num, r.year, r.time_period) for r in unicef[:2]] == [(1, 2019, "2019-10"), (2, 2019, "2019-06")]
    assert unicef[0].extra == {"DATA_SOURCE_PRIORITY": "1"} and unicef[2].extra is None
    bank_rows = built.staged["worldbank"].where("value is null").collect()
    assert [(r.country_iso3, r.country_id, r.year, r.row_num) for r in bank_rows] == [("GHA", "GH", 2019, 3)]
    first = built.staged["who"].where("source_file like '%/A/%' and row_num = 1").first()
    assert (first.spatial_dim, first.time_dim, first.numeric_value, first.value_text, first.dim1) == ("NGA", 2019, 100.0, "100.0", "SEX_BTSX")
    assert first.source_modified_at is not None
    assert {r.concept for r in built.staged["load_log"].collect()} == {"under5_mortality", "stunting_prevalence"}


@pytest.mark.parametrize(("change", "missing", "unexpected"), [("schema_rename_required", True, True), ("schema_drop_required", True, False), ("schema_add_unexpected", False, True)])
def test_schema_contract(spark, tmp_path, change, missing, unexpected):
    from tessera.operators.experiments import corrupt_schema
    from tessera.sources.snapshot import manifest_files, read_manifest

    w = SnapshotWriter(tmp_path, "r2", {})
    pages = {"who": (json.dumps({"value": [who("NGA", 2019, 1.0)]}).encode(), "application/json"), "worldbank": (json.dumps([{}, [bank("NGA", 2019, 1.0)]]).encode(), "application/json"), "unicef": (csv_page(["NGA,X,_T,,S,,2019,1"]), "text/csv")}
    for source, (content, kind) in pages.items():
        w.write_pages(source, "S", "under5_mortality", [RawPage("u", 200, kind, corrupt_schema(content, source, change))])
    run = str(w.finalize())
    reports = staging.schema_reports(spark, run, manifest_files(spark, read_manifest(spark, run))).collect()
    assert len(reports) == 3
    assert all(bool(r.missing) == missing and bool(r.unexpected) == unexpected for r in reports), reports
    if missing:
        with pytest.raises(staging.SchemaError):
            staging.stage_snapshot(spark, run)


def test_accounting(built):
    assert built.accounting() == {"staged": 21, "loaded": 16, "rejected": 5, "headline": 11, "selected": 10}


def test_reasons(built):
    got = {(r.source, r.reason) for r in built.rejected.collect()}
    assert got == {("who", "unknown_country"), ("who", "out_of_range"), ("who", "unmapped_vocabulary"), ("who", "exact_duplicate"), ("worldbank", "no_value")}
    detail = json.loads(built.rejected.where("reason = 'out_of_range'").first().detail)
    assert detail["iso3"] == "GHA" and detail["value"] == 5000.0 and detail["sex_raw"] is None


def test_selection_and_lineage(built):
    ken = built.fact.where("country = 'KEN' and concept = 'stunting_prevalence' and source = 'unicef'").orderBy("period_text").collect()
    assert [(r.period_text, r.is_selected, r.n_candidates, r.selection_rule) for r in ken] == [("2019-06", False, 2, "source_priority_then_latest_period"), ("2019-10", True, 2, "source_priority_then_latest_period")]
    assert all("noncanonical_period" in r.quality_flags for r in ken)
    lineage = built.fact.select("source_file", "row_num").unionByName(built.rejected.select("source_file", "row_num"))
    assert lineage.distinct().count() == 21 and built.standard.join(lineage, ["source_file", "row_num"], "left_anti").count() == 0


def test_groups_and_reconciled_cells(built):
    groups = {(r.concept, r.source): r.group_label for r in built.groups.collect()}
    assert groups == {("stunting_prevalence", "who"): "who", ("stunting_prevalence", "unicef"): "unicef+worldbank", ("stunting_prevalence", "worldbank"): "unicef+worldbank", **{("under5_mortality", s): "unicef+who+worldbank" for s in ("who", "unicef", "worldbank")}}
    cells = {(r.concept, r.country): r for r in built.reconciled.collect()}
    ken = cells["stunting_prevalence", "KEN"]
    assert (ken.n_sources, ken.n_evidence_groups, ken.reconciled_value, ken.reconciled_source, ken.conflict) == (3, 2, 40.0, "who", True)
    assert ken.spread_rel == pytest.approx(10 / 35) and ken.group_values == {"who": 40.0, "unicef+worldbank": 30.0}
    assert [(cells[k].n_sources, cells[k].n_evidence_groups, cells[k].reconciled_value, cells[k].reconciled_source) for k in (("stunting_prevalence", "NGA"), ("under5_mortality", "KEN"), ("under5_mortality", "NGA"))] == [(1, 1, 25.0, "unicef"), (3, 1, 50.0, "who"), (3, 1, 100.0, "who")]


def test_reference_mismatch_stops_the_build(spark, tmp_path):
    run = write(tmp_path, "r3", [bank("NGA", 2019, 100.4, "XX")])
    with pytest.raises(core.ReferenceMismatch):
        Core(spark, staging.stage_snapshot(spark, run), PARAMS).accounting()


@pytest.mark.parametrize(("place", "country", "how"), [("NGA", "NGA", "exact"), ("nga", "NGA", "normalized"), (" NGA", "NGA", "normalized"), ("NG", "NGA", "iso2"), ("Nigeria", "NGA", "alias"), ("Ivory Coast", "CIV", "alias"), ("XXX", None, None), ("AFR", None, None), (None, None, None)])
def test_country_cascade(spark, place, country, how):
    from tessera.sources import dimensions

    keys = core.country_keys(dimensions.countries(spark), dimensions.aliases(spark))
    row = core.resolve_country(spark.createDataFrame([(place,)], "place string"), keys).first()
    assert (row.country, row.country_resolution) == (country, how)


def test_dimensions_are_complete(spark):
    from tessera.sources import dimensions

    assert dimensions.countries(spark).count() == 54 and dimensions.countries(spark).select("iso2").distinct().count() == 54
    assert {r.un_subregion: r["count"] for r in dimensions.countries(spark).groupBy("un_subregion").count().collect()} == {"Eastern Africa": 18, "Middle Africa": 9, "Northern Africa": 6, "Southern Africa": 5, "Western Africa": 16}
    assert dimensions.vocabulary(spark).count() == 31 and dimensions.aliases(spark).count() == 22


def test_core_quality_metrics(built):
    metrics = quality_baseline(core_observations(built.selected), built, (2019, 2021), ["NGA", "KEN", "GHA"], "core")
    rows = {(r.source, r.concept, r.metric): r for r in metrics.collect()}
    assert rows["who", "under5_mortality", "records_staged"].value == 8
    rejected = rows["who", "under5_mortality", "records_rejected"]
    assert (rejected.numerator, rejected.denominator) == (4, 8) and json.loads(rejected.details)["exact_duplicate"] == 1
    assert rows["", "under5_mortality", "naive_join_fanout"].value == 1.0
    assert rows["who", "under5_mortality", "uniqueness"].value == 1.0
    assert rows["", "stunting_prevalence", "conflict_rate_among_cross_validated"].value == 1.0


def test_staging_quality_has_vocabulary(built):
    metrics = {(r.source, r.metric): r.value for r in quality_baseline(observations(built.standard), built, (2019, 2021), ["NGA", "KEN", "GHA"], "staging").where("scope = 'source'").collect()}
    assert metrics["who", "distinct_sex_values"] == 3 and metrics["unicef", "distinct_sex_values"] == 3
    assert metrics["who", "countries_outside_who_afr_region"] == 0.0
    with pytest.raises(ValueError):
        quality_baseline(observations(built.standard), built, (2019, 2021), [], "marts")


def test_store_and_read_back(spark, built, run_dir, tmp_path):
    warehouse = str(tmp_path / "wh")
    assert staging.load_snapshot(spark, run_dir, warehouse) == staging.load_snapshot(spark, run_dir, warehouse) == {"who": 9, "worldbank": 4, "unicef": 8}
    build_all(spark, built.staged, warehouse, "r", PARAMS, MartParams(year_min=2019, year_max=2021, min_countries=2))
    api = Reader(spark, warehouse)
    assert api.latest_run() == "r" and api.snapshot_info()["parameters"]["n_countries"] == 54
    assert [(r.iso3, r.value, r.quality_tier) for r in api.panel("stunting_prevalence").collect()] == [("KEN", 40.0, "conflict"), ("NGA", 25.0, "single_evidence_group")]
    assert api.panel("under5_mortality", ["NGA"]).count() == 1
    assert [(r.concept, r.latest_year) for r in api.country_latest("KEN").collect()] == [("stunting_prevalence", 2019), ("under5_mortality", 2019)]
    assert api.association("under5_mortality", "stunting_prevalence", "level") is None
    assert api.trust().count() == 2 and api.countries().count() == 54
    assert api.pipeline_summary()["reasons"] == {"unknown_country": 1, "out_of_range": 1, "unmapped_vocabulary": 1, "exact_duplicate": 1, "no_value": 1}
    assert api.region_band("under5_mortality", "Western Africa").first().n_countries == 1
    with pytest.raises(LookupError):
        Reader(spark, warehouse, "none").snapshot_info()


def test_stream_measures_each_batch(spark, built, tmp_path):
    obs = observations(built.standard).select("source", "concept", "iso3", "period_text", "year", "value", "value_text", "low", "high", "dim_key")
    obs.coalesce(1).write.parquet(str(tmp_path / "in"))
    ranges = built.indicators.select("concept", F.col("valid_min").alias("lo"), F.col("valid_max").alias("hi"))
    query = watch_quality(spark, str(tmp_path / "in"), obs.schema, ranges, ["NGA", "KEN", "GHA"], (2019, 2021), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert query.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).where("metric = 'records_received'").agg(F.sum("value")).first()[0]
    assert got == 21


def test_purge_removes_one_run_from_all_layers(spark, tmp_path):
    from tessera.plans.build import purge_run

    for layer, tables in (("staging", ("who", "load_log")), ("core", ("fact_observation", "build_log")), ("marts", ("trend", "build_log"))):
        for name in tables:
            for run in ("r1", "r2"):
                spark.range(3).write.parquet(f"{tmp_path}/{layer}/{name}/run_id={run}")
    assert purge_run(spark, str(tmp_path), "r1") == ["marts/build_log", "marts/trend", "core/build_log", "core/fact_observation", "staging/load_log", "staging/who"]
    assert purge_run(spark, str(tmp_path), "r1") == [] == purge_run(spark, str(tmp_path / "none"), "r2")
    assert {p.parent.name + "/" + p.name for p in tmp_path.glob("*/*/run_id=*")} >= {"who/run_id=r2"} and not list(tmp_path.glob("*/*/run_id=r1"))
    with pytest.raises(ValueError):
        purge_run(spark, str(tmp_path), "../x")


def test_dimensions_from_a_folder_and_a_changed_header(spark, tmp_path, monkeypatch):
    from tessera.sources import dimensions

    (tmp_path / "sources.csv").write_text("# own sources\nsource,priority\nlab,1\n\"a, b\",2\n")
    assert [tuple(r) for r in dimensions.sources(spark, str(tmp_path)).orderBy("priority").collect()] == [("lab", 1), ("a, b", 2)]
    monkeypatch.setattr(dimensions, "_lines", lambda name: ["priority,source", "1,lab"])
    with pytest.raises(ValueError):
        dimensions.sources(spark)
