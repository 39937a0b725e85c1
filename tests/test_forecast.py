"""Baselines, backtests, features, gate and models: exact values, and no look into the future."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import forecast as M
from tessera.session import cut


@pytest.fixture(scope="module")
def exponential(spark):
    rows = [("under5_mortality", iso, "Western Africa", y, base * 0.97 ** (y - 2000)) for iso, base in (("AAA", 200), ("BBB", 100), ("CCC", 50)) for y in range(2000, 2016)]
    return spark.createDataFrame(rows, "concept string, iso3 string, un_subregion string, year int, value double")


@pytest.fixture(scope="module")
def ranges(spark):
    return spark.createDataFrame([(c, 0.0, 1000.0) for c in M.CONCEPTS], "concept string, lo double, hi double")


def test_backtest_values(exponential, ranges):
    got = M.backtest(exponential, ranges).where("iso3 = 'AAA'").collect()
    assert len(got) == sum(min(10, 15 - i) for i in range(4, 15)) and min(r.n_history for r in got) == 5
    one = [r for r in got if r.horizon == 1]
    assert all(r.ape_last_value == pytest.approx(1 / 0.97 - 1) for r in one)
    r = next(r for r in got if r.origin_year == 2010 and r.horizon == 3)
    years, values = np.arange(2006, 2011), 200 * 0.97 ** np.arange(6, 11)
    slope, intercept = np.polyfit(years, values, 1)
    assert r.pred_linear_trend_5 == pytest.approx(intercept + slope * 2013)
    assert r.pred_average_change == pytest.approx(values[-1] + (values[-1] - 200) / 10 * 3)


def test_forecasts_ignore_the_future_and_are_clipped(exponential, ranges):
    changed = exponential.withColumn("value", F.when(F.col("year") > 2010, F.col("value") * 50).otherwise(F.col("value")))
    key = lambda df: sorted((r.iso3, r.origin_year, r.target_year, r.pred_linear_trend_5) for r in M.backtest(df, ranges).where("origin_year <= 2010").collect())
    assert key(exponential) == key(changed)
    steep = exponential.withColumn("value", 90.0 * (F.col("year") - 1999))
    assert M.backtest(steep, ranges).agg(F.max("pred_linear_trend_5")).first()[0] == 1000.0


def test_bootstrap():
    assert M.cluster_bootstrap_median([np.full(3, 0.04)] * 4) == (0.04, 0.04)
    assert all(math.isnan(x) for x in M.cluster_bootstrap_median([np.ones(3)]))
    assert M.cluster_bootstrap_median([np.full(4, 0.01)] * 4 + [np.full(4, 0.50)] * 4) == (0.01, 0.50)


def test_summary_and_gate(spark, exponential, ranges):
    summary = M.summarize(M.backtest(exponential, ranges), resamples=20).cache()
    r = summary.where("bucket = '1' and model = 'last_value'").first()
    assert r.median_ape == pytest.approx(1 / 0.97 - 1) and r.ci_low == pytest.approx(r.ci_high) and r.n_countries == 3
    volume = M.data_volume(exponential)
    v = volume.first()
    assert (v.countries, v.countries_with_history, v.median_observations, v.median_gap_years, v.share_annual) == (3, 3, 16.0, 1.0, 1.0)
    strict, loose = M.gate(volume, summary).first(), M.gate(volume, summary, 3, 0.0, 10, 3).first()
    assert not strict.supports_forecasting and not strict.C1_data and loose.supports_forecasting
    assert M.gate(volume, summary.limit(0)).first().n_instances == 0


def test_own_features_of_an_exponential(exponential):
    scaled = exponential.withColumn("value", 100 * F.exp(-0.05 * (F.col("year") - 2000)))
    r = M.own_features(scaled).where("iso3 = 'AAA' and year = 2010").first()
    assert [r.dlog1, r.dlog3, r.dlog5, r.avg_dlog, r.vol5] == [pytest.approx(x, abs=1e-9) for x in (-0.05, -0.15, -0.25, -0.05, 0.0)]
    first = M.own_features(scaled).where("iso3 = 'AAA' and year = 2000").first()
    assert first.dlog1 is None and first.avg_dlog is None and first.vol5 is None


@pytest.fixture(scope="module")
def synthetic(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c in range(12):
        for k, concept in enumerate(M.CONCEPTS):
            level, rate = 4 + 0.1 * k, -0.03 - 0.002 * c
            for y in range(1995, 2018):
                level += rate + 0.003 * rng.standard_normal()
                rows.append((concept, f"C{c:02d}", M.REGIONS[c % 5], y, float(np.exp(level))))
    return spark.createDataFrame(rows, "concept string, iso3 string, un_subregion string, year int, value double").cache()


def test_instances_and_matrix(synthetic, ranges):
    got = M.build_instances(synthetic, ranges)
    r = got.where("iso3 = 'C00' and concept = 'dtp3_coverage' and origin_year = 2010 and horizon = 4").first()
    assert r.y == pytest.approx(math.log(r.actual / r.last)) and r.level == pytest.approx(math.log(r.last))
    assert r.x_dtp3_coverage_level is None and r.x_under5_mortality_level is not None
    future = synthetic.withColumn("value", F.when(F.col("year") > 2010, F.col("value") * 9).otherwise(F.col("value")))
    names = ["level", "dlog5", "vol5", "x_under5_mortality_dlog3"]
    pick = lambda df: sorted(map(tuple, M.build_instances(df, ranges).where("origin_year <= 2010").select("concept", "iso3", "origin_year", "horizon", *names).na.fill(-9.0).collect()))
    assert pick(synthetic) == pick(future)
    matrix, columns = M.design_matrix(got)
    assert len(columns) == len(set(columns)) == 1 + 6 + 8 + 4 + 4 + 5 and set(columns) <= set(matrix.columns)


def test_models_beat_the_last_value(spark, synthetic, ranges):
    instances = cut(M.build_instances(synthetic.where("year <= 2014"), ranges))
    results = M.evaluate_models(instances, cutoffs=(2009,), seeds=(0,), iterations=5, min_train=100, alphas=(0.1, 10.0))
    results = cut(results)
    summary = cut(M.summarize_models(results, resamples=20))
    decisive = {(r.concept, r.model): r for r in summary.where("bucket = '4-5'").collect()}
    for concept in M.CONCEPTS:
        assert decisive[concept, "ridge"].median_ape < decisive[concept, "last_value"].median_ape
        best = decisive[concept, "ridge"].best_baseline
        assert decisive[concept, best].median_diff == 0.0
    assert M.verdicts(summary).count() == 8
    best = summary.where("model = 'gbm' and bucket = '4-5'").select("concept", "best_baseline")
    assert M.by_cutoff(results, best).count() == 4
    assert results.where("pred_gbm < lo or pred_gbm > hi").count() == 0
    assert M.evaluate_models(instances, cutoffs=(2009,), min_train=10**9) is None


def test_naive_panel_and_paired_degradation(spark):
    countries = spark.createDataFrame([("NGA", "W"), ("KEN", "E")], "iso3 string, un_subregion string")
    rows = [("who", "NGA", 2019, 1.0, None, None, 1), ("who", "NGA", 2019, 2.0, "SEX_BTSX", None, 2), ("who", "NGA", 2019, 9.0, "SEX_MLE", None, 3), ("who", "nga", 2018, 3.0, None, None, 4), ("who", "KEN", None, 3.0, None, None, 5), ("who", "KEN", 2018, None, None, None, 6), ("who", "KEN", 2017, 7.0, None, "WEALTHQUINTILE_TOTL", 7), ("who", "KEN", 2016, 7.0, None, "WEALTHQUINTILE_WQ1", 8), ("unicef", "KEN", 2015, 7.0, None, None, 9)]
    standard = spark.createDataFrame(rows, "source string, place string, year int, value double, sex_raw string, wealth_raw string, row_num int").withColumns({"concept": F.lit("dtp3_coverage"), "source_file": F.lit("f")})
    assert {(r.iso3, r.year, r.value) for r in M.naive_panel(standard, countries).collect()} == {("NGA", 2019, 2.0), ("KEN", 2017, 7.0)}
    side = lambda e: spark.createDataFrame([("c", f"I{i}", 2010, 4, 0.1 + e, 0.1 + 2 * e) for i in range(4)], "concept string, iso3 string, origin_year int, horizon int, ape_baseline double, ape_gbm double")
    paired = M.paired_frames(side(0.0), side(0.3), side(0.1))
    got = {r.comparison: r for r in M.degradation(paired, "gbm", resamples=20).collect()}
    assert got["naive"].median_delta == pytest.approx(0.6) and got["naive_minus_pipeline"].ci_low == pytest.approx(0.4)
    cover = M.coverage(side(0.0).limit(3), side(0.0)).first()
    assert cover.coverage == 0.75
    panel = spark.createDataFrame([("conflict", False, False), ("x", True, False), ("x", False, True), ("x", False, False)], "quality_tier string, outlier_flag boolean, source_disagreement boolean")
    assert M.analysis_panel(panel).count() == 1 and M.analysis_panel(panel, drop_flagged=False).count() == 3
