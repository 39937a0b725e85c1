"""Fault injection: pool, disjoint and repeatable draws, and outcomes through the unchanged core."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import core, experiments as X
from tessera.params import CoreParams
from tessera.session import cut
from tessera.sources import dimensions

PARAMS = CoreParams(year_min=2005, year_max=2016, dependence_min_shared=5)
YEARS = range(2005, 2017)


def standard_rows(spark):
    rows = []
    for source, factor in (("who", 1.0), ("worldbank", 1.001), ("unicef", 1.0005)):
        n = 0
        for iso, offset in (("NGA", 0), ("KEN", 10), ("GHA", 15)):
            for i, y in enumerate(YEARS):
                n += 1
                v = (40 + 2.5 * i + offset) * factor
                who = source == "who"
                rows.append(("r", f"{source}/f", n, source, iso, y, str(y), v, str(v), v - 1 if who else None, v + 1 if who else None, "SEX_BTSX" if who else "_T" if source == "unicef" else None, None, None, None, "M12T23" if source == "unicef" else None, None, None, False, "dtp3_coverage"))
    schema = "run_id string, source_file string, row_num int, source string, place string, year int, period_text string, value double, value_text string, low double, high double, sex_raw string, wealth_raw string, residence_raw string, maternal_edu_raw string, age_raw string, upstream_label string, priority int, unexpected_dim boolean, concept string"
    return spark.createDataFrame(rows, schema).withColumn("extra", F.lit(None).cast("map<string,string>"))


class Built:
    def __init__(self, spark, standard):
        classified = cut(core.classify(standard, dimensions.countries(spark), dimensions.aliases(spark), dimensions.indicators(spark), dimensions.vocabulary(spark), PARAMS))
        self.rejected, self.fact = cut(core.rejects(classified)), cut(core.with_series_flags(core.facts(classified), PARAMS))
        chosen = core.selected_rows(self.fact)
        self.groups = cut(core.evidence_groups(chosen, core.source_dependence(chosen, dimensions.sources(spark), PARAMS)))
        self.reconciled = cut(core.reconcile(chosen, self.groups, dimensions.sources(spark), PARAMS))


@pytest.fixture(scope="module")
def world(spark):
    standard = cut(standard_rows(spark))
    built = Built(spark, standard)
    pool = cut(X.build_pool(built.fact, built.groups, built.reconciled))
    ranges = dimensions.indicators(spark).select("concept", F.col("valid_min").alias("lo"), F.col("valid_max").alias("hi"))
    return standard, built, pool, ranges


def test_pool(world):
    rows = world[2].collect()
    assert len(rows) == 108 and {r.group_label for r in rows} == {"unicef+who+worldbank"} and {r.cell_members for r in rows} == {3}
    assert {r.n_neighbours for r in rows if 2007 <= r.year <= 2014} == {4} and {r.n_neighbours for r in rows if r.year in (2005, 2016)} == {2}
    assert X.clean_universe(world[2]).count() == 108


def test_validity_faults_end_to_end(spark, world):
    standard, _, pool, ranges = world
    countries = dimensions.countries(spark)
    plan = lambda seed: X.plan_validity(pool, standard, countries, ranges, seed, 4)
    faults = cut(plan(7))
    assert {r.fault_type: r["count"] for r in faults.groupBy("fault_type").count().collect()} == dict.fromkeys(X.VALIDITY, 4)
    assert faults.select("source_file", "row_num").distinct().count() == 36
    key = lambda df: sorted(map(tuple, df.select("fault_type", "source_file", "row_num", "variant").collect()))
    assert key(plan(7)) == key(faults) != key(plan(8))
    corrupted = cut(X.apply_faults(standard, faults))
    assert corrupted.count() == 108 + 4
    after = Built(spark, corrupted)
    placed = cut(X.located(faults, standard))
    outcomes = cut(X.classify_outcomes(placed, after.rejected, after.fact, after.reconciled))
    wrong = outcomes.where("not correct").select("fault_type", "source", "variant", "labels").collect()
    assert not wrong, wrong
    rates = {r.fault_type: r.rate for r in X.detection_rates(outcomes, "fault_type").collect()}
    assert rates == dict.fromkeys(X.VALIDITY, 1.0)
    naive = {(r.fault_type, r.naive) for r in X.naive_outcomes(placed, corrupted, countries).select("fault_type", "naive").collect()}
    assert {("missing_value", "dropped"), ("duplicate", "accepted_wrong"), ("out_of_range", "accepted_wrong"), ("country_invalid", "dropped"), ("categorical_invalid", None)} <= naive
    false = {r.label: r.n for r in X.false_positives(pool, placed, after.rejected, after.fact, after.reconciled).collect()}
    assert not any(k.startswith("rejected") for k in false)
    assert X.outlier_context(after.fact, placed).agg(F.sum("n")).first()[0] > 0
    assert X.alert_precision(outcomes, spark.createDataFrame([("flagged:conflict", 3)], "label string, n long")).where("label = 'flagged:conflict'").first().precision == 0.0


def test_magnitudes_are_isolated_and_found(spark, world):
    standard, _, pool, ranges = world
    faults = cut(X.plan_magnitude(pool, ranges, 3, 2, magnitudes=(0.5, 0.25)))
    rows = faults.collect()
    assert rows and len({(r.source, r.country) for r in rows}) == len(rows) == len({(r.country, r.year) for r in rows})
    for r in rows:
        size = abs(r.new_value / r.original_value - 1)
        assert min(abs(size - m) for m in (0.5, 0.25)) < 1e-3 and 0 <= r.new_value <= 100
    after = Built(spark, X.apply_faults(standard, faults))
    outcomes = X.classify_outcomes(faults, after.rejected, after.fact, after.reconciled)
    assert outcomes.where("not correct").count() == 0


def test_mixed_never_hits_a_row_twice(spark, world):
    standard, _, pool, ranges = world
    faults = X.plan_mixed(pool, standard, dimensions.countries(spark), ranges, 5, 0.3)
    rows = [(r.source_file, r.row_num) for r in faults.collect()]
    assert len(rows) == len(set(rows)) >= 20


def test_clean_alert_rates(world):
    got = {r.label: (r.alerts, r.total) for r in X.clean_alert_rates(world[1].fact, world[1].reconciled).collect()}
    assert got["temporal_outlier"] == (0, 108) and got["conflict"] == (0, 36)


def test_schema_outcomes_and_resumable_passes(spark, tmp_path):
    assert [X.schema_outcome(m, u) for m, u in (([], []), (["x"], ["y"]), ([], ["y"]))] == ["silent", "schema:error", "schema:warned"]
    calls = []

    def one(seed):
        calls.append(seed)
        return spark.createDataFrame([(seed * 2,)], "v int")

    for seeds in ((1, 2), (1, 2, 3)):
        out = X.run_passes(spark, seeds, one, str(tmp_path / "res"))
    assert calls == [1, 2, 3] and {(r.seed, r.v) for r in out.collect()} == {(1, 2), (2, 4), (3, 6)}
    X.write_log(out, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3
