"""Marts and quality metrics on hand-counted panels, against independent formulas."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import core, marts, quality
from tessera.params import CoreParams, MartParams

P = MartParams(year_min=2000, year_max=2016, min_countries=5)
BASE = {"NGA": 200, "MLI": 160, "UGA": 140, "KEN": 120, "GHA": 100, "SEN": 90}
SLOPE = {"NGA": (30, 1.0), "KEN": (70, 1.5), "GHA": (60, 0.5), "SEN": (80, 0.8), "MLI": (40, 2.0), "UGA": (50, 1.2)}
YEARS = range(2000, 2017)


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(c, "under5", y, b * 0.97 ** (y - 2000)) for c, b in BASE.items() for y in YEARS]
    rows += [(c, "dtp3", y, s + k * (y - 2000)) for c, (s, k) in SLOPE.items() for y in YEARS]
    rows += [("KEN", "odd", 2012, 40.0)]
    df = spark.createDataFrame(rows, "country string, concept string, year int, value double")
    return df.withColumns({"quality_tier": F.when(F.col("concept") == "odd", "conflict").otherwise("single_evidence_group"), "outlier_flag": (F.col("country") == "NGA") & (F.col("year") == 2008) & (F.col("concept") == "dtp3"), "source_disagreement": F.lit(False), "flat_run": F.lit(False)})


def test_trend_is_exact(panel):
    got = {(r.country, r.concept): r for r in marts.trend(panel, params=P).collect()}
    assert len(got) == 12  # the single point has no trend
    for c in BASE:
        r = got[c, "under5"]
        assert r.annual_pct_change == pytest.approx(-0.03) and (r.window_start, r.window_end, r.n_points) == (2000, 2016, 17)
        assert r.absolute_change == pytest.approx(BASE[c] * (0.97**16 - 1))
        line = got[c, "dtp3"]
        assert line.linear_slope_per_year == pytest.approx(SLOPE[c][1]) and line.linear_r2 == pytest.approx(1.0)


def test_latest(panel):
    got = {(r.country, r.concept): r for r in marts.latest(panel).collect()}
    r = got["NGA", "under5"]
    assert (r.latest_year, r.n_observations, r.first_year, r.years_behind) == (2016, 17, 2000, 0)
    assert got["KEN", "odd"].years_behind == 0 and got["KEN", "odd"].quality_tier == "conflict"


def test_region_quartiles(spark, panel):
    members = spark.createDataFrame([("NGA", "W"), ("MLI", "W"), ("GHA", "W"), ("SEN", "W"), ("TGO", "W"), ("UGA", "E"), ("KEN", "E")], "country string, un_subregion string")
    r = marts.region_year(panel, members).where("un_subregion = 'W' and concept = 'under5' and year = 2000").first()
    assert (r.n_countries, r.n_possible, r.coverage_share) == (4, 5, 0.8)
    assert (r.median_value, r.p25_value, r.p75_value, r.min_value, r.max_value) == (130.0, 97.5, 170.0, 90.0, 200.0)


def spearman(a, b):
    rank = lambda v: [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]
    ra, rb = rank(a), rank(b)
    ma, mb = sum(ra) / len(ra), sum(rb) / len(rb)
    return sum((x - ma) * (y - mb) for x, y in zip(ra, rb, strict=True)) / math.sqrt(sum((x - ma) ** 2 for x in ra) * sum((y - mb) ** 2 for y in rb))


def test_association_level_and_change(spark, panel):
    indicators = spark.createDataFrame([("under5", 1), ("dtp3", 2), ("odd", 3)], "concept string, ordinal int")
    got = {r.basis: r for r in marts.association(panel, indicators, P).collect()}
    level = [(BASE[c] * 0.97**15, SLOPE[c][0] + 15 * SLOPE[c][1]) for c in BASE]
    change = [(BASE[c] * (0.97**15 - 1), 15 * SLOPE[c][1]) for c in BASE]
    for basis, values in (("level", level), ("change", change)):
        r = got[basis]
        rho = spearman(*zip(*values, strict=True))
        assert (r.indicator_a, r.indicator_b, r.n_countries) == ("under5", "dtp3", 6) and r.spearman_rho == pytest.approx(rho, abs=1e-9)
        assert r.rho_ci_low == pytest.approx(math.tanh(math.atanh(rho) - 1.96 / math.sqrt(3)))
    assert got["level"].reference == "2015 +-3y" and got["change"].reference == "2000 to 2015 +-3y"


def test_equity_gap_pairs_only_within_a_survey(spark):
    rows = []
    add = lambda src, year, period, label, value, sex="total", wealth="total", residence="total": rows.append((src, "NGA", "stunting", year, period, label, value, sex, wealth, residence))
    add("who", 2010, "2010", "w", 240.0, wealth="q1")
    add("who", 2010, "2010", "w", 120.0, wealth="q5")
    add("who", 2010, "2010", "w", 190.0, sex="female")
    add("who", 2010, "2010", "w", 210.0, sex="male")
    for period, label, urban, rural in (("2014-06", "A", 20.0, 30.0), ("2014-10", "B", 22.0, 44.0)):
        add("unicef", 2014, period, label, urban, residence="urban")
        add("unicef", 2014, period, label, rural, residence="rural")
    add("unicef", 2015, "2015", "A", 1.0, residence="urban")  # no partner in its survey
    add("unicef", 2015, "2015", "B", 2.0, residence="rural")
    fact = spark.createDataFrame(rows, "source string, country string, concept string, year int, period_text string, upstream_label string, value double, sex string, wealth_quintile string, residence string").withColumns({"maternal_education": F.lit("total"), "other_dims": F.lit(None).cast("string"), "age_group": F.lit("_T")})
    sources = spark.createDataFrame([("who", 1), ("unicef", 2)], "source string, priority int")
    indicators = spark.createDataFrame([("stunting", "_T")], "concept string, unicef_headline_age string")
    got = {r.dimension: r for r in marts.equity_gap(fact, sources, indicators).collect()}
    assert (got["wealth"].value_a, got["wealth"].value_b, got["wealth"].ratio) == (240.0, 120.0, 2.0)
    assert (got["sex"].group_a, got["sex"].difference) == ("female", -20.0)
    r = got["residence"]
    assert (r.value_a, r.value_b, r.upstream_label, r.n_candidate_pairs, r.year) == (44.0, 22.0, "B", 2, 2014)


def test_trust_and_reversals(panel):
    t = {r.concept: r for r in marts.data_trust(panel, 54, P).collect()}
    assert (t["dtp3"].n_values, t["dtp3"].n_countries) == (102, 6) and t["dtp3"].grid_coverage == pytest.approx(102 / (54 * 17))
    assert t["dtp3"].share_outlier_flag == pytest.approx(1 / 102) and t["odd"].share_conflict == 1.0
    r = marts.reversals(panel).where("country = 'NGA' and concept = 'dtp3' and year = 2010").first()
    assert r.rise == pytest.approx(4.0) and r.n_flagged == 1


@pytest.mark.parametrize(("value", "around", "flag"), [(500.0, [96.0, 94.0, 88.0, 86.0], True), (97.0, [96.0, 94.0, 88.0, 86.0], False), (500.0, [96.0, 94.0], False), (0.05, [0.0, 0.0, 0.0], False)])
def test_outlier_rule(spark, value, around, flag):
    rule = core.outlier_rule(F.lit(value), F.array(*[F.lit(x) for x in around]), 3.5, 0.2, 0.1, 3)
    assert spark.range(1).select(rule.alias("f")).first().f is flag


def test_outlier_in_series(spark):
    values = [100, 98, 96, 94, 92, 500, 88, 86, 84, 82, 80]
    df = spark.createDataFrame([("x", 2010 + i, float(v)) for i, v in enumerate(values)], "k string, year int, value double")
    assert [r.year for r in core.temporal_outliers(df, ["k"]).where("outlier").collect()] == [2015]


@pytest.mark.parametrize(
    ("years", "values", "flags"),
    [
        (range(2000, 2008), [90.01, 80.02, 70.03, 70.03, 70.03, 70.03, 60.04, 50.05], [0, 0, 1, 1, 1, 1, 0, 0]),
        (range(2000, 2004), [90.01, 70.03, 70.03, 70.03], [0, 0, 0, 0]),
        ([2000, 2001, 2003, 2004], [70.03] * 4, [0] * 4),
        (range(2000, 2004), [70.03, 70.03 + 1e-12, 70.03, 70.03 - 1e-12], [1] * 4),
        (range(2000, 2005), [70.1, 70.1, 70.1, 70.1, 60.2], [0] * 5),
        (range(2000, 2009), [1.23] * 4 + [4.56] * 5, [1] * 9),
    ],
)
def test_flat_runs(spark, years, values, flags):
    df = spark.createDataFrame([("s", y, v) for y, v in zip(years, values, strict=True)], "k string, year int, value double")
    assert [int(r.flat_run) for r in core.flat_runs(df, ["k"]).orderBy("year").collect()] == flags


def test_groups_close_over_chains(spark):
    selected = spark.createDataFrame([("c", s) for s in "abcde"] + [("d", "a")], "concept string, source string")
    dependence = spark.createDataFrame([("c", "a", "d", True), ("c", "b", "c", True), ("c", "c", "d", True), ("c", "a", "e", False)], "concept string, source_a string, source_b string, dependent boolean")
    got = {(r.concept, r.source): (r.group_label, r.n_members) for r in core.evidence_groups(selected, dependence).collect()}
    assert got == {**{("c", s): ("a+b+c+d", 4) for s in "abcd"}, ("c", "e"): ("e", 1), ("d", "a"): ("a", 1)}


def test_group_disagreement_is_no_conflict(spark):
    rows = [(s, c, "m", y, 50.0 * (1.10 if s == "worldbank" and (c, y) == ("KEN", 2013) else 1.001 if s == "worldbank" else 1)) for s in ("who", "worldbank") for c in ("NGA", "KEN", "GHA") for y in range(2010, 2017)]
    selected = spark.createDataFrame(rows, "source string, country string, concept string, year int, value double")
    sources = spark.createDataFrame([("who", 1), ("worldbank", 3)], "source string, priority int")
    p = CoreParams(dependence_min_shared=10)
    dependence = core.source_dependence(selected, sources, p)
    row = dependence.first()
    assert (row.n_shared, row.n_within, row.dependent) == (21, 20, True)
    cells = core.reconcile(selected, core.evidence_groups(selected, dependence), sources, p)
    flagged = cells.where("within_group_disagreement").collect()
    assert cells.count() == 21 and [(r.country, r.year) for r in flagged] == [("KEN", 2013)]
    assert flagged[0].max_within_group_spread_rel == pytest.approx(5 / 52.5) and not flagged[0].conflict


OBS = "source string, concept string, iso3 string, period_text string, year int, value double, value_text string, low double, high double, dim_key string"


@pytest.fixture(scope="module")
def obs(spark):
    rows = []
    add = lambda source, iso, period, year, value, text, dim="t", low=None, high=None: rows.append((source, "dtp3", iso, period, year, value, text, low, high, dim))
    add("who", "NGA", "2019", 2019, 90.0, "90")
    add("who", "NGA", "2019", 2019, 90.0, "90", "m")
    add("who", "KEN", "2019", 2019, 150.0, "150")
    add("who", "KEN", "2020", 2020, None, None)
    add("who", "GHA", "2020", 2020, None, "abc")
    add("who", "GHA", "2021", 2021, 70.0, "70", "t", 50.0, 60.0)
    add("who", "XXX", "2019", 2019, 50.0, "50")
    add("who", "NGA", "2019", 2019, 90.0, "90")
    add("worldbank", "NGA", "2019", 2019, 90.0, "90")
    add("unicef", "NGA", "2019", 2019, 88.0, "88")
    add("unicef", "NGA", "2019", 2019, 60.0, "60", "f")
    add("unicef", "KEN", "2016-2017", 2016, 50.0, "50")
    return spark.createDataFrame(rows, OBS)


def test_row_level_counts(spark, obs):
    ranges = spark.createDataFrame([("dtp3", 0.0, 100.0)], "concept string, lo double, hi double")
    countries, years = ["NGA", "KEN", "GHA"], (2019, 2021)
    metrics = quality.row_level(obs, ranges, countries, years).unionByName(quality.coverage_and_grain(obs, countries, years))
    got = {(r.source, r.metric): r for r in metrics.collect()}
    want = {"missing_rate": 2, "unparseable_rate": 1, "out_of_range_rate": 1, "bounds_violation_rate": 1, "invalid_country_rate": 1, "invalid_year_rate": 0, "invalid_row_rate": 4, "exact_duplicate_rate": 1, "noncanonical_period_rate": 0, "grain_ambiguity_rate": 3}
    assert {m: got["who", m].numerator for m in want} == want and all(got["who", m].denominator == 8 for m in want)
    assert (got["who", "ambiguous_cell_rate"].numerator, got["who", "ambiguous_cell_rate"].denominator) == (1, 6)
    assert (got["who", "grid_coverage"].numerator, got["who", "grid_coverage"].denominator) == (3, 9)
    assert got["unicef", "noncanonical_period_rate"].value == pytest.approx(1 / 3)
    scores = {(r.scope, r.source, r.metric): r for r in quality.scores(metrics).collect()}
    assert [scores["series", "who", d].value for d in ("completeness", "validity", "uniqueness", "consistency")] == [0.75, 0.5, 0.625, 1.0]
    composite = scores["series", "who", "composite"]
    assert composite.value == pytest.approx(2.875 / 4)
    assert json.loads(composite.details)["leave_one_out_min"] == pytest.approx(1.875 / 3)
    assert scores["overall", "", "completeness"].value == pytest.approx(1 - 2 / 12)


def test_integration_counts(obs):
    got = {r.metric: (r.numerator, r.denominator) for r in quality.integration(obs).collect()}
    assert got["naive_join_fanout"] == (6, 1) and got["naive_join_conflict_rate"] == (3, 6)
    assert got["cells_in_all_three_sources"] == (1, 5)


def test_vocabulary_and_schema_variants(spark):
    who = spark.createDataFrame([("SEX", "A", None, None, "AFR", "NGA"), ("SEX", "B", None, None, "EMR", "XXX"), (None, None, None, None, "AFR", "KEN"), (None, None, None, None, "AFR", "GHA")], "dim1_type string, dim1 string, dim3_type string, dim3 string, parent_location_code string, spatial_dim string")
    unicef = spark.createDataFrame([("M", None), ("F", None)], "sex string, wealth_quintile string")
    got = {(r.source, r.metric): r for r in quality.vocabulary(who, unicef).collect()}
    assert got["who", "distinct_sex_values"].value == 2 and got["unicef", "distinct_wealth_values"].value == 0
    outside = got["who", "countries_outside_who_afr_region"]
    assert (outside.numerator, outside.denominator) == (1, 4)
    headers = spark.createDataFrame([("s1", ["a", "b", "c"]), ("s2", ["a", "b", "d"]), ("s3", ["a", "b", "c"])], "series string, columns array<string>")
    variants = {r.metric: r for r in quality.schema_variants(headers).collect()}
    assert variants["distinct_column_sets"].value == 2.0 and variants["columns_shared_by_all_series"].value == 0.5
    assert quality.schema_variants(headers.limit(0)).count() == 0


def test_naive_conflicts_equal_the_plain_product(spark):
    import random

    from tessera.operators import quality

    rng = random.Random(2)
    rows = [(s, rng.choice("ab"), rng.choice("xyz"), 2000 + rng.randrange(2), rng.choice([None, 0.0, -5.0, 100.0, 100.0, 105.0, 109.9, 111.2, rng.uniform(1, 200)])) for s in ("who", "worldbank", "unicef") for _ in range(120)]
    want = {}
    for w in rows:
        for b in rows:
            for u in rows:
                if (w[0], b[0], u[0]) == ("who", "worldbank", "unicef") and w[1:4] == b[1:4] == u[1:4] and None not in (w[4], b[4], u[4]):
                    v = (w[4], b[4], u[4])
                    total, bad = want.get(w[1], (0, 0))
                    want[w[1]] = (total + 1, bad + (max(v) - min(v) > 0.1 * sum(v) / 3.0))
    got = {r.concept: (r.total, r.conflicting) for r in quality.naive_conflicts(spark.createDataFrame(rows, "source string, concept string, iso3 string, year int, value double")).collect()}
    assert got == want and all(0 < bad < total for total, bad in want.values())


@pytest.mark.parametrize("large", [1, 1 << 17])
def test_naive_conflicts_of_odd_values_equal_the_plain_join(spark, large):
    import random

    rng = random.Random(4)
    odd = [float("nan"), float("inf"), float("-inf"), 1e308, 1.7e308, -1e308, 5e-324, 1e-310, 1.1e-310, -0.0, 0.0, -7.0]
    pools = {"plain": range(1000, 1120), "wide": [1.05**i for i in range(-400, 400)], "odd": odd, "mixed": [*odd, *range(1000, 1120)], None: range(1000, 1010)}
    rows = [(s, concept, iso3, 2000, float(rng.choice(pool))) for concept, pool in pools.items() for iso3 in ("x", "y", None) for s in ("who", "worldbank", "unicef") for _ in range(60)]
    obs = spark.createDataFrame(rows, "source string, concept string, iso3 string, year int, value double")
    obs.createOrReplaceTempView("odd_rows")
    want = spark.sql("""SELECT w.concept, count(*) AS total, count_if(greatest(w.value, b.value, u.value) - least(w.value, b.value, u.value) > 0.10D * (w.value + b.value + u.value) / 3.0D) AS conflicting
        FROM odd_rows w JOIN odd_rows b USING (concept, iso3, year) JOIN odd_rows u USING (concept, iso3, year) WHERE w.source = 'who' AND b.source = 'worldbank' AND u.source = 'unicef' GROUP BY w.concept""")
    got = quality.naive_conflicts(obs, large=large)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 4


@pytest.mark.parametrize("large", [1000, 1 << 17])
def test_naive_conflicts_of_many_different_values_in_one_band(spark, large):
    """6.4e10 combinations of values that all lie close together, so none can be made; counted here by two searches for each pair."""
    import threading

    import numpy as np

    rng = np.random.default_rng(3)
    w, b, u = (np.sort(rng.choice(np.arange(10_000, 11_200, 0.25), 4000, replace=False)) for _ in range(3))
    rows = [(s, "a", "x", 2000, float(v)) for s, values in (("who", w), ("worldbank", b), ("unicef", u)) for v in values]
    obs = spark.createDataFrame(rows, "source string, concept string, iso3 string, year int, value double").repartition(4)
    agreed = 0
    for x in w:
        low, high = np.minimum(x, b), np.maximum(x, b)
        bad = lambda y: np.maximum(high, y) - np.minimum(low, y) > 0.1 * (x + b + y) / 3.0  # noqa: B023, E731
        # Up to the higher of the pair a larger value agrees better, above it worse.
        left, right = np.zeros(len(b), int), np.searchsorted(u, high, "right")
        middle = right.copy()
        while (left < right).any():
            mid = (left + right) // 2
            no = bad(u[np.minimum(mid, len(u) - 1)])
            left, right = np.where((left < right) & no, mid + 1, left), np.where((left < right) & ~no, mid, right)
        first, left, right = left, middle, np.full(len(b), len(u))
        while (left < right).any():
            mid = (left + right) // 2
            no = bad(u[np.minimum(mid, len(u) - 1)])
            left, right = np.where((left < right) & ~no, mid + 1, left), np.where((left < right) & no, mid, right)
        agreed += int((left - first).sum())
    stop = threading.Timer(100, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        row = quality.naive_conflicts(obs, large=large).first()
    finally:
        stop.cancel()
    assert (row.total, row.conflicting) == (4000**3, 4000**3 - agreed) and 0 < agreed < 4000**3


def test_numbered_is_the_rank_by_draw(spark):
    from pyspark.sql import functions as F

    from tessera.functions.windows import numbered

    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(97)) / 97.0).alias("d"))
    rows = df.collect()
    for keys in ([], ["g"]):
        got = {r.id: r.n for r in numbered(df, "d", ["id"], "n", keys, buckets=8).collect()}
        for group in {tuple(r[k] for k in keys) for r in rows}:
            own = sorted((r.d, r.id) for r in rows if tuple(r[k] for k in keys) == group)
            assert [got[i] for _, i in own] == list(range(len(own)))
