"""Scalar and window helpers, and the semantic traps they guard against."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions import windows as W


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "expected"), [("Côte d'Ivoire", "cotedivoire"), ("  Gambia, The ", "gambiathe"), ("São Tomé & Príncipe", "saotomeprincipe"), ("", ""), (None, None)])
def test_normalize_name(spark, text, expected):
    assert one(spark, S.normalize_name(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize(("text", "expected"), [("90", 90.0), (" 1e3 ", 1000.0), (".5", 0.5), ("12d", None), ("1_000", None), ("abc", None), ("", None), (None, None)])
def test_typed_double(spark, text, expected):
    assert one(spark, S.typed_double(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize(("text", "expected"), [("2019", 2019), ("2019.0", 2019), ("2019.5", None), ("inf", None), ("x", None)])
def test_typed_long(spark, text, expected):
    assert one(spark, S.typed_long(F.lit(text))) == expected


@pytest.mark.parametrize(("text", "expected"), [("2016-2017", 2016), ("2019", 2019), (" 2019-10", 2019), ("FY2019", None), ("19", None), (None, None)])
def test_year_of(spark, text, expected):
    assert one(spark, S.year_of(F.lit(text).cast("string"))) == expected


def test_safe_corr_is_null_on_constants_and_agrees_elsewhere(spark):
    df = spark.createDataFrame([("c", 1.0, 2.0), ("c", 1.0, 3.0), ("l", 1.0, 2.0), ("l", 2.0, 4.5), ("l", 3.0, 5.0), ("s", 1.0, 1.0)], "g string, x double, y double")
    got = {r.g: r.r for r in df.groupBy("g").agg(S.safe_corr(F.col("x"), F.col("y")).alias("r")).collect()}
    assert got["c"] is None and got["s"] is None
    assert got["l"] == pytest.approx(3 / math.sqrt(2 * 31 / 6))


def test_wilson_and_fisher(spark):
    low, high = (one(spark, c) for c in S.wilson(F.lit(8), F.lit(10)))
    p, z, n = 0.8, 1.96, 10
    centre, half, scale = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    assert (low, high) == (pytest.approx((centre - half) / scale), pytest.approx((centre + half) / scale))
    assert [one(spark, c) for c in S.wilson(F.lit(0), F.lit(0))] == [0.0, 0.0]
    low, high = (one(spark, c) for c in S.fisher_interval(F.lit(-0.74), F.lit(54)))
    assert low == pytest.approx(math.tanh(math.atanh(-0.74) - 1.96 / math.sqrt(51)))
    assert [one(spark, c) for c in S.fisher_interval(F.lit(1.0), F.lit(54))] == [None, None]
    assert [one(spark, c) for c in S.fisher_interval(F.lit(0.5), F.lit(3))] == [None, None]


def test_relative_difference_and_ratio_guard_zero(spark):
    assert one(spark, S.relative_difference(F.lit(0.0), F.lit(0.0))) == 0.0
    assert one(spark, S.relative_difference(F.lit(100.0), F.lit(90.0))) == pytest.approx(0.1)
    assert one(spark, S.ratio(F.lit(1), F.lit(0))) is None


def test_median_of_arrays(spark):
    assert one(spark, S.median_of(F.array(F.lit(9.0), F.lit(1.0), F.lit(4.0), F.lit(2.0)))) == 3.0
    assert one(spark, S.median_of(F.array(F.lit(5.0)))) == 5.0
    assert one(spark, S.median_of(F.array().cast("array<double>"))) is None


def test_canonical_json_sorts_keys(spark):
    a = F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))
    assert one(spark, S.canonical_json(a)) == '{"a":"2","b":"1"}'
    assert one(spark, S.canonical_json(F.lit(None).cast("map<string,string>"))) is None


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 20.0), (1, 30.0)], "g int, v double")
    assert sorted(r.r for r in df.select(W.average_rank("v", ["g"]).alias("r")).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_nearest_prefers_the_earlier_on_ties(spark):
    df = spark.createDataFrame([("a", 2013), ("a", 2017), ("b", 2014), ("b", 2016), ("c", 2000)], "k string, y int")
    assert {(r.k, r.y) for r in W.nearest(df, ["k"], "y", 2015, 2).collect()} == {("a", 2013), ("b", 2014)}


def test_run_lengths_keep_the_anchor(spark):
    drift = [(1, y, 1.0 + 0.6 * i) for i, y in enumerate(range(2000, 2004))]
    df = spark.createDataFrame(drift, "k int, y int, v double")
    got = {r.y: r.run_length for r in W.run_lengths(df, ["k"], "y", "v", 1.0).collect()}
    assert got == {2000: 2, 2001: 2, 2002: 2, 2003: 2}  # adjacent values are within 1.0, the anchor's band isn't


def test_lag_at_needs_the_exact_year(spark):
    df = spark.createDataFrame([(1, 2000, 1.0), (1, 2001, 2.0), (1, 2004, 5.0)], "k int, y int, v double")
    got = {r.y: r.x for r in df.select("y", W.lag_at("v", ["k"], "y", 3).alias("x")).collect()}
    assert got == {2000: None, 2001: None, 2004: 2.0}
