"""Registered queries of model inputs, cut-offs, comparisons and diagnoses, on the same observations, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.functions.windows import first_by
from tessera.operators import experiments, forecast
from tessera.plans import queries as base
from tessera.plans.queries import ORACLES, Layer, r6, register, rounded


def _exact(sql: str) -> str:
    """The SQL of a query without its rounding."""
    return re.sub(r"round\((.*?), 6\) \+ 0\.0 AS", r"\1 AS", sql)


def _instances(spark, sf_dir):
    rows = base.series(spark, sf_dir).withColumn("un_subregion", F.lit(""))
    concepts = [r.concept for r in rows.select("concept").distinct().orderBy("concept").collect()]
    return forecast.build_instances(rows, base._series_ranges(spark, sf_dir), concepts), concepts


@register(
    "design_matrix",
    f"""SELECT iso3, concept, origin_year, horizon, CAST(horizon AS DOUBLE) AS h, round(horizon * dlog1, 6) + 0.0 AS h_dlog1, round(horizon * dlog3 / 3, 6) + 0.0 AS h_dlog3, round(horizon * dlog5 / 5, 6) + 0.0 AS h_dlog5, round(horizon * avg_dlog, 6) + 0.0 AS h_avg,
  CAST(concept = '1-URGENT' AS DOUBLE) AS is_first, 0.0::DOUBLE AS in_region FROM ({_exact(ORACLES["instances"])}) i""",
)
def design_matrix(spark, sf_dir):
    built, concepts = _instances(spark, sf_dir)
    matrix, _ = forecast.design_matrix(built, concepts, ["Eastern Africa"])
    return rounded(matrix.select("iso3", "concept", "origin_year", "horizon", "h", "h_dlog1", "h_dlog3", "h_dlog5", "h_avg", F.col(f"`is_{concepts[0]}`").alias("is_first"), F.col("in_Eastern_Africa").alias("in_region")))


@register(
    "cutoff_split",
    f"SELECT concept, CAST(count(*) FILTER (WHERE origin_year + horizon <= 24000) AS BIGINT) AS n_train, CAST(count(*) FILTER (WHERE origin_year = 24000) AS BIGINT) AS n_test FROM ({ORACLES['instances']}) i GROUP BY concept HAVING count(*) FILTER (WHERE origin_year + horizon <= 2000 OR origin_year = 24000) > 0",
)
def cutoff_split(spark, sf_dir):
    train, test = forecast.split(_instances(spark, sf_dir)[0], 24000)
    both = train.select("concept", F.lit(1).alias("a"), F.lit(0).alias("b"), (F.col("origin_year") + F.col("horizon") <= 2000).alias("c")).unionAll(test.select("concept", F.lit(0), F.lit(1), F.lit(True)))
    counted = both.groupBy("concept").agg(F.sum("a").alias("n_train"), F.sum("b").alias("n_test"), F.max("c").alias("listed"))
    return counted.where("listed").drop("listed")  # as the SQL's HAVING has it


_RIVALS = ("linear_trend_5", "average_change")
_ERRORS = ", ".join(f"abs({m} - actual) / actual AS e_{m}" for m in ("last_value", *_RIVALS))


@register(
    "model_comparison",
    f"""WITH {base._BACKTEST}, e AS (SELECT *, {base._BUCKET} AS bucket, {_ERRORS} FROM backtest WHERE horizon <= 10),
m AS ({" UNION ALL ".join(f"SELECT concept, bucket, iso3, '{m}' AS model, e_{m} AS ape, e_{m} - e_last_value AS diff FROM e" for m in _RIVALS)}), medians AS (SELECT concept, bucket, quantile_cont(e_last_value, 0.5) AS base FROM e GROUP BY ALL)
SELECT concept, bucket, model, 'last_value' AS best_baseline, round(base, 6) + 0.0 AS best_baseline_ape, CAST(count(*) AS BIGINT) AS n_instances, CAST(count(DISTINCT iso3) AS BIGINT) AS n_countries, round(quantile_cont(ape, 0.5), 6) + 0.0 AS median_ape, round(quantile_cont(diff, 0.5), 6) + 0.0 AS median_diff, round(avg((diff < 0)::INT), 6) + 0.0 AS share_better
FROM m JOIN medians USING (concept, bucket) GROUP BY concept, bucket, model, base""",
)
def model_comparison(spark, sf_dir):
    """Two baselines in the place of models, against the third; the intervals are drawn, and have no SQL."""
    compared = forecast.summarize_models(base._backtest(spark, sf_dir), models=_RIVALS, baselines=("last_value",), resamples=20)
    return rounded(compared.select("concept", "bucket", "model", "best_baseline", "best_baseline_ape", "n_instances", "n_countries", "median_ape", "median_diff", "share_better"))


@register(
    "errors_by_cutoff",
    f"""WITH {base._BACKTEST}, e AS (SELECT *, {_ERRORS} FROM backtest WHERE horizon BETWEEN 4 AND 5)
SELECT concept, origin_year AS cutoff, CAST(count(*) AS BIGINT) AS n_instances, round(quantile_cont(e_last_value, 0.5), 6) + 0.0 AS baseline_ape, {", ".join(f"round(quantile_cont(e_{m}, 0.5), 6) + 0.0 AS {m}_ape" for m in _RIVALS)} FROM e GROUP BY concept, origin_year""",
)
def errors_by_cutoff(spark, sf_dir):
    tested = base._backtest(spark, sf_dir).withColumn("cutoff", F.col("origin_year"))
    best = tested.select("concept").distinct().withColumn("best_baseline", F.lit("last_value"))
    return rounded(forecast.by_cutoff(tested, best, models=_RIVALS, baselines=("last_value",)).drop("best_baseline"))


@register("analysis_panel", f"WITH {base._PANEL} SELECT country, concept, year, round(value, 6) + 0.0 AS value, quality_tier FROM panel WHERE quality_tier <> 'conflict' AND NOT source_disagreement")
def analysis_panel(spark, sf_dir):
    return rounded(forecast.analysis_panel(Layer(spark, sf_dir).panel).select("country", "concept", "year", "value", "quality_tier"))


@register("latest_gap", f"SELECT DISTINCT ON (country, concept) * FROM ({ORACLES["equity_gap"]}) g ORDER BY country, concept, year DESC")
def latest_gap(spark, sf_dir):
    return first_by(base.equity_gap(spark, sf_dir), ["country", "concept"], [F.col("year").desc()])


@register(
    "outlier_context",
    f"""WITH {base._POOL}, f AS (SELECT *, CASE WHEN row_num % 20 = 0 THEN 1 ELSE 0 END AS hit FROM pool WHERE row_num % 40 <> 0 AND row_num % 140 <> 20),
n AS (SELECT *, sum(hit) OVER (PARTITION BY source, country, concept ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - hit AS near FROM f)
SELECT row_num % 7 = 0 AND row_num % 60 <> 0 AS flagged, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE near > 0) AS BIGINT) AS n_near_fault FROM n WHERE hit = 0 GROUP BY ALL""",
)
def outlier_context(spark, sf_dir):
    """Every seventh row counts as flagged here; the diagnosis asks whether a fault stands near it in its series."""
    _, faults, _, fact, _ = base._faulted(spark, sf_dir)
    flagged = fact.withColumns({"source": F.col("source_file"), "is_headline": F.lit(True), "is_selected": F.lit(True), "quality_flags": F.transform("quality_flags", lambda x: F.when(x == "bounds_violation", "temporal_outlier").otherwise("other"))})
    return experiments.outlier_context(flagged, faults)
