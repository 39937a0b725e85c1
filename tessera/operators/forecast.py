"""Forecast baselines, rolling-origin backtests, model instances, and their evaluation.

A series is the rows of (concept, iso3) ordered by year. Histories are window prefixes, targets meet origins
in an equi-join on the year (origin + horizon), so nothing loops over series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import lag_at
from tessera.session import cut

SERIES = ("concept", "iso3")
BASELINES = ("last_value", "linear_trend_5", "average_change")
BUCKETS = ((1, 1, "1"), (2, 3, "2-3"), (4, 5, "4-5"), (6, 10, "6-10"))
MIN_HISTORY, MAX_HORIZON, RESAMPLES = 5, 10, 500
CONCEPTS = ("under5_mortality", "maternal_mortality_ratio", "dtp3_coverage", "measles_mcv1_coverage")
REGIONS = ("Eastern Africa", "Middle Africa", "Northern Africa", "Southern Africa", "Western Africa")
INSTANCE_HISTORY = 6
CUTOFFS = (2010, 2012, 2014, 2016, 2017)
MIN_TRAIN = 500
DECISIVE = "4-5"
BASELINE_FOR = {"under5_mortality": "linear_trend_5", "maternal_mortality_ratio": "linear_trend_5", "dtp3_coverage": "last_value", "measles_mcv1_coverage": "last_value"}


def bucket_of(horizon: Column) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi, label in BUCKETS:
        out = F.when(horizon.between(lo, hi), label).otherwise(out)
    return out


def origins(panel: DataFrame, keys: Sequence[str] = SERIES, order: str = "year", value: str = "value", k: int = 5) -> DataFrame:
    """Each row as a forecast origin with what its history says: first point, last-k line, length."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, tail = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-(k - 1), 0)
    y, v = F.col(order).cast("double"), F.col(value)
    return panel.select(
        *panel.columns,
        F.row_number().over(w).alias("n_history"),
        F.first(order).over(before).alias("first_year"),
        F.first(value).over(before).alias("first_value"),
        F.count("*").over(tail).alias("n_tail"),
        F.regr_slope(v, y).over(tail).alias("slope"),
        F.regr_intercept(v, y).over(tail).alias("intercept"),
    )


def baseline_forecasts(last: Column, at: Column, target: Column) -> dict[str, Column]:
    """The three baselines for columns of origins()."""
    line = F.when((F.col("n_tail") >= 2) & F.col("slope").isNotNull(), F.col("intercept") + F.col("slope") * target).otherwise(last)
    pace = F.try_divide(last - F.col("first_value"), (at - F.col("first_year")).cast("double"))
    return {"last_value": last, "linear_trend_5": line, "average_change": F.coalesce(last + pace * (target - at), last)}


def horizons(df: DataFrame, panel: DataFrame, keys: Sequence[str], max_horizon: int, order: str = "year", value: str = "value") -> DataFrame:
    """Origins joined to the later points of their series up to max_horizon units on: target_year, horizon, actual."""
    reach = df.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(max_horizon)))).withColumn("target_year", F.col(order) + F.col("horizon"))
    later = panel.select(*keys, F.col(order).alias("target_year"), F.col(value).alias("actual"))
    return reach.join(later, [*keys, "target_year"])


def backtest(panel: DataFrame, ranges: DataFrame, keys: Sequence[str] = SERIES, order: str = "year", value: str = "value", min_history: int = MIN_HISTORY, max_horizon: int = MAX_HORIZON) -> DataFrame:
    """All (origin, target) forecasts of the baselines, clipped to the range of ranges (concept, lo, hi), with errors."""
    pairs = horizons(origins(panel, keys, order, value).where(F.col("n_history") >= min_history), panel, keys, max_horizon, order, value).where("actual > 0").join(ranges, "concept")
    predicted = {n: F.greatest(F.col("lo"), F.least(F.col("hi"), p)) for n, p in baseline_forecasts(F.col(value), F.col(order), F.col("target_year")).items()}
    with_preds = pairs.select(*keys, F.col(order).alias("origin_year"), "target_year", "horizon", "n_history", "actual", *[p.alias(f"pred_{n}") for n, p in predicted.items()])
    return with_preds.withColumns({f"ape_{n}": F.abs(F.col(f"pred_{n}") - F.col("actual")) / F.col("actual") for n in predicted})


def cluster_bootstrap_median(groups: Sequence[np.ndarray], resamples: int = RESAMPLES, seed: int = 0) -> tuple[float, float]:
    """95 % interval of the median of pooled values when whole groups are resampled."""
    if len(groups) < 2:
        return float("nan"), float("nan")
    rng = np.random.default_rng(seed)
    medians = [np.median(np.concatenate([groups[i] for i in rng.integers(0, len(groups), len(groups))])) for _ in range(resamples)]
    low, high = np.percentile(medians, [2.5, 97.5])
    return float(low), float(high)


def unpivot_errors(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row for each forecast and model: model, ape."""
    return df.select("*", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"ape_{m}").alias("ape")) for m in models])).alias("__m")).select("*", "__m.model", "__m.ape").drop("__m")


def bootstrap_intervals(df: DataFrame, keys: Sequence[str], cluster: str, value: str, resamples: int = RESAMPLES) -> DataFrame:
    """(keys, ci_low, ci_high): the interval of each group; clusters in name order, so a seed gives one result."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [g[value].to_numpy() for _, g in frame.groupby(cluster, sort=True)]
        low, high = cluster_bootstrap_median(parts, resamples)
        return pd.DataFrame([[*[frame[k].iloc[0] for k in keys], low, high]], columns=[*keys, "ci_low", "ci_high"])

    schema = ", ".join([*[f"{k} {df.schema[k].dataType.simpleString()}" for k in keys], "ci_low double", "ci_high double"])
    return df.select(*keys, cluster, value).groupBy(*keys).applyInPandas(run, schema)


def summarize(tested: DataFrame, models: Sequence[str] = BASELINES, resamples: int | None = RESAMPLES) -> DataFrame:
    """Median error by concept, horizon bucket and model; with resamples also its interval over countries."""
    rows = unpivot_errors(tested.withColumn("bucket", bucket_of(F.col("horizon"))).where("bucket is not null"), models)
    keys = ["concept", "bucket", "model"]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_instances"), F.count_distinct("iso3").alias("n_countries"), F.percentile("ape", F.lit(0.5)).alias("median_ape"))
    return out.join(bootstrap_intervals(rows, keys, "iso3", "ape", resamples), keys) if resamples else out


def data_volume(panel: DataFrame, min_observations: int = 8) -> DataFrame:
    """Length and density of the series of each concept."""
    w = Window.partitionBy(*SERIES).orderBy("year")
    gaps = panel.withColumn("gap", F.col("year") - F.lag("year").over(w))
    series = gaps.groupBy(*SERIES).agg(F.count("*").alias("n"), F.collect_list("gap").alias("gaps"))
    counts = series.groupBy("concept").agg(F.count("*").alias("countries"), F.count_if(F.col("n") >= min_observations).alias("countries_with_history"), F.percentile("n", F.lit(0.5)).alias("median_observations"))
    spaced = gaps.groupBy("concept").agg(F.percentile("gap", F.lit(0.5)).alias("median_gap_years"), F.avg((F.col("gap") == 1).cast("int")).alias("share_annual"))
    return counts.join(spaced, "concept")


def gate(volume: DataFrame, summary: DataFrame, min_countries: int = 30, min_headroom: float = 0.05, min_instances: int = 200, min_eval_countries: int = 20) -> DataFrame:
    """C1 data, C2 headroom of the best baseline, C3 enough forecasts; a concept passes if all hold."""
    best = summary.where(F.col("bucket") == DECISIVE).groupBy("concept").agg(F.min(F.struct("median_ape", "model", "n_instances", "n_countries")).alias("b"))
    joined = volume.join(best, "concept", "left")
    c1 = F.col("countries_with_history") >= min_countries
    c2 = F.coalesce(F.col("b.median_ape") >= min_headroom, F.lit(False))
    c3 = F.coalesce((F.col("b.n_instances") >= min_instances) & (F.col("b.n_countries") >= min_eval_countries), F.lit(False))
    return joined.select("concept", c1.alias("C1_data"), c2.alias("C2_headroom"), c3.alias("C3_evaluable"), F.col("b.model").alias("best_baseline"), F.col("b.median_ape").alias("best_median_ape"), F.coalesce("b.n_instances", F.lit(0)).alias("n_instances"), F.coalesce("b.n_countries", F.lit(0)).alias("n_countries"), (c1 & c2 & c3).alias("supports_forecasting"))


def log_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.ln(F.when(a > 0, a) / F.when(b > 0, b)))


def own_features(panel: DataFrame, keys: Sequence[str] = SERIES, order: str = "year", value: str = "value") -> DataFrame:
    """Features of a series at each of its years, from values up to that year only."""
    lag = lambda k: lag_at(value, keys, order, k)
    v = F.col(value)
    stepped = origins(panel, keys, order, value).withColumns({"dlog1": log_ratio(v, lag(1)), "dlog3": log_ratio(v, lag(3)), "dlog5": log_ratio(v, lag(5))})
    recent = Window.partitionBy(*keys).orderBy(order).rangeBetween(-4, 0)
    span = (F.col(order) - F.col("first_year")).cast("double")
    return stepped.withColumns({
        "level": F.ln(F.when(v > 0, v)),
        "avg_dlog": F.try_divide(log_ratio(v, F.col("first_value")), span),
        "vol5": F.when(F.count("dlog1").over(recent) >= 3, F.stddev_pop("dlog1").over(recent)),
    })


def build_instances(panel: DataFrame, ranges: DataFrame, concepts: Sequence[str] = CONCEPTS, min_history: int = INSTANCE_HISTORY, max_horizon: int = MAX_HORIZON) -> DataFrame:
    """Every forecastable (concept, country, origin, horizon) with features, label ln(actual / last) and baselines."""
    own = panel.where(F.col("concept").isin(list(concepts)))
    featured = own_features(own)
    cross = featured.groupBy("iso3", "year").agg(*[f for c in concepts for f in (F.max(F.when(F.col("concept") == c, F.col("level"))).alias(f"x_{c}_level"), F.max(F.when(F.col("concept") == c, F.col("dlog3"))).alias(f"x_{c}_dlog3"))])
    at = featured.where((F.col("n_history") >= min_history) & (F.col("value") > 0)).join(cross, ["iso3", "year"])
    # What the concept says about itself stands in the own features already.
    at = at.withColumns({f"x_{c}_{k}": F.when(F.col("concept") != c, F.col(f"x_{c}_{k}")) for c in concepts for k in ("level", "dlog3")})
    pairs = horizons(at, own, SERIES, max_horizon).where("actual > 0").join(ranges, "concept")
    predicted = {n: F.greatest(F.col("lo"), F.least(F.col("hi"), p)) for n, p in baseline_forecasts(F.col("value"), F.col("year"), F.col("target_year")).items()}
    features = ["level", "dlog1", "dlog3", "dlog5", "avg_dlog", "vol5", *[f"x_{c}_{k}" for c in concepts for k in ("level", "dlog3")]]
    out = pairs.select(*SERIES, "un_subregion", F.col("year").alias("origin_year"), "target_year", "horizon", F.col("value").alias("last"), "actual", F.ln(F.col("actual") / F.col("value")).alias("y"), "lo", "hi", *features, *[p.alias(f"pred_{n}") for n, p in predicted.items()])
    return out.withColumns({f"ape_{n}": F.abs(F.col(f"pred_{n}") - F.col("actual")) / F.col("actual") for n in predicted})


def design_matrix(instances: DataFrame, concepts: Sequence[str] = CONCEPTS, regions: Sequence[str] = REGIONS) -> tuple[DataFrame, list[str]]:
    """Instances with interactions and fixed one-hot columns, and the names of the model's inputs."""
    h = F.col("horizon")
    extra = {"h_dlog1": h * F.col("dlog1"), "h_dlog3": h * F.col("dlog3") / 3, "h_dlog5": h * F.col("dlog5") / 5, "h_avg": h * F.col("avg_dlog")}
    extra |= {f"is_{c}": (F.col("concept") == c).cast("double") for c in concepts}
    extra |= {f"in_{r.replace(' ', '_')}": F.coalesce((F.col("un_subregion") == r).cast("double"), F.lit(0.0)) for r in regions}
    own = ["level", "dlog1", "dlog3", "dlog5", "avg_dlog", "vol5"]
    names = ["h", *own, *[f"x_{c}_{k}" for c in concepts for k in ("level", "dlog3")], *extra]
    return instances.withColumns({"h": h.cast("double"), **extra}), names


def _pipeline(names: list[str], estimator, scale: bool):
    """Median imputation with a missing-value indicator for each input, optional scaling, then the estimator."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, VectorAssembler

    flags = SQLTransformer(statement="SELECT *, " + ", ".join(f"double(`{n}` IS NULL) AS `m_{n}`" for n in names) + " FROM __THIS__")
    filled = Imputer(strategy="median", inputCols=names, outputCols=[f"f_{n}" for n in names])
    inputs = [*[f"f_{n}" for n in names], *([] if scale else [f"m_{n}" for n in names])]
    stages = [flags, filled, VectorAssembler(inputCols=inputs, outputCol="raw" if scale else "features")]
    if scale:
        stages.append(StandardScaler(withMean=True, inputCol="raw", outputCol="features"))
    return Pipeline(stages=[*stages, estimator])


def _usable(train: DataFrame, names: list[str]) -> list[str]:
    """Inputs that have a value in the training rows; an all-null one can't be imputed."""
    counts = train.agg(*[F.count(n).alias(n) for n in names]).first()
    return [n for n in names if counts[n]]


def fit_ridge(train: DataFrame, names: list[str], alphas: Sequence[float] = (0.1, 1.0, 10.0, 100.0)):
    """Ridge regression of y; the penalty with the least cross-validated squared error of alphas."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    n = max(1, train.count())
    model = LinearRegression(labelCol="y", elasticNetParam=0.0, standardization=False, predictionCol="log_ratio", maxIter=50)
    grid = ParamGridBuilder().addGrid(model.regParam, [a / n for a in alphas]).build()
    search = CrossValidator(estimator=_pipeline(_usable(train, names), model, scale=True), estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="y", predictionCol="log_ratio"), numFolds=3, seed=0)
    return search.fit(train).bestModel


def fit_boosted(train: DataFrame, names: list[str], seed: int, iterations: int = 300):
    """Shallow boosted trees of y with feature subsampling. Missing inputs are filled and flagged."""
    from pyspark.ml.regression import GBTRegressor

    model = GBTRegressor(labelCol="y", predictionCol="log_ratio", maxIter=iterations, stepSize=0.05, maxDepth=3, minInstancesPerNode=20, featureSubsetStrategy="0.8", seed=seed)
    return _pipeline(_usable(train, names), model, scale=False).fit(train)


def to_values(df: DataFrame, log_ratio_col: str, out: str) -> DataFrame:
    """Predicted log ratios in the concept's units, clipped to its range."""
    return df.withColumn(out, F.greatest(F.col("lo"), F.least(F.col("hi"), F.col("last") * F.exp(log_ratio_col))))


def split(instances: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """Training targets lie at or before the cut-off; test forecasts are made at it."""
    return instances.where(F.col("target_year") <= cutoff), instances.where(F.col("origin_year") == cutoff)


def evaluate_models(instances: DataFrame, cutoffs: Sequence[int] = CUTOFFS, seeds: Sequence[int] = (0, 1, 2, 3, 4), iterations: int = 300, min_train: int = MIN_TRAIN, alphas: Sequence[float] = (0.1, 1.0, 10.0, 100.0)) -> DataFrame | None:
    """Test instances of every cut-off with the errors of ridge and boosted trees (mean over seeds)."""
    matrix, names = design_matrix(instances)
    matrix = cut(matrix)
    key = [*SERIES, "origin_year", "horizon"]
    out = None
    for cutoff in cutoffs:
        train, test = split(matrix, cutoff)
        if train.count() < min_train or test.isEmpty():
            continue
        ridge = to_values(fit_ridge(train, names, alphas).transform(test), "log_ratio", "pred_ridge").select(*key, "pred_ridge")
        votes = None
        for seed in seeds:
            one = fit_boosted(train, names, seed, iterations).transform(test).select(*key, F.lit(seed).alias("seed"), "log_ratio")
            votes = one if votes is None else votes.unionByName(one)
        mean = votes.groupBy(*key).agg(F.avg("log_ratio").alias("log_ratio"))
        scored = to_values(test.join(mean, key), "log_ratio", "pred_gbm").join(ridge, key).withColumn("cutoff", F.lit(cutoff))
        scored = scored.withColumns({f"ape_{m}": F.abs(F.col(f"pred_{m}") - F.col("actual")) / F.col("actual") for m in ("ridge", "gbm")})
        out = scored if out is None else out.unionByName(scored)
    return out


def summarize_models(results: DataFrame, models: Sequence[str] = (*BASELINES, "ridge", "gbm"), baselines: Sequence[str] = BASELINES, resamples: int = RESAMPLES) -> DataFrame:
    """Each model against the best baseline of its concept and bucket, paired by instance."""
    data = results.withColumn("bucket", bucket_of(F.col("horizon"))).where("bucket is not null")
    place = {m: i for i, m in enumerate(baselines)}
    medians = unpivot_errors(data, baselines).groupBy("concept", "bucket", "model").agg(F.percentile("ape", F.lit(0.5)).alias("m"))
    order = F.element_at(F.create_map(*[x for m, i in place.items() for x in (F.lit(m), F.lit(i))]), F.col("model"))
    best = medians.groupBy("concept", "bucket").agg(F.min(F.struct("m", order.alias("o"), "model")).alias("b")).select("concept", "bucket", F.col("b.model").alias("best_baseline"), F.col("b.m").alias("best_baseline_ape"))
    joined = data.join(best, ["concept", "bucket"])
    base = F.coalesce(*[F.when(F.col("best_baseline") == m, F.col(f"ape_{m}")) for m in baselines])
    rows = unpivot_errors(joined.withColumn("__base", base), models).withColumn("diff", F.col("ape") - F.col("__base"))
    keys = ["concept", "bucket", "model"]
    out = rows.groupBy(*keys, "best_baseline", "best_baseline_ape").agg(F.count("*").alias("n_instances"), F.count_distinct("iso3").alias("n_countries"), F.percentile("ape", F.lit(0.5)).alias("median_ape"), F.percentile("diff", F.lit(0.5)).alias("median_diff"), F.avg((F.col("diff") < 0).cast("int")).alias("share_better"))
    return out.join(bootstrap_intervals(rows, keys, "iso3", "diff", resamples).withColumnsRenamed({"ci_low": "diff_low", "ci_high": "diff_high"}), keys)


def verdicts(summary: DataFrame, models: Sequence[str] = ("ridge", "gbm")) -> DataFrame:
    """A model is useful if its median error is lower and the interval of the difference lies below zero."""
    lower, below = F.col("median_ape") < F.col("best_baseline_ape"), F.coalesce(F.col("diff_high") < 0, F.lit(False))
    return summary.where((F.col("bucket") == DECISIVE) & F.col("model").isin(list(models))).select("concept", "model", "best_baseline", "median_ape", F.col("best_baseline_ape").alias("baseline_ape"), "median_diff", "diff_low", "diff_high", lower.alias("lower_error"), below.alias("interval_below_zero"), (lower & below).alias("useful"))


def by_cutoff(results: DataFrame, best: DataFrame, models: Sequence[str] = ("ridge", "gbm"), baselines: Sequence[str] = BASELINES) -> DataFrame:
    """Median errors at the decisive horizon for each cut-off; best (concept, best_baseline)."""
    data = results.where(bucket_of(F.col("horizon")) == DECISIVE).join(best, "concept")
    base = F.coalesce(*[F.when(F.col("best_baseline") == m, F.col(f"ape_{m}")) for m in baselines])
    median = lambda c: F.percentile(c, F.lit(0.5))
    out = data.withColumn("__base", base).groupBy("concept", "cutoff", "best_baseline").agg(F.count("*").alias("n_instances"), median("__base").alias("baseline_ape"), *[median(f"ape_{m}").alias(f"{m}_ape") for m in models])
    return out.withColumn("gbm_beats_baseline", F.col("gbm_ape") < F.col("baseline_ape")) if "gbm" in models else out


# --- ablation ----------------------------------------------------------------------------------------------


def analysis_panel(panel: DataFrame, drop_flagged: bool = True) -> DataFrame:
    """The reconciled panel without conflicts and, with drop_flagged, without flagged values."""
    solid = panel.where("quality_tier <> 'conflict'")
    return solid.where("not outlier_flag and not source_disagreement") if drop_flagged else solid


def naive_panel(standard: DataFrame, countries: DataFrame, concepts: Sequence[str] = CONCEPTS, source: str = "who") -> DataFrame:
    """One source as published: exact totals, exact ISO3, nulls dropped, a later duplicate wins."""
    total = lambda c, code: F.col(c).isNull() | (F.col(c) == code)
    rows = standard.where((F.col("source") == source) & F.col("concept").isin(list(concepts)) & total("sex_raw", "SEX_BTSX") & total("wealth_raw", "WEALTHQUINTILE_TOTL") & F.col("year").isNotNull() & F.col("value").isNotNull())
    known = rows.join(countries.select(F.col("iso3").alias("place"), "un_subregion"), "place")
    return known.groupBy("concept", F.col("place").alias("iso3"), "un_subregion", "year").agg(F.max_by("value", F.struct("source_file", "row_num")).alias("value"))


def score_against_truth(scored: DataFrame, truth: DataFrame, clean_keys: DataFrame) -> DataFrame:
    """Errors of a variant's forecasts against the clean values, for forecasts that the clean data have too."""
    key = [*SERIES, "origin_year", "horizon"]
    real = truth.select(*SERIES, F.col("year").alias("target_year"), F.col("value").alias("truth")).where("truth is not null")
    base = F.coalesce(*[F.when(F.col("concept") == c, F.col(f"pred_{m}")) for c, m in BASELINE_FOR.items()])
    joined = scored.withColumn("pred_baseline", base).join(real, [*SERIES, "target_year"]).join(clean_keys.select(*key).distinct(), key, "left_semi")
    return joined.select(*key, "cutoff", *[(F.abs(F.col(f"pred_{m}") - F.col("truth")) / F.col("truth")).alias(f"ape_{m}") for m in ("baseline", "gbm") if f"pred_{m}" in joined.columns])


def paired_frames(clean: DataFrame, naive: DataFrame, pipeline: DataFrame, keys: Sequence[str] = (*SERIES, "origin_year", "horizon"), models: Sequence[str] = ("baseline", "gbm")) -> DataFrame:
    """Forecasts that all three variants have, side by side."""
    side = lambda df, v: df.select(*keys, *[F.col(f"ape_{m}").alias(f"{m}_{v}") for m in models])
    return side(clean, "clean").join(side(naive, "naive"), list(keys)).join(side(pipeline, "pipeline"), list(keys))


def degradation(paired: DataFrame, model: str, group: Sequence[str] = ("concept",), resamples: int | None = RESAMPLES) -> DataFrame:
    """Median paired loss against clean input of naive and pipeline, and their difference, by group."""
    c = lambda v: F.col(f"{model}_{v}")
    deltas = {"naive": c("naive") - c("clean"), "pipeline": c("pipeline") - c("clean"), "naive_minus_pipeline": c("naive") - c("pipeline")}
    rows = paired.select(*group, "iso3", F.explode(F.array(*[F.struct(F.lit(n).alias("comparison"), d.alias("delta")) for n, d in deltas.items()])).alias("d")).select(*group, "iso3", "d.comparison", "d.delta")
    keys = [*group, "comparison"]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("iso3").alias("n_countries"), F.percentile("delta", F.lit(0.5)).alias("median_delta"))
    return out.join(bootstrap_intervals(rows, keys, "iso3", "delta", resamples), keys) if resamples else out


def coverage(variant: DataFrame, clean_keys: DataFrame) -> DataFrame:
    """Share of the clean forecasts that a variant can make at all."""
    return variant.agg(F.count("*").alias("n")).withColumn("n_clean", F.lit(clean_keys.count())).select("n", "n_clean", F.try_divide(F.col("n").cast("double"), F.col("n_clean")).alias("coverage"))
