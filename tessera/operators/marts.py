"""Analytical marts over the reconciled panel. All take column names or natural keys and return DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import fisher_interval, has_flag, ratio, safe_corr
from tessera.functions.windows import average_rank, first_by, nearest
from tessera.operators.core import CELL, is_total, selected_rows
from tessera.params import MartParams


def quality_tier(conflict: Column, n_groups: Column) -> Column:
    return F.when(conflict, "conflict").when(n_groups > 1, "cross_validated").otherwise("single_evidence_group")


def panel(reconciled: DataFrame, fact: DataFrame) -> DataFrame:
    """One value per cell with its trust information; flags come from the row whose value was taken."""
    chosen = selected_rows(fact).select(*CELL, F.col("source").alias("reconciled_source"), has_flag(F.col("quality_flags"), "temporal_outlier").alias("outlier_flag"), has_flag(F.col("quality_flags"), "flat_run").alias("flat_run"))
    joined = reconciled.join(chosen, [*CELL, "reconciled_source"], "left")
    return joined.select(
        *CELL,
        F.col("reconciled_value").alias("value"),
        "reconciled_source",
        "n_sources",
        "n_evidence_groups",
        quality_tier(F.col("conflict"), F.col("n_evidence_groups")).alias("quality_tier"),
        F.coalesce("outlier_flag", F.lit(False)).alias("outlier_flag"),
        F.col("within_group_disagreement").alias("source_disagreement"),
        F.coalesce("flat_run", F.lit(False)).alias("flat_run"),
    )


def latest(df: DataFrame, entity: str = "country", measure: str = "concept", order: str = "year", keep: Sequence[str] = ("value", "quality_tier")) -> DataFrame:
    """Latest row of each series with its age against the latest one of the measure anywhere.

    Two aggregations, so a measure with most of the rows is pre-aggregated and never sorted in one task.
    """
    last = F.max(F.struct(order, *keep)).alias("__last")
    series = df.groupBy(entity, measure).agg(last, F.min(order).alias("first_year"), F.count("*").alias("n_observations"))
    newest = series.groupBy(measure).agg(F.max(F.col("__last")[order]).alias("__newest"))
    return series.join(newest, measure).select(entity, measure, F.col("__last")[order].alias("latest_year"), *[F.col("__last")[c].alias(c) for c in keep], "first_year", "n_observations", (F.col("__newest") - F.col("__last")[order]).alias("years_behind"))


def trend(df: DataFrame, keys: Sequence[str] = ("country", "concept"), order: str = "year", value: str = "value", params: MartParams = MartParams()) -> DataFrame:
    """Linear and log-linear trend of each series over the window, if it is long and dense enough."""
    y, v = F.col(order), F.col(value)
    log_slope = F.regr_slope(F.ln(F.when(v > 0, v)), y)
    start, end = F.min_by(value, order), F.max_by(value, order)
    return (
        df.where(y >= params.trend_start)
        .groupBy(*keys)
        .agg(
            F.min(order).alias("window_start"),
            F.max(order).alias("window_end"),
            F.count("*").alias("n_points"),
            start.alias("value_start"),
            end.alias("value_end"),
            (end - start).alias("absolute_change"),
            F.regr_slope(v, y).alias("linear_slope_per_year"),
            F.regr_r2(v, y).alias("linear_r2"),
            F.when(F.min(v) > 0, F.exp(log_slope) - 1).alias("annual_pct_change"),
        )
        .where((F.col("n_points") >= params.trend_min_points) & (F.col("window_end") - F.col("window_start") >= params.trend_min_span))
    )


def region_year(df: DataFrame, members: DataFrame, region: str = "un_subregion", entity: str = "country", keys: Sequence[str] = ("concept", "year"), value: str = "value") -> DataFrame:
    """Unweighted distribution over a region's entities; members (entity, region) gives how many are possible."""
    possible = members.groupBy(region).agg(F.count("*").alias("n_possible"))
    quartile = lambda q: F.percentile(value, F.lit(q))
    grouped = df.join(members.select(entity, region), entity).groupBy(region, *keys).agg(
        F.count("*").alias("n_countries"), F.avg(value).alias("mean_value"), quartile(0.5).alias("median_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), quartile(0.25).alias("p25_value"), quartile(0.75).alias("p75_value")
    )
    return grouped.join(possible, region).withColumn("coverage_share", F.col("n_countries") / F.col("n_possible"))


def rank_association(values: DataFrame, entity: str, measure_order: str, measure: str, value: str, min_entities: int) -> DataFrame:
    """Spearman and Pearson association of each pair of measures across entities, with a Fisher-z interval.

    values has one row for each (entity, measure); measure_order puts the sides of a pair in order.
    """
    a = values.select(entity, F.col(measure).alias("a"), F.col(measure_order).alias("oa"), F.col(value).alias("va"))
    b = values.select(entity, F.col(measure).alias("b"), F.col(measure_order).alias("ob"), F.col(value).alias("vb"))
    pairs = a.join(b, entity).where("oa < ob")
    ranked = pairs.withColumn("ra", average_rank("va", ("a", "b"))).withColumn("rb", average_rank("vb", ("a", "b")))
    found = ranked.groupBy("a", "b").agg(F.count("*").alias("n"), safe_corr(F.col("ra"), F.col("rb")).alias("rho"), safe_corr(F.col("va"), F.col("vb")).alias("r"))
    low, high = fisher_interval(F.col("rho"), F.col("n"))
    return found.where((F.col("n") >= min_entities) & F.col("rho").isNotNull()).select(
        F.col("a").alias("indicator_a"), F.col("b").alias("indicator_b"), F.col("n").alias("n_countries"), F.col("rho").alias("spearman_rho"), F.col("r").alias("pearson_r"), low.alias("rho_ci_low"), high.alias("rho_ci_high")
    )


def level_values(df: DataFrame, params: MartParams) -> DataFrame:
    """The value of each series nearest to the reference year, conflicts left out."""
    return nearest(df.where("quality_tier <> 'conflict'"), ("country", "concept"), "year", params.ref_year, params.tolerance).select("country", "concept", "value")


def change_values(df: DataFrame, params: MartParams) -> DataFrame:
    """Differences between the values nearest to the reference and to the base year, if far enough apart."""
    solid = df.where("quality_tier <> 'conflict'")
    end = nearest(solid, ("country", "concept"), "year", params.ref_year, params.tolerance).select("country", "concept", F.col("value").alias("ve"), F.col("year").alias("ye"))
    start = nearest(solid, ("country", "concept"), "year", params.base_year, params.tolerance).select("country", "concept", F.col("value").alias("vs"), F.col("year").alias("ys"))
    return end.join(start, ["country", "concept"]).where(F.col("ye") - F.col("ys") >= params.change_min_span).select("country", "concept", (F.col("ve") - F.col("vs")).alias("value"))


def association(df: DataFrame, indicators: DataFrame, params: MartParams) -> DataFrame:
    """Level and change associations; indicators (concept, ordinal) orders the pairs."""
    out = []
    for basis, label, values in (("level", params.level_label, level_values(df, params)), ("change", params.change_label, change_values(df, params))):
        ordered = values.join(indicators.select("concept", "ordinal"), "concept")
        out.append(rank_association(ordered, "country", "ordinal", "concept", "value", params.min_countries).withColumns({"basis": F.lit(basis), "reference": F.lit(label)}))
    return out[0].unionByName(out[1])


#: Dimension of a gap, the column it splits, and its two groups (label, code), a over b.
GAPS = (
    ("wealth", "wealth_quintile", ("poorest", "q1"), ("richest", "q5")),
    ("sex", "sex", ("female", "female"), ("male", "male")),
    ("residence", "residence", ("rural", "rural"), ("urban", "urban")),
)


def paired_gaps(df: DataFrame, dimension: str, split: str, a: tuple[str, str], b: tuple[str, str], keys: Sequence[str], value: str = "value") -> DataFrame:
    """Pairs of the two groups of a split within equal keys, where each group has exactly one row."""
    of = lambda code: F.col(split) == code
    return (
        df.where(F.col(split).isin(a[1], b[1]))
        .groupBy(*keys)
        .agg(F.max(F.when(of(a[1]), F.col(value))).alias("value_a"), F.max(F.when(of(b[1]), F.col(value))).alias("value_b"), F.count_if(of(a[1])).alias("__na"), F.count_if(of(b[1])).alias("__nb"))
        .where("__na = 1 and __nb = 1")
        .select(F.lit(dimension).alias("dimension"), F.lit(a[0]).alias("group_a"), F.lit(b[0]).alias("group_b"), *keys, "value_a", "value_b")
    )


def equity_gap(fact: DataFrame, sources: DataFrame, indicators: DataFrame) -> DataFrame:
    """Gaps between groups of the same survey or series; of several pairs the best source's latest one."""
    rows = fact.join(sources.select("source", "priority"), "source").join(indicators.select("concept", "unicef_headline_age"), "concept")
    extra = is_total(F.get_json_object("other_dims", "$.HEAD_OF_HOUSE")) & is_total(F.get_json_object("other_dims", "$.AGE_AT_BIRTH"))
    base = rows.where((F.col("maternal_education") == "total") & extra & ((F.col("source") != "unicef") | F.col("age_group").eqNullSafe(F.col("unicef_headline_age"))))
    keys = ("source", "priority", *CELL, "upstream_label", "period_text")
    splits = [c for _, c, _, _ in GAPS]
    candidates = None
    for dimension, split, a, b in GAPS:
        others = [F.col(c) == "total" for c in splits if c != split]
        pairs = paired_gaps(base.where(others[0] & others[1]), dimension, split, a, b, keys)
        candidates = pairs if candidates is None else candidates.unionByName(pairs)
    group = (*CELL, "dimension")
    counted = candidates.withColumn("n_candidate_pairs", F.count("*").over(Window.partitionBy(*group)))
    best = first_by(counted, group, [F.col("priority"), F.col("period_text").desc_nulls_last(), F.col("upstream_label").asc_nulls_last()])
    return best.select(*group, "group_a", "group_b", "value_a", "value_b", ratio(F.col("value_a"), F.col("value_b")).alias("ratio"), (F.col("value_a") - F.col("value_b")).alias("difference"), "source", "upstream_label", "n_candidate_pairs")


def data_trust(df: DataFrame, n_countries: int, params: MartParams) -> DataFrame:
    """Coverage and mix of quality tiers of each indicator."""
    share = lambda c: F.avg(c.cast("int"))
    tier = lambda t: share(F.col("quality_tier") == t)
    return df.groupBy("concept").agg(
        F.count("*").alias("n_values"), F.count_distinct("country").alias("n_countries"), F.min("year").alias("year_min"), F.max("year").alias("year_max"),
        (F.count("*") / F.lit(float(n_countries * (params.year_max - params.year_min + 1)))).alias("grid_coverage"),
        tier("cross_validated").alias("share_cross_validated"), tier("single_evidence_group").alias("share_single_evidence"), tier("conflict").alias("share_conflict"),
        share(F.col("outlier_flag")).alias("share_outlier_flag"), share(F.col("source_disagreement")).alias("share_source_disagreement"), share(F.col("flat_run")).alias("share_flat_run"),
    )


def reversals(df: DataFrame, keys: Sequence[str] = ("country", "concept"), order: str = "year", value: str = "value", span: int = 4, flag: str | None = "outlier_flag") -> DataFrame:
    """Each row with the value `span` years before, the rise since, and the flagged rows from then to now."""
    w = Window.partitionBy(*keys).orderBy(order)
    inside = w.rangeBetween(-span, 0)
    lagged = df.withColumn("v_prev", F.lag(value, span).over(w)).withColumn("y_prev", F.lag(order, span).over(w))
    flags = F.sum(F.col(flag).cast("int")).over(inside) if flag else F.lit(0)
    return lagged.withColumn("n_flagged", flags).where(F.col("y_prev") == F.col(order) - span).withColumn("rise", F.col(value) - F.col("v_prev"))
