"""Core layer: standardised rows -> classified rows -> facts -> dependence -> reconciled cells.

Frames carry natural keys: source, country (ISO3), concept, year. Every function is DataFrame -> DataFrame and
keeps further columns unless it aggregates. Dimension tables are small by nature (countries, vocabulary);
they are joined without a hint, so the optimizer broadcasts them as long as their size allows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import clean_text, flag_array, has_flag, median_of, normalize_name, relative_difference
from tessera.functions.windows import first_by, neighbours, run_lengths
from tessera.params import CoreParams

CELL = ("country", "concept", "year")
REASONS = ("unknown_country", "invalid_year", "unparseable_value", "no_value", "out_of_range", "unmapped_vocabulary", "exact_duplicate")
#: Attributes that make two accepted rows of a source the same observation.
IDENTITY = ("source", "concept", "country", "year", "period_text", "sex", "wealth_quintile", "residence", "maternal_education", "age_raw", "upstream_label", "value", "other_dims")


def is_total(code: Column) -> Column:
    return F.coalesce(code, F.lit("_T")) == "_T"


# --- standardisation ---------------------------------------------------------------------------------------


def standardize(who: DataFrame, worldbank: DataFrame, unicef: DataFrame, load_log: DataFrame) -> DataFrame:
    """Three source shapes in one; the concept of a row comes from its file's entry in the load log."""
    none = lambda kind: F.lit(None).cast(kind)
    unexpected = lambda n, kind: F.coalesce(~F.col(f"dim{n}_type").eqNullSafe(kind) & F.col(f"dim{n}").isNotNull(), F.lit(False))
    shared = ["run_id", "source_file", "row_num"]
    from_who = who.select(
        *shared,
        F.lit("who").alias("source"),
        F.col("spatial_dim").alias("place"),
        F.col("time_dim").alias("year"),
        F.col("time_dim").cast("string").alias("period_text"),
        F.col("numeric_value").alias("value"),
        "value_text",
        "low",
        "high",
        F.when(F.col("dim1_type") == "SEX", F.col("dim1")).alias("sex_raw"),
        F.when(F.col("dim3_type") == "WEALTHQUINTILE", F.col("dim3")).alias("wealth_raw"),
        none("string").alias("residence_raw"),
        none("string").alias("maternal_edu_raw"),
        F.col("dim2").alias("age_raw"),
        F.col("data_source_dim").alias("upstream_label"),
        none("int").alias("priority"),
        none("map<string,string>").alias("extra"),
        (unexpected(1, "SEX") | unexpected(2, "AGEGROUP") | unexpected(3, "WEALTHQUINTILE")).alias("unexpected_dim"),
    )
    from_bank = worldbank.select(
        *shared,
        F.lit("worldbank").alias("source"),
        F.col("country_iso3").alias("place"),
        "year",
        F.col("date_text").alias("period_text"),
        "value",
        F.col("value").cast("string").alias("value_text"),
        *[none("double").alias(c) for c in ("low", "high")],
        *[none("string").alias(c) for c in ("sex_raw", "wealth_raw", "residence_raw", "maternal_edu_raw", "age_raw", "upstream_label")],
        none("int").alias("priority"),
        none("map<string,string>").alias("extra"),
        F.lit(False).alias("unexpected_dim"),
    )
    from_unicef = unicef.select(
        *shared,
        F.lit("unicef").alias("source"),
        F.col("ref_area").alias("place"),
        "year",
        F.col("time_period").alias("period_text"),
        F.col("obs_value").alias("value"),
        "value_text",
        F.col("lower_bound").alias("low"),
        F.col("upper_bound").alias("high"),
        F.col("sex").alias("sex_raw"),
        F.col("wealth_quintile").alias("wealth_raw"),
        F.col("residence").alias("residence_raw"),
        F.coalesce(F.col("extra")["MATERNAL_EDU_LVL"], F.col("extra")["MOTHER_EDUCATION"]).alias("maternal_edu_raw"),
        F.col("age").alias("age_raw"),
        F.col("data_source").alias("upstream_label"),
        F.col("extra")["DATA_SOURCE_PRIORITY"].try_cast("int").alias("priority"),
        "extra",
        F.lit(False).alias("unexpected_dim"),
    )
    rows = from_who.unionByName(from_bank).unionByName(from_unicef)
    return rows.join(load_log.select("run_id", "source_file", "concept"), ["run_id", "source_file"])


# --- classification ----------------------------------------------------------------------------------------


def country_keys(countries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(step, lookup, country): every text that identifies a country, with the step at which it may match.

    Step 1 takes ISO3 as written, 2 ISO3 after trimming and upper case, 3 ISO2 likewise, 4 normalised names.
    """
    names = countries.select(normalize_name(F.col("name")).alias("lookup"), F.col("iso3").alias("country")).unionByName(aliases.select(normalize_name(F.col("alias")).alias("lookup"), F.col("iso3").alias("country")))
    step = lambda n, df: df.select(F.lit(n).alias("step"), "lookup", "country")
    iso3 = countries.select(F.col("iso3").alias("lookup"), F.col("iso3").alias("country"))
    return step(1, iso3).unionByName(step(2, iso3)).unionByName(step(3, countries.select(F.col("iso2").alias("lookup"), F.col("iso3").alias("country")))).unionByName(step(4, names.where("lookup <> ''").groupBy("lookup").agg(F.min("country").alias("country"))))


RESOLUTIONS = ("exact", "normalized", "iso2", "alias")


def resolve_country(df: DataFrame, keys: DataFrame, place: str = "place") -> DataFrame:
    """Cascading lookup: adds country and country_resolution, the first step that matches; both null if none does.

    The distinct places are resolved, not the rows, so the big side meets one small table once.
    """
    text = F.col("place")
    upper = F.upper(F.trim(text))
    places = df.select(F.col(place).alias("place")).where(F.col("place").isNotNull()).distinct()
    tries = places.select("place", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("step"), c.alias("lookup")) for i, c in enumerate((text, upper, upper, normalize_name(text)))])).alias("t")).select("place", "t.step", "t.lookup")
    matched = tries.join(keys, ["step", "lookup"]).groupBy("place").agg(F.min_by("country", "step").alias("country"), F.min("step").alias("step"))
    named = matched.select(F.col("place").alias("__place"), "country", F.element_at(F.array(*[F.lit(x) for x in RESOLUTIONS]), F.col("step")).alias("country_resolution"))
    return df.join(named, F.col(place) == F.col("__place"), "left").drop("__place")


def crosswalk(df: DataFrame, vocabulary: DataFrame, dimension: str, raw: str, out: str) -> DataFrame:
    """Canonical value of a source's code: absent is 'total', unknown is null."""
    own = vocabulary.where(F.col("dimension") == dimension).select(F.col("source").alias("__source"), F.col("source_value").alias("__code"), F.col("canonical").alias("__canonical"))
    joined = df.join(own, (F.col("source") == F.col("__source")) & (F.col(raw) == F.col("__code")), "left")
    return joined.withColumn(out, F.when(F.col(raw).isNull(), "total").otherwise(F.col("__canonical"))).drop("__source", "__code", "__canonical")


def reject_reason(year_min: int, year_max: int) -> Column:
    """The first rule that a row breaks, null if none; before duplicates are looked for."""
    value, year = F.col("value"), F.col("year")
    unmapped = F.col("unexpected_dim") | F.col("sex").isNull() | F.col("wealth_quintile").isNull() | F.col("residence").isNull()
    return (
        F.when(F.col("country").isNull(), "unknown_country")
        .when(year.isNull() | (year < year_min) | (year > year_max), "invalid_year")
        .when(value.isNull() & F.col("value_text").isNotNull(), "unparseable_value")
        .when(value.isNull(), "no_value")
        .when((value < F.col("valid_min")) | (value > F.col("valid_max")), "out_of_range")
        .when(unmapped, "unmapped_vocabulary")
    )


def mark_duplicates(df: DataFrame, identity: Sequence[str], order: Sequence[str], reason: str = "reason") -> DataFrame:
    """Adds dup_rank among rows without a reason (1 for all others) and reject_reason.

    Rows with a reason get a partition of their own each, so that they neither rank nor pile up in one task.
    """
    clean = F.col(reason).isNull()
    alone = F.when(~clean, F.xxhash64(*order))
    rank = F.row_number().over(Window.partitionBy(alone, *identity).orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    ranked = df.withColumn("dup_rank", F.when(clean, rank).otherwise(1))
    return ranked.withColumn("reject_reason", F.when(clean & (F.col("dup_rank") > 1), "exact_duplicate").otherwise(F.col(reason)))


def classify(standard: DataFrame, countries: DataFrame, aliases: DataFrame, indicators: DataFrame, vocabulary: DataFrame, params: CoreParams) -> DataFrame:
    """Resolved keys, canonical dimensions and at most one reject_reason for every standardised row."""
    from tessera.functions.scalars import canonical_json

    rows = resolve_country(standard, country_keys(countries, aliases))
    rows = rows.join(indicators.select("concept", "valid_min", "valid_max", "unicef_headline_age"), "concept", "left")
    for dimension, raw in (("sex", "sex_raw"), ("wealth_quintile", "wealth_raw"), ("residence", "residence_raw")):
        rows = crosswalk(rows, vocabulary, dimension, raw, dimension)
    rows = rows.withColumn("maternal_education", F.when(is_total(F.col("maternal_edu_raw")), "total").otherwise(F.col("maternal_edu_raw"))).withColumn("other_dims", canonical_json(F.col("extra")))
    reasoned = rows.withColumn("reason", reject_reason(params.year_min, params.year_max))
    return mark_duplicates(reasoned, IDENTITY, ("source_file", "row_num")).drop("reason")


def rejects(classified: DataFrame) -> DataFrame:
    """Rejected rows with their reason and the raw values as JSON."""
    detail = F.to_json(F.struct(F.col("place").alias("iso3"), "year", "value", "value_text", "sex_raw", "wealth_raw", "residence_raw"), {"ignoreNullFields": "false"})
    return classified.where(F.col("reject_reason").isNotNull()).select("run_id", "source", "concept", "source_file", "row_num", F.col("reject_reason").alias("reason"), detail.alias("detail"))


# --- facts -------------------------------------------------------------------------------------------------


def headline_predicate() -> Column:
    """National total of the indicator's defined population."""
    totals = (F.col("sex") == "total") & (F.col("wealth_quintile") == "total") & (F.col("residence") == "total") & (F.col("maternal_education") == "total")
    extra = is_total(F.get_json_object("other_dims", "$.HEAD_OF_HOUSE")) & is_total(F.get_json_object("other_dims", "$.AGE_AT_BIRTH"))
    return totals & extra & ((F.col("source") != "unicef") | F.col("age_raw").eqNullSafe(F.col("unicef_headline_age")))


def row_flags(value: str = "value", low: str = "low", high: str = "high", period: str = "period_text") -> Column:
    return flag_array(
        bounds_violation=F.col(low).isNotNull() & F.col(high).isNotNull() & ((F.col(value) < F.col(low)) | (F.col(value) > F.col(high))),
        noncanonical_period=~F.col(period).rlike("^[0-9]{4}$"),
    )


def select_headline(df: DataFrame, keys: Sequence[str], headline: str = "is_headline", order: Sequence[Column] = ()) -> DataFrame:
    """Adds n_candidates, is_selected (the first headline row of each group in the order) and selection_rule."""
    group = Window.partitionBy(*keys)
    h = F.col(headline)
    ranked = df.withColumn("n_candidates", F.sum(F.when(h, 1).otherwise(0)).over(group)).withColumn("__rk", F.row_number().over(group.orderBy(F.when(h, 0).otherwise(1), *order)))
    rule = F.when(~h, F.lit(None).cast("string")).when(F.col("n_candidates") == 1, "single_candidate").otherwise("source_priority_then_latest_period")
    return ranked.withColumn("is_selected", h & (F.col("__rk") == 1)).withColumn("selection_rule", rule).drop("__rk")


def facts(classified: DataFrame) -> DataFrame:
    """Accepted rows at an explicit grain; ambiguity is flagged, never deleted."""
    accepted = classified.where(F.col("reject_reason").isNull()).withColumn("is_headline", headline_predicate())
    order = [F.col("priority").desc_nulls_last(), F.col("period_text").desc_nulls_first(), F.col("source_file"), F.col("row_num")]
    chosen = select_headline(accepted, ("source", *CELL), order=order)
    return chosen.withColumn("quality_flags", row_flags()).select(
        "run_id", "source", *CELL, "period_text", "value", F.col("low").alias("lower_bound"), F.col("high").alias("upper_bound"),
        "sex", "wealth_quintile", "residence", "maternal_education", F.col("age_raw").alias("age_group"), "upstream_label", "other_dims",
        "is_headline", "is_selected", "n_candidates", "selection_rule", "quality_flags", "source_file", "row_num", "country_resolution",
    )


# --- series flags ------------------------------------------------------------------------------------------


def outlier_rule(value: Column, around: Column, z: float, relative: float, absolute: float, least: int) -> Column:
    """Whether a value leaves the band of its neighbours' median by robust z, relative and absolute floors."""
    centre = median_of(around)
    spread = median_of(F.transform(around, lambda x: F.abs(x - centre))) * 1.4826
    band = F.greatest(z * spread, relative * F.abs(centre), F.lit(absolute))
    return (F.size(around) >= least) & (F.abs(value - centre) > band)


def temporal_outliers(df: DataFrame, keys: Sequence[str], order: str = "year", value: str = "value", params: CoreParams = CoreParams()) -> DataFrame:
    """Adds outlier: the rule on the values two places before and after in the series."""
    around = neighbours(value, keys, order, params.outlier_each_side)
    rule = outlier_rule(F.col(value), F.col("__around"), params.outlier_z, params.outlier_relative_floor, params.outlier_absolute_floor, params.outlier_min_neighbours)
    return df.withColumn("__around", around).withColumn("outlier", F.coalesce(rule, F.lit(False))).drop("__around")


def flat_runs(df: DataFrame, keys: Sequence[str], order: str = "year", value: str = "value", params: CoreParams = CoreParams(), step: float = 0.1) -> DataFrame:
    """Adds flat_run: the row belongs to at least min_run consecutive years of one value.

    A series whose values are all multiples of `step` is rounded, and repeats there say nothing.
    """
    off_grid = F.abs(F.col(value) / step - F.round(F.col(value) / step)) * step
    rounded = F.max(off_grid).over(Window.partitionBy(*keys)) <= 1e-6
    marked = run_lengths(df.withColumn("__rounded", rounded), keys, order, value, params.flat_tolerance)
    return marked.withColumn("flat_run", (F.col("run_length") >= params.flat_min_run) & ~F.col("__rounded")).drop("__rounded", "run_id", "run_length")


def with_series_flags(fact: DataFrame, params: CoreParams) -> DataFrame:
    """Appends temporal_outlier and flat_run to the quality flags of selected rows."""
    series = ("source", "country", "concept")
    selected = fact.where("is_headline and is_selected").select(*series, "year", "value")
    outliers = temporal_outliers(selected, series, params=params).where("outlier").select(*series, "year", F.lit(True).alias("__outlier"))
    flat = flat_runs(selected.where(F.col("concept").isin(*params.flat_concepts)), series, params=params).where("flat_run").select(*series, "year", F.lit(True).alias("__flat"))
    joined = fact.join(outliers, [*series, "year"], "left").join(flat, [*series, "year"], "left")
    own = F.col("is_headline") & F.col("is_selected")
    more = flag_array(temporal_outlier=own & F.col("__outlier"), flat_run=own & F.col("__flat"))
    return joined.withColumn("quality_flags", F.concat("quality_flags", more)).drop("__outlier", "__flat").select(*fact.columns)


# --- dependence and reconciliation --------------------------------------------------------------------------


def selected_rows(fact: DataFrame) -> DataFrame:
    return fact.where("is_headline and is_selected")


def source_dependence(selected: DataFrame, sources: DataFrame, params: CoreParams, cell: Sequence[str] = ("country", "year"), within: str = "concept", source: str = "source") -> DataFrame:
    """Pairs of sources by concept: shared cells, those within the tolerance, median difference, dependence.

    sources (source, priority) orders the two sides of a pair.
    """
    ranked = selected.join(sources.select(F.col("source").alias(source), F.col("priority").alias("__p")), source).select(within, *cell, F.col(source).alias("source"), "__p", "value")
    a = ranked.withColumnsRenamed({"source": "source_a", "value": "va", "__p": "pa"})
    b = ranked.withColumnsRenamed({"source": "source_b", "value": "vb", "__p": "pb"})
    pairs = a.join(b, [within, *cell]).where("pb > pa").withColumn("difference", relative_difference(F.col("va"), F.col("vb")))
    tolerance = params.dependence_tolerance
    measured = pairs.groupBy(within, "source_a", "source_b").agg(
        F.count("*").alias("n_shared"),
        F.count_if(F.abs(F.col("va") - F.col("vb")) <= tolerance * F.greatest(F.abs("va"), F.abs("vb"))).alias("n_within"),
        F.percentile("difference", F.lit(0.5)).alias("median_rel_diff"),
    )
    share = F.col("n_within") / F.col("n_shared")
    return measured.withColumn("share_within", share).withColumn("dependent", (F.col("n_shared") >= params.dependence_min_shared) & (share >= params.dependence_min_share))


def evidence_groups(selected: DataFrame, dependence: DataFrame, within: str = "concept") -> DataFrame:
    """(concept, source, group_label, n_members): connected components of dependent sources.

    A concept has as many nodes as sources, so its components come from one fold over its edges: the two ends'
    labels become the smaller of them. The label of a group lists its members in name order, joined by '+'.
    """
    nodes = selected.groupBy(within).agg(F.array_sort(F.collect_set("source")).alias("nodes"))
    edges = dependence.where("dependent").groupBy(within).agg(F.collect_list(F.struct(F.col("source_a").alias("x"), F.col("source_b").alias("y"))).alias("edges"))
    both = nodes.join(edges, within, "left")
    start = F.transform("nodes", lambda n: F.struct(n.alias("source"), n.alias("root")))

    def merge(labels: Column, edge: Column) -> Column:
        root = lambda end: F.filter(labels, lambda n: n["source"] == end)[0]["root"]
        low, high = F.least(root(edge["x"]), root(edge["y"])), F.greatest(root(edge["x"]), root(edge["y"]))
        return F.transform(labels, lambda n: F.struct(n["source"].alias("source"), F.when(n["root"] == high, low).otherwise(n["root"]).alias("root")))

    labelled = both.withColumn("labels", F.when(F.col("edges").isNull(), start).otherwise(F.aggregate("edges", start, merge)))
    rows = labelled.select(within, "labels", F.explode("labels").alias("n"))
    members = F.transform(F.filter("labels", lambda m: m["root"] == F.col("n.root")), lambda m: m["source"])
    return rows.select(within, F.col("n.source").alias("source"), F.array_join(members, "+").alias("group_label"), F.size(members).cast("bigint").alias("n_members"))


def reconcile(selected: DataFrame, groups: DataFrame, sources: DataFrame, params: CoreParams, cell: Sequence[str] = CELL) -> DataFrame:
    """One value for each cell: that of the best source (lowest priority number), never an average.

    Two levels of aggregation: the best source of each evidence group, then of each cell. spread and conflict
    compare the groups' values; within-group spread compares the sources of a group.
    """
    candidates = selected.join(sources.select("source", "priority"), "source", "inner") if "priority" not in selected.columns else selected
    candidates = candidates.join(groups.select("concept", "source", "group_label"), ["concept", "source"])
    mean = F.avg("value")
    grouped = candidates.groupBy(*cell, "group_label").agg(
        F.min(F.struct("priority", "source", "value")).alias("rep"),
        F.count("*").alias("n"),
        F.when((F.count("*") > 1) & (mean != 0), F.try_divide(F.max("value") - F.min("value"), F.abs(mean))).otherwise(0.0).alias("inner_spread"),
    )
    several = F.count("*") > 1
    value = F.col("rep.value")
    spread = F.max(value) - F.min(value)
    relative = F.when(several & (F.avg(value) != 0), F.try_divide(spread, F.abs(F.avg(value))))
    return grouped.groupBy(*cell).agg(
        F.sum("n").alias("n_sources"),
        F.count("*").alias("n_evidence_groups"),
        F.min("rep").getField("value").alias("reconciled_value"),
        F.min("rep").getField("source").alias("reconciled_source"),
        F.when(several, spread).alias("spread_abs"),
        relative.alias("spread_rel"),
        F.coalesce(relative > params.conflict_tolerance, F.lit(False)).alias("conflict"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("group_label", value.alias("value"))))).alias("group_values"),
        F.max("inner_spread").alias("max_within_group_spread_rel"),
        (F.max("inner_spread") > params.group_disagreement_tolerance).alias("within_group_disagreement"),
    )


def equal_flags(fact: DataFrame) -> DataFrame:
    """Facts with one boolean column for each quality flag."""
    return fact.withColumns({f: has_flag(F.col("quality_flags"), f) for f in ("bounds_violation", "noncanonical_period", "temporal_outlier", "flat_run")})


# --- reference checks ---------------------------------------------------------------------------------------


class ReferenceMismatch(Exception):
    """Staged data contradict the reference tables."""


def check_reference(worldbank: DataFrame, who: DataFrame, countries: DataFrame) -> DataFrame:
    """Countries with their WHO region; raises if an exact ISO3 has another ISO2, or a country two regions."""
    wrong = (
        worldbank.where(F.col("country_id").isNotNull())
        .select(F.trim("country_iso3").alias("iso3"), F.col("country_id").alias("staged"))
        .distinct()
        .join(countries.select("iso3", "iso2"), "iso3")
        .where("staged <> iso2")
        .orderBy("iso3", "staged")
        .limit(20)
        .collect()
    )
    if wrong:
        raise ReferenceMismatch("; ".join(f"{r.iso3}: staged {r.staged}, reference {r.iso2}" for r in wrong))
    regions = (
        who.where(F.col("parent_location_code").isNotNull())
        .join(countries.select(F.col("iso3").alias("spatial_dim")), "spatial_dim", "left_semi")
        .groupBy(F.col("spatial_dim").alias("iso3"))
        .agg(F.min("parent_location_code").alias("who_region_code"), F.min("parent_location").alias("who_region"), F.count_distinct("parent_location_code").alias("n"))
    )
    torn = regions.where("n > 1").orderBy("iso3").limit(20).collect()
    if torn:
        raise ReferenceMismatch("several WHO regions: " + ", ".join(r.iso3 for r in torn))
    return countries.join(regions.drop("n"), "iso3", "left")


def learned_aliases(worldbank: DataFrame, countries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases with the names under which the bank reports exactly identified countries; a clash raises."""
    named = worldbank.where(clean_text(F.col("country_name")).isNotNull()).select(F.col("country_name").alias("alias"), F.col("country_iso3").alias("iso3")).distinct()
    own = named.join(countries.select("iso3"), "iso3", "left_semi").select("alias", "iso3", F.lit("world_bank_name").alias("alias_type"))
    both = aliases.select("alias", "iso3", "alias_type").unionByName(own)
    clash = both.groupBy(normalize_name(F.col("alias")).alias("alias_norm")).agg(F.count_distinct("iso3").alias("n"), F.min("alias").alias("alias")).where("n > 1").orderBy("alias").limit(20).collect()
    if clash:
        raise ReferenceMismatch("one name for several countries: " + ", ".join(r.alias for r in clash))
    return first_by(both, ["alias"], [F.col("alias_type")])
