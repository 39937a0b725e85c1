"""Data-quality metrics in long form: the same checks for any layer that offers the observation columns.

Input rows: source, concept, iso3, period_text, year, value, value_text, low, high, dim_key. Each family of
metrics is one aggregation whose numerators unfold into rows (scope, source, concept, dimension, metric,
value, numerator, denominator, details). value = numerator / denominator, null for denominator 0.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import ratio

METRIC_COLUMNS = ("scope", "source", "concept", "dimension", "metric", "value", "numerator", "denominator", "details")
SCORE_METRICS = {"completeness": "missing_rate", "validity": "invalid_row_rate", "uniqueness": "grain_ambiguity_rate", "consistency": "noncanonical_period_rate"}


def _metric(scope: str, dimension: str, metric: str, numerator: Column | None, denominator: Column | None = None, value: Column | None = None, details: Column | None = None) -> Column:
    none = F.lit(None)
    num = numerator.cast("bigint") if numerator is not None else none.cast("bigint")
    den = denominator.cast("bigint") if denominator is not None else none.cast("bigint")
    v = value.cast("double") if value is not None else ratio(num, den)
    return F.struct(F.lit(scope).alias("scope"), F.lit(dimension).alias("dimension"), F.lit(metric).alias("metric"), v.alias("value"), num.alias("numerator"), den.alias("denominator"), (details if details is not None else none).cast("string").alias("details"))


def _unfold(df: DataFrame, metrics: Sequence[Column], source: Column | None = None, concept: Column | None = None) -> DataFrame:
    source = source if source is not None else F.lit("")
    concept = concept if concept is not None else F.lit("")
    rows = df.select(source.alias("source"), concept.alias("concept"), F.explode(F.array(*metrics)).alias("m"))
    return rows.select("m.scope", "source", "concept", "m.dimension", "m.metric", "m.value", "m.numerator", "m.denominator", "m.details")


def row_level(obs: DataFrame, ranges: DataFrame, countries: Sequence[str], years: tuple[int, int]) -> DataFrame:
    """Completeness, validity, uniqueness and consistency of each (source, concept), in one aggregation.

    ranges (concept, lo, hi). The exact duplicates are the rows beyond the distinct (iso3, period_text, dim_key,
    value_text); they are counted by a pre-aggregation on a hash of the four, nulls included.
    """
    value, year = F.col("value"), F.col("year")
    has = value.isNotNull()
    unparseable = ~has & F.col("value_text").isNotNull()
    outside = has & ((value < F.col("lo")) | (value > F.col("hi")))
    bounds = has & F.col("low").isNotNull() & F.col("high").isNotNull() & ((value < F.col("low")) | (value > F.col("high")))
    bad_year = year.isNull() | (year < years[0]) | (year > years[1])
    bad_country = F.col("iso3").isNull() | ~F.col("iso3").isin(list(countries))
    odd_period = F.col("period_text").isNull() | ~F.col("period_text").rlike("^[0-9]{4}$")
    no = lambda c: F.coalesce(c, F.lit(False))
    joined = obs.join(ranges, "concept", "left")
    a = joined.groupBy("source", "concept").agg(
        F.count("*").alias("n"),
        F.count_if(~has).alias("missing"),
        F.count_if(unparseable).alias("unparseable"),
        F.count_if(no(outside)).alias("out_of_range"),
        F.count_if(no(bounds)).alias("bounds"),
        F.count_if(bad_year).alias("bad_year"),
        F.count_if(bad_country).alias("bad_country"),
        F.count_if(odd_period).alias("odd_period"),
        F.count_if(unparseable | no(outside) | no(bounds) | bad_year | bad_country).alias("invalid"),
        F.count_distinct(F.struct("iso3", "period_text", "dim_key", "value_text")).alias("different"),
        F.count_distinct("iso3").alias("n_countries"),
    )
    n = F.col("n")
    rate = lambda dimension, metric, num: _metric("series", dimension, metric, num, n)
    return _unfold(
        a,
        [
            _metric("series", "completeness", "records_received", n, value=n),
            rate("completeness", "missing_rate", F.col("missing")),
            rate("validity", "unparseable_rate", F.col("unparseable")),
            rate("validity", "out_of_range_rate", F.col("out_of_range")),
            rate("validity", "bounds_violation_rate", F.col("bounds")),
            rate("validity", "invalid_year_rate", F.col("bad_year")),
            rate("validity", "invalid_country_rate", F.col("bad_country")),
            rate("validity", "invalid_row_rate", F.col("invalid")),
            rate("uniqueness", "exact_duplicate_rate", n - F.col("different")),
            rate("consistency", "noncanonical_period_rate", F.col("odd_period")),
            _metric("series", "completeness", "countries_present", None, value=F.col("n_countries")),
        ],
        F.col("source"),
        F.col("concept"),
    )


def coverage_and_grain(obs: DataFrame, countries: Sequence[str], years: tuple[int, int]) -> DataFrame:
    """grid_coverage, grain_ambiguity_rate and ambiguous_cell_rate from one two-level aggregation by cell."""
    expected = len(countries) * (years[1] - years[0] + 1)
    inside = F.col("value").isNotNull() & F.col("year").between(*years) & F.col("iso3").isin(list(countries))
    cells = obs.groupBy("source", "concept", "iso3", "year").agg(F.count("*").alias("c"), F.max(F.coalesce(inside, F.lit(False)).cast("int")).alias("covered"))
    real = F.col("year").isNotNull() & F.col("iso3").isNotNull()
    many = real & (F.col("c") > 1)
    a = cells.groupBy("source", "concept").agg(
        F.sum("c").alias("n"), F.sum("covered").alias("covered"), F.count_if(many).alias("ambiguous"), F.coalesce(F.sum(F.when(many, F.col("c"))), F.lit(0)).alias("rows"), F.count_if(real).alias("cells")
    )
    covered = _unfold(a, [_metric("series", "completeness", "grid_coverage", F.col("covered"), F.lit(expected))], F.col("source"), F.col("concept"))
    grain = [_metric("series", "uniqueness", "grain_ambiguity_rate", F.col("rows"), F.col("n")), _metric("series", "uniqueness", "ambiguous_cell_rate", F.col("ambiguous"), F.col("cells"))]
    return covered.unionByName(_unfold(a.where("cells > 0"), grain, F.col("source"), F.col("concept")))


def naive_fanout(obs: DataFrame, sources: Sequence[str] = ("who", "worldbank", "unicef")) -> DataFrame:
    """(concept, shared_cells, naive_rows, any_cells): what a row-level join of all sources would make.

    The product of the counts in a cell says how many rows it would make, without making them.
    """
    real = F.col("year").isNotNull() & F.col("iso3").isNotNull()
    count = lambda s: F.count_if(F.col("source") == s)
    cells = obs.where(F.col("year").isNotNull()).groupBy("concept", "iso3", "year").agg(*[count(s).alias(f"n{i}") for i, s in enumerate(sources)], F.max(F.col("value").isNotNull().cast("int")).alias("valued"))
    product = F.lit(1).cast("bigint")
    for i in range(len(sources)):
        product = product * F.col(f"n{i}")
    shared = real & (product > 0)
    return cells.groupBy("concept").agg(F.count_if(shared).alias("shared_cells"), F.sum(F.when(shared, product)).cast("bigint").alias("naive_rows"), F.sum("valued").alias("any_cells")).where("shared_cells > 0")


def _agreeing(keys: Sequence[str], share: float) -> Callable[[pa.Table], pa.Table]:
    """Of a table (keys, place of the source, value, c, first), by keys, the last left out: counts by source (n; f finite
    or less; i infinite) of its rows with `first`, and the agreeing combinations that begin at these.

    Of a combination x <= y <= z (ties by the source's place) x and z decide alone unless z lies in a narrow window
    above x; sums of counts do for those below it. In the window the condition rises with y, so one search for each
    pair finds the smallest y that agrees, judged by the condition itself. Cells where sums can overflow or values have
    few digits left have no sure side. Workers get these functions by value.
    """
    k = share / 3
    sure, most = (1 + 2 * k) / (1 - k) * (1 - 1e-9), (1 + k) / (1 - 2 * k) * (1 + 1e-9)
    chunk = 1 << 18
    names = [*(f"{a}{i}" for a in "nfi" for i in range(3)), "agreed"]

    def sums(counts: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(counts)])

    def run(table: pa.Table) -> pa.Table:
        cells = np.zeros(table.num_rows, np.int64)
        for key in keys:
            codes = table[key].combine_chunks().dictionary_encode().indices.to_numpy()
            cells = np.unique(cells * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
        place, value, c, first = (table[name].combine_chunks().to_numpy(zero_copy_only=False) for name in ("place", "value", "c", "first"))
        one = np.unique(cells, return_index=True)[1]
        edge, out = np.zeros(len(one), bool), {name: np.zeros(len(one), np.int64) for name in names}
        for name, counted in (("n", first), ("f", first & (value < np.inf)), ("i", first & (value == np.inf))):
            for i in range(3):
                at = counted & (place == i)
                np.add.at(out[f"{name}{i}"], cells[at], c[at])
        edge[cells[(np.abs(value) > 5e307) & (np.abs(value) < np.inf) | (value > 0) & (value < 1e-290)]] = True
        first = first & ((value >= 0) | edge[cells])
        cells, place, value, c, first = (a[value < np.inf] for a in (cells, place, value, c, first))
        known = np.unique(value)
        # A row's spot orders by cell, then value; a cell has one spot more than there are values.
        spots = cells * (len(known) + 1) + np.searchsorted(known, value)
        order = np.argsort(spots, kind="stable")
        rows = [order[place[order] == i] for i in range(3)]
        spot, v, n, cell = ([a[at] for at in rows] for a in (spots, value, c, cells))
        n_sum = [sums(a) for a in n]

        def behind(i: int, at: np.ndarray, t: np.ndarray, side: str) -> np.ndarray:
            return np.searchsorted(spot[i], at * (len(known) + 1) + np.searchsorted(known, t, side))

        for p, q, r in itertools.permutations(range(3)) if all(map(len, rows)) else ():
            x = np.flatnonzero(first[rows[p]])
            vx, cx = v[p][x], cell[p][x]
            odd = edge[cx]
            y0 = np.searchsorted(spot[q], spot[p][x] + int(q < p))
            z0 = np.searchsorted(spot[r], spot[p][x] + int(r < p))
            top = np.searchsorted(spot[q], spot[r] + int(q < r))
            z1 = np.maximum(z0, behind(r, cx, np.where(odd, -np.inf, vx * sure), "left"))
            z2 = np.maximum(z1, behind(r, cx, np.where(odd, np.inf, vx * most), "right"))
            below = sums(n[r] * n_sum[q][top])
            got = below[z1] - below[z0] - n_sum[q][y0] * (n_sum[r][z1] - n_sum[r][z0])
            ends = sums(z2 - z1)
            for start in range(0, int(ends[-1]), chunk):
                pair = np.arange(start, min(start + chunk, int(ends[-1])))
                i = np.searchsorted(ends, pair, "right") - 1
                z = pair - ends[i] + z1[i]
                a, b, lo, hi = vx[i], v[r][z], y0[i], top[z]

                def agrees(y: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
                    parts = {p: a[at], q: v[q][np.clip(y, 0, len(v[q]) - 1)], r: b[at]}  # noqa: B023
                    most_spread = share * (parts[0] + parts[1] + parts[2]) / 3.0
                    return (parts[r] - parts[p] <= most_spread) | np.isnan(most_spread)  # Spark sorts NaN last

                y = np.clip(behind(q, cx[i], (b * (1 - k) - a * (1 + k)) / k, "left"), lo, hi)
                # Rounding can put the guess beside the true place; those few are searched by the condition.
                off = np.flatnonzero(((y < hi) & ~agrees(y)) | ((y > lo) & agrees(y - 1)))
                left, right = lo[off], hi[off]
                while (open_ := left < right).any():
                    mid = (left + right) // 2
                    yes = agrees(mid, off)
                    left, right = np.where(open_ & ~yes, mid + 1, left), np.where(open_ & yes, mid, right)
                y[off] = left
                np.add.at(got, i, n[r][z] * (n_sum[q][hi] - n_sum[q][y]))
            np.add.at(out["agreed"], cx, n[p][x] * got)
        return pa.table({key: table[key].take(pa.array(one)) for key in keys[:-1]} | out)

    def quietly(table: pa.Table) -> pa.Table:
        with np.errstate(over="ignore", invalid="ignore"):
            return run(table)

    return quietly


def naive_conflicts(obs: DataFrame, sources: Sequence[str] = ("who", "worldbank", "unicef"), share: float = 0.10, large: int = 1 << 17) -> DataFrame:
    """(concept, total, conflicting) over all combinations of one row from each of three sources in a cell.

    A combination conflicts if the spread of its values exceeds `share` of their mean. No combination is made: all are
    counted by products of counts, those that agree by `_agreeing`, copies of a value as one row with a weight. Values
    that agree lie within a narrow factor of the smallest, so cells of more than `large` values are dealt out by
    logarithmic bands: a value begins combinations in its own band only and is there in the bands below that reach it.
    """
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    keys = ["concept", "iso3", "year"]
    value = F.col("value")
    real = obs.where(value.isNotNull() & F.col("concept").isNotNull() & F.col("iso3").isNotNull() & F.col("year").isNotNull() & F.col("source").isin(list(sources)))
    place = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source")).cast("int") - 1
    weighted = real.groupBy(*keys, place.alias("place"), value.cast("double").alias("value")).agg(F.count("*").alias("c"))
    # At most one cell for each `large` values, so these are few. Both readers of `weighted` take all its columns
    # and rows (n_rows says nothing new), else their shuffles differ and the rows are joined and dealt twice.
    sizes = weighted.groupBy(*keys).agg(F.count("*").alias("n_values"), F.sum("c").alias("n_rows"), F.max(F.when(F.abs("value") < float("inf"), F.abs("value"))).alias("most"), F.min(F.when(value > 0, value)).alias("least"))
    split = sizes.where((F.col("n_values") > large) & (F.col("n_rows") > large) & (F.col("most") <= 5e307) & (F.col("least") >= 1e-290)).select(*keys, F.lit(True).alias("split"))
    rows = weighted.join(F.broadcast(split), keys, "left")
    parts = 8
    width = (math.log1p(share / 3) - math.log1p(-2 * share / 3)) * (1 + 1e-6) / parts
    own = F.when(F.col("split").isNull(), F.lit(0)).when((value > 0) & (value < float("inf")), F.floor(F.ln("value") / width)).otherwise(F.lit(-(10**9))).cast("bigint")
    met = rows.withColumn("own", own).withColumn("band", F.explode(F.when(F.col("split").isNull(), F.array("own")).otherwise(F.sequence(F.col("own") - parts, "own"))))
    dealt = met.select(*keys, "band", "place", "value", "c", (F.col("band") == F.col("own")).alias("first"), F.pmod(F.xxhash64(*keys, "band"), F.lit(512)).alias("bucket"))
    schema = ", ".join([*[f"{k} {dealt.schema[k].dataType.simpleString()}" for k in keys], *[f"{a}{i} bigint" for a in "nfi" for i in range(3)], "agreed bigint"])
    found = dealt.groupBy("bucket").applyInArrow(_agreeing([*keys, "band"], share), schema)
    cells = found.groupBy(*keys).agg(*[F.sum(f"{a}{i}").alias(f"{a}{i}") for a in "nfi" for i in range(3)], F.sum("agreed").alias("agreed")).where("n0 > 0 and n1 > 0 and n2 > 0")
    product = lambda a: F.col(f"{a}0") * F.col(f"{a}1") * F.col(f"{a}2")
    # Spark and the SQL sort NaN above infinity: a spread with either among its values exceeds no mean, unless all three are infinite.
    conflicting = product("f") + product("i") - F.col("agreed")
    return cells.groupBy("concept").agg(F.sum(product("n")).alias("total"), F.sum(conflicting).alias("conflicting"))


def integration(obs: DataFrame, sources: Sequence[str] = ("who", "worldbank", "unicef")) -> DataFrame:
    fan = _unfold(
        naive_fanout(obs, sources),
        [_metric("concept", "integration", "naive_join_fanout", F.col("naive_rows"), F.col("shared_cells")), _metric("concept", "integration", "cells_in_all_three_sources", F.col("shared_cells"), F.col("any_cells"))],
        concept=F.col("concept"),
    )
    conflicts = _unfold(naive_conflicts(obs, sources), [_metric("concept", "integration", "naive_join_conflict_rate", F.col("conflicting"), F.col("total"))], concept=F.col("concept"))
    return fan.unionByName(conflicts)


def vocabulary(who: DataFrame, unicef: DataFrame, home_region: str = "AFR") -> DataFrame:
    """How the sources encode sex, wealth and region."""
    out = None
    for source, name, values in (
        ("who", "sex_values", who.where("dim1_type = 'SEX'").select(F.col("dim1").alias("v"))),
        ("unicef", "sex_values", unicef.where("sex is not null").select(F.col("sex").alias("v"))),
        ("who", "wealth_values", who.where("dim3_type = 'WEALTHQUINTILE'").select(F.col("dim3").alias("v"))),
        ("unicef", "wealth_values", unicef.where("wealth_quintile is not null").select(F.col("wealth_quintile").alias("v"))),
    ):
        one = values.agg(F.count_distinct("v").alias("n"), F.to_json(F.array_sort(F.collect_set("v"))).alias("d"))
        rows = _unfold(one, [_metric("source", "integration", f"distinct_{name}", None, value=F.col("n"), details=F.col("d"))], F.lit(source))
        out = rows if out is None else out.unionByName(rows)
    places = who.groupBy("parent_location_code").agg(F.array_sort(F.collect_set("spatial_dim")).alias("isos"))
    outside = F.coalesce(F.sum(F.when(~F.col("parent_location_code").eqNullSafe(home_region), F.size("isos"))), F.lit(0))
    regions = places.agg(outside.alias("outside"), F.size(F.array_distinct(F.flatten(F.collect_list("isos")))).alias("total"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("parent_location_code", F.lit("")), "isos"))))).alias("d"))
    return out.unionByName(_unfold(regions, [_metric("source", "integration", "countries_outside_who_afr_region", F.col("outside"), F.col("total"), details=F.col("d"))], F.lit("who")))


def schema_variants(headers: DataFrame, source: str = "unicef") -> DataFrame:
    """headers (series, columns array): how far the column sets of one source's series agree."""
    every = F.collect_list("columns")
    union = F.size(F.array_distinct(F.flatten(every)))
    shared = F.size(F.reduce(F.slice(every, 2, F.greatest(F.size(every), F.lit(1))), F.try_element_at(every, F.lit(1)), lambda a, b: F.array_intersect(a, b)))
    one = headers.agg(F.count("*").alias("n"), F.count_distinct("columns").alias("sets"), union.alias("u"), shared.alias("s"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("series", "columns"))))).alias("d")).where("n > 0")
    return _unfold(one, [_metric("source", "integration", "distinct_column_sets", F.col("sets"), F.col("n"), value=F.col("sets"), details=F.col("d")), _metric("source", "integration", "columns_shared_by_all_series", F.col("s"), F.col("u"))], F.lit(source))


def core_metrics(load_log: DataFrame, rejected: DataFrame, fact: DataFrame, reconciled: DataFrame, groups: DataFrame) -> DataFrame:
    """Accounting of the pipeline and outcomes of reconciliation."""
    keys = ["source", "concept"]
    staged = load_log.groupBy(*keys).agg(F.sum("rows_loaded").alias("n"))
    reasons = rejected.groupBy(*keys, "reason").count().groupBy(*keys).agg(F.sum("count").alias("rejected"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "count"))))).alias("reasons"))
    loaded = fact.groupBy(*keys).agg(F.count("*").alias("loaded"), F.count_if(F.col("is_selected")).alias("selected"))
    joined = staged.join(reasons, keys, "left").join(loaded, keys, "left").na.fill(0, ["rejected", "loaded", "selected"])
    lineage = _unfold(
        joined,
        [
            _metric("series", "lineage", "records_staged", None, value=F.col("n")),
            _metric("series", "lineage", "records_rejected", F.col("rejected"), F.col("n"), details=F.coalesce("reasons", F.lit("{}"))),
            _metric("series", "lineage", "records_loaded", None, value=F.col("loaded")),
            _metric("series", "lineage", "records_selected", F.col("selected"), F.col("n"), value=F.col("selected")),
        ],
        F.col("source"),
        F.col("concept"),
    )
    cells = reconciled.groupBy("concept").agg(F.count("*").alias("cells"), F.count_if(F.col("n_evidence_groups") > 1).alias("crossed"), F.count_if("conflict").alias("conflicts"))
    outcome = _unfold(
        cells,
        [
            _metric("concept", "integration", "cells_reconciled", None, value=F.col("cells")),
            _metric("concept", "integration", "cross_validated_cell_rate", F.col("crossed"), F.col("cells")),
            _metric("concept", "integration", "conflict_rate_among_cross_validated", F.col("conflicts"), F.col("crossed")),
        ],
        concept=F.col("concept"),
    )
    labels = groups.groupBy("concept").agg(F.array_sort(F.collect_set("group_label")).alias("g"))
    independent = _unfold(labels, [_metric("concept", "integration", "independent_evidence_groups", None, value=F.size("g"), details=F.to_json("g"))], concept=F.col("concept"))
    return lineage.unionByName(outcome).unionByName(independent)


def scores(metrics: DataFrame) -> DataFrame:
    """Scores in [0, 1] by series, source and overall: 1 - pooled rate, and their mean as composite.

    GROUPING SETS pool the numerators and denominators; the composite exists where all dimensions do.
    """
    wanted = F.lit(False)
    for dimension, metric in SCORE_METRICS.items():
        wanted = wanted | ((F.col("dimension") == dimension) & (F.col("metric") == metric))
    base = metrics.where((F.col("scope") == "series") & wanted & (F.col("denominator") > 0)).select("source", "concept", "dimension", F.coalesce("numerator", F.lit(0)).alias("num"), F.col("denominator").alias("den"))
    sets = [[F.col("source"), F.col("concept"), F.col("dimension")], [F.col("source"), F.col("dimension")], [F.col("dimension")]]
    pooled = base.groupingSets(sets, "source", "concept", "dimension").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.grouping("source").alias("gs"), F.grouping("concept").alias("gc"))
    scope = F.when(F.col("gs") == 1, "overall").when(F.col("gc") == 1, "source").otherwise("series")
    scored = pooled.select(scope.alias("scope"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("concept", F.lit("")).alias("concept"), "dimension", "num", "den", (1 - F.col("num") / F.col("den")).alias("score"))
    single = scored.select("scope", "source", "concept", F.lit("score").alias("dimension"), F.col("dimension").alias("metric"), F.col("score").alias("value"), (F.col("den") - F.col("num")).alias("numerator"), F.col("den").alias("denominator"), F.lit(None).cast("string").alias("details"))
    k = len(SCORE_METRICS)
    total, low, high = F.sum("score"), F.min("score"), F.max("score")
    composite = scored.groupBy("scope", "source", "concept").agg(F.count("*").alias("n"), (total / k).alias("value"), ((total - high) / (k - 1)).alias("lo"), ((total - low) / (k - 1)).alias("hi")).where(F.col("n") == k)
    whole = composite.select(
        "scope", "source", "concept", F.lit("score").alias("dimension"), F.lit("composite").alias("metric"), "value", F.lit(None).cast("bigint").alias("numerator"), F.lit(None).cast("bigint").alias("denominator"),
        F.to_json(F.struct(F.lit("equal").alias("weights"), F.col("lo").alias("leave_one_out_min"), F.col("hi").alias("leave_one_out_max"))).alias("details"),
    )
    return single.unionByName(whole)


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """The same metric before and after, side by side."""
    keys = ["scope", "source", "concept", "dimension", "metric"]
    side = lambda df, n: df.select(*keys, F.col("value").alias(n), F.col("numerator").alias(f"{n}_numerator"), F.col("denominator").alias(f"{n}_denominator"))
    return side(before, "before").join(side(after, "after"), keys).withColumn("change", F.col("after") - F.col("before"))


def pairwise_agreement(obs: DataFrame, min_shared: int = 5, cell: Sequence[str] = ("iso3", "year")) -> DataFrame:
    """Agreement of each pair of sources on a concept: median difference, shares over 10 % and exactly equal."""
    a = obs.select("concept", *cell, F.col("source").alias("source_a"), F.col("value").alias("va"))
    b = obs.select("concept", *cell, F.col("source").alias("source_b"), F.col("value").alias("vb"))
    from tessera.functions.scalars import relative_difference

    pairs = a.join(b, ["concept", *cell]).where("source_a < source_b and va is not null and vb is not null").withColumn("d", relative_difference(F.col("va"), F.col("vb")))
    return pairs.groupBy("concept", "source_a", "source_b").agg(F.count("*").alias("n"), F.percentile("d", F.lit(0.5)).alias("median_rel_diff"), F.avg((F.col("d") > 0.10).cast("int")).alias("share_over_10pct"), F.avg((F.col("va") == F.col("vb")).cast("int")).alias("share_exact")).where(F.col("n") >= min_shared)


def source_profile(obs: DataFrame) -> DataFrame:
    """Coverage and repeated keys of each (source, concept)."""
    cells = obs.groupBy("source", "concept", "iso3", "year").agg(F.count("*").alias("c"))
    return cells.groupBy("source", "concept").agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_cells"), F.count_distinct("iso3").alias("n_countries"), F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.count_if(F.col("c") > 1).alias("repeated_cells"))
