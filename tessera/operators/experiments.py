"""Fault injection with ground truth, and classification of what the pipeline made of each fault.

Faults are a table (one row for each fault, keyed by source_file and row_num), and injection is an expression
over the standardised rows that meet it in a join; nothing is changed in place. Rows are drawn by a seeded
hash, so a seed gives the same faults on any cluster, and fault types never share a row.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import has_flag, wilson
from tessera.functions.windows import first_by, numbered
from tessera.operators.core import CELL, selected_rows

ROW = ("source_file", "row_num")
VALIDITY = ("missing_value", "unparseable_value", "out_of_range", "duplicate", "country_recoverable", "country_invalid", "date_noncanonical", "date_unparseable", "categorical_invalid")
MAGNITUDES = (0.02, 0.05, 0.10, 0.25, 0.50, 1.0, 3.0, 9.0)
MIXED_MAGNITUDES = (0.10, 0.25, 0.50, 1.0, 3.0)
SCHEMA_FAULTS = ("schema_rename_required", "schema_drop_required", "schema_add_unexpected")

# Outcomes that count as right handling of each fault type.
EXPECTED = {
    "missing_value": ("rejected:no_value",),
    "unparseable_value": ("rejected:unparseable_value",),
    "out_of_range": ("rejected:out_of_range",),
    "duplicate": ("rejected:exact_duplicate",),
    "country_recoverable": ("recovered",),
    "country_invalid": ("rejected:unknown_country",),
    "date_noncanonical": ("recovered", "flagged:noncanonical_period"),
    "date_unparseable": ("rejected:invalid_year",),
    "categorical_invalid": ("rejected:unmapped_vocabulary",),
    "value_change": ("flagged:temporal_outlier", "flagged:within_group_disagreement", "flagged:conflict"),
    "schema_rename_required": ("schema:error",),
    "schema_drop_required": ("schema:error",),
    "schema_add_unexpected": ("schema:warned",),
}
# Order in which labels are reported.
LABEL_ORDER = ("flagged:temporal_outlier", "flagged:within_group_disagreement", "flagged:conflict", "flagged:bounds_violation", "flagged:noncanonical_period")


def draw(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(1 << 40)) / float(1 << 40)


def pick_of(seed: int, salt: str, options: Sequence[Column], *keys: str) -> Column:
    """One of the options, by a seeded hash of the keys."""
    at = F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *[F.col(k) for k in keys]), F.lit(len(options))).cast("int")
    return F.element_at(F.array(*options), at + 1)


def build_pool(fact: DataFrame, groups: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Selected rows with the context that decides whether a fault in them can be seen."""
    series = Window.partitionBy("source", "country", "concept").orderBy("year")
    near = F.count("*").over(series.rowsBetween(-2, 2)) - 1
    cells = reconciled.select(*CELL, (F.col("conflict") | F.col("within_group_disagreement")).alias("cell_flagged"))
    rows = selected_rows(fact).withColumn("n_neighbours", near).join(groups.select("concept", "source", "group_label"), ["concept", "source"], "left").withColumn("group_label", F.coalesce("group_label", "source")).join(cells, list(CELL), "left").withColumn("cell_flagged", F.coalesce("cell_flagged", F.lit(False)))
    members = F.count("*").over(Window.partitionBy(*CELL, "group_label"))
    return rows.withColumn("cell_members", members).select("source", *ROW, *CELL, "value", "quality_flags", "cell_flagged", "n_neighbours", "group_label", "cell_members")


def clean_universe(pool: DataFrame) -> DataFrame:
    """Rows without flags in cells without flags."""
    return pool.where((F.size("quality_flags") == 0) & ~F.col("cell_flagged"))


def plan_validity(pool: DataFrame, standard: DataFrame, countries: DataFrame, ranges: DataFrame, seed: int, n: int, exclude: DataFrame | None = None, types: Sequence[str] = VALIDITY) -> DataFrame:
    """Faults of the validity types, n rows of each. Rows with a dimension code go to categorical_invalid first.

    The rows get one global draw by hash. The type that only some rows can take is served first, the others
    take the rest in turn, so no row is hit twice.
    """
    rows = clean_universe(pool).join(standard.select(*ROW, "place", "period_text", "sex_raw", "wealth_raw", "residence_raw"), list(ROW))
    if exclude is not None:
        rows = rows.join(exclude.select(*ROW), list(ROW), "left_anti")
    coded = F.coalesce("sex_raw", "wealth_raw", "residence_raw").isNotNull()
    plain = [t for t in types if t != "categorical_invalid"]
    ordered = rows.withColumn("__d", draw(seed, *ROW))
    chosen_coded = numbered(ordered.where(coded), "__d", ROW, "__i").where(F.col("__i") < (n if "categorical_invalid" in types else 0)).drop("__i").withColumn("fault_type", F.lit("categorical_invalid"))
    others = ordered.join(chosen_coded.select(*ROW), list(ROW), "left_anti")
    dealt = numbered(others, "__d", ROW, "__i").where(F.col("__i") < n * len(plain))
    in_turn = F.element_at(F.array(*[F.lit(t) for t in plain or [""]]), (F.col("__i") % max(1, len(plain)) + 1).cast("int"))
    turned = dealt.withColumn("fault_type", in_turn).drop("__i").select(*chosen_coded.columns)
    faults = chosen_coded.unionByName(turned).join(countries.select(F.col("iso3").alias("country"), "iso2", "name"), "country", "left").join(ranges, "concept", "left")
    k = (*ROW, "fault_type")
    option = lambda salt, *values: pick_of(seed, salt, [F.lit(v) if isinstance(v, str) else v for v in values], *k)
    kind = F.col("fault_type")
    year = F.col("year").cast("string")
    below = -F.round(F.abs("value") + 1 + 99 * draw(seed + 1, *k), 4)
    above = F.round(F.col("hi") * (1.1 + 1.9 * draw(seed + 2, *k)), 4)
    new_value = F.when(kind == "out_of_range", F.when(draw(seed + 3, *k) < 0.5, above).otherwise(below))
    month = F.lpad((F.floor(draw(seed + 4, *k) * 12) + 1).cast("string"), 2, "0")
    unicef = F.col("source") == "unicef"
    new_place = F.when(kind == "country_recoverable", option("recover", F.lower("country"), F.concat(F.lit(" "), F.col("country"), F.lit(" ")), F.col("iso2"), F.col("name"))).when(kind == "country_invalid", option("invalid", "XXX", "ZZZ", "AFR", "SSA", "ABC"))
    new_period = F.when(kind == "date_noncanonical", F.when(unicef, F.concat_ws("-", year, month)).otherwise(F.concat(year, F.lit(".0")))).when(kind == "date_unparseable", option("date", F.substring(year, 3, 2), F.concat(F.lit("FY"), year), "N/A", F.concat(F.lit("June "), year)))
    new_text = F.when(kind == "unparseable_value", option("text", "n/a", "NA", "-", "unknown"))
    new_code = F.when(kind == "categorical_invalid", option("code", "Total", "T", "ALL", "99"))
    expected = F.lit(None).cast("array<string>")
    for t in types:
        expected = F.when(kind == t, F.array(*[F.lit(x) for x in EXPECTED[t]])).otherwise(expected)
    # The bank's values keep no raw text, so an unparseable one can't be told from a missing one.
    expected = F.when((kind == "unparseable_value") & (F.col("source") == "worldbank"), F.array(F.lit("rejected:no_value"))).otherwise(expected)
    return faults.select("fault_type", F.coalesce(new_place, new_period, new_text, new_code, new_value.cast("string"), kind).alias("variant"), "source", *ROW, *CELL, F.col("value").alias("original_value"), "n_neighbours", "cell_members", new_value.alias("new_value"), new_place.alias("new_place"), new_period.alias("new_period"), new_text.alias("new_text"), new_code.alias("new_code"), expected.alias("expected"))


def plan_magnitude(pool: DataFrame, ranges: DataFrame, seed: int, n: int, magnitudes: Sequence[float] = MAGNITUDES, isolate: bool = True, exclude: DataFrame | None = None) -> DataFrame:
    """Value changes of known size, n of each magnitude, within the plausible range.

    With isolate, at most one row of a series and of a cell is changed: the best drawn row of each cell is taken,
    then the best drawn of each series among those. Both are rankings by hash, so they run in parallel.
    """
    rows = clean_universe(pool).where("n_neighbours >= 3 or cell_members >= 2")
    if exclude is not None:
        rows = rows.join(exclude.select(*ROW), list(ROW), "left_anti")
    rows = rows.withColumn("__d", draw(seed, *ROW))
    if isolate:
        rows = first_by(first_by(rows, CELL, [F.col("__d"), *[F.col(c) for c in ROW]]), ("source", "country", "concept"), [F.col("__d"), *[F.col(c) for c in ROW]])
    sizes = [float(x) for x in magnitudes]
    value, first_up = F.col("value"), draw(seed + 1, *ROW) < 0.5
    fits = lambda c: F.when(c.between(F.col("lo"), F.col("hi")) & (c != value), F.round(c, 6))

    def changed(m: float) -> Column:
        up, down = fits(value * (1 + m)), fits(value / (1 + m) if m >= 1 else value * (1 - m))
        return F.when(first_up, F.coalesce(up, down)).otherwise(F.coalesce(down, up))

    # Each row is offered to the magnitudes that fit it, one by a further draw; then n of each by the draw.
    options = F.filter(F.array(*[F.struct(F.lit(m).alias("magnitude"), changed(m).alias("new_value")) for m in sizes]), lambda x: x["new_value"].isNotNull())
    fitting = rows.join(ranges, "concept").withColumn("__o", options).where(F.size("__o") > 0)
    taken = F.element_at("__o", (F.floor(draw(seed + 2, *ROW) * F.size("__o")) + 1).cast("int"))
    sized = fitting.withColumn("__t", taken).withColumns({"magnitude": F.col("__t.magnitude"), "new_value": F.col("__t.new_value")}).drop("__o", "__t")
    each = numbered(sized, "__d", ROW, "__k", ["magnitude"]).where(F.col("__k") < n)
    none = lambda: F.lit(None).cast("string")
    return each.select(F.lit("value_change").alias("fault_type"), F.concat(F.round(F.col("magnitude") * 100).cast("int").cast("string"), F.lit("%")).alias("variant"), "source", *ROW, *CELL, F.col("value").alias("original_value"), "n_neighbours", "cell_members", "new_value", none().alias("new_place"), none().alias("new_period"), none().alias("new_text"), none().alias("new_code"), F.array(*[F.lit(x) for x in EXPECTED["value_change"]]).alias("expected"))


def plan_mixed(pool: DataFrame, standard: DataFrame, countries: DataFrame, ranges: DataFrame, seed: int, rate: float) -> DataFrame:
    """A share of the clean rows, equally over the validity types and five magnitudes; no row twice."""
    per_group = max(1, round(rate * clean_universe(pool).count() / (len(VALIDITY) + len(MIXED_MAGNITUDES))))
    changes = plan_magnitude(pool, ranges, seed, per_group, MIXED_MAGNITUDES, isolate=False)
    return changes.unionByName(plan_validity(pool, standard, countries, ranges, seed, per_group, exclude=changes))


def apply_faults(standard: DataFrame, faults: DataFrame) -> DataFrame:
    """Standardised rows with the faults in them. Duplicates are appended behind the last row of their file."""
    from tessera.functions.scalars import year_of

    plan = faults.select(*ROW, "fault_type", "new_value", "new_place", "new_period", "new_text", "new_code", "original_value")
    joined = standard.join(plan, list(ROW), "left")
    kind = F.coalesce("fault_type", F.lit(""))
    changed = F.col("new_value").isNotNull()
    gone = kind.isin("missing_value", "unparseable_value")
    bank = F.col("source") == "worldbank"
    factor = F.try_divide(F.col("new_value"), F.col("original_value"))
    text = F.when(changed, F.col("new_value").cast("string")).when(kind == "missing_value", F.lit(None)).when(kind == "unparseable_value", F.when(~bank, F.col("new_text"))).otherwise(F.col("value_text"))
    coded = kind == "categorical_invalid"
    first_code = [F.when(coded & F.col("sex_raw").isNotNull(), "sex_raw"), F.when(coded & F.col("wealth_raw").isNotNull(), "wealth_raw"), F.when(coded & F.col("residence_raw").isNotNull(), "residence_raw")]
    target = F.coalesce(*first_code)
    # A period like 2010.0 is read as a number by the sources that deliver numbers, so the year survives.
    whole = F.when(F.col("new_period").rlike(r"^[0-9]{4}\.0$"), F.substring("new_period", 1, 4))
    # Only one of the sources reads the year from the first four digits; numbers are read as numbers.
    unicef = F.col("source") == "unicef"
    read = F.when(unicef, year_of(F.col("new_period"))).otherwise(F.coalesce(whole, F.when(F.col("new_period").rlike("^[0-9]+$"), F.col("new_period"))).try_cast("int"))
    period = F.when(F.col("new_period").isNull(), F.col("period_text")).when(F.col("source") == "who", read.cast("string")).otherwise(F.col("new_period"))
    mutated = joined.select(
        *[
            {
                "value": F.when(changed, F.col("new_value")).when(gone, F.lit(None)).otherwise(F.col("value")).alias("value"),
                "value_text": text.alias("value_text"),
                "low": F.when(changed & factor.isNotNull(), F.col("low") * factor).otherwise(F.col("low")).alias("low"),
                "high": F.when(changed & factor.isNotNull(), F.col("high") * factor).otherwise(F.col("high")).alias("high"),
                "place": F.trim(F.coalesce("new_place", "place")).alias("place"),
                "year": F.when(F.col("new_period").isNotNull(), read).otherwise(F.col("year")).alias("year"),
                "period_text": period.alias("period_text"),
                **{c: F.when(target == c, F.col("new_code")).otherwise(F.col(c)).alias(c) for c in ("sex_raw", "wealth_raw", "residence_raw")},
            }.get(c, F.col(c))
            for c in standard.columns
        ]
    )
    copied = faults.where("fault_type = 'duplicate'").select(*ROW)
    last = standard.groupBy("source_file").agg(F.max("row_num").alias("__last"))
    rank = F.row_number().over(Window.partitionBy("source_file").orderBy("row_num"))
    copies = standard.join(copied, list(ROW)).join(last, "source_file").withColumn("row_num", (F.col("__last") + rank).cast(standard.schema["row_num"].dataType)).select(*standard.columns)
    return mutated.unionByName(copies)


def located(faults: DataFrame, standard: DataFrame) -> DataFrame:
    """Faults with the row where they show: a duplicate's is its copy, all others' their own."""
    last = standard.groupBy("source_file").agg(F.max("row_num").alias("__last"))
    is_copy = F.col("fault_type") == "duplicate"
    rank = F.row_number().over(Window.partitionBy("source_file", is_copy).orderBy("row_num"))
    return faults.join(last, "source_file").withColumn("origin_row_num", F.col("row_num")).withColumn("row_num", F.when(is_copy, F.col("__last") + rank).otherwise(F.col("row_num")).cast(faults.schema["row_num"].dataType)).drop("__last")


def classify_outcomes(faults: DataFrame, rejected: DataFrame, fact: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Adds labels (array, most telling first), correct and silent to each fault."""
    rejects = rejected.select(*ROW, F.col("reason"))
    rows = fact.select(*ROW, F.col("country").alias("f_country"), F.col("year").alias("f_year"), F.col("value").alias("f_value"), "quality_flags")
    cells = reconciled.select(*CELL, "conflict", "within_group_disagreement")
    joined = faults.join(rejects, list(ROW), "left").join(rows, list(ROW), "left").join(cells, list(CELL), "left")
    flags = {
        "flagged:temporal_outlier": has_flag(F.col("quality_flags"), "temporal_outlier"),
        "flagged:within_group_disagreement": F.coalesce("within_group_disagreement", F.lit(False)),
        "flagged:conflict": F.coalesce("conflict", F.lit(False)),
        "flagged:bounds_violation": has_flag(F.col("quality_flags"), "bounds_violation"),
        "flagged:noncanonical_period": has_flag(F.col("quality_flags"), "noncanonical_period"),
    }
    raised = F.array_compact(F.array(*[F.when(flags[name], F.lit(name)) for name in LABEL_ORDER]))
    close = F.abs(F.col("f_value") - F.col("original_value")) <= F.greatest(F.lit(1e-9), 1e-9 * F.greatest(F.abs("f_value"), F.abs("original_value")))
    same = F.coalesce((F.col("f_country") == F.col("country")) & (F.col("f_year") == F.col("year")) & close, F.lit(False))
    labels = F.when(F.col("reason").isNotNull(), F.array(F.concat(F.lit("rejected:"), F.col("reason")))).when(F.col("f_country").isNull(), F.array(F.lit("lost"))).when(F.size(raised) > 0, raised).when(same, F.array(F.lit("recovered"))).otherwise(F.array(F.lit("silent")))
    out = joined.withColumn("labels", labels)
    return out.select(*faults.columns, "labels", F.arrays_overlap("labels", "expected").alias("correct"), (F.col("labels") == F.array(F.lit("silent"))).alias("silent"))


def naive_outcomes(faults: DataFrame, corrupted: DataFrame, countries: DataFrame) -> DataFrame:
    """Adds naive: what a loader makes of each fault that joins on the exact ISO3 and drops nulls."""
    rows = corrupted.select(*ROW, F.col("place").alias("n_place"), F.col("year").alias("n_year"), F.col("value").alias("n_value")).join(countries.select(F.col("iso3").alias("n_place"), F.lit(True).alias("n_known")), "n_place", "left")
    joined = faults.join(rows, list(ROW), "left")
    dropped = F.col("n_value").isNull() | F.col("n_year").isNull() | F.col("n_known").isNull()
    close = F.abs(F.col("n_value") - F.col("original_value")) <= F.greatest(F.lit(1e-9), 1e-9 * F.greatest(F.abs("n_value"), F.abs("original_value")))
    right = (F.col("n_place") == F.col("country")) & (F.col("n_year") == F.col("year")) & close
    outcome = F.when(F.col("fault_type") == "categorical_invalid", F.lit(None)).when(dropped, "dropped").when((F.col("fault_type") == "duplicate") | ~right, "accepted_wrong").otherwise("accepted_correct")
    return joined.withColumn("naive", outcome).select(*faults.columns, "naive")


def false_positives(pool: DataFrame, faults: DataFrame, rejected: DataFrame, fact: DataFrame, reconciled: DataFrame) -> DataFrame:
    """(label, n): alerts on clean rows and cells that no fault touched. Row checks count rows, cell checks cells."""
    touched = faults.select("source_file", F.coalesce(F.col("origin_row_num") if "origin_row_num" in faults.columns else F.lit(None).cast("int"), F.col("row_num")).alias("row_num")).unionByName(faults.select(*ROW)).distinct()
    untouched = clean_universe(pool).join(touched, list(ROW), "left_anti")
    rows = untouched.select(*ROW, *CELL).join(rejected.select(*ROW, "reason"), list(ROW), "left").join(fact.select(*ROW, F.col("quality_flags").alias("now")), list(ROW), "left")
    dropped = rows.where("reason is not null").groupBy(F.concat(F.lit("rejected:"), F.col("reason")).alias("label")).agg(F.count("*").alias("n"))
    flagged = rows.where("reason is null and now is not null").select(F.explode("now").alias("f")).where(F.col("f").isin("temporal_outlier", "bounds_violation", "noncanonical_period")).groupBy(F.concat(F.lit("flagged:"), F.col("f")).alias("label")).agg(F.count("*").alias("n"))
    cells = rows.where("reason is null").select(*CELL).distinct().join(faults.select(*CELL).distinct(), list(CELL), "left_anti").join(reconciled.select(*CELL, "conflict", "within_group_disagreement"), list(CELL))
    by_cell = cells.select(F.explode(F.array_compact(F.array(F.when(F.col("within_group_disagreement"), F.lit("flagged:within_group_disagreement")), F.when(F.col("conflict"), F.lit("flagged:conflict"))))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return dropped.unionByName(flagged).unionByName(by_cell)


def clean_alert_rates(fact: DataFrame, reconciled: DataFrame) -> DataFrame:
    """(label, alerts, total): how often each check fires on data without faults."""
    flag = lambda name: F.count_if(has_flag(F.col("quality_flags"), name)).alias(name)
    rows = selected_rows(fact).agg(F.count("*").alias("total"), *[flag(x) for x in ("temporal_outlier", "bounds_violation", "noncanonical_period")])
    cells = reconciled.agg(F.count("*").alias("total"), F.count_if("within_group_disagreement").alias("within_group_disagreement"), F.count_if("conflict").alias("conflict"))
    unfold = lambda df, names: df.select("total", F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("alerts")) for x in names])).alias("a")).select("a.label", "a.alerts", "total")
    return unfold(rows, ("temporal_outlier", "bounds_violation", "noncanonical_period")).unionByName(unfold(cells, ("within_group_disagreement", "conflict")))


def detection_rates(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Share of rightly handled faults with its Wilson interval."""
    rates = outcomes.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.count_if("silent").alias("n_silent"))
    low, high = wilson(F.col("n_correct"), F.col("n"))
    return rates.withColumns({"rate": F.col("n_correct") / F.col("n"), "ci_low": low, "ci_high": high})


def alert_precision(outcomes: DataFrame, false_alerts: DataFrame) -> DataFrame:
    """(label, true_positives, false_positives, precision) of each kind of alert."""
    hits = outcomes.select(F.explode("labels").alias("label"), F.array_contains("expected", F.col("label")).alias("right")).where("right").groupBy("label").agg(F.count("*").alias("true_positives"))
    return hits.join(false_alerts.withColumnRenamed("n", "false_positives"), "label", "full_outer").na.fill(0).withColumn("precision", F.try_divide(F.col("true_positives").cast("double"), F.col("true_positives") + F.col("false_positives")))


def corrupt_schema(content: bytes, source: str, fault_type: str) -> bytes:
    """A raw file with a required field renamed or dropped, or an unknown one added (driver side, one file)."""
    required = {"who": "NumericValue", "worldbank": "countryiso3code", "unicef": "OBS_VALUE"}[source]
    dropped = {"who": "SpatialDim", "worldbank": "date", "unicef": "TIME_PERIOD"}[source]

    def change(row: dict) -> dict:
        if fault_type == "schema_rename_required":
            return {(k + "_x" if k == required else k): v for k, v in row.items()}
        if fault_type == "schema_drop_required":
            return {k: v for k, v in row.items() if k != dropped}
        return row | {"NEW_FIELD": "1"}

    if source == "unicef":
        reader = csv.DictReader(io.StringIO(content.decode("utf-8-sig"), newline=""))
        rows = [change(r) for r in reader]
        out = io.StringIO()
        writer = csv.DictWriter(out, list(change(dict.fromkeys(reader.fieldnames or ()))), lineterminator="\n")
        writer.writeheader()
        writer.writerows(rows)
        return out.getvalue().encode()
    payload = json.loads(content)
    if source == "who":
        payload["value"] = [change(r) for r in payload["value"]]
    else:
        payload[1] = [change(r) for r in payload[1] or []]
    return json.dumps(payload).encode()


def schema_outcome(missing: Sequence[str], unexpected: Sequence[str]) -> str:
    return "schema:error" if missing else "schema:warned" if unexpected else "silent"


def outlier_context(outcomes_fact: DataFrame, faults: DataFrame) -> DataFrame:
    """Flagged clean rows with whether a fault stands within two places in their series (why they were flagged)."""
    hit = faults.select(*ROW, F.lit(1).alias("__hit"))
    series = Window.partitionBy("source", "country", "concept").orderBy("year")
    rows = selected_rows(outcomes_fact).join(hit, list(ROW), "left").withColumn("__hit", F.coalesce("__hit", F.lit(0)))
    near = rows.withColumn("faults_near", F.sum("__hit").over(series.rowsBetween(-2, 2)) - F.col("__hit"))
    return near.where(F.col("__hit") == 0).groupBy(has_flag(F.col("quality_flags"), "temporal_outlier").alias("flagged")).agg(F.count("*").alias("n"), F.count_if(F.col("faults_near") > 0).alias("n_near_fault"))


def write_log(faults: DataFrame, path: str) -> None:
    """The ground truth as JSON lines."""
    faults.write.mode("errorifexists").json(path)


def run_passes(spark: SparkSession, seeds: Sequence[int], run_one, results: str) -> DataFrame:
    """Resumable experiment: run_one(seed) -> DataFrame, written once to results/seed=<n> and skipped if there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(results)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for seed in seeds:
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{results}/seed={seed}/_SUCCESS")
        if not files.exists(done):
            run_one(seed).write.mode("overwrite").parquet(f"{results}/seed={seed}")
    return spark.read.option("basePath", results).parquet(*[f"{results}/seed={s}" for s in seeds])
