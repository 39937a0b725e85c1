"""From staged tables to facts, reconciled cells, marts and quality metrics, as one object of lazy frames."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import core, marts, quality
from tessera.params import CoreParams, MartParams
from tessera.session import cut
from tessera.sources import dimensions


@dataclass
class Core:
    """The core layer of one run. Frames are lazy; what several of them read is stored once."""

    spark: SparkSession
    staged: dict[str, DataFrame]
    params: CoreParams = field(default_factory=CoreParams)
    standard_rows: DataFrame | None = None

    @cached_property
    def countries(self) -> DataFrame:
        return cut(core.check_reference(self.staged["worldbank"], self.staged["who"], dimensions.countries(self.spark)))

    @cached_property
    def indicators(self) -> DataFrame:
        return dimensions.indicators(self.spark)

    @cached_property
    def sources(self) -> DataFrame:
        return dimensions.sources(self.spark)

    @cached_property
    def standard(self) -> DataFrame:
        if self.standard_rows is not None:
            return self.standard_rows
        return core.standardize(self.staged["who"], self.staged["worldbank"], self.staged["unicef"], self.staged["load_log"])

    @cached_property
    def classified(self) -> DataFrame:
        aliases = core.learned_aliases(self.staged["worldbank"], self.countries, dimensions.aliases(self.spark))
        return cut(core.classify(self.standard, self.countries, aliases, self.indicators, dimensions.vocabulary(self.spark), self.params))

    @cached_property
    def rejected(self) -> DataFrame:
        return core.rejects(self.classified)

    @cached_property
    def fact(self) -> DataFrame:
        return cut(core.with_series_flags(core.facts(self.classified), self.params))

    @cached_property
    def selected(self) -> DataFrame:
        return core.selected_rows(self.fact)

    @cached_property
    def dependence(self) -> DataFrame:
        return cut(core.source_dependence(self.selected, self.sources, self.params))

    @cached_property
    def groups(self) -> DataFrame:
        return cut(core.evidence_groups(self.selected, self.dependence))

    @cached_property
    def reconciled(self) -> DataFrame:
        return cut(core.reconcile(self.selected, self.groups, self.sources, self.params))

    def accounting(self) -> dict[str, int]:
        row = self.fact.agg(F.count("*").alias("loaded"), F.count_if("is_headline").alias("headline"), F.count_if(F.col("is_headline") & F.col("is_selected")).alias("selected")).first()
        return {"staged": self.standard.count(), "rejected": self.rejected.count()} | row.asDict()


@dataclass
class Marts:
    core: Core
    params: MartParams = field(default_factory=MartParams)

    @cached_property
    def panel(self) -> DataFrame:
        return cut(marts.panel(self.core.reconciled, self.core.fact))

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        members = self.core.countries.select(F.col("iso3").alias("country"), "un_subregion")
        return {
            "country_indicator_year": self.panel,
            "country_latest": marts.latest(self.panel),
            "trend": marts.trend(self.panel, params=self.params),
            "region_year": marts.region_year(self.panel, members),
            "indicator_association": marts.association(self.panel, self.core.indicators, self.params),
            "equity_gap": marts.equity_gap(self.core.fact, self.core.sources, self.core.indicators),
            "data_trust": marts.data_trust(self.panel, self.core.countries.count(), self.params),
        }


def write_run(tables: dict[str, DataFrame], warehouse: str, layer: str, run_id: str, log: dict) -> None:
    """Replace a run's partitions, empty ones too; the build log comes last, so a run without it isn't there."""
    for name, df in tables.items():
        df.drop("run_id").write.mode("overwrite").parquet(f"{warehouse}/{layer}/{name}/run_id={run_id}")
    spark = next(iter(tables.values())).sparkSession
    entry = spark.createDataFrame([(json.dumps(log, sort_keys=True, default=str),)], "parameters string").withColumn("built_at", F.current_timestamp())
    entry.write.mode("overwrite").parquet(f"{warehouse}/{layer}/build_log/run_id={run_id}")


def build_all(spark: SparkSession, staged: dict[str, DataFrame], warehouse: str, run_id: str, core_params: CoreParams = CoreParams(), mart_params: MartParams = MartParams()) -> tuple[Core, Marts]:
    """Build and store both layers of a run; building again replaces it."""
    built = Core(spark, staged, core_params)
    write_run({"fact_observation": built.fact, "rejected_record": built.rejected, "source_dependence": built.dependence, "evidence_group": built.groups, "fact_reconciled": built.reconciled}, warehouse, "core", run_id, core_params.as_dict() | built.accounting())
    mart = Marts(built, mart_params)
    write_run(mart.tables, warehouse, "marts", run_id, mart_params.as_dict() | {"n_countries": built.countries.count()})
    return built, mart


def observations(standard: DataFrame) -> DataFrame:
    """The quality engine's view of the staged layer."""
    dims = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("sex_raw", "wealth_raw", "residence_raw", "maternal_edu_raw", "age_raw", "upstream_label")])
    return standard.select("run_id", "source", "concept", "source_file", "row_num", F.col("place").alias("iso3"), "period_text", "year", "value", "value_text", "low", "high", dims.alias("dim_key"))


def core_observations(selected: DataFrame) -> DataFrame:
    """The same view of the selected facts."""
    return selected.select("run_id", "source", "concept", "source_file", "row_num", F.col("country").alias("iso3"), F.col("year").cast("string").alias("period_text"), "year", "value", F.col("value").cast("string").alias("value_text"), F.col("lower_bound").alias("low"), F.col("upper_bound").alias("high"), F.lit("total").alias("dim_key"))


def quality_baseline(obs: DataFrame, built: Core, years: tuple[int, int], countries: list[str], stage: str) -> DataFrame:
    """All metrics and scores of a layer ('staging' or 'core')."""
    if stage not in ("staging", "core"):
        raise ValueError(f"unknown stage {stage!r}")
    ranges = built.indicators.select("concept", F.col("valid_min").alias("lo"), F.col("valid_max").alias("hi"))
    obs = cut(obs)
    metrics = quality.row_level(obs, ranges, countries, years).unionByName(quality.coverage_and_grain(obs, countries, years)).unionByName(quality.integration(obs))
    if stage == "staging":
        metrics = metrics.unionByName(quality.vocabulary(built.staged["who"], built.staged["unicef"]))
    else:
        metrics = metrics.unionByName(quality.core_metrics(built.staged["load_log"], built.rejected, built.fact, built.reconciled, built.groups))
    metrics = cut(metrics)
    return metrics.unionByName(quality.scores(metrics))


#: Tables of a run from the most dependent layer to the first; each layer's log goes first, so a half-purged run isn't there.
PURGE_ORDER = ("marts", "core", "staging")
RUN_LOGS = ("build_log", "load_log")


def purge_run(spark: SparkSession, warehouse: str, run_id: str) -> list[str]:
    """Delete a run's partitions from all layers, those that depend on others first; returns what was deleted.

    A run that isn't there deletes nothing. The files are found through Spark's file systems, so any store will do.
    """
    if not run_id or "/" in run_id:
        raise ValueError(f"no run id: {run_id!r}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(warehouse)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for layer in PURGE_ORDER:
        folder = hadoop.Path(f"{warehouse}/{layer}")
        if not fs.exists(folder):
            continue
        names = sorted((s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()), key=lambda name: (name not in RUN_LOGS, name))
        for name in names:
            part = hadoop.Path(f"{warehouse}/{layer}/{name}/run_id={run_id}")
            if fs.exists(part) and fs.delete(part, True):
                gone.append(f"{layer}/{name}")
    return gone
