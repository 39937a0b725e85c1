"""Read side: the queries of a stored run. Every function returns a small, ordered DataFrame."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.windows import first_by
from tessera.operators import marts
from tessera.params import MartParams
from tessera.sources import dimensions


@dataclass
class Reader:
    """Queries over the latest stored run of a warehouse, or over a given one."""

    spark: SparkSession
    warehouse: str
    run_id: str | None = None

    def _log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.warehouse}/marts/build_log")

    def latest_run(self) -> str | None:
        row = self._log().orderBy(F.col("built_at").desc(), F.col("run_id").desc()).first()
        return row.run_id if row else None

    def table(self, name: str, layer: str = "marts") -> DataFrame:
        run = self.run_id or self.latest_run()
        if run is None:
            raise LookupError("no marts have been built")
        return self.spark.read.parquet(f"{self.warehouse}/{layer}/{name}").where(F.col("run_id") == run)

    def snapshot_info(self) -> dict:
        run = self.run_id or self.latest_run()
        row = self._log().where(F.col("run_id") == run).first()
        if row is None:
            raise LookupError("no marts have been built")
        return {"run_id": run, "built_at": row.built_at, "parameters": json.loads(row.parameters)}

    def indicators(self) -> DataFrame:
        return dimensions.indicators(self.spark).select("concept", "name", "unit", "domain").orderBy("concept")

    def countries(self) -> DataFrame:
        return dimensions.countries(self.spark).select("iso3", F.col("name").alias("country"), "un_subregion").orderBy("country")

    def _named(self, df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("country", "iso3").join(self.countries(), "iso3")

    def trust(self) -> DataFrame:
        return self.table("data_trust").join(self.indicators().select("concept", F.col("name").alias("indicator")), "concept").orderBy("concept")

    def panel(self, concept: str, iso3s: list[str] | None = None) -> DataFrame:
        rows = self.table("country_indicator_year").where(F.col("concept") == concept)
        if iso3s:
            rows = rows.where(F.col("country").isin(iso3s))
        return self._named(rows).select("iso3", "country", "un_subregion", "year", "value", "quality_tier", "outlier_flag", "source_disagreement", "n_sources", "n_evidence_groups", "reconciled_source").orderBy("country", "year")

    def region_band(self, concept: str, un_subregion: str) -> DataFrame:
        return self.table("region_year").where((F.col("concept") == concept) & (F.col("un_subregion") == un_subregion)).select("year", "n_countries", "n_possible", "median_value", "min_value", "max_value").orderBy("year")

    def country_latest(self, iso3: str) -> DataFrame:
        return self.table("country_latest").where(F.col("country") == iso3).join(self.indicators(), "concept").select("concept", F.col("name").alias("indicator"), "unit", "latest_year", "value", "quality_tier", "first_year", "n_observations", "years_behind").orderBy("concept")

    def country_trends(self, iso3: str) -> DataFrame:
        return self.table("trend").where(F.col("country") == iso3).select("concept", "window_start", "window_end", "n_points", "absolute_change", "linear_slope_per_year", "annual_pct_change").orderBy("concept")

    def association(self, a: str, b: str, basis: str) -> dict | None:
        """The association of two concepts, in either order; None if there is none."""
        both = ((F.col("indicator_a") == a) & (F.col("indicator_b") == b)) | ((F.col("indicator_a") == b) & (F.col("indicator_b") == a))
        row = self.table("indicator_association").where(both & (F.col("basis") == basis)).first()
        return row and {"n": row.n_countries, "rho": row.spearman_rho, "ci_low": row.rho_ci_low, "ci_high": row.rho_ci_high, "reference": row.reference}

    def scatter(self, a: str, b: str, basis: str) -> DataFrame:
        """One point for each country, aligned as the association is."""
        stored = self.snapshot_info()["parameters"]
        params = MartParams(**{k: stored[k] for k in MartParams.__dataclass_fields__})
        panel = self.table("country_indicator_year").where(F.col("concept").isin(a, b))
        values = marts.level_values(panel, params) if basis == "level" else marts.change_values(panel, params)
        side = lambda c, n: values.where(F.col("concept") == c).select("country", F.col("value").alias(n))
        return self._named(side(a, "x").join(side(b, "y"), "country")).select("iso3", "country", "un_subregion", "x", "y").orderBy("country")

    def equity(self, concept: str, dimension: str) -> DataFrame:
        """Each country's latest gap."""
        gaps = self.table("equity_gap").where((F.col("concept") == concept) & (F.col("dimension") == dimension))
        return self._named(first_by(gaps, ["country"], [F.col("year").desc()])).drop("run_id", "concept", "dimension").orderBy("country")

    def equity_options(self) -> DataFrame:
        return self.table("equity_gap").groupBy("concept", "dimension").agg(F.count_distinct("country").alias("countries")).orderBy("concept", "dimension")

    def pipeline_summary(self) -> dict:
        """Accounting of the latest run and its rejects by reason."""
        core_log = self.spark.read.parquet(f"{self.warehouse}/core/build_log").where(F.col("run_id") == (self.run_id or self.latest_run())).first()
        reasons = {r.reason: r["count"] for r in self.table("rejected_record", "core").groupBy("reason").count().collect()}
        logged = json.loads(core_log.parameters)
        return {k: logged[k] for k in ("staged", "loaded", "rejected", "headline", "selected")} | {"reasons": reasons}
