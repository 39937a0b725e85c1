"""Parameters of the builds; the defaults are the documented rules."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class CoreParams:
    year_min: int = 1990
    year_max: int = 2026
    dependence_tolerance: float = 0.01
    dependence_min_shared: int = 30
    dependence_min_share: float = 0.90
    conflict_tolerance: float = 0.10
    group_disagreement_tolerance: float = 0.05
    outlier_z: float = 3.5
    outlier_relative_floor: float = 0.20
    outlier_absolute_floor: float = 0.1
    outlier_each_side: int = 2
    outlier_min_neighbours: int = 3
    flat_min_run: int = 4
    flat_tolerance: float = 1e-9
    flat_concepts: tuple[str, ...] = ("under5_mortality", "neonatal_mortality", "maternal_mortality_ratio")

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class MartParams:
    year_min: int = 1990
    year_max: int = 2026
    trend_start: int = 2000
    trend_min_points: int = 4
    trend_min_span: int = 8
    ref_year: int = 2015
    base_year: int = 2000
    tolerance: int = 3
    change_min_span: int = 8
    min_countries: int = 10

    @property
    def level_label(self) -> str:
        return f"{self.ref_year} +-{self.tolerance}y"

    @property
    def change_label(self) -> str:
        return f"{self.base_year} to {self.ref_year} +-{self.tolerance}y"

    def as_dict(self) -> dict:
        return asdict(self)
