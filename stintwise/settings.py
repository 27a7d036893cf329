"""Thresholds and physical constants. One frozen object, passed to column builders."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # They decide which laps count and what the features mean.
    outlier_factor: float = 1.15
    fast_circuit_kph: float = 200.0
    car_mass_kg: float = 860.0
    start_fuel_kg: float = 100.0
    fuel_per_lap_kg: float = 1.6
    corner_entry_m: float = 50.0
    corner_exit_m: float = 50.0
    corner_apex_m: float = 15.0
    min_speed_kph: float = 0.0
    max_speed_kph: float = 380.0
    max_fill_samples: int = 5
    corner_grid_m: float = 2.0
    resample_m: float = 5.0
    min_dt_s: float = 1e-6
    min_rows_own_fit: int = 30
    min_circuits_own_fit: int = 5
    min_std: float = 1e-8
    min_leaf_support: float = 10.0
    max_age_laps: int = 60

    # Spark-side sizing.
    corner_bin_m: float = 100.0  # distance bin in which samples look up corner marks
    slice_us: int = 60_000_000  # width of one time slice for ordered work on long groups
    slice_rows: int = 1_000_000  # a slice with more rows is split further
    lookup_max_rows: int = 50_000  # largest table that may be pinned and broadcast


DEFAULTS = Settings()
