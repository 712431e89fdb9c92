"""Whole analyses, put together from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from fleetspectra.operators import fleet, grid, outliers, signals, spectra, statistics
from fleetspectra.operators.grid import Limit
from fleetspectra.sources.tables import stored
from fleetspectra.spec import CleanRule, SpectrumSpec


def prepare_signals(
    df: DataFrame,
    speed: str = "20",
    torque: str = "4",
    rpm: str = "11",
    fuel_flow: str = "87",
    gradient: str = "209",
    sample_s: float = 1.0,
    limit_s: int = 10,
    time_since_last: bool = False,
    key: str = "vin",
    order: str = "timestamp",
) -> DataFrame:
    """Clean engine speed and fuel flow, then add the derived columns.

    ``time_since_last`` needs the rows in one piece and no spectrum needs it,
    so it is only added when asked for; cleaning and it share one shuffle.
    """
    rules = [CleanRule(s, f"`{s}` > 0", limit_s) for s in (rpm, fuel_flow)]
    if time_since_last:
        df = signals.clean_and_time_since_last(df, rules, key=key, order=order)
    else:
        df = signals.clean_signals(df, rules, key=key, order=order)
    df = signals.add_distance(df, speed, sample_s)
    df = signals.add_engine_power(df, torque, rpm)
    df = signals.add_abs(df, gradient)
    df = signals.add_year_month(df, order)
    return signals.copy_signal(df, speed, f"{speed}_cleaned")


class GridRule(NamedTuple):
    """The common grid of one spectrum."""

    lo: Limit
    hi: Limit
    width: float


# The grids of the speed, weight and gradient spectra.
SPEED_GRID = GridRule(0, "max", 1)
WEIGHT_GRID = GridRule("min", 55000, 1000)
GRADIENT_GRID = GridRule("min", 10, 1)


def complete_config(
    spectra_df: DataFrame, config: int, rule: GridRule, by: Sequence[str] = ()
) -> DataFrame:
    """One spectrum of a table of several, on its common grid."""
    rows = spectra.one_spectrum(spectra_df, config)
    return grid.complete_spectra(rows, rule.lo, rule.hi, rule.width, by=by)


def distance_spectra(
    df: DataFrame, specs: Sequence[SpectrumSpec], group_by: Sequence[str] = ("vin",)
) -> DataFrame:
    """The distance-weighted spectra, the ones that are stored."""
    return spectra.spectra(df, specs, weights=("distance",), group_by=group_by)


class OutlierReport(NamedTuple):
    """Vehicles to leave out, and what each test did per group."""

    outliers: DataFrame
    mileage_summary: DataFrame
    speed_summary: DataFrame
    kept: DataFrame


def stats_to_outliers(
    stats: DataFrame,
    min_km: float = outliers.MIN_KM,
    column: str = "vehicle_speed_avg_driving_kmh",
    k: float = outliers.IQR_REACH,
    distance: str = "distance_via_speed_km",
    key: str = "vin",
    by: str = "sales_group",
    store: bool = True,
) -> OutlierReport:
    """Mileage test, then the interquartile test on what is left, all groups at once.

    The statistics are stored first, because the tests read them several
    times; pass ``store=False`` when they come from a table.
    """
    if store:
        stats = stored(stats, "stats")
    mileage = outliers.mileage_outliers(stats, min_km, distance, key, by)
    speed = outliers.iqr_outliers(mileage.kept, column, k, key, by)
    both = outliers.outlier_vins(mileage.removed, speed.removed)
    return OutlierReport(both, mileage.summary, speed.summary, speed.kept)


def signals_to_stats(
    df: DataFrame,
    names: statistics.SignalNames = statistics.SignalNames(),
    group_by: Sequence[str] = ("sales_group", "vin"),
    sample_s: float = 1.0,
) -> DataFrame:
    """Statistics per vehicle, on signals as they come."""
    return statistics.vehicle_stats(df, names, group_by, sample_s)


class CleanSpectra(NamedTuple):
    """Spectra without outliers, who went, and the counts."""

    spectra: DataFrame
    removed: DataFrame
    summary: DataFrame
    totals: DataFrame


def combine_clean_spectra(
    spectra_df: DataFrame, outlier_df: DataFrame, scope: str = "any"
) -> CleanSpectra:
    """Take the outliers out of the spectra of all groups."""
    summary = outliers.removal_summary(spectra_df, outlier_df, scope)
    return CleanSpectra(
        outliers.remove_outliers(spectra_df, outlier_df, scope),
        outliers.removed_vins(spectra_df, outlier_df, scope),
        summary,
        outliers.removal_totals(summary),
    )


def fleet_average_of_signals(
    df: DataFrame,
    spec: SpectrumSpec,
    rule: GridRule,
    by: Sequence[str] = ("sales_group",),
    key: str = "vin",
) -> DataFrame:
    """Signals to mean spectrum per group: histogram, common grid, shares, mean."""
    counted = distance_spectra(df, [spec], [*by, key])
    full = grid.complete_spectra(counted, rule.lo, rule.hi, rule.width, key, by)
    return fleet.fleet_average(full, by, "interval_start", key)
