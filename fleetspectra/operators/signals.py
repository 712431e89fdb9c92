"""Cleaned and derived signal columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspectra.functions.times import epoch_micros, epoch_seconds
from fleetspectra.operators.ordering import clean_with_previous, hold_last_valid, interpolate_valid, with_previous
from fleetspectra.spec import CleanRule

# The reading that means "speed not available", and the rated
# torque the torque share refers to.
SPEED_NOT_AVAILABLE = 200.0
RATED_TORQUE = 2500.0


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def clean_signals(
    df: DataFrame,
    rules: Sequence[CleanRule],
    drop: bool = True,
    key: str = "vin",
    order: str = "timestamp",
    tie: Sequence[str] = (),
    slice_s: int | None = None,
) -> DataFrame:
    """Add the cleaned signals; with ``drop``, rows lacking any of them go.

    How bad readings are filled is this library's own definition, see
    ``CleanRule``.
    """
    out = hold_last_valid(df, rules, key, order, tie, slice_s)
    return out.dropna(subset=[r.output for r in rules], how="any") if drop else out


def interpolate_signals(
    df: DataFrame,
    rules: Sequence[CleanRule],
    drop: bool = True,
    key: str = "vin",
    order: str = "timestamp",
    tie: Sequence[str] = (),
    slice_s: int | None = None,
) -> DataFrame:
    """Like ``clean_signals``, but bad readings lie on a line between the good ones around them; results are doubles."""
    out = interpolate_valid(df, rules, key, order, tie, slice_s)
    return out.dropna(subset=[r.output for r in rules], how="any") if drop else out


def available(speed: str, sna: float | None = SPEED_NOT_AVAILABLE) -> Column:
    """Speed, null where the reading stands for "not available"."""
    return _col(speed) if sna is None else F.when(_col(speed) != F.lit(sna), _col(speed))


def distance_km(
    speed: str, dt_s: float | Column = 1.0, sna: float | None = SPEED_NOT_AVAILABLE
) -> Column:
    """Kilometres driven during one sample."""
    dt = dt_s if isinstance(dt_s, Column) else F.lit(float(dt_s))
    return available(speed, sna) * dt / F.lit(3600.0)


def add_distance(
    df: DataFrame,
    speed: str,
    sample_s: float = 1.0,
    output: str = "distance_via_speed_km",
    sna: float | None = SPEED_NOT_AVAILABLE,
) -> DataFrame:
    """Distance with a constant time per sample; no shuffle."""
    return df.withColumn(output, distance_km(speed, sample_s, sna))


def add_distance_by_gap(
    df: DataFrame,
    speed: str,
    max_gap_s: float,
    output: str = "distance_via_speed_km",
    sna: float | None = SPEED_NOT_AVAILABLE,
    key: str = "vin",
    order: str = "timestamp",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Distance with the time since the vehicle's previous row, capped."""
    out = with_previous(df, {"__before": order}, key=key, order=order, tie=tie)
    gap = (epoch_micros(F.col(order)) - epoch_micros(F.col("__before"))) / F.lit(1e6)
    capped = F.when(gap.isNotNull(), F.least(gap, F.lit(float(max_gap_s))))
    return out.withColumn(output, distance_km(speed, capped, sna)).drop("__before")


def add_engine_power(
    df: DataFrame, torque: str, rpm: str, output: str = "engine_power_kw"
) -> DataFrame:
    """Power in kW from torque in Nm and engine speed in 1/min."""
    return df.withColumn(output, _col(torque) * _col(rpm) * F.lit(2 * math.pi / 60000))


def add_abs(df: DataFrame, signal: str, output: str | None = None) -> DataFrame:
    return df.withColumn(output or f"{signal}_abs", F.abs(_col(signal)))


def add_year_month(
    df: DataFrame, order: str = "timestamp", output: str = "year_month"
) -> DataFrame:
    """Year and month as a number such as 202406."""
    return df.withColumn(output, F.year(order) * 100 + F.month(order))


def add_odometer_km(df: DataFrame, metres: str, output: str = "odometer_km") -> DataFrame:
    return df.withColumn(output, _col(metres) / F.lit(1000.0))


def add_torque_share(
    df: DataFrame, torque: str, rated: float = RATED_TORQUE, output: str = "engine_torque_percentage"
) -> DataFrame:
    """Positive torque as a share of the rated one, else 0."""
    share = F.when(_col(torque) > 0, _col(torque) / F.lit(float(rated))).otherwise(F.lit(0.0))
    return df.withColumn(output, share)


def add_driving_flag(df: DataFrame, speed: str, output: str = "driving") -> DataFrame:
    return df.withColumn(output, F.coalesce(available(speed) > 0, F.lit(False)))


def copy_signal(df: DataFrame, signal: str, output: str) -> DataFrame:
    return df.withColumn(output, _col(signal))


def add_time_since_last(
    df: DataFrame,
    key: str = "vin",
    order: str = "timestamp",
    tie: Sequence[str] = (),
    previous: str = "timestamp_lag_vin",
    output: str = "diff_time_to_last_timestamp_vin_min",
    slice_s: int = 3600,
) -> DataFrame:
    """Minutes since the vehicle's previous row, both ends in whole seconds."""
    out = with_previous(df, {previous: order}, key=key, order=order, tie=tie, slice_s=slice_s)
    return out.withColumn(output, minutes_between(F.col(previous), F.col(order)))


def clean_and_time_since_last(
    df: DataFrame,
    rules: Sequence[CleanRule],
    drop: bool = True,
    key: str = "vin",
    order: str = "timestamp",
    tie: Sequence[str] = (),
    previous: str = "timestamp_lag_vin",
    output: str = "diff_time_to_last_timestamp_vin_min",
    slice_s: int | None = None,
) -> DataFrame:
    """``clean_signals`` and ``add_time_since_last`` of the rows that stay, from one shuffle."""
    out = clean_with_previous(df, rules, {previous: order}, None, drop, key, order, tie, slice_s)
    return out.withColumn(output, minutes_between(F.col(previous), F.col(order)))


def minutes_between(before: Column, after: Column) -> Column:
    return (epoch_seconds(after) - epoch_seconds(before)) / F.lit(60)


def add_gear_shift(
    df: DataFrame,
    gear: str,
    key: str = "vin",
    order: str = "timestamp",
    tie: Sequence[str] = (),
    slice_s: int = 3600,
) -> DataFrame:
    """Previous gear, whether it changed, and from which to which.

    A vehicle's first row is compared with gear 0.
    """
    lag, event = f"{gear}_lag", "gear_shift_event"
    out = with_previous(df, {lag: gear}, {lag: 0}, key, order, tie, slice_s)
    shifted = F.coalesce(_col(gear) != _col(lag), F.lit(False))
    return out.select(
        "*",
        F.when(shifted, 1).otherwise(0).alias(event),
        F.when(shifted, _col(lag)).otherwise(F.lit(0)).alias(f"{gear}_from"),
        F.when(shifted, _col(gear)).otherwise(F.lit(0)).alias(f"{gear}_to"),
    )


def with_columns_in_order(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns one after the other, so each may use those before it."""
    for name, value in columns.items():
        df = df.withColumn(name, value)
    return df
