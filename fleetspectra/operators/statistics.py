"""Statistics per vehicle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspectra.functions.numeric import exact_avg, exact_sum, known, stable_stddev
from fleetspectra.operators.signals import SPEED_NOT_AVAILABLE

# Fixed value: diesel, kilograms per litre.
FUEL_DENSITY = 0.84


@dataclass(frozen=True)
class SignalNames:
    """Which column holds which signal; None leaves its statistics out."""

    speed: str = "20_agg_avg_300"
    fuel_flow: str | None = "87"
    weight: str | None = "5589"
    gradient: str | None = "209"


def vehicle_stats(
    df: DataFrame,
    names: SignalNames = SignalNames(),
    group_by: Sequence[str] = ("vin",),
    sample_s: float = 1.0,
    sna: float | None = SPEED_NOT_AVAILABLE,
    density: float = FUEL_DENSITY,
) -> DataFrame:
    """Distance, fuel, speed, weight and gradient statistics in one aggregation.

    The formulas are this library's own definitions: each row stands for
    ``sample_s`` seconds of operation, driving means speed above 0, fuel flow is in kg/h.
    """
    speed = known(F.col(f"`{names.speed}`"))
    if sna is not None:
        speed = F.when(speed != F.lit(float(sna)), speed)
    dt = F.lit(float(sample_s))
    # Speed and distance are columns first, so each is computed once per row.
    step = df.withColumn("__speed", speed).withColumn("__km", speed * dt / F.lit(3600.0))
    speed, km = F.col("__speed"), F.col("__km")
    driving = speed > 0
    stats = {
        "distance_via_speed_km": exact_sum(km),
        "vehicle_speed_avg_driving_kmh": exact_avg(F.when(driving, speed)),
        "vehicle_speed_avg_kmh": exact_avg(speed),
        "vehicle_speed_max_kmh": F.max(speed),
        "operating_time_h": F.count(F.lit(1)) * dt / F.lit(3600.0),
        "driving_time_h": F.count(F.when(driving, speed)) * dt / F.lit(3600.0),
    }
    if names.fuel_flow:
        flow = known(F.col(f"`{names.fuel_flow}`"))
        stats["fuel_kg"] = exact_sum(flow * dt / F.lit(3600.0))
    if names.weight:
        weight = known(F.col(f"`{names.weight}`"))
        both = weight.isNotNull() & km.isNotNull()
        stats["weight_distance_based_kg"] = F.try_divide(
            exact_sum(F.when(both, weight * km)), exact_sum(F.when(both, km))
        )
        stats["weight_avg_kg"] = exact_avg(weight)
        stats["weight_min_kg"] = F.min(weight)
        stats["weight_max_kg"] = F.max(weight)
    if names.gradient:
        slope = F.when(driving, known(F.col(f"`{names.gradient}`")))
        stats["road_gradient_avg"] = exact_avg(slope)
        stats["road_gradient_abs_avg"] = exact_avg(F.abs(slope))
        stats["road_gradient_stddev"] = stable_stddev(slope)
    out = step.groupBy(*group_by).agg(*[s.alias(name) for name, s in stats.items()])
    if names.fuel_flow:
        litres = F.col("fuel_kg") / F.lit(float(density))
        per_100 = F.try_divide(F.col("fuel_l"), F.col("distance_via_speed_km")) * F.lit(100.0)
        out = out.withColumn("fuel_l", litres).withColumn("fuel_l_per_100km", per_100)
    return out
