"""Vehicles that should not count, and taking them out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspectra.functions.joins import join_groups
from fleetspectra.functions.numeric import exact_sum, joined_limbs, limbs
from fleetspectra.operators.quantiles import grouped_quantiles

# Least mileage, reach of the fences in interquartile ranges,
# and the weights a loaded or empty truck can have.
MIN_KM = 500.0
IQR_REACH = 1.5
WEIGHT_LO, WEIGHT_HI, WEIGHT_WIDTH = 12000, 50000, 1000

# The columns with a bin's edges; completed spectra have them as interval_start, interval_end.
EDGES = ("x1_quantized", "x1_upper")


class Split(NamedTuple):
    """Rows that stay, vehicles that go, and the count of both per group."""

    kept: DataFrame
    removed: DataFrame
    summary: DataFrame


def _split(df: DataFrame, keep: Column, key: str, by: str) -> Split:
    # A null test drops a row; left bare, the test reaches the scan.
    kept = F.coalesce(keep, F.lit(False))
    vehicles = df.groupBy(by, key).agg(F.max(kept).alias("__kept"))
    return Split(
        df.where(keep),
        df.where(~kept).select(key, by),
        vehicles.groupBy(by).agg(
            F.count(key).alias("vins_before"),
            F.count(F.when(F.col("__kept"), F.col(key))).alias("vins_after"),
        ),
    )


def mileage_outliers(
    stats: DataFrame,
    min_km: float = MIN_KM,
    column: str = "distance_via_speed_km",
    key: str = "vin",
    by: str = "sales_group",
) -> Split:
    """Vehicles below a mileage, or without one, go."""
    return _split(stats, F.col(column) >= F.lit(float(min_km)), key, by)


def iqr_bounds(
    stats: DataFrame, column: str, k: float = IQR_REACH, by: Sequence[str] = ("sales_group",)
) -> DataFrame:
    """Quartiles and fences per group; the quartiles are values of the data."""
    quartiles = grouped_quantiles(stats, column, {"q1": 0.25, "q3": 0.75}, by)
    iqr = F.col("q3") - F.col("q1")
    return quartiles.select(
        "*",
        (F.col("q1") - F.lit(float(k)) * iqr).alias("lower_bound"),
        (F.col("q3") + F.lit(float(k)) * iqr).alias("upper_bound"),
    )


def iqr_outliers(
    stats: DataFrame,
    column: str = "vehicle_speed_avg_driving_kmh",
    k: float = IQR_REACH,
    key: str = "vin",
    by: str = "sales_group",
) -> Split:
    """Vehicles beyond the fences of their group, or without a value, go.

    ``stats`` is read several times: pass a stored table, not a plan over raw
    signals.
    """
    bounds = iqr_bounds(stats, column, k, [by])
    fenced = join_groups(stats, bounds, [by], "left")
    inside = F.col(column).between(F.col("lower_bound"), F.col("upper_bound"))
    split = _split(fenced, inside, key, by)
    return split._replace(kept=split.kept.select(*stats.columns))


def outlier_vins(*removed: DataFrame) -> DataFrame:
    """All removed vehicles under each other; a vehicle may appear twice."""
    return reduce(DataFrame.unionByName, removed)


def completeness_outliers(
    df: DataFrame, signals: Sequence[str], min_share: float, key: str = "vin", by: Sequence[str] = ()
) -> DataFrame:
    """Share of rows with a reading, per vehicle and signal, and who is below.

    The threshold is this library's own definition.
    """
    rows = F.count(F.lit(1))
    shares = {f"{s}_share": F.count(F.col(f"`{s}`")) / rows for s in signals}
    out = df.groupBy(*by, key).agg(
        rows.alias("rows"), *[share.alias(name) for name, share in shares.items()]
    )
    lowest = reduce(F.least, [F.col(f"`{n}`") for n in shares]) if len(shares) > 1 else F.col(
        f"`{next(iter(shares))}`"
    )
    return out.withColumn("incomplete", lowest < F.lit(float(min_share)))


def _flags(outliers: DataFrame, keys: Sequence[str]) -> DataFrame:
    return outliers.select(*keys).distinct()


def _scope_keys(scope: str, key: str, by: str) -> list[str]:
    if scope not in ("any", "same_group"):
        raise ValueError("scope is any or same_group")
    return [key] if scope == "any" else [key, by]


def remove_outliers(
    spectra_df: DataFrame,
    outliers: DataFrame,
    scope: str = "any",
    key: str = "vin",
    by: str = "sales_group",
) -> DataFrame:
    """Spectra without the outlier vehicles.

    ``scope="any"`` removes a vehicle from every group once any group flagged
    it, ``"same_group"`` only from the groups that did.
    """
    keys = _scope_keys(scope, key, by)
    return spectra_df.join(_flags(outliers, keys), keys, "left_anti")


def removed_vins(
    spectra_df: DataFrame,
    outliers: DataFrame,
    scope: str = "any",
    key: str = "vin",
    by: str = "sales_group",
) -> DataFrame:
    """Vehicles of the spectra that are outliers, once per group."""
    keys = _scope_keys(scope, key, by)
    vehicles = spectra_df.select(key, by).distinct()
    return vehicles.join(_flags(outliers, keys), keys, "left_semi")


def removal_summary(
    spectra_df: DataFrame,
    outliers: DataFrame,
    scope: str = "any",
    key: str = "vin",
    by: str = "sales_group",
) -> DataFrame:
    """Vehicles before, after and removed per group, from one pass."""
    keys = _scope_keys(scope, key, by)
    flags = _flags(outliers, keys).withColumn("__out", F.lit(1))
    vehicles = spectra_df.select(key, by).distinct().join(flags, keys, "left")
    return vehicles.groupBy(by).agg(
        F.count(key).alias("vins_before"),
        F.count(F.when(F.col("__out").isNull(), F.col(key))).alias("vins_after"),
        F.count(F.when(F.col("__out").isNotNull(), F.col(key))).alias("vins_removed"),
    )


def removal_totals(summary: DataFrame) -> DataFrame:
    """Totals of the summary; a vehicle in two groups counts twice."""
    return summary.agg(
        F.sum("vins_before").alias("total_before"),
        F.sum("vins_after").alias("total_after"),
        (F.sum("vins_before") - F.sum("vins_after")).alias("total_removed"),
    )


def _centers(lo: float, hi: float, width: float) -> list[float]:
    return [lo + (i + 0.5) * width for i in range(round((hi - lo) / width))]


def _center(edges: tuple[str, str]) -> Column:
    return (F.col(edges[0]) + F.col(edges[1])) / F.lit(2.0)


def weight_matrix(
    spectra_df: DataFrame,
    lo: float = WEIGHT_LO,
    hi: float = WEIGHT_HI,
    width: float = WEIGHT_WIDTH,
    key: str = "vin",
    edges: tuple[str, str] = EDGES,
) -> DataFrame:
    """One row per vehicle, one column ``bin_<centre>`` per bin of the range.

    Bins outside the range are dropped, missing ones are 0. The bins are
    given, so Spark need not look for them. The spectra are shuffled once, by
    vehicle, which both steps of the pivot use.
    """
    centers = _centers(lo, hi, width)
    wide = (
        spectra_df.select(key, _center(edges).alias("__center"), "count")
        .repartition(key)
        .groupBy(key)
        .pivot("__center", centers)
        .agg(exact_sum(F.col("count")))
    )
    return wide.select(
        key,
        *[
            F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"bin_{c:g}") for c in centers
        ],
    )


def weight_shares(matrix: DataFrame, key: str = "vin") -> DataFrame:
    """The matrix as shares of each vehicle's mass; vehicles without any go."""
    bins = [c for c in matrix.columns if c != key]
    total = reduce(Column.__add__, [F.col(f"`{c}`") for c in bins])
    massive = matrix.withColumn("__total", total).where("__total <> 0")
    return massive.select(key, *[(F.col(f"`{c}`") / F.col("__total")).alias(c) for c in bins])


def zero_mass_outliers(
    spectra_df: DataFrame,
    lo: float = WEIGHT_LO,
    hi: float = WEIGHT_HI,
    width: float = WEIGHT_WIDTH,
    key: str = "vin",
    by: str = "sales_group",
    edges: tuple[str, str] = EDGES,
) -> DataFrame:
    """Vehicles with no weight inside the range, with the groups they are in.

    The mass is that of the vehicle over all its groups. What lies outside the
    range does not save a vehicle. The bins are added up per vehicle and group
    first, so only one row of each is put in order by vehicle.
    """
    center = _center(edges)
    inside = (center > F.lit(float(lo))) & (center < F.lit(float(hi)))
    aligned = F.floor((center - F.lit(float(lo))) / F.lit(float(width))) * width + lo + width / 2
    bins = spectra_df.select(key, by, F.when(inside & (center == aligned), F.col("count")).alias("__inside"))
    parts = limbs(F.col("__inside"))
    names = [f"__limb_{i}" for i in range(len(parts))]
    members = bins.groupBy(key, by).agg(*[F.sum(part).alias(name) for name, part in zip(names, parts)])
    vehicle = W.partitionBy(key)
    mass = joined_limbs([F.sum(name).over(vehicle) for name in names])
    return members.select(key, by, F.coalesce(mass, F.lit(0.0)).alias("__mass")).where("__mass = 0").select(key, by)
