"""Wasserstein distances of spectra: how far load has to be moved along the axis to turn one spectrum into another.

On one axis that is the area between the cumulative shares, so no pair of bins and no pair of vehicles is formed:
a vehicle is compared with its fleet, and fleets with each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspectra.functions.joins import join_groups
from fleetspectra.functions.numeric import exact_avg, exact_sum
from fleetspectra.operators.grid import normalize_spectra


def cumulative_shares(
    spectra_df: DataFrame,
    by: Sequence[str] = (),
    key: str = "vin",
    start: str = "interval_start",
    upper: str = "interval_end",
) -> DataFrame:
    """``bin_lo, bin_hi, up_to`` per vehicle: its share at or below each bin. Vehicles without a total are left out.

    Needs the vehicles of a group on their common grid (``complete_spectra``). A vehicle's window holds its bins; the
    total and the running sum share one shuffle.
    """
    keys = [*by, key]
    rows = spectra_df.select(*keys, F.col(start).alias("bin_lo"), F.col(upper).alias("bin_hi"), "count")
    shares = normalize_spectra(rows, keys, "__share").where(F.col("__share").isNotNull())
    so_far = W.partitionBy(*keys).orderBy("bin_lo").rowsBetween(W.unboundedPreceding, W.currentRow)
    return shares.select(*keys, "bin_lo", "bin_hi", exact_sum(F.col("__share"), over=so_far).alias("up_to"))


def _fleets(cumulative: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each group's mean; every vehicle weighs the same. The mean of running sums is the running sum of the mean."""
    return cumulative.groupBy(*by, "bin_lo", "bin_hi").agg(exact_avg(F.col("up_to")).alias("__fleet"))


def _area(a: str, b: str):
    return exact_sum(F.abs(F.col(a) - F.col(b)) * (F.col("bin_hi") - F.col("bin_lo")))


def fleet_distances(
    spectra_df: DataFrame,
    by: Sequence[str] = (),
    key: str = "vin",
    start: str = "interval_start",
    upper: str = "interval_end",
) -> DataFrame:
    """``distance`` of each vehicle's spectrum from the mean spectrum of its group, in units of the axis."""
    cumulative = cumulative_shares(spectra_df, by, key, start, upper)
    both = join_groups(cumulative, _fleets(cumulative, by), [*by, "bin_lo", "bin_hi"])
    return both.groupBy(*by, key).agg(_area("up_to", "__fleet").alias("distance"))


def group_distances(
    spectra_df: DataFrame,
    by: str = "sales_group",
    key: str = "vin",
    start: str = "interval_start",
    upper: str = "interval_end",
) -> DataFrame:
    """``group_a, group_b, distance`` of the mean spectra of each two groups, the first one smaller.

    Each group is one row a bin by then, so pairs are pairs of groups. Rows without a group are left out.
    """
    fleets = _fleets(cumulative_shares(spectra_df, [by], key, start, upper), [by]).where(F.col(by).isNotNull())
    a = fleets.select(F.col(by).alias("group_a"), "bin_lo", "bin_hi", F.col("__fleet").alias("__a"))
    b = fleets.select(F.col(by).alias("group_b"), "bin_lo", "bin_hi", F.col("__fleet").alias("__b"))
    pairs = a.join(b, ["bin_lo", "bin_hi"]).where("group_a < group_b")
    return pairs.groupBy("group_a", "group_b").agg(_area("__a", "__b").alias("distance"))
