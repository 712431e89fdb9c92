"""Average spectra of fleets."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspectra.functions.joins import join_groups
from fleetspectra.functions.numeric import exact_sum, known
from fleetspectra.operators.grid import normalize_spectra


def _shares(
    spectra_df: DataFrame, bin_col: str, key: str, by: Sequence[str]
) -> DataFrame:
    return normalize_spectra(
        spectra_df.select(*by, key, F.col(bin_col).alias("x_bin"), "count"),
        [*by, key],
        "norm_count",
    )


def _means(shares: DataFrame, by: Sequence[str], key: str, means: dict[str, Column]) -> DataFrame:
    """Per group and bin, for each name: the shares where the test holds, over the group's vehicles that have any.

    A vehicle without a row for a bin counts 0 there, so completed and uncompleted spectra agree and the
    means of a group add up to 1.
    """
    keys = list(by) or ["__all"]
    rows = shares.where(F.col("norm_count").isNotNull())
    rows = rows if by else rows.withColumn("__all", F.lit(1))
    vehicles = rows.groupBy(*keys).agg(
        *[F.count_distinct(F.when(test, F.col(key))).alias(f"__n_{name}") for name, test in means.items()]
    )
    sums = rows.groupBy(*keys, "x_bin").agg(
        *[exact_sum(F.when(test, F.col("norm_count"))).alias(f"__s_{name}") for name, test in means.items()]
    )
    out = join_groups(sums, vehicles, keys)
    return out.select(
        *by, "x_bin", *[F.try_divide(F.col(f"__s_{n}"), F.col(f"__n_{n}")).alias(n) for n in means]
    )


def fleet_average(
    spectra_df: DataFrame,
    by: Sequence[str] = (),
    bin_col: str = "interval_start",
    key: str = "vin",
) -> DataFrame:
    """Mean share per bin over the group's vehicles. Every vehicle weighs the same.

    A vehicle whose total is 0 has no shares and is left out of the mean; so is
    a bin in which no vehicle has a share.
    """
    shares = _shares(spectra_df, bin_col, key, by)
    return _means(shares, by, key, {"avg_norm_count": F.lit(True)})


def vehicle_vs_fleet(
    spectra_df: DataFrame,
    by: Sequence[str] = (),
    bin_col: str = "interval_start",
    key: str = "vin",
) -> DataFrame:
    """Each vehicle's share next to its fleet's mean: the lines of a chart."""
    shares = _shares(spectra_df, bin_col, key, by)
    average = fleet_average(spectra_df, by, bin_col, key)
    lines = shares.select(*by, key, "x_bin", "norm_count")
    return join_groups(lines, average, [*by, "x_bin"], "left")


def fleet_before_after(
    spectra_df: DataFrame,
    outliers: DataFrame,
    by: Sequence[str] = (),
    bin_col: str = "interval_start",
    key: str = "vin",
    on: Sequence[str] | None = None,
) -> DataFrame:
    """Mean share per bin with and without the outlier vehicles, in one pass.

    ``on`` are the columns a flag refers to: ``[key]`` (default), or with the
    group for flags that count only in their own group. A bin no remaining
    vehicle has a share in gives null.
    """
    keys = list(on or [key])
    flags = outliers.select(*keys).distinct().withColumn("__out", F.lit(1))
    shares = join_groups(_shares(spectra_df, bin_col, key, by), flags, keys, "left")
    return _means(shares, by, key, {"avg_before": F.lit(True), "avg_after": F.col("__out").isNull()})


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of ``value`` weighted by ``weight``, where both are known (NaN is not)."""
    both = known(value).isNotNull() & known(weight).isNotNull()
    return F.try_divide(
        exact_sum(F.when(both, value * weight)), exact_sum(F.when(both, weight))
    )


def sort_averages(averages: DataFrame, by: Sequence[str] = (), bin_col: str = "x_bin") -> DataFrame:
    """Averages in the order of a chart's axis, with their ``position`` from 1 on in each group.

    A group's window holds its bins, as many as an axis has.
    """
    keys = [F.col(c) for c in by] or [F.lit(1)]
    position = F.row_number().over(W.partitionBy(*keys).orderBy(bin_col))
    return averages.withColumn("position", position).orderBy(*by, bin_col)


def fleet_average_cells(
    spectra_df: DataFrame,
    by: Sequence[str] = (),
    cells: Sequence[str] = ("x1_quantized", "x2_quantized"),
    key: str = "vin",
) -> DataFrame:
    """Mean share per occupied cell of spectra over several axes; every vehicle weighs the same.

    A vehicle without a row for a cell counts 0 there, by dividing by the group's vehicles: no grid is built, and what
    is shuffled is the occupied cells. A group's means add up to 1. Vehicles whose total is 0 are left out.
    """
    shares = normalize_spectra(spectra_df.select(*by, key, *cells, "count"), [*by, key], "norm_count")
    packed = shares.select(*by, key, F.struct(*cells).alias("x_bin"), "norm_count")
    means = _means(packed, by, key, {"avg_norm_count": F.lit(True)})
    return means.select(*by, *[F.col("x_bin")[c].alias(c) for c in cells], "avg_norm_count")


def complete_cells(
    averages: DataFrame, axes: Mapping[str, tuple[float, float, float]], by: Sequence[str] = (), value: str = "avg_norm_count"
) -> DataFrame:
    """All cells of a grid for each group of averages, 0 where nothing was; rows off the grid vanish.

    ``axes``: column to (lowest edge, end, width). The grid is built for groups, not for vehicles.
    """
    keys = list(by) or ["__all"]
    rows = averages if by else averages.withColumn("__all", F.lit(1))
    grid = rows.select(*keys).distinct()
    for column, (lo, hi, width) in axes.items():
        steps = F.sequence(F.lit(0), F.lit(max(0, math.ceil((hi - lo) / width - 1e-9) - 1)))
        grid = grid.withColumn("__n", F.explode(steps)).withColumn(column, F.lit(float(lo)) + F.col("__n") * F.lit(float(width))).drop("__n")
    out = join_groups(grid, rows.select(*keys, *axes, value), [*keys, *axes], "left")
    return out.select(*by, *axes, F.coalesce(value, F.lit(0.0)).alias(value))
