"""Comparing groups of vehicles: weighted means, radar, boxes, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspectra.functions.joins import join_groups
from fleetspectra.operators.fleet import weighted_mean
from fleetspectra.operators.quantiles import grouped_quantiles


def weighted_fleet_average(
    stats: DataFrame,
    values: Sequence[str],
    weight: str,
    by: Sequence[str] = ("sales_group",),
) -> DataFrame:
    """Means per group, weighted by mileage or time."""
    return stats.groupBy(*by).agg(
        *[weighted_mean(F.col(v), F.col(weight)).alias(v) for v in values]
    )


def radar_profile(averages: DataFrame, values: Sequence[str], by: str = "sales_group") -> DataFrame:
    """Each value scaled to 0..1 between the groups' least and greatest.

    A value that is the same in all groups has no scale and gives null.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(v).alias("parameter"), F.col(v).cast("double").alias("value"))
            for v in values
        ]
    )
    long = averages.select(by, F.explode(pairs).alias("__p")).select(by, "__p.*")
    span = long.groupBy("parameter").agg(F.min("value").alias("__min"), F.max("value").alias("__max"))
    scaled = F.try_divide(F.col("value") - F.col("__min"), F.col("__max") - F.col("__min"))
    return long.join(span, "parameter").select(by, "parameter", "value", scaled.alias("scaled"))


def box_stats(
    stats: DataFrame, column: str, by: Sequence[str] = ("sales_group",), k: float = 1.5
) -> DataFrame:
    """Quartiles, whiskers and number of outliers per group.

    Whiskers end at the last value within ``k`` interquartile ranges.
    """
    quartiles = grouped_quantiles(
        stats, column, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by
    )
    reach = F.lit(float(k)) * (F.col("q3") - F.col("q1"))
    x = F.col(column)
    inside = x.between(F.col("q1") - reach, F.col("q3") + reach)
    rows = stats.where(x.isNotNull() & ~F.isnan(x.cast("double"))).select(*by, column)
    # The quartiles are the same on all rows of a group, so max just hands them on.
    return join_groups(rows, quartiles, list(by)).groupBy(*by).agg(
        F.count(x).alias("vehicles"),
        *[F.max(q).alias(q) for q in ("q1", "median", "q3")],
        F.min(F.when(inside, x)).alias("whisker_lo"),
        F.max(F.when(inside, x)).alias("whisker_hi"),
        F.count(F.when(~inside, x)).alias("outliers"),
    )


def stat_histogram(stats: DataFrame, column: str, series: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between least and greatest value of each series.

    The last bin includes its upper edge; empty bins have 0 vehicles. A series
    with a single value gets bins from half below to half above it.
    """
    x = F.col(column).cast("double")
    rows = stats.where(x.isNotNull() & ~F.isnan(x)).select(series, x.alias("__x"))
    span = rows.groupBy(series).agg(F.min("__x").alias("__a"), F.max("__x").alias("__b"))
    flat = F.col("__a") == F.col("__b")
    span = span.select(
        series,
        F.when(flat, F.col("__a") - 0.5).otherwise(F.col("__a")).alias("__lo"),
        F.when(flat, F.col("__b") + 0.5).otherwise(F.col("__b")).alias("__hi"),
    )
    width = (F.col("__hi") - F.col("__lo")) / F.lit(bins)
    number = F.least(
        F.floor((F.col("__x") - F.col("__lo")) / width), F.lit(bins - 1).cast("bigint")
    ).cast("int")
    counts = (
        join_groups(rows, span, [series])
        .groupBy(series, number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("__vehicles"))
    )
    all_bins = span.select(
        series, "__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    return join_groups(all_bins, counts, [series, "bin"], "left").select(
        series,
        "bin",
        (F.col("__lo") + F.col("bin") * width).alias("bin_lo"),
        (F.col("__lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce("__vehicles", F.lit(0)).alias("vehicles"),
    )
