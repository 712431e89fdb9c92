"""Choosing vehicles and taking their signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def select_cohort(
    vehicles: DataFrame,
    contains: Mapping[str, str] | None = None,
    equals: Mapping[str, object] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Vehicles whose texts contain, and whose codes equal, what is given."""
    tests = [F.col(c).contains(text) for c, text in (contains or {}).items()]
    tests += [F.col(c) == F.lit(value) for c, value in (equals or {}).items()]
    chosen = vehicles.where(reduce(Column.__and__, tests)) if tests else vehicles
    return chosen.select(*columns) if columns else chosen


def cohort_combinations(
    vehicles: DataFrame, by: Sequence[str], key: str = "vin", output: str = "truck_count"
) -> DataFrame:
    """Vehicles per combination of codes, the most frequent first."""
    counts = vehicles.groupBy(*by).agg(F.count(key).alias(output))
    return counts.orderBy(F.desc(output), *by)


def sample_vehicles(vehicles: DataFrame, n: int, seed: int = 42, key: str = "vin") -> DataFrame:
    """``n`` vehicles in an order that looks random but never changes.

    Sorting by ``rand()`` draws other vehicles each time the plan runs again;
    a hash of vehicle and seed draws the same ones.
    """
    shuffled = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    return vehicles.orderBy(shuffled, key).limit(n)


def time_literal(df: DataFrame, column: str, text: str) -> Column:
    """A literal of the column's own type, so the comparison reaches the scan."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        kind = T.TimestampType()
    return F.lit(text).cast(kind)


def in_period(df: DataFrame, start: str | None = None, end: str | None = None, order: str = "timestamp") -> DataFrame:
    """Rows with ``start <= time < end``; an end that isn't given doesn't limit."""
    if start is None and end is None:
        return df
    ts = F.col(order)
    if isinstance(df.schema[order].dataType, T.StringType):
        ts = F.to_timestamp(ts)
    if start is not None:
        df = df.where(ts >= time_literal(df, order, start))
    if end is not None:
        df = df.where(ts < time_literal(df, order, end))
    return df


def extract_signals(
    signals: DataFrame,
    vehicles: DataFrame,
    start: str | None = None,
    end: str | None = None,
    key: str = "vin",
    order: str = "timestamp",
) -> DataFrame:
    """Signals of the chosen vehicles within a period.

    A semi join keeps each signal row once even if a vehicle is listed twice.
    Spark broadcasts the list when it is small enough and otherwise sorts and
    merges, splitting a vehicle with too many rows (AQE skew join).
    """
    signals = in_period(signals, start, end, order)
    return signals.join(vehicles.select(key), key, "left_semi")


def vehicle_count(df: DataFrame, by: Sequence[str] = (), key: str = "vin") -> DataFrame:
    """Rows and distinct vehicles, in all or per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("vehicles")
    )


def vehicle_count_approx(
    df: DataFrame, by: Sequence[str] = (), key: str = "vin", rsd: float = 0.02
) -> DataFrame:
    """Distinct vehicles from a sketch; the quick check on raw data."""
    return df.groupBy(*by).agg(F.approx_count_distinct(key, rsd).alias("vehicles"))


#: Bits of a sketch of vehicles; estimates hold for up to some three times as many vehicles.
SKETCH_BITS = 22


def vehicle_sketches(
    signals: DataFrame, by: Sequence[str], key: str = "vin", number: Column | None = None, bits: int = SKETCH_BITS
) -> DataFrame:
    """``bucket, bitmap`` per group: which of ``2**bits`` places have a vehicle. Store it, and later count any union of groups.

    A place is a hash of the vehicle, or ``number`` where vehicles are numbered from 0 below ``2**bits`` (counts are
    exact then). A bitmap is 4 KB, and only those with a vehicle exist. Rows without a vehicle are left out. A bitmap
    holds what its rows say in any order, so sketches of months that are merged equal the sketch of the year.
    """
    place = number if number is not None else F.pmod(F.xxhash64(key), F.lit(1 << bits))
    rows = signals.where(F.col(key).isNotNull()).select(*by, place.cast("bigint").alias("__place"))
    bucket, position = F.bitmap_bucket_number("__place"), F.bitmap_bit_position("__place")
    return rows.groupBy(*by, bucket.alias("bucket")).agg(F.bitmap_construct_agg(position).alias("bitmap"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def sketched_count(sketches: DataFrame, by: Sequence[str], exact: bool = False, bits: int = SKETCH_BITS) -> DataFrame:
    """``vehicles`` per group from its sketches, merged first if there are several.

    Two vehicles may share a place; the number of empty places tells how many do (linear counting). With ``exact``,
    for numbered vehicles, the places themselves are counted.
    """
    size = float(1 << bits)
    ones = merge_sketches(sketches, by).groupBy(*by).agg(F.sum(F.bitmap_count("bitmap")).alias("__ones"))
    full = F.least(F.col("__ones"), F.lit(size - 1))
    count = F.col("__ones") if exact else F.round(F.lit(-size) * F.log1p(-full / F.lit(size))).cast("bigint")
    return ones.select(*by, count.alias("vehicles"))
