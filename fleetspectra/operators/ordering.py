"""Looking back in time within a vehicle, without one task per vehicle.

A window over a whole vehicle sorts all its rows in one task, which fails as
soon as one vehicle holds a large part of the data. Here the windows run per
vehicle *and time slice*; what a slice needs from earlier ones is handed over
as one row per slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from fleetspectra.functions.times import epoch_micros, epoch_seconds
from fleetspectra.spec import CleanRule

SLICE = "__slice"
SLICE_S = 3600
# Rows without a time stamp have no neighbours; they are spread over these.
UNTIMED_SLICES = 4096


def slice_start(seconds: Column, slice_s: int) -> Column:
    return seconds - F.pmod(seconds, F.lit(slice_s))


def time_slice(order: str, slice_s: int, spread_by: Sequence[str]) -> Column:
    """The second at which a row's time slice starts."""
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread_by]), F.lit(UNTIMED_SLICES))
    started = slice_start(epoch_seconds(F.col(order)), slice_s)
    return F.coalesce(started, F.lit(-(2**62)) + spread).cast("bigint")


def with_previous(
    df: DataFrame,
    columns: Mapping[str, str],
    defaults: Mapping[str, object] | None = None,
    key: str = "vin",
    order: str = "timestamp",
    tie: Sequence[str] = (),
    slice_s: int = SLICE_S,
) -> DataFrame:
    """Add the value a column had in the vehicle's previous row.

    ``columns`` maps new column to source column; a vehicle's first row gets
    ``defaults[new]`` (null if not given). ``tie`` orders rows with equal time
    stamps. Rows without vehicle or time have no previous row.

    The rows are read and shuffled once, by vehicle and slice; the hand-over,
    the window and the join of both use that shuffle. For that they travel
    whole, so select the columns you need first. The hand-over holds one row
    per vehicle and slice, so the only window over a whole vehicle sees
    ``time span / slice_s`` rows.
    """
    spread_by = [key, *columns.values(), *tie]
    rows = df.select(
        F.col(f"`{key}`").alias("__key"), time_slice(order, slice_s, spread_by).alias(SLICE), F.struct("*").alias("__row")
    )
    return _previous(rows.repartition("__key", SLICE), df, columns, defaults, key, order, tie)


def clean_with_previous(
    df: DataFrame,
    rules: Sequence[CleanRule],
    columns: Mapping[str, str],
    defaults: Mapping[str, object] | None = None,
    drop: bool = True,
    key: str = "vin",
    order: str = "timestamp",
    tie: Sequence[str] = (),
    slice_s: int | None = None,
) -> DataFrame:
    """``hold_last_valid`` and then ``with_previous`` over the rows that stay, from one shuffle of the signals.

    Both look at the same slices: the good readings copied into a slice serve the first, its own rows the second.
    With ``drop``, rows that lack a cleaned signal go and are no one's previous row. Rows travel whole, so select the
    columns you need first.
    """
    slice_s = slice_s or max([SLICE_S, *[4 * r.limit_s for r in rules]])
    cleaned = _in_slices(df, rules, key, order, tie, slice_s)
    outputs = [r.output for r in rules]
    if drop:
        cleaned = cleaned.dropna(subset=outputs, how="any")
    kept = [*df.columns, *outputs]
    rows = cleaned.select(
        F.col(f"`{key}`").alias("__key"), F.col("__home").alias(SLICE), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row")
    )
    return _previous(rows, cleaned.select(*[F.col(f"`{c}`") for c in kept]), columns, defaults, key, order, tie)


def _previous(
    rows: DataFrame,
    like: DataFrame,
    columns: Mapping[str, str],
    defaults: Mapping[str, object] | None,
    key: str,
    order: str,
    tie: Sequence[str],
) -> DataFrame:
    """The rows in ``__row``, dealt by ``__key`` and slice, with the values of their previous rows.

    Both branches use the whole row and no filter that could move below the shuffle, so Spark makes the shuffle once.
    """
    field = lambda name: F.col("__row")[name]
    default = {new: F.lit((defaults or {}).get(new)).cast(like.schema[old].dataType) for new, old in columns.items()}
    timed = F.col("__key").isNotNull() & field(order).isNotNull()
    rank = F.struct(field(order), *[field(t) for t in tie])
    last = rows.groupBy("__key", SLICE).agg(
        F.max_by("__row", F.when(timed, rank)).alias("__last"), F.first("__key").alias("__of"), F.first(SLICE).alias("__at")
    )
    carry = last.where(F.col("__last").isNotNull()).select(
        "__of", "__at", F.lag("__last").over(W.partitionBy("__of").orderBy("__at")).alias("__carry")
    )
    within = W.partitionBy("__key", SLICE).orderBy(field(order), *[field(t) for t in tie])
    before = rows.withColumn("__within", F.lag("__row").over(within))
    both = before.join(carry, (F.col("__key") == F.col("__of")) & (F.col(SLICE) == F.col("__at")), "left")
    both = both.withColumn("__before", F.when(timed, F.coalesce("__within", "__carry")))
    return both.select(
        *[field(c).alias(c) for c in like.columns],
        *[
            F.when(F.col("__before").isNotNull(), F.col("__before")[old]).otherwise(default[new]).alias(new)
            for new, old in columns.items()
        ],
    )


def hold_last_valid(
    df: DataFrame,
    rules: Sequence[CleanRule],
    key: str = "vin",
    order: str = "timestamp",
    tie: Sequence[str] = (),
    slice_s: int | None = None,
) -> DataFrame:
    """Add ``rule.output`` per rule: the reading, or the last good one.

    Good readings near the end of a slice are copied into the slices their
    time limit reaches, so each slice can be worked on alone: one shuffle, no
    join, and copies of about ``limit / slice_s`` of the rows.
    """
    if not any(r.limit_s > 0 for r in rules):
        types = {r.output: df.schema[r.signal].dataType for r in rules}
        return df.select("*", *[_or_fill(_good(r, types), r, types).alias(r.output) for r in rules])
    slice_s = slice_s or max(SLICE_S, *[4 * r.limit_s for r in rules])
    return _in_slices(df, rules, key, order, tie, slice_s).drop("__home")


def _good(rule: CleanRule, types: Mapping[str, object]) -> Column:
    """The reading where it is good, else null. NaN is no reading."""
    reading = F.col(f"`{rule.signal}`")
    known = reading.isNotNull()
    if isinstance(types[rule.output], (DoubleType, FloatType)):
        known = known & ~F.isnan(reading)
    return F.when(F.expr(rule.valid) & known, reading)


def _in_slices(
    df: DataFrame, rules: Sequence[CleanRule], key: str, order: str, tie: Sequence[str], slice_s: int
) -> DataFrame:
    """The rows with their cleaned signals and their slice in ``__home``, dealt by vehicle and slice."""
    types = {r.output: df.schema[r.signal].dataType for r in rules}
    valid = {r.output: _good(r, types) for r in rules}
    held = [r for r in rules if r.limit_s > 0]
    reach = max([r.limit_s for r in held], default=0)
    any_valid = reduce(Column.__or__, [valid[r.output].isNotNull() for r in held], F.lit(False))
    home = time_slice(order, slice_s, [key, *(r.signal for r in held), *tie])
    until = slice_start(epoch_seconds(F.col(order)) + F.lit(reach), slice_s)
    # A row without a time stamp has no "until" and stays where it is.
    slices = F.when(
        any_valid & until.isNotNull(),
        F.sequence(F.col("__home"), until.cast("bigint"), F.lit(slice_s).cast("bigint")),
    ).otherwise(F.array(F.col("__home")))
    spread = df.withColumn("__home", home).withColumn(SLICE, F.explode(slices))

    window = (
        W.partitionBy(key, SLICE)
        .orderBy(order, *tie)
        .rangeBetween(W.unboundedPreceding, W.currentRow)
    )
    now = epoch_micros(F.col(order))

    def cleaned(rule: CleanRule) -> Column:
        good = valid[rule.output]
        if rule.limit_s <= 0:
            return _or_fill(good, rule, types)
        good_at = F.when(good.isNotNull(), now)
        age = now - F.last(good_at, ignorenulls=True).over(window)
        recent = F.col(key).isNotNull() & (age <= F.lit(rule.limit_s * 1_000_000))
        last_good = F.when(recent, F.last(good, ignorenulls=True).over(window))
        return _or_fill(F.coalesce(good, last_good), rule, types)

    return (
        spread.select("*", *[cleaned(r).alias(r.output) for r in rules])
        .where(F.col(SLICE) == F.col("__home"))
        .drop(SLICE)
    )


def interpolate_valid(
    df: DataFrame,
    rules: Sequence[CleanRule],
    key: str = "vin",
    order: str = "timestamp",
    tie: Sequence[str] = (),
    slice_s: int | None = None,
) -> DataFrame:
    """Add ``rule.output`` per rule: the reading, or a straight line between the good readings around it.

    A bad reading needs a good one of its vehicle at most ``limit_s`` seconds before and one at most as long after
    it, else it takes ``fill``. Of several good readings at the same time the one ordered nearest counts. Good
    readings near both ends of a slice are copied into the slices that their limit reaches, so one shuffle serves the
    look back and the look ahead.
    """
    types = {r.output: df.schema[r.signal].dataType for r in rules}
    valid = {r.output: _good(r, types) for r in rules}
    reach = max([r.limit_s for r in rules], default=0)
    slice_s = slice_s or max(SLICE_S, 4 * reach)
    any_valid = reduce(Column.__or__, [c.isNotNull() for c in valid.values()], F.lit(False))
    home = time_slice(order, slice_s, [key, *(r.signal for r in rules), *tie])
    since, until = (slice_start(epoch_seconds(F.col(order)) + F.lit(d), slice_s).cast("bigint") for d in (-reach, reach))
    slices = F.when(any_valid & until.isNotNull(), F.sequence(since, until, F.lit(slice_s).cast("bigint"))).otherwise(F.array("__home"))
    spread = df.withColumn("__home", home).withColumn(SLICE, F.explode(slices))
    near = W.partitionBy(key, SLICE).orderBy(order, *tie)
    back, ahead = near.rowsBetween(W.unboundedPreceding, -1), near.rowsBetween(1, W.unboundedFollowing)
    now = epoch_micros(F.col(order))

    def filled(rule: CleanRule) -> Column:
        good = valid[rule.output]
        reading = F.when(good.isNotNull(), F.struct(now.alias("t"), good.cast("double").alias("v")))
        a, b = F.last(reading, ignorenulls=True).over(back), F.first(reading, ignorenulls=True).over(ahead)
        limit = F.lit(rule.limit_s * 1_000_000)
        both = F.col(key).isNotNull() & (now - a["t"] <= limit) & (b["t"] - now <= limit)
        part = F.coalesce(F.try_divide(now - a["t"], b["t"] - a["t"]), F.lit(0.0))
        line = F.when(both, a["v"] + (b["v"] - a["v"]) * part)
        value = F.coalesce(good.cast("double"), line)
        return value if rule.fill is None else F.coalesce(value, F.lit(float(rule.fill)))

    out = spread.select("*", *[filled(r).alias(r.output) for r in rules])
    return out.where(F.col(SLICE) == F.col("__home")).drop(SLICE, "__home")


def _or_fill(value: Column, rule: CleanRule, types: Mapping[str, object]) -> Column:
    if rule.fill is None:
        return value
    return F.coalesce(value, F.lit(rule.fill).cast(types[rule.output]))
