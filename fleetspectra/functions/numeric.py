"""Sums and means whose result does not depend on row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: Doubles are cut into limbs of 20 bits, from 2**20 down to 2**-60.
LIMB = float(1 << 20)
LIMBS = 5


def exact_sum(value: Column, over: WindowSpec | None = None) -> Column:
    """Sum of doubles, the same in any order.

    Adding doubles gives other last digits whenever partitions arrive in
    another order or a lost task runs again. Whole numbers do not, so each
    double is cut into limbs of 20 bits, which is exact down to ``2**-60``, and
    the limbs are added as bigints. That holds for some 9e12 rows and sums up
    to 9e24. NaN and infinities count as missing.
    """
    total = [F.sum(limb) for limb in limbs(value)]
    return joined_limbs(total if over is None else [part.over(over) for part in total])


def limbs(value: Column) -> list[Column]:
    """A double as LIMBS bigints, whose sums ``joined_limbs`` puts together; for sums in several steps."""
    rest, parts = known(value) / F.lit(LIMB), []
    for _ in range(LIMBS):
        limb = F.rint(rest)
        parts.append(limb.cast("bigint"))
        rest = (rest - limb) * F.lit(LIMB)
    return parts


def joined_limbs(total: Sequence[Column]) -> Column:
    """The double that sums of limbs stand for; null without a value."""
    fraction = F.lit(0.0)
    for part in total[:1:-1]:
        fraction = (fraction + part) / F.lit(LIMB)
    return (total[0] * F.lit(LIMB) + total[1]) + fraction


def exact_avg(value: Column) -> Column:
    """Mean over the rows that have a value; null when none has."""
    return F.try_divide(exact_sum(value), F.count(known(value)))


def stable_stddev(value: Column, digits: int = 12) -> Column:
    """Sample deviation from merged means and second moments; null below two values.

    Those keep all digits of values that lie far from 0, but their last ones depend on the order of merging; so the
    result is rounded to ``digits`` significant ones.
    """
    deviation = F.nullif(F.stddev_samp(known(value)), F.lit(float("nan")))
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(deviation)))
    return F.when(deviation > 0, F.rint(deviation * scale) / scale).otherwise(deviation)


def known(value: Column) -> Column:
    """The value as a double; NaN and infinities count as missing."""
    number = value.cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)
