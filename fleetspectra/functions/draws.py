"""Draws that look random but are the same in every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of a hash that make a number; a double holds them exactly.
DIGITS = 13


def draw(*parts: Column | str | int) -> Column:
    """A number from 0 up to 1 by the md5 of the parts, joined by colons."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digits = F.substring(F.md5(F.concat_ws(":", *texts)), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**DIGITS))
