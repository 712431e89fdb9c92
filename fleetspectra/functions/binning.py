"""Bins of an axis: number, edges and label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetspectra.spec import Axis

# How a label's edges are written, with and without a sign.
SIGNED_EDGE = r"[+-]?\d+(?:\.\d+)?"
UNSIGNED_EDGE = r"\d+(?:\.\d+)?"

# Fractional edges use decimals: 0.3 / 0.1 is 2.999... in doubles.
FRACTION = "DECIMAL(18,9)"


def _number(value: float, whole: bool) -> str:
    return f"CAST({float(value)!r} AS DOUBLE)" if whole else f"CAST('{value}' AS {FRACTION})"


def on_axis(axis: Axis, out_of_range: str = "drop", keep_null: bool = False) -> str:
    """SQL test for the rows that get a bin."""
    x = f"`{axis.signal}`"
    if out_of_range == "clip":
        inside = f"({x} IS NOT NULL AND NOT isnan({x}))"
    else:
        lo, hi = _number(axis.start, True), _number(axis.stop, True)
        inside = f"({x} >= {lo} AND {x} < {hi})"
    return f"({inside} OR {x} IS NULL)" if keep_null else inside


def bin_number(axis: Axis, out_of_range: str = "drop") -> str:
    """SQL for the bin, 0 being the first, of rows ``on_axis``.

    A reading is never rounded: on a fractional axis the quotient only gives
    the bin nearby, and the edges decide.
    """
    x, last = f"`{axis.signal}`", axis.bins - 1
    start, width = _number(axis.start, True), _number(axis.width, True)
    number = f"CAST(floor((CAST({x} AS DOUBLE) - {start}) / {width}) AS INT)"
    if not axis.whole:
        own = lower_edge(f"({number})", axis.start, axis.width)
        after = lower_edge(f"({number} + 1)", axis.start, axis.width)
        number = f"CASE WHEN {x} < {own} THEN {number} - 1 WHEN {x} >= {after} THEN {number} + 1 ELSE {number} END"
    number = f"greatest(least({number}, {last}), 0)"
    if out_of_range == "clip":
        lo, hi = _number(axis.start, True), _number(axis.stop, True)
        number = f"CASE WHEN {x} < {lo} THEN 0 WHEN {x} >= {hi} THEN {last} ELSE {number} END"
    return number


def lower_edge(number: str, start: float, width: float) -> str:
    """SQL for the lower edge, a double, of the bin given by an int expression."""
    whole = float(start).is_integer() and float(width).is_integer()
    edge = f"{_number(start, whole)} + {number} * {_number(width, whole)}"
    return f"CAST({edge} AS DOUBLE)"


def _edge_text(edge: str) -> str:
    """Whole edges without a decimal point, others as they are."""
    whole = f"CAST({edge} AS BIGINT)"
    return f"IF({whole} = {edge}, CAST({whole} AS STRING), CAST({edge} AS STRING))"


def interval_label(lo: str, hi: str) -> Column:
    """``[lo,hi)`` from two columns; null when the bin has no edges."""
    return F.expr(f"concat('[', {_edge_text(lo)}, ',', {_edge_text(hi)}, ')')")


def interval_start(label: Column, signed: bool = True) -> Column:
    """Lower edge read back from a label; null when the label has none.

    ``signed=False`` reads only labels without signs, so negative bins give
    null.
    """
    edge = SIGNED_EDGE if signed else UNSIGNED_EDGE
    return F.regexp_extract(label, rf"\[({edge}),", 1).try_cast("double")


def interval_end(label: Column, signed: bool = True) -> Column:
    """Upper edge read back from a label; null when the label has none."""
    edge = SIGNED_EDGE if signed else UNSIGNED_EDGE
    return F.regexp_extract(label, rf",({edge})\)", 1).try_cast("double")


def bin_center(label: Column) -> Column:
    """Middle between the two edges of a label."""
    return (interval_start(label) + interval_end(label)) / F.lit(2.0)
