"""Load spectra: per-vehicle histograms weighted by time or distance."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspectra.functions.binning import bin_number, interval_label, lower_edge, on_axis
from fleetspectra.functions.names import split_signal
from fleetspectra.functions.numeric import exact_sum
from fleetspectra.spec import SpectrumSpec

CLEANED = "_cleaned"


def config_id(position: int, weight: str) -> int:
    """Ids follow the list: odd for time, even for distance."""
    return 2 * position + (1 if weight == "time" else 2)


def signal_parts(spec: SpectrumSpec) -> list[tuple[str, str | None]]:
    """Id and suffix per axis; a single axis forgets that it was cleaned."""
    strip = CLEANED if len(spec.axes) == 1 else None
    return [split_signal(axis.signal, strip) for axis in spec.axes]


def usable_specs(df: DataFrame, specs: Sequence[SpectrumSpec]) -> list[tuple[int, SpectrumSpec]]:
    """Specs whose signals the table has, each with its place in the list."""
    usable = []
    for position, spec in enumerate(specs):
        missing = [a.signal for a in spec.axes if a.signal not in df.columns]
        if missing:
            warnings.warn(f"spectrum {spec.title}: no signal {', '.join(missing)} in the table")
        else:
            usable.append((position, spec))
    return usable


def spectra(
    df: DataFrame,
    specs: Sequence[SpectrumSpec],
    weights: Sequence[str] = ("time", "distance"),
    distance: str = "distance_via_speed_km",
    time: str = "timestamp",
    group_by: Sequence[str] = ("vin",),
) -> DataFrame:
    """All spectra of ``specs`` from one scan of the signals.

    Each row is turned into the cells it counts in, one per spectrum, and one
    aggregation gives both the time and the distance weight. What is shuffled
    is one row per vehicle and bin and task, however many rows a vehicle has.
    Empty bins are not produced. Works on streams too (output mode update).

    Columns: ``ls_config_id``, the ``group_by`` columns and, per axis n,
    ``xn_signal_id``, ``xn_quantized`` (lower edge), ``xn_upper``,
    ``xn_interval``; then ``count``.
    """
    if not weights or not set(weights) <= {"time", "distance"}:
        raise ValueError("weights are time and distance")
    usable = usable_specs(df, specs)
    if not usable:
        raise ValueError("none of the spectra has its signals in the table")
    dims = max(len(spec.axes) for _, spec in usable)
    layout = _cell_layout(usable)
    if len(layout) == 1:
        # As a filter of its own, the test reaches the scan.
        _, spec, first = layout[0]
        counted = df.where(_counted(spec))
        binned = counted.select("*", F.expr(_cell_number(spec, first)).alias("__cell"))
    else:
        cells = [f"IF({_counted(s)}, {_cell_number(s, first)}, NULL)" for _, s, first in layout]
        binned = df.select("*", F.expr(f"explode(array({', '.join(cells)}))").alias("__cell"))
        binned = binned.where("__cell IS NOT NULL")

    totals = {}
    if "time" in weights:
        totals["time"] = F.count(F.col(f"`{time}`"))
    if "distance" in weights:
        totals["distance"] = exact_sum(F.col(f"`{distance}`"))
    grouped = binned.groupBy(*group_by, "__cell").agg(
        *[total.alias(f"__{weight}") for weight, total in totals.items()]
    )
    counts = ", ".join(
        f"named_struct('id', {config_id(0, weight)}, 'count', CAST(__{weight} AS DOUBLE))"
        for weight in totals
    )
    rows = grouped.select(
        *group_by,
        "__cell",
        F.expr(_by_cell(layout, lambda position, *_: str(position))).alias("__spec"),
        F.expr(f"explode(array({counts}))").alias("__w"),
    )
    parts = [_axis_columns(layout, d) for d in range(dims)]
    rows = rows.select("*", *[number for number, _, _ in parts])
    rows = rows.select("*", *[column for _, columns, _ in parts for column in columns])
    rows = rows.select("*", *[label for _, _, label in parts])
    return rows.select(
        F.expr("CAST(__spec * 2 + __w.id AS INT)").alias("ls_config_id"),
        *group_by,
        *[f"x{d + 1}_{part}" for d in range(dims) for part in _PARTS],
        "__w.count",
    )


_PARTS = ("signal_id", "quantized", "upper", "interval")
Layout = list[tuple[int, SpectrumSpec, int]]


def _slots(spec: SpectrumSpec) -> list[int]:
    """Bins per axis, with one more for rows without a reading if they are kept."""
    return [axis.bins + int(spec.keep_null) for axis in spec.axes]


def _cell_layout(usable: Sequence[tuple[int, SpectrumSpec]]) -> Layout:
    """Number the cells of all spectra through; each spectrum has its first cell.

    Grouping by one whole number per row is what makes one scan cheaper than a
    scan per spectrum.
    """
    layout, first = [], 0
    for position, spec in usable:
        layout.append((position, spec, first))
        first += math.prod(_slots(spec))
    return layout


def _counted(spec: SpectrumSpec) -> str:
    """SQL test for the rows that count in a spectrum."""
    tests = [f"({text})" for text in spec.filters]
    tests += [on_axis(a, spec.out_of_range, spec.keep_null) for a in spec.axes]
    return " AND ".join(tests)


def _cell_number(spec: SpectrumSpec, first: int) -> str:
    """SQL for the cell a counted row falls in."""
    cell = "0L"
    for axis, slots in zip(spec.axes, _slots(spec)):
        number = bin_number(axis, spec.out_of_range)
        if spec.keep_null:
            number = f"IF(`{axis.signal}` IS NULL, {axis.bins}, {number})"
        cell = f"({cell} * {slots} + {number})"
    return f"{cell} + {first}L"


def _by_cell(layout: Layout, value: Callable[[int, SpectrumSpec, int], str]) -> str:
    """SQL for a value that depends on the spectrum a cell belongs to."""
    cases = [f"WHEN __cell >= {entry[2]} THEN {value(*entry)}" for entry in reversed(layout)]
    return f"CASE {' '.join(cases)} END"


def _axis_columns(layout: Layout, dim: int) -> tuple[Column, list[Column], Column]:
    """Bin number, then id and edges, then label of one axis, from the cell."""

    def on_this_axis(value: Callable[[SpectrumSpec, int], str]) -> str:
        return _by_cell(
            layout, lambda _, spec, first: value(spec, first) if dim < len(spec.axes) else "NULL"
        )

    def number(spec: SpectrumSpec, first: int) -> str:
        slots = _slots(spec)
        cell = f"((__cell - {first}) DIV {math.prod(slots[dim + 1 :])}) % {slots[dim]}"
        return f"IF({cell} < {spec.axes[dim].bins}, CAST({cell} AS INT), NULL)"

    def edge(n: str) -> str:
        return on_this_axis(
            lambda spec, _: lower_edge(n, spec.axes[dim].start, spec.axes[dim].width)
        )

    n, x = f"__n{dim}", f"x{dim + 1}_"
    columns = [
        F.expr(on_this_axis(lambda spec, _: f"'{signal_parts(spec)[dim][0]}'")).alias(x + "signal_id"),
        F.expr(edge(n)).alias(x + "quantized"),
        F.expr(edge(f"({n} + 1)")).alias(x + "upper"),
    ]
    label = interval_label(x + "quantized", x + "upper").alias(x + "interval")
    return F.expr(on_this_axis(number)).alias(n), columns, label


def one_spectrum(spectra_df: DataFrame, config: int) -> DataFrame:
    """The rows of one spectrum out of a table of several."""
    return spectra_df.where(F.col("ls_config_id") == config)


def inspect_vehicle(spectra_df: DataFrame, vin: object, config: int) -> DataFrame:
    """One vehicle's spectrum, the highest bin first."""
    rows = one_spectrum(spectra_df, config).where(F.col("vin") == F.lit(vin))
    axes = [c for c in rows.columns if c.endswith("_quantized")]
    return rows.orderBy(*[F.desc(c) for c in axes])


def stack_spectra(parts: Sequence[DataFrame]) -> DataFrame:
    """Spectra of several runs under each other; counts become doubles."""
    parts = [p.withColumn("count", F.col("count").cast("double")) for p in parts]
    return reduce(DataFrame.unionByName, parts)


def rebin_spectra(
    spectra_df: DataFrame,
    factor: int,
    start: float,
    width: float,
    keys: Sequence[str] = ("vin",),
) -> DataFrame:
    """Merge each ``factor`` neighbouring bins of a one-axis spectrum."""
    number = F.floor(
        F.rint((F.col("x1_quantized") - F.lit(float(start))) / F.lit(float(width))) / F.lit(factor)
    )
    merged = spectra_df.groupBy(*keys, number.cast("int").alias("__b")).agg(
        exact_sum(F.col("count")).alias("count")
    )
    edges = {"x1_quantized": "__b", "x1_upper": "(__b + 1)"}
    merged = merged.select(
        *keys,
        *[F.expr(lower_edge(n, start, width * factor)).alias(name) for name, n in edges.items()],
        "count",
    )
    return merged.select(
        *keys, *edges, interval_label(*edges).alias("x1_interval"), "count"
    )
