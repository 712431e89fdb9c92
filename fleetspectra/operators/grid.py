"""Spectra on a common grid of bins, and as shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspectra.functions.binning import interval_label, lower_edge
from fleetspectra.functions.numeric import exact_sum

Limit = float | str | tuple[str, float]

# The column that tells the spectra of one table apart.
CONFIG = "ls_config_id"

# Edges that differ by less than this part of a bin are the same edge.
EDGE_TOLERANCE = "1e-6"


def grid_bounds(
    spectra_df: DataFrame,
    by: Sequence[str] = (),
    start: str = "x1_quantized",
    upper: str = "x1_upper",
) -> DataFrame:
    """Smallest lower and largest upper edge, in all or per group."""
    return spectra_df.groupBy(*by).agg(
        F.min(start).alias("grid_lo"), F.max(upper).alias("grid_hi")
    )


def upper_edge_quantile(
    spectra_df: DataFrame, p: float = 0.99, by: Sequence[str] = (), upper: str = "x1_upper"
) -> DataFrame:
    """Exact quantile of the upper edges, one of the edges itself.

    Spark keeps one counter per distinct edge, and an axis has few edges.
    """
    return spectra_df.groupBy(*by).agg(_edge_quantile(p, upper).alias("upper_edge"))


def _edge_quantile(p: float, column: str) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`)")


def _limit(limit: Limit, start: str, upper: str, low: bool) -> Column | None:
    """The aggregate that gives a limit, or None for a plain number."""
    if isinstance(limit, tuple):
        return _edge_quantile(limit[1], upper)
    if limit == "min":
        return F.min(start)
    if limit == "max":
        return F.max(start if low else upper)
    return None


def complete_spectra(
    spectra_df: DataFrame,
    lo: Limit,
    hi: Limit,
    width: float,
    key: str = "vin",
    by: Sequence[str] = (),
    start: str = "x1_quantized",
    upper: str = "x1_upper",
    keep_above: bool = False,
) -> DataFrame:
    """Every vehicle with every bin from ``lo`` to ``hi``; missing counts are 0.

    A limit is a number, ``"min"`` or ``"max"`` of the data, or ``("p", 0.99)``
    for a quantile of the upper edges; limits from data are taken per ``by``
    group, and per spectrum where the table holds several (``ls_config_id``).
    Rows outside the grid vanish; with ``keep_above`` those from ``hi`` on
    stay as they were counted, and no vehicle is filled there. Other columns
    are null on filled rows.

    A vehicle's first row also brings the empty bins: those of the grid that
    the vehicle has no row for. So the spectra are read once and shuffled
    once, by vehicle, and only rows that were counted are put in order.
    Limits from data need one more reading: pass a stored table then. They
    are one row per group, which goes to every task.
    """
    if CONFIG in spectra_df.columns and CONFIG not in by:
        by = [CONFIG, *by]
    keys = [*by, key]
    rows = spectra_df
    data_limits = {
        name: agg
        for name, agg in {
            "__lo": _limit(lo, start, upper, True),
            "__hi": _limit(hi, start, upper, False),
        }.items()
        if agg is not None
    }
    if data_limits and by:
        limits = spectra_df.groupBy(*by).agg(*[a.alias(n) for n, a in data_limits.items()])
        # Dealt by group for a join, all vehicles of a group would stay in one task.
        rows = rows.join(F.broadcast(limits), list(by))
    else:
        for name, agg in data_limits.items():
            rows = rows.withColumn(name, spectra_df.agg(agg.alias(name)).scalar())
    for name, limit in {"__lo": lo, "__hi": hi}.items():
        if name not in data_limits:
            rows = rows.withColumn(name, F.lit(float(limit)))

    vehicle = W.partitionBy(*keys).orderBy(start)
    whole = vehicle.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    size = f"CAST(ceil(round((__hi - __lo) / {float(width)!r}, 9)) AS INT)"
    rows = rows.select("*", F.expr(size).alias("__size"), _own_bin(start, width).alias("__own"))
    rows = rows.select(
        "*",
        (F.row_number().over(vehicle) == 1).alias("__first"),
        F.collect_set("__own").over(whole).alias("__taken"),
    )
    # A seed is an empty bin; the row itself goes along as a null.
    seeds = "array_except(sequence(0, __size - 1), __taken)"
    seeds = f"IF(__first AND __size > 0, concat({seeds}, array(CAST(NULL AS INT))), array(CAST(NULL AS INT)))"
    spread = rows.select("*", F.expr(f"explode({seeds})").alias("__seed")).drop("__taken")
    spread = spread.select("*", F.coalesce("__seed", "__own").alias("__n"))
    filled = F.col("__seed").isNotNull()
    above = F.expr(f"__seed IS NULL AND `{start}` >= __hi" if keep_above else "false")
    kept = spread.where(F.expr("__n >= 0 AND __n < __size") | above)
    rest = [
        c for c in spectra_df.columns if c not in (*keys, start, upper, "x1_interval", "count")
    ]
    if "__lo" in data_limits:
        edges = [f"__lo + {n} * {float(width)!r}" for n in ("__n", "(__n + 1)")]
    else:
        edges = [lower_edge(n, lo, width) for n in ("__n", "(__n + 1)")]
    out = kept.select(
        *keys,
        *[
            F.when(above, F.col(own).cast("double")).otherwise(F.expr(f"CAST({edge} AS DOUBLE)")).alias(name)
            for own, edge, name in zip((start, upper), edges, ("interval_start", "interval_end"), strict=True)
        ],
        *[F.when(~filled, F.col(f"`{c}`")).alias(c) for c in rest],
        F.when(filled, F.lit(0.0)).otherwise(F.coalesce("count", F.lit(0.0))).alias("count"),
    )
    return out.select(
        *keys,
        interval_label("interval_start", "interval_end").alias("x1_interval"),
        "interval_start",
        "interval_end",
        *rest,
        "count",
    )


def _own_bin(start: str, width: float) -> Column:
    """Bin of the grid a row lies on; null when its edge is not one of the grid's."""
    steps = f"(`{start}` - __lo) / {float(width)!r}"
    return F.expr(f"IF(abs({steps} - rint({steps})) < {EDGE_TOLERANCE}, CAST(rint({steps}) AS INT), NULL)")


def total_distance(spectra_df: DataFrame, keys: Sequence[str] = ("vin",)) -> DataFrame:
    """Sum of the counts per vehicle."""
    return spectra_df.groupBy(*keys).agg(exact_sum(F.col("count")).alias("total_distance"))


def normalize_spectra(
    spectra_df: DataFrame,
    keys: Sequence[str] = ("vin",),
    output: str = "normalized_count",
) -> DataFrame:
    """Counts as shares of the vehicle's total; null when the total is 0.

    The window holds one vehicle's bins, as many rows as its axes have bins.
    """
    total = exact_sum(F.col("count"), over=W.partitionBy(*keys))
    return spectra_df.withColumn(output, F.try_divide(F.col("count"), total))


def sort_spectra(
    spectra_df: DataFrame, key: str = "vin", start: str = "interval_start"
) -> DataFrame:
    """By vehicle and bin, for display; tables carry no order."""
    return spectra_df.orderBy(key, start)
