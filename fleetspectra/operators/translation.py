"""Readable names and texts for spectra, from the signal lookups.

The lookups are dictionaries of signals; Spark sees their size and broadcasts
them when it is small enough.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspectra.operators.spectra import config_id, signal_parts
from fleetspectra.spec import SpectrumSpec

# The vehicle network the state texts are taken from, and the
# kinds of signal whose bare number is already readable.
NET_TYPE = 1026
COUNTABLE_TYPES = ("int", "enum")
NO_UNIT = "No unit"


def one_per(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, the smallest, known values first; a doubled lookup row must not double counts."""
    rest = [c for c in df.columns if c not in keys]
    ranked = [part for c in rest for part in (F.col(c).isNull().alias(f"__no_{c}"), F.col(c))]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("__first"))
    return picked.select(*keys, *[F.col(f"__first.{c}") for c in rest])


def number_text(value: Column) -> Column:
    """Whole numbers without a decimal point."""
    whole = value.cast("bigint")
    return F.when(whole == value, whole.cast("string")).otherwise(value.cast("string"))


def translate_spectra(
    spectra_df: DataFrame,
    signal_mapping: DataFrame,
    state_mapping: DataFrame,
    net_type: int = NET_TYPE,
) -> DataFrame:
    """Add ``xn_value_to_text`` per axis.

    It is the state's text if there is one; else the bare value for int and
    enum signals without a unit; else the interval label.
    """
    states = one_per(
        state_mapping.where(F.col("vehicle_net_type") == net_type).select(
            F.col("signal_id").cast("string").alias("signal_id"),
            F.col("value").cast("double").alias("value"),
            "text",
        ),
        ["signal_id", "value"],
    )
    signals = one_per(
        signal_mapping.select(F.col("signal_id").cast("string").alias("signal_id"), "type", "unit"),
        ["signal_id"],
    )
    out = spectra_df
    for n in range(1, sum(c.endswith("_interval") for c in spectra_df.columns) + 1):
        x = f"x{n}_"
        text = states.select(
            F.col("signal_id").alias(x + "signal_id"),
            F.col("value").alias(x + "quantized"),
            F.col("text").alias("__text"),
        )
        kind = signals.select(
            F.col("signal_id").alias(x + "signal_id"),
            F.col("type").alias("__type"),
            F.col("unit").alias("__unit"),
        )
        countable = F.col("__type").isin(*COUNTABLE_TYPES) & (F.col("__unit") == NO_UNIT)
        out = (
            out.join(text, [x + "signal_id", x + "quantized"], "left")
            .join(kind, x + "signal_id", "left")
            .withColumn(
                x + "value_to_text",
                F.coalesce(
                    F.col("__text"),
                    F.when(countable, number_text(F.col(x + "quantized"))),
                    F.col(x + "interval"),
                ),
            )
            .drop("__text", "__type", "__unit")
        )
    return out


def signal_name(can_name: Column, name: Column, suffix: Column) -> Column:
    """The bus name, else the plain one, with what was done to the signal."""
    base = F.coalesce(can_name, name)
    return F.when(suffix.isNotNull(), F.concat(base, F.lit("_"), suffix)).otherwise(base)


def name_signals(metadata: DataFrame, signal_mapping: DataFrame) -> DataFrame:
    """Add the lookup's columns and ``xn_signal`` for each axis."""
    lookup = one_per(
        signal_mapping.withColumn("signal_id", F.col("signal_id").cast("string")), ["signal_id"]
    )
    out = metadata
    for n in range(1, sum(c.endswith("_signal_id") for c in metadata.columns) + 1):
        x = f"x{n}_"
        renamed = lookup.select(*[F.col(c).alias(x + c) for c in lookup.columns])
        named = signal_name(
            F.col(x + "can_signal_name"), F.col(x + "signal_name"), F.col(x + "signal_suffix")
        )
        out = out.join(renamed, x + "signal_id", "left").withColumn(x + "signal", named)
    return out


def spectra_metadata(
    spark: SparkSession,
    specs: Sequence[SpectrumSpec],
    weights: Sequence[str] = ("time", "distance"),
) -> DataFrame:
    """One row per spectrum: what was counted, how, and under which filter."""
    dims = max(len(spec.axes) for spec in specs)
    names = ["ls_config_id int", "title string", "tag string", "count_type string"]
    names += ["description string"]
    for n in range(1, dims + 1):
        names += [f"x{n}_signal_in_config string", f"x{n}_signal_id string"]
        names += [f"x{n}_signal_suffix string"]
    rows = []
    for position, spec in enumerate(specs):
        axes = [(a.signal, *parts) for a, parts in zip(spec.axes, signal_parts(spec))]
        axes += [(None, None, None)] * (dims - len(axes))
        for weight in weights:
            fixed = (config_id(position, weight), spec.title, spec.tag, weight, spec.description)
            rows.append(fixed + tuple(v for axis in axes for v in axis))
    return spark.createDataFrame(rows, ", ".join(names))
