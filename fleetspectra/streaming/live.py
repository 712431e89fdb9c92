"""Spectra that grow while signals arrive.

Counts and distances only ever add up, so the batch operator runs on a stream
as it is; the state is one row per vehicle and bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fleetspectra.operators.spectra import spectra
from fleetspectra.sources.tables import shared_folder
from fleetspectra.spec import SpectrumSpec


def start_spectra(
    signals: DataFrame,
    specs: Sequence[SpectrumSpec],
    name: str,
    sink: str,
    group_by: Sequence[str] = ("vin",),
    mode: str = "update",
) -> StreamingQuery:
    """Start a query that emits the changed bins of each batch to ``sink``.

    The ``memory`` sink keeps every row on the driver: for tests only.
    """
    writer = spectra(signals, specs, group_by=group_by).writeStream
    place = f"{shared_folder(signals.sparkSession)}/fleetspectra-stream-{name}"
    return (
        writer.format(sink)
        .queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", place)
        .start()
    )
