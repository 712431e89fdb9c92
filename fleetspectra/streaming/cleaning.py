"""Cleaning and the previous row on arriving signals, with the result of the batch operators.

A vehicle's state holds its last row, its last good reading of each signal, and the rows that the watermark has not
passed yet. A row is worked on once the watermark has passed it: then no earlier row of its vehicle can follow. The
state's function only puts rows in order; what a reading means is decided by the same expressions as in the batch
operators, before and after it, and rows travel through it as text that it does not look into.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType, TimestampType

from fleetspectra.functions.times import epoch_micros
from fleetspectra.operators.ordering import UNTIMED_SLICES, _good, _or_fill
from fleetspectra.spec import CleanRule

# The state's function travels to the executors by value, so a cluster needs no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows as JSON keep microseconds.
FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def clean_stream(
    signals: DataFrame,
    rules: Sequence[CleanRule],
    previous: Mapping[str, str] | None = None,
    defaults: Mapping[str, object] | None = None,
    key: str = "vin",
    order: str = "timestamp",
    tie: Sequence[str] = (),
    delay: str = "1 hour",
    drop: bool = True,
    forget_s: int | None = None,
) -> DataFrame:
    """The rows of a stream with ``rule.output`` per rule and, for ``previous`` (new column: source), the previous row's value.

    The result is that of ``clean_signals`` and then ``with_previous`` over all rows that are at most ``delay`` late;
    later ones are dropped by the watermark. A row comes out once the watermark has passed it, so the last ``delay``
    of a vehicle waits for newer rows of any vehicle. With ``drop``, rows that lack a cleaned signal go and are no
    one's previous row. Rows without vehicle or time have no neighbours and come out at once. ``order`` is a timestamp
    in microseconds; ``tie`` orders rows of equal time. A vehicle's state stays for good, or until ``forget_s``
    seconds after its last row; a vehicle that comes back later than that begins anew.

    State is one row per vehicle plus the rows of its last ``delay``. A micro-batch's rows of one vehicle are ordered
    in one task, so bound the batches (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).
    """
    if not isinstance(signals.schema[order].dataType, TimestampType):
        raise ValueError(f"the watermark needs a timestamp with time zone in {order}")
    previous, defaults = dict(previous or {}), dict(defaults or {})
    held = [r for r in rules if r.limit_s > 0]
    types = {r.output: signals.schema[r.signal].dataType for r in rules}
    columns = [F.col(f"`{c}`") for c in signals.columns]
    untimed = F.col(f"`{key}`").isNull() | F.col(f"`{order}`").isNull()
    spread = F.when(untimed, 1 + F.pmod(F.xxhash64(*columns), F.lit(UNTIMED_SLICES))).otherwise(F.lit(0))
    now = [r for r in rules if r.limit_s <= 0 and r.fill is None]
    keep = F.lit(True)
    for r in now if drop else []:
        keep = keep & _good(r, types).isNotNull()
    rows = signals.withWatermark(order, delay).select(
        F.col(f"`{key}`").alias("__key"), spread.alias("__spread"), F.col(f"`{order}`").alias("__order"),
        epoch_micros(F.col(f"`{order}`")).alias("__at"), keep.alias("__keep"),
        *[F.col(f"`{t}`").alias(f"__tie_{i}") for i, t in enumerate(tie)],
        *[_good(r, types).isNotNull().alias(f"__ok_{i}") for i, r in enumerate(held)],
        F.to_json(F.struct(*columns), FORMATS).alias("__row"),
    )
    found = rows.groupBy("__key", "__spread").applyInPandasWithState(
        _in_order([r.limit_s for r in held], [drop and r.fill is None for r in held], len(tie), forget_s),
        ", ".join(["__row string", "__before string", *[f"__good_{i} string" for i in range(len(held))]]),
        ", ".join(["pending binary", "last string", "last_at bigint", *[f"at_{i} bigint, good_{i} string" for i in range(len(held))]]),
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    schema = StructType(signals.schema.fields)
    row = lambda name: F.from_json(name, schema, FORMATS)
    found = found.select(row("__row").alias("__r"), row("__before").alias("__b"), *[row(f"__good_{i}").alias(f"__g_{i}") for i in range(len(held))])
    out = found.select("__r.*", "__b", *[f"__g_{i}" for i in range(len(held))])
    cleaned = {
        r.output: _or_fill(F.col(f"__g_{held.index(r)}")[r.signal] if r in held else _good(r, types), r, types) for r in rules
    }
    before = {
        new: F.when(F.col("__b").isNull(), F.lit(defaults.get(new)).cast(signals.schema[old].dataType)).otherwise(F.col("__b")[old])
        for new, old in previous.items()
    }
    return out.select(*columns, *[c.alias(n) for n, c in {**cleaned, **before}.items()])


def _in_order(limits: list[int], needed: list[bool], n_ties: int, forget_s: int | None):
    """The state's function: limits of the held rules in seconds, whether a row without a good reading goes, number of ties."""
    order = ["__at", *[f"__tie_{i}" for i in range(n_ties)]]
    names = ["__row", "__before", *[f"__good_{i}" for i in range(len(limits))]]

    def ready_rows(rows: pd.DataFrame, last: str | None, good: list) -> tuple[pd.DataFrame, str | None, list]:
        """Rows in order -> their output, the last row that stays, the last good readings."""
        rows = rows.sort_values(order, kind="stable", na_position="first", ignore_index=True)
        text, at = rows["__row"].to_numpy(object), rows["__at"].to_numpy(np.int64)
        peers = rows.groupby(order, sort=False, dropna=False).ngroup().to_numpy()
        final = np.searchsorted(peers, peers, side="right") - 1  # the last row of the same time
        keep, columns, later = rows["__keep"].to_numpy(bool), [], []
        for i, limit in enumerate(limits):
            ok = rows[f"__ok_{i}"].to_numpy(bool)
            latest = np.maximum.accumulate(np.where(ok, np.arange(len(rows)), -1))
            source = np.where(ok, np.arange(len(rows)), latest[final])
            since = np.where(source >= 0, at[source], np.int64(-(2**62)) if good[i][0] is None else good[i][0])
            recent = at - since <= limit * 1_000_000
            value = np.where(source >= 0, text[source], good[i][1])
            columns.append(np.where(recent, value, None))
            keep &= recent | (not needed[i])
            newest = latest[-1]
            later.append((int(at[newest]), text[newest]) if newest >= 0 else good[i])
        stays = np.flatnonzero(keep)
        before = np.concatenate([[last], text[stays[:-1]]]) if len(stays) else np.empty(0, object)
        out = pd.DataFrame(dict(zip(names, [text[stays], before, *[c[stays] for c in columns]])), dtype=object)
        return out, text[stays[-1]] if len(stays) else last, later

    def alone(rows: pd.DataFrame) -> pd.DataFrame:
        """Rows without vehicle or time: only their own readings count."""
        keep = rows["__keep"].to_numpy(bool)
        good = [rows[f"__ok_{i}"].to_numpy(bool) for i in range(len(limits))]
        for ok, need in zip(good, needed):
            keep = keep & (ok | (not need))
        text = rows["__row"].to_numpy(object)
        return pd.DataFrame(dict(zip(names, [text[keep], None, *[np.where(ok, text, None)[keep] for ok in good]])), dtype=object, columns=names)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[1]:
            yield from map(alone, frames)
            return
        have = state.get if state.exists else (None, None, None, *[None] * (2 * len(limits)))
        parts = [f.drop(columns=["__key", "__spread", "__order"]) for f in frames]
        if have[0] is not None:
            parts.append(pa.ipc.open_stream(have[0]).read_pandas())
        last, last_at = have[1], have[2]
        good = [(have[3 + 2 * i], have[4 + 2 * i]) for i in range(len(limits))]
        passed = state.getCurrentWatermarkMs() * 1000
        rest = None
        if parts:
            rows = pd.concat(parts, ignore_index=True)
            due = rows["__at"].to_numpy(np.int64) <= passed
            if due.any():
                last_at = max(last_at or 0, int(rows["__at"][due].max()))
                out, last, good = ready_rows(rows[due], last, good)
                yield out
            rest = rows[~due] if not due.all() else None
        pending = None
        if rest is not None:
            sink = pa.BufferOutputStream()
            table = pa.Table.from_pandas(rest, preserve_index=False)
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            pending = sink.getvalue().to_pybytes()
        elif forget_s is not None and (last_at or 0) + forget_s * 1_000_000 <= passed:
            state.remove()
            return
        state.update((pending, last, last_at, *[x for pair in good for x in pair]))
        if rest is not None:
            state.setTimeoutTimestamp(int(rest["__at"].min()) // 1000 + 1)
        elif forget_s is not None:
            state.setTimeoutTimestamp(last_at // 1000 + 1000 * forget_s + 1)

    return step
