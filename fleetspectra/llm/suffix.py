"""Removal of byte strings that occur more than once, by prefix-free parsing of the corpus.

Rolling-hash triggers cut the texts into phrases. A window of ``width`` bytes is a phrase's tail (a suffix of
the dictionary) followed by the next phrases (a prefix of a suffix of the parse); windows that are equal have
the same first trigger at the same place, so they meet under it. What has to be ordered are the suffixes at
triggers, one in some sixty positions, and where a stretch of the parse occurs as a whole again, all its
windows are settled at once. Only stretches where two texts part are taken apart, at last window by window. Of the corpus' suffix order only its classes are made (suffixes that agree in the next ``width``
bytes, by hash), as the classes alone say what is repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspectra.llm.common import in_batches, settled, sized_join, stored
from fleetspectra.llm.textvec import U, Rolling, Texts, chunks, mix

#: Bytes that a trigger depends on; one place in EVERY is a trigger.
TRIGGER, EVERY = 8, 64
SEGMENT, LOOSE, KNOWN = 0, 1, 2


def triggers(texts: Texts, rolling: Rolling, size: int = TRIGGER, every: int = EVERY) -> tuple[np.ndarray, np.ndarray]:
    """End (exclusive) and document of each trigger: the hash of the ``size`` bytes before it is 0 modulo ``every``."""
    n = len(texts.data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n)
    found = np.flatnonzero(mix(rolling.raw(at, at + size)) % U(every) == 0)
    doc = np.searchsorted(texts.edges, found, side="right") - 1
    inside = found + size <= texts.edges[doc + 1]
    return found[inside] + size, doc[inside]


def _reach(width: int) -> tuple[int, int, int]:
    """How far left of its trigger a window may begin to be found by what follows it, lies around it, or precedes it."""
    return width * 38 // 100, width * 76 // 100, width * 98 // 100


def parse(texts: Texts, width: int) -> dict[str, np.ndarray]:
    """Rows of the parse, places relative to their document.

    SEGMENT: the windows from ``lo`` on, ``n`` of them, whose first trigger is the same; ``k`` is a hash of bytes
    that all of them hold around it, ``x`` of all their bytes. LOOSE: a window (``k`` its hash) without a trigger
    near its begin; ``lo`` is -1 if the chunk has several (then KNOWN rows say where). KNOWN: ``n`` windows from
    ``lo`` on that are repeated.
    """
    rolling = Rolling(texts.data)
    reach = _reach(width)
    end, doc = triggers(texts, rolling)
    first, last = texts.edges[doc], texts.edges[doc + 1] - width
    before = np.full(len(end), -(1 << 60))
    if len(end) > 1:
        same = doc[1:] == doc[:-1]
        before[1:][same] = end[:-1][same]
    begin = np.maximum(first, before - TRIGGER + 1)
    stop = np.minimum(end - TRIGGER, last)
    rows = []
    for kind, (a, b) in enumerate(zip((TRIGGER - 1, *reach), reach, strict=False)):
        lo, hi = np.maximum(begin, end - b), np.minimum(stop, end - a - 1)
        ok = np.flatnonzero(hi >= lo)
        lo, hi, at = lo[ok], hi[ok], end[ok]
        k = mix(rolling.raw(at - (a if kind else TRIGGER), at + width - b) + U(kind + 1))
        x = mix(rolling.raw(lo, hi + width) + _shape(at, lo, hi))
        rows.append((np.full(len(ok), SEGMENT), doc[ok], lo - first[ok], hi - lo + 1, k, x, at - first[ok]))
    # windows that begin far before their first trigger, or have none after them
    tail_doc = np.arange(texts.n)
    tail_lo = texts.edges[:-1].copy()
    if len(end):
        newest = np.full(texts.n, -1)
        newest[doc] = end  # in order, so the last one stays
        tail_lo = np.where(newest >= 0, np.maximum(tail_lo, newest - TRIGGER + 1), tail_lo)
    lo = np.concatenate([begin, tail_lo])
    hi = np.concatenate([np.minimum(stop, end - reach[-1] - 1), texts.edges[1:] - width])
    loose_doc = np.concatenate([doc, tail_doc])
    count = np.maximum(0, hi - lo + 1)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    at_doc = np.repeat(loose_doc, count)
    value = rolling.raw(at, at + width)
    found, index, group, times = np.unique(mix(value), return_index=True, return_inverse=True, return_counts=True)
    twice = times[group] > 1
    lone = index[times == 1]
    zero = np.zeros(len(lone), np.uint64)
    none = np.zeros(len(lone), np.int64)
    rows.append((none + LOOSE, at_doc[lone], at[lone] - texts.edges[at_doc[lone]], none + 1, found[times == 1], zero, none))
    several = found[times > 1]
    none = np.zeros(len(several), np.int64)
    rows.append((none + LOOSE, at_doc[index[times > 1]], none - 1, none + 1, several, several * U(0), none))
    order = np.flatnonzero(twice)
    order = order[np.lexsort((at[order],))]
    if len(order):
        p, d = at[order], at_doc[order]
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 1) | (d[1:] != d[:-1])]))
        length = np.diff(np.concatenate([cut, [len(p)]]))
        gap = np.zeros(len(cut), np.uint64)
        rows.append((np.full(len(cut), KNOWN), d[cut], p[cut] - texts.edges[d[cut]], length, gap, gap, length * 0))
    names = ("kind", "doc", "lo", "n", "k", "x", "at")
    return {name: np.concatenate([r[c] for r in rows]) for c, name in enumerate(names)}


def _parsed(texts_of: DataFrame, width: int) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            key, size, many = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 3))
            parts = []
            for first, end, texts in chunks(batch.column(2)):
                rows = parse(texts, width)
                rows["h"], rows["size"], rows["many"] = (x[first:end][rows["doc"]] for x in (key, size, many))
                parts.append(rows)
            one = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(one["kind"].astype(np.int8)), pa.array(one["h"]), pa.array(one["size"].astype(np.int64)),
                    pa.array(one["lo"].astype(np.int32)), pa.array(one["n"].astype(np.int32)),
                    pa.array(one["at"].astype(np.int32)),
                    pa.array(one["k"].astype(np.uint64).view(np.int64)), pa.array(one["x"].astype(np.uint64).view(np.int64)),
                    pa.array(one["many"].astype(bool)),
                ],
                ["kind", "h", "size", "lo", "n", "at", "k", "x", "many"],
            )

        return step

    schema = "kind tinyint, h bigint, size bigint, lo int, n int, at int, k bigint, x bigint, many boolean"
    return texts_of.select("h", "size", "text", "many").mapInArrow(in_batches(make), schema)


def _shape(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (at - lo).astype(np.uint64) * U(0x9FB21C651E98DF25) + (at - hi).astype(np.uint64) * U(0xD1B54A32D192ED03)


def cut_finer(rolling: Rolling, base: int, segments: list, grain: int, width: int) -> tuple[np.ndarray, ...]:
    """Segments of one text cut at every ``grain``-th distance from their trigger: place, number, trigger, k, x, witness.

    ``k`` is a hash of the bytes that all windows at these distances hold, ``x`` of all bytes of the piece's windows.
    """
    lo, n, at = (np.array([s[c] for s in segments]) for c in ("lo", "n", "at"))
    far, near = (at - lo) // grain, (at - lo - n + 1) // grain  # the pieces that the farthest and nearest window are in
    count = far - near + 1
    row = np.repeat(np.arange(len(lo)), count)
    piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + near[row]
    from_ = np.maximum(lo[row], at[row] - piece * grain - grain + 1)
    to = np.minimum((lo + n - 1)[row], at[row] - piece * grain)
    x = mix(rolling.raw(from_ + base, to + base + width) + _shape(at[row], from_, to))
    if grain == 1:
        x = mix(rolling.raw(from_ + base, from_ + base + width))
        k = x
    else:
        start = at[row] - piece * grain + base
        k = mix(rolling.raw(start, start + width - grain + 1) + (piece + 5).astype(np.uint64))
    witness = np.array([s["witness"] for s in segments], bool)[row]
    return from_, to - from_ + 1, at[row], k, x, witness


def _finer(held: DataFrame, grain: int, width: int) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            key, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            segments = batch.column(3).to_pylist()
            for first, end, texts in chunks(batch.column(2)):
                rolling = Rolling(texts.data)
                for row in range(first, end):
                    lo, n, at, k, x, witness = cut_finer(rolling, texts.edges[row - first], segments[row], grain, width)
                    out.append((
                        np.full(len(lo), key[row]), np.full(len(lo), size[row]), lo.astype(np.int32), n.astype(np.int32),
                        at.astype(np.int32), k.view(np.int64), x.view(np.int64), witness,
                    ))
            columns = [pa.array(np.concatenate([o[c] for o in out])) for c in range(8)]
            return pa.RecordBatch.from_arrays(columns, ["h", "size", "lo", "n", "at", "k", "x", "witness"])

        return step

    schema = "h bigint, size bigint, lo int, n int, at int, k bigint, x bigint, witness boolean"
    return held.select("h", "size", "text", "segments").mapInArrow(in_batches(make), schema)


def _judged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows known to be repeated, and the pieces to be cut finer: one for each class of equal ones.

    A piece whose ``k`` is met once has no repeated window. Pieces with equal ``x`` settle each other; where a
    ``k`` has several ``x``, a window may still be shared. A witness stands for several equal pieces settled before.
    """
    weight = F.sum(F.when(F.col("witness"), 2).otherwise(1)).alias("all")
    groups = rows.groupBy("k").agg(weight, F.min("x").alias("least"), F.max("x").alias("most")).where("all > 1")
    groups = groups.select(F.col("k").alias("gk"), (F.col("least") == F.col("most")).alias("alike"))
    met = stored(rows.join(groups, F.col("k") == F.col("gk")).drop("gk"))
    mixed = met.where("not alike")
    classes = stored(mixed.groupBy("k", "x").agg(weight, F.min(F.struct("h", "size", "lo", "n", "at")).alias("one")))
    again = classes.where("all > 1").select(F.col("k").alias("gk"), F.col("x").alias("gx"))
    settled_too = mixed.join(again, (F.col("k") == F.col("gk")) & (F.col("x") == F.col("gx")), "left_semi")
    known = met.where("alike").unionByName(settled_too).where("not witness").select("h", "size", "lo", "n")
    piece = F.struct("one.lo", "one.n", "one.at", (F.col("all") > 1).alias("witness"))
    asked = classes.select("one.h", "one.size", piece.alias("s")).groupBy("h", "size").agg(F.collect_list("s").alias("segments"))
    return known, asked


def _merged(rows: DataFrame, width: int) -> DataFrame:
    """``h, size, runs``: begin and end of each maximal removed run, from repeated windows (``lo``, ``n`` of them)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            merged = []
            for at in batch.column(2).to_pylist():
                begin = np.array([a["lo"] for a in at])
                end = begin + np.array([a["n"] for a in at]) - 1 + width
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                new = np.concatenate([[True], begin[1:] > end[:-1]])
                last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])
                merged.append(np.stack([begin[new], end[last]], 1).ravel().astype(np.int32))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(merged, pa.list_(pa.int32()))], ["h", "size", "runs"])

        return step

    # Each content was parsed once, so a list is as long as the text at most, whatever the number of its copies.
    grouped = rows.groupBy("h", "size").agg(F.collect_list(F.struct("lo", "n")).alias("at"))
    return grouped.mapInArrow(in_batches(make), "h bigint, size bigint, runs array<int>")


#: Mixed segments are cut into pieces of so many windows, and mixed pieces into single windows.
GRAINS = (8, 1)


def repeated_runs(texts_of: DataFrame, width: int = 400) -> DataFrame:
    """``h, size, runs`` of the texts (``h, size, text, many``) that have bytes in a string of ``width`` bytes found elsewhere too.

    A text stands here once; ``many`` says that it has copies. Its own windows are repeated then and aren't asked for,
    but they settle those of other texts.
    """
    parsed = _parsed(texts_of, width)
    kind = F.col("kind")
    loose = stored(parsed.where(kind != SEGMENT))
    every = loose.where((kind == KNOWN) & ~F.col("many")).select("h", "size", "lo", "n")
    rows = parsed.where(kind == SEGMENT).drop("kind").withColumnRenamed("many", "witness")
    for grain in (None, *GRAINS):
        if grain:
            rows = _finer(sized_join(texts_of, settled(asked), ["h", "size"]), grain, width)
        if grain == 1:
            single = loose.where(kind == LOOSE).withColumns({"x": F.col("k"), "witness": F.col("many") | (F.col("lo") < 0)})
            rows = rows.unionByName(single.drop("kind", "many"))
        known, asked = _judged(rows)
        every = every.union(known)
    return settled(_merged(every, width))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) for each row: its text without the repeated bytes.

    A byte goes if a string of ``width`` bytes over it also starts anywhere else, in the same text too. Strings
    never reach from one row into another. Texts with equal bytes share their result; a null text reads as
    empty, texts shorter than ``width`` stay; null and repeated ids are kept as they are.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.octet_length(text).cast("bigint").alias("size"), text.alias("text"))
    long = rows.where(F.col("size") >= width)
    # Of each content the row with the smallest id is parsed (all rows with it, if it repeats); the others are settled
    # by it, as all windows of a text with copies are repeated.
    copies = long.groupBy("h", "size").agg(F.count(F.lit(1)).alias("times"), F.min("doc_id").alias("first")).where("times > 1")
    copies = stored(copies.select("h", "size", "first", F.lit(True).alias("many")))
    one = sized_join(long, copies, ["h", "size"], "left").where(F.col("many").isNull() | F.col("doc_id").eqNullSafe(F.col("first")))
    runs = repeated_runs(one.select("h", "size", "text", F.coalesce("many", F.lit(False)).alias("many")), width)
    whole = copies.select("h", "size", F.array(F.lit(0), F.col("size").cast("int")).alias("runs"))
    alone = runs.join(copies.select("h", "size"), ["h", "size"], "left_anti")
    return _cut(sized_join(rows, stored(alone.unionByName(whole)), ["h", "size"], "left"), dict(rows.dtypes)["doc_id"])


def _cut(joined: DataFrame, id_type: str) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            size, removed, spans, kept = [], [], [], []
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                data, at = text.as_py().encode(), runs.as_py() or []
                edges = [0, *at, len(data)]
                rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                size.append(len(data))
                removed.append(len(data) - len(rest))
                spans.append(len(at) // 2)
                kept.append(rest)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (size, removed, spans)), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

        return step

    schema = f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    return joined.select("doc_id", "text", "runs").mapInArrow(in_batches(make), schema)
