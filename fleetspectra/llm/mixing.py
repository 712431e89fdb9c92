"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspectra.llm.common import WORD, in_few_parts, ranked, settled

#: Most copies of a document, as the targets stop at so many times their source's size.
MOST_COPIES = 3
#: A task pairs the rows of one block of a source; the residuals of FAN_IN blocks meet in the next level's block.
BLOCK_ROWS, FAN_IN = 4_000, 1_000
EXACT = 1e-9
#: Pairs that may change places when a source's last words are settled.
SWAPS = 3


def word_count(text_col: str = "text") -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, n_docs, target`` from one row per source.

    By code point, null last, sources weigh 1, 2, 3, 1, ... and share the total size by weight. A target
    stops at ``most`` times its source's size and its excess goes to the others by weight, until none is
    above: the targets are min(most * size, level * weight) for the level at which they add up. Each round
    sums over the sources once; the driver sees the sums only.
    """
    order = [F.col("source").isNull(), F.col("source")]
    rows = ranked(sizes.where("source is not null"), order[1:], "place")
    last = sizes.where("source is null").withColumn("place", F.lit(rows.count()).cast("bigint"))
    rows = rows.unionByName(last).withColumn("weight", (F.col("place") % 3 + 1).cast("double"))
    rows = settled(rows.withColumn("most", F.col("source_size") * float(most)))
    total = rows.agg(F.sum("source_size")).head()[0] or 0
    level, full = None, F.lit(False)
    while total:
        capped, free = rows.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).head()
        if not free:
            break
        new = (float(total) - (capped or 0.0)) / free
        if level is not None and new <= level:
            break
        level = new
        full = F.col("most") <= F.lit(level) * F.col("weight")
    target = F.lit(0.0) if level is None else F.least("most", F.lit(level) * F.col("weight"))
    return rows.select("source", "source_size", "n_docs", target.alias("target"))


def _flight(blocks: pd.DataFrame, last: bool) -> pd.DataFrame:
    """Pair the open rows of one block, largest sizes first, until one at most is left open.

    Two open rows exchange words: one gains what the other loses, in the direction chosen so that each
    row's expected share stays, and as far as one of them reaches 0 or 1.
    """
    rows = blocks.sort_values(["size", "draw", "doc_id"], ascending=[False, True, True], kind="stable")
    share, size, draw = rows["share"].to_numpy(copy=True), rows["size"].to_numpy(), rows["draw"].to_numpy()
    undecided = (share > EXACT) & (share < 1 - EXACT) & (size > 0)
    held = -1
    for k in np.flatnonzero(undecided).tolist():
        if held < 0:
            held = k
            continue
        a, b = share[held], share[k]
        sa, sb = size[held], size[k]
        up = min((1 - a) * sa, b * sb)
        down = min(a * sa, (1 - b) * sb)
        move = up if draw[k] * (up + down) < down else -down
        a, b = a + move / sa, b - move / sb
        share[held], share[k] = a, b
        open_a, open_b = EXACT < a < 1 - EXACT, EXACT < b < 1 - EXACT
        held = held if open_a else k if open_b else -1
    done = (share <= EXACT) | (share >= 1 - EXACT) | (size == 0)
    share[done] = np.round(share[done])
    if last and held >= 0:
        _land(share, size, undecided, held)
    return rows.assign(share=share)


def _land(share: np.ndarray, size: np.ndarray, undecided: np.ndarray, held: int) -> None:
    """Decide the last open row to the nearer side, then turn over or swap the few rows that bring the words closest to the target."""
    wanted = share[held] * size[held]
    share[held] = float(share[held] >= 0.5)
    missing = wanted - share[held] * size[held]
    turn = undecided & (share == float(missing < 0))
    turn[held] = False
    left = abs(missing)
    for k in np.flatnonzero(turn).tolist():  # largest first, as the rows are sorted
        if size[k] <= left:
            share[k] = 1.0 - share[k]
            left -= size[k]
    missing = np.copysign(left, missing)
    for _ in range(SWAPS):
        taken, rest = np.flatnonzero(undecided & (share == 1)), np.flatnonzero(undecided & (share == 0))
        if not len(taken) or not len(rest):
            return
        rest = rest[::-1]  # smallest first
        aim = size[taken] + missing
        right = np.clip(np.searchsorted(size[rest], aim), 0, len(rest) - 1)
        near = np.where(np.abs(size[rest[np.maximum(right - 1, 0)]] - aim) < np.abs(size[rest[right]] - aim), np.maximum(right - 1, 0), right)
        off = size[rest[near]] - aim
        best = int(np.argmin(np.abs(off)))
        if abs(off[best]) >= abs(missing):
            return
        share[taken[best]], share[rest[near[best]]] = 0.0, 1.0
        missing = -off[best]


def _flight_at(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda blocks: _flight(blocks, last)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    seed: int = 17, block_rows: int = BLOCK_ROWS, fan_in: int = FAN_IN,
) -> DataFrame:
    """``doc_id, size, source_size, target, source, copies, taken``: how often the mix takes each row.

    Each row of a source is wanted target / source size times: the whole part always, the rest by pivotal
    rounding, which keeps the source's words: rows are paired and exchange words until one is decided. A
    source's rows fall into blocks by a hash of the id, so a hot source is many tasks; a block leaves one
    open row at most, and those of ``fan_in`` blocks meet in one block of the next level, up to one block a
    source. There the last open row is rounded to the nearer side, and the few rows that fit into what is
    then missing are turned over or swapped, so a source misses its target by a few words where it has many rows. Draws are hashes of the id: reruns agree whatever the partitions.

    A null source is a source, a null or empty text has size 0 and is taken 0 words (its whole copies stay),
    repeated rows are rows of their own. No documents: no rows.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size")
    )
    rows = settled(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    wanted = settled(targets(sizes))
    most_rows, all_rows = (x or 0 for x in wanted.agg(F.max("n_docs"), F.sum("n_docs")).head())
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES))))
    ratio = F.coalesce(ratio, F.lit(1.0))
    ratio = F.when(F.abs(ratio - F.round(ratio)) < EXACT, F.round(ratio)).otherwise(ratio)
    blocks = F.greatest(F.ceil(F.col("n_docs") / F.lit(block_rows)), F.lit(1))
    own = F.xxhash64("doc_id", F.lit(seed))
    keyed = rows.withColumnRenamed("source", "its").join(
        wanted, F.col("its").eqNullSafe(F.col("source")), "inner"
    ).select(
        "doc_id", "source", "size", "source_size", "target", F.floor(ratio).cast("int").alias("whole"), (ratio - F.floor(ratio)).alias("share"),
        F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), blocks).alias("block"),
        (F.shiftrightunsigned(own, 11).cast("double") / float(1 << 53)).alias("draw"),
    )
    schema = keyed.schema
    n_blocks, level = -(-most_rows // block_rows), keyed
    decided = None
    while True:
        last = n_blocks <= 1

        made = level.groupBy("source", "block").applyInPandas(_flight_at(last), schema)
        made = settled(in_few_parts(made, all_rows, block_rows))
        is_open = (F.col("share") > 0) & (F.col("share") < 1)
        part = made if last else made.where(~is_open)
        decided = part if decided is None else decided.unionByName(part)
        if last:
            break
        level = made.where(is_open).withColumn("block", F.floor(F.col("block") / F.lit(fan_in)).cast(schema["block"].dataType))
        n_blocks = -(-n_blocks // fan_in)
    copies = (F.col("whole") + F.round("share").cast("int")).alias("copies")
    return decided.select("doc_id", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows that repeat in id, source and size share the copies of all of them: as many each, and one more for the first
    ones in an order of their texts. They are numbered by a range shuffle, so no task holds a group of them. The
    input's columns travel in one of their own, so their names are free.
    """
    plan = mix(docs, id_col, text_col, source_col)
    n = plan.count()
    plan = plan.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("total"), F.count("*").alias("peers"))
    plan = plan.select(F.struct("doc_id", "source", "size").alias("its"), "total", "peers")
    plan = settled(in_few_parts(plan, n))
    key = F.struct(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size")
    )
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), F.xxhash64(text_col).alias("text_hash"))
    same = [F.col(f"key.{c}").eqNullSafe(F.col(f"its.{c}")) for c in ("doc_id", "source", "size")]
    rows = rows.join(plan, same[0] & same[1] & same[2])
    each = F.floor(F.col("total") / F.col("peers")).cast("int")
    out = rows.where("peers = 1 OR total % peers = 0").select("row", each.alias("times"))
    several = rows.where("peers > 1 AND total % peers > 0")
    if not plan.where("peers > 1 AND total % peers > 0").isEmpty():
        several = several.withColumn("key_hash", F.xxhash64("key.doc_id", "key.source", "key.size")).withColumn("nth", F.monotonically_increasing_id())
        several = ranked(several, [F.col("key_hash"), F.col("text_hash"), F.col("nth")], "place")
        first = several.groupBy("key_hash").agg(F.min("place").alias("begins"))
        more = (F.col("place") - F.col("begins") < F.col("total") % F.col("peers")).cast("int")
        out = out.unionByName(several.join(first, "key_hash").select("row", (each + more).alias("times")))
    return out.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
