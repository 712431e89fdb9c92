"""Helpers shared by the corpus operators: stored steps, global ranks, connected components, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: a word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a local session without one gets its own."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="llm-steps-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df`` stored in the shared folder: read again rather than made again, also after lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like ``settled`` for tables of many rows: columnar and compressed, as a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows for each partition of a table that is stored, at least, where their number is known.
PART_ROWS = 1 << 12


def in_few_parts(df: DataFrame, rows: int, part_rows: int = PART_ROWS) -> DataFrame:
    """``df``, of ``rows`` rows at most, in no more partitions than such that hold ``part_rows`` each; for tables to be stored.

    Each partition is a file with a checksum beside it, and for each of these the executor starts a process that sets its
    mode and shares all of the executor's memory until it runs. Adaptive execution does the same where it may.
    """
    return df.coalesce(max(1, -(-rows // part_rows)))


def fold_of(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def ranked(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """``df`` with the row's place (from 0) in the order ``by``.

    A range shuffle sorts the rows; a place is the row's place in its partition plus the sizes of the
    partitions before it, of which there are as many as partitions. No task sees all rows.
    """
    rows = settled(df.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()))
    sizes = dict(rows.groupBy(F.shiftright("_at", 33).cast("int").alias("part")).count().collect())
    offsets, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(part, 0)
    offset = F.array(*(F.lit(x).cast("bigint") for x in offsets or [0]))
    place = F.element_at(offset, (F.shiftright("_at", 33) + 1).cast("int")) + F.col("_at").bitwiseAND((1 << 33) - 1)
    return rows.withColumn(name, place).drop("_at")


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a bigint, b bigint): ``node, label`` for every node that has a link.

    Contraction: each node moves to its first neighbour, by number in even rounds and by a hash in odd
    ones (so neither stars nor long chains need many rounds), links between the places that remain go on.
    Hot nodes are pre-aggregated, and their rows in the joins are split by Spark's skew handling.
    """
    links = settled(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("label", F.col("node"))
    left = links.count()
    n_nodes = 2 * left  # at most
    nodes = settled(in_few_parts(nodes, n_nodes))
    turn = 0
    while left:
        order = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c, t=turn: F.xxhash64(F.col(c), F.lit(t)))
        both = links.union(links.select("b", "a"))
        first = both.groupBy("a").agg(F.min(F.struct(order("b").alias("k"), F.col("b"))).alias("m"))
        here = F.struct(order("a").alias("k"), F.col("a").alias("b"))
        moves = settled(in_few_parts(first.select(F.col("a").alias("at"), F.least("m", here)["b"].alias("to")), 2 * left))
        ends = links.join(moves, F.col("a") == F.col("at")).select(F.col("to").alias("a"), "b")
        ends = ends.join(moves, F.col("b") == F.col("at")).select("a", F.col("to").alias("b")).where("a <> b")
        links = settled(in_few_parts(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), left))
        nodes = nodes.join(moves, F.col("label") == F.col("at"), "left").select("node", F.coalesce("to", "label").alias("label"))
        nodes = settled(in_few_parts(nodes, n_nodes))
        left = links.count()
        turn += 1
    return nodes


BATCH_ROWS = 1024


def in_batches(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> Callable:
    """A function for ``mapInArrow`` that sets up once a task and then maps BATCH_ROWS rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH_ROWS):
                step = step or make()
                yield step(batch.slice(first, BATCH_ROWS))

    return run


def bounded_sample(df: DataFrame, kind: str, per_kind: int, by: str = "doc_id", seed: int = 5) -> DataFrame:
    """About ``per_kind`` rows of each value of ``kind``, the same in every run, with ``weight``: the rows that each stands for.

    A row is in if a hash of its id falls below the share that its kind needs; no kind is sorted or collected.
    """
    sizes = df.groupBy(kind).agg(F.count("*").alias("_n")).withColumnRenamed(kind, "_kind")
    rows = df.join(sizes, F.col(kind) == F.col("_kind"))
    draw = F.shiftrightunsigned(F.xxhash64(by, F.lit(seed)), 11).cast("double") / float(1 << 53)
    share = F.least(F.lit(1.0), F.lit(float(per_kind)) / F.col("_n"))
    return rows.where(draw < share).withColumn("weight", F.lit(1.0) / share).drop("_kind", "_n")


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, use: Column, per_kind: int) -> DataFrame:
    """``doc_id, label, weight`` of a bounded sample of the labels that may be learned from; one label an id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & use)
    known = known.groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    present = docs.select(F.col(id_col).cast("bigint").alias("doc_id")).where("doc_id is not null")
    return bounded_sample(known.join(present, "doc_id", "left_semi"), "label", per_kind)


#: A table is broadcast only if it was counted and its rows take no more than so many bytes.
BROADCAST_BYTES = 48 << 20


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", bound: int = BROADCAST_BYTES) -> DataFrame:
    """Join a table of texts with a stored table of findings.

    The findings are measured; within ``bound`` they are broadcast and the texts stay where they are, beyond
    it both sides are shuffled by the keys. The rows are the same.
    """
    width = sum(
        F.coalesce(F.size(c) * _bytes_of(t.elementType), F.lit(0)) if hasattr(t, "elementType") else F.lit(16)
        for c, t in ((f.name, f.dataType) for f in small.schema)
    )
    total = small.agg(F.sum(width)).head()[0] or 0
    return big.join(F.broadcast(small) if total <= bound else small, on, how)


def _bytes_of(kind) -> Column:
    return F.lit(8 * (len(kind.fields) + 2) if hasattr(kind, "fields") else 8)
