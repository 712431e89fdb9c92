"""Exact duplicates by grace hashing: texts are dealt to buckets until each fits a table that compares whole contents.

1. Each task puts its rows into an open-addressing table, so a content leaves the task once, with the number of its
   rows and the best of them, however often it stands there (a content of a third of all rows is as many leaders as
   tasks).
2. The leaders are dealt to buckets by bits of their hash. A bucket of more bytes than a table may hold is dealt again
   by further bits, until each fits; only sizes are looked at for that. The content is then moved once, by Spark's
   shuffle, whose files are the spill files.
3. One table per bucket joins leaders of equal content. Tables hold each different content once and compare all of its
   bytes; the hash only says where to look.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fleetspectra.llm.common import BATCH_ROWS, settled, stored

#: Fixed value: the characters that do not count.
SPACES = b" \t\n\x0b\x0c\r"
#: A task's own table is handed on when its contents reach this size.
TASK_BYTES = 16 << 20
#: A bucket's contents reach this size at most, unless it is one content.
BUCKET_BYTES = 16 << 20
#: Bits of the hash that deal the rows of one level to buckets, and the levels that 64 bits allow.
BITS, LEVELS = 12, 5


class Contents:
    """An open-addressing table of byte strings with linear probing; equal means equal in every byte."""

    def __init__(self, size: int = 1 << 10):
        self.slots, self.hashes, self.values, self.bytes = [-1] * size, [], [], 0

    def place(self, h: int, content: bytes) -> int:
        """The number of the content, in order of first appearance."""
        mask = len(self.slots) - 1
        at = (h ^ h >> 29) & mask
        while (found := self.slots[at]) >= 0:
            if self.hashes[found] == h and self.values[found] == content:
                return found
            at = at + 1 & mask
        self.slots[at] = len(self.values)
        self.hashes.append(h)
        self.values.append(content)
        self.bytes += len(content)
        if 2 * len(self.values) > len(self.slots):
            self._grow()
        return len(self.values) - 1

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for number, h in enumerate(self.hashes):
            at = (h ^ h >> 29) & mask
            while self.slots[at] >= 0:
                at = at + 1 & mask
            self.slots[at] = number


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (code points, id, row): more code points, then the smaller id (null last), then the earlier row."""
    key = lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0, x[2])
    return a if key(a) <= key(b) else b


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _members(schema: pa.Schema, task_bytes: int):
    """Rows ``row, doc_id, text`` as members of a local class, and one leader per class, which holds the content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first, count, best = Contents(), [], [], []

        def leaders() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(first), BATCH_ROWS):
                some = slice(at, at + BATCH_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b[2] for b in best[some]], pa.int64()), pa.array([b[1] for b in best[some]], schema.field("doc_id").type),
                        pa.array([b[0] for b in best[some]], pa.int64()), pa.array(first[some], pa.int64()),
                        pa.array([_signed(h) for h in table.hashes[some]], pa.int64()), pa.array([len(v) for v in table.values[some]], pa.int64()),
                        pa.array(count[some], pa.int64()), pa.array(table.values[some], pa.binary()),
                    ],
                    schema=schema,
                )

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                rows, ids = part.column(0).to_pylist(), part.column(1).to_pylist()
                texts = pc.fill_null(part.column(2), "")
                lengths = pc.utf8_length(texts).to_pylist()
                local = []
                for row, doc_id, n, text in zip(rows, ids, lengths, texts.cast(pa.binary()).to_pylist()):
                    content = text.translate(None, SPACES)
                    number = table.place(xxhash.xxh3_64_intdigest(content), content)
                    if number == len(first):
                        first.append(row)
                        count.append(1)
                        best.append((n, doc_id, row))
                    else:
                        count[number] += 1
                        best[number] = _better(best[number], (n, doc_id, row))
                    local.append(first[number])
                nothing = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1).cast(schema.field("doc_id").type), pa.array(lengths, pa.int64()), pa.array(local, pa.int64()),
                        nothing, nothing, nothing, pa.nulls(len(rows), pa.binary()),
                    ],
                    schema=schema,
                )
                if table.bytes > task_bytes:
                    yield from leaders()
                    table, first, count, best = Contents(), [], [], []
        yield from leaders()

    return run


def _joined(schema: pa.Schema):
    """Leaders in order of their bucket -> the class of each: the row that stays, its id, the rows, the content's SHA-256."""

    def classes(leaders: list, size: list, best: list, digests: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in leaders], pa.int64()), pa.array([best[x[1]][2] for x in leaders], pa.int64()),
                pa.array([best[x[1]][1] for x in leaders], schema.field("keep_id").type), pa.array([size[x[1]] for x in leaders], pa.int64()),
                pa.array([digests[x[1]] for x in leaders], pa.string()),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, table, leaders, size, best = None, Contents(), [], [], []
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH_ROWS):
                columns = [c.to_pylist() for c in batch.slice(begin, BATCH_ROWS).columns]
                for of, h, local, count, n, doc_id, row, content in zip(*columns):
                    if of != bucket:
                        if leaders:
                            yield classes(leaders, size, best, [hashlib.sha256(v).hexdigest() for v in table.values])
                        bucket, table, leaders, size, best = of, Contents(), [], [], []
                    number = table.place(h, content)
                    if number == len(size):
                        size.append(0)
                        best.append((n, doc_id, row))
                    size[number] += count
                    best[number] = _better(best[number], (n, doc_id, row))
                    leaders.append((local, number))
        if leaders:
            yield classes(leaders, size, best, [hashlib.sha256(v).hexdigest() for v in table.values])

    return run


def bucketed(leaders: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``leaders`` with ``bucket``, a prefix of the bits of ``h`` just long enough for ``bucket_bytes``.

    A bucket that is too large is dealt again by the next bits; its number begins with a 1 that tells prefixes of
    other lengths apart. One content alone can't be dealt and needs no more: a table holds it once.
    """

    def prefix(level: int):
        bits = BITS * (level + 1)
        return F.shiftrightunsigned("h", 64 - bits).bitwiseOR(F.lit(1 << bits).cast("bigint"))

    out = leaders.withColumn("bucket", prefix(0))
    for level in range(1, LEVELS):
        sizes = out.groupBy("bucket").agg(F.sum("n_bytes").alias("held"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        large = settled(sizes.where((F.col("held") > bucket_bytes) & (F.col("lo") != F.col("hi"))).select("bucket", F.lit(True).alias("large")))
        if large.isEmpty():
            break
        out = out.join(large, "bucket", "left").withColumn("bucket", F.when(F.col("large"), prefix(level)).otherwise(F.col("bucket"))).drop("large")
    return out


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """``doc_id, row, n_chars, keep_id, keep_row, group_size, kept, text_sha256`` for each row.

    Texts are equal if they are equal without blanks (space, tab, line feed, vertical tab, form feed, carriage
    return); a null text reads as empty, and all empty texts are equal. The row with the most code points stays, then
    the smallest id (null last), then the earlier of repeated rows, so one row of each group stays. Ids keep their
    type; other columns are not looked at. An empty table gives no rows.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return _duplicates(rows, bucket_bytes, task_bytes)


def _duplicates(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    kind = dict(rows.dtypes)["doc_id"]
    columns = f"row bigint, doc_id {kind}, n_chars bigint, local bigint, h bigint, n_bytes bigint, members bigint, content binary"
    found = stored(rows.mapInArrow(_members(_arrow(columns), task_bytes), columns))
    leaders = bucketed(found.where("content is not null"), bucket_bytes)
    dealt = leaders.select("bucket", "h", "local", "members", "n_chars", "doc_id", "row", "content").repartition("bucket")
    columns = f"local bigint, keep_row bigint, keep_id {kind}, group_size bigint, text_sha256 string"
    classes = dealt.sortWithinPartitions("bucket").mapInArrow(_joined(_arrow(columns)), columns)
    members = found.where("content is null").select("row", "doc_id", "n_chars", "local")
    return members.join(classes, "local").select(
        "doc_id", "row", "n_chars", "keep_id", "keep_row", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def _arrow(columns: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(columns))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay of each group of equal texts.

    The rows are numbered in a stored copy, whose record holds the input's columns, so no name can clash.
    """
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("record")))
    record = F.col("record")
    found = _duplicates(numbered.select("row", record[id_col].alias("doc_id"), record[text_col].cast("string").alias("text")))
    return numbered.join(found.where("kept").select("row"), "row", "left_semi").select("record.*")
