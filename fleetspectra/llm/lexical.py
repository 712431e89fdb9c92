"""Ranked lexical search: the best documents of each item, by range maxima over posting lists.

A task puts its documents, in order of their ids, into segments of a bounded number of postings. Every posting list of
a segment has a sparse table of range maxima. An item's search starts with all of the segment's documents as one
interval; the sum of the lists' maxima over an interval bounds every score in it. The intervals with the highest bounds
are split at the document that holds their greatest single term score, which is scored by itself; short intervals are
scored outright. What cannot reach the task's current k-th best score (ties by id included) is left out. Tasks hand on
k rows an item, which are ranked in two steps. No posting is shuffled, so frequent words make no hot key.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspectra.llm.common import BATCH_ROWS, in_batches, stored

#: The term score tf / (tf + 2 * m / 100) in whole numbers, with half of the length's share in m.
SCALE, ONE, TERM = 1000, 1_000_000_000, 20
BEST = 50
#: Postings of a segment: its lists and tables take about 80 bytes for each.
SEGMENT_POSTINGS = 1 << 20
#: Intervals with so few postings of the item are scored outright; so many intervals are taken up at once.
LEAF_POSTINGS, AT_ONCE = 512, 32
#: Items are searched in blocks whose different terms are no more than this.
BLOCK_TERMS = 200_000
#: Hand-overs of the tasks are ranked within so many parts first.
PARTS = 256

#: Letters and digits in lower case, all bytes of other characters as they are, the rest blank.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Segment:
    """Posting lists of some documents: ``docs`` and ``impacts`` end to end, list ``t`` from ``edges[t]`` to ``edges[t + 1]``."""

    def __init__(self, n_docs: int, n_terms: int, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray):
        order = np.lexsort((docs, terms))
        self.n_docs, self.docs, self.impacts = n_docs, docs[order], impacts[order]
        self.edges = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.keys = terms[order] * n_docs + self.docs
        # tables[j][i]: place of the greatest impact among the 2**j from i on; lists lie end to end and no query crosses them.
        longest = int(np.diff(self.edges).max(initial=0))
        self.tables = [np.arange(len(docs), dtype=np.int32)]
        for j in range(1, longest.bit_length()):
            last, half = self.tables[-1], 1 << (j - 1)
            a, b = last[: len(last) - half], last[half:]
            self.tables.append(np.where(self.impacts[a] >= self.impacts[b], a, b))
        size = max((len(t) for t in self.tables), default=0)
        self.flat = np.zeros((len(self.tables), size), np.int32)
        for j, table in enumerate(self.tables):
            self.flat[j, : len(table)] = table
        self.tables = None

    def greatest(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Impact and place of the greatest posting of each range; 0 and -1 for empty ones."""
        size = hi - lo
        full = size > 0
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        start = np.where(full, lo, 0)
        a = self.flat[level, start]
        b = self.flat[level, np.where(full, hi - (1 << level), 0)]
        at = np.where(self.impacts[a] >= self.impacts[b], a, b)
        return np.where(full, self.impacts[at], 0), np.where(full, at, -1)

    def search(self, terms: np.ndarray, best: Best, leaf: int = LEAF_POSTINGS) -> None:
        """Put every document of this segment that belongs to the item's best into ``best``."""
        terms = terms[self.edges[terms + 1] > self.edges[terms]]
        if not len(terms) or not self.n_docs:
            return
        a, lo, hi = np.zeros(1, np.int64), self.edges[terms][None, :], self.edges[terms + 1][None, :]
        value, place = self.greatest(lo, hi)
        bound = value.sum(1)
        while len(bound):
            alive = (bound > best.floor) | (bound == best.floor) & (a < best.first_after)
            alive &= bound > 0
            if not alive.all():
                a, lo, hi, value, place, bound = (x[alive] for x in (a, lo, hi, value, place, bound))
                if not len(bound):
                    return
            take = np.argpartition(-bound, AT_ONCE - 1)[:AT_ONCE] if len(bound) > AT_ONCE else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[take] = False
            short = (hi[take] - lo[take]).sum(1) <= leaf
            leaves, split = take[short], take[~short]
            if len(leaves):
                best.add(*self._outright(lo[leaves], hi[leaves]))
            kept = [(x[rest]) for x in (a, lo, hi, value, place, bound)]
            if len(split):
                column = value[split].argmax(1)
                doc = self.docs[place[split, column]].astype(np.int64)
                # Where the document stands, or would stand, in each list.
                key = terms[None, :] * self.n_docs + doc[:, None]
                at = np.searchsorted(self.keys, key)
                there = (at < hi[split]) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key)
                best.add(doc, np.where(there, self.impacts[np.minimum(at, len(self.impacts) - 1)], 0).sum(1))
                new_a = np.concatenate([a[split], doc + 1])
                new_lo = np.concatenate([lo[split], at + there])
                new_hi = np.concatenate([at, hi[split]])
                new_value, new_place = self.greatest(new_lo, new_hi)
                new = (new_a, new_lo, new_hi, new_value, new_place, new_value.sum(1))
                kept = [np.concatenate(pair) for pair in zip(kept, new)]
            a, lo, hi, value, place, bound = kept

    def _outright(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All documents of some disjoint intervals and their scores."""
        lo, size = lo.ravel(), (hi - lo).ravel()
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        doc, number = np.unique(self.docs[at], return_inverse=True)
        score = np.zeros(len(doc), np.int64)
        np.add.at(score, number, self.impacts[at])
        return doc.astype(np.int64), score


class Best:
    """The k best documents of an item so far, over all segments of a task."""

    def __init__(self, k: int):
        self.k, self.rows, self.floor, self.first_after, self.keys = k, [], 0, 0, []

    def enter(self, keys: list[tuple]) -> None:
        """Go on to a segment whose documents have these keys, in ascending order."""
        self.keys = keys
        self._bounds()

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        good = (scores > self.floor) | (scores == self.floor) & (docs < self.first_after)
        good &= scores > 0
        if not good.any():
            return
        self.rows += [(-s, self.keys[d]) for d, s in zip(docs[good].tolist(), scores[good].tolist())]
        if len(self.rows) > self.k:
            self.rows.sort()
            del self.rows[self.k :]
        self._bounds()

    def _bounds(self) -> None:
        """A document needs the floor, and at the floor a place before ``first_after``."""
        if len(self.rows) < self.k:
            self.floor, self.first_after = 0, 0
        else:
            self.rows.sort()
            score, key = self.rows[-1]
            self.floor, self.first_after = -score, bisect.bisect_left(self.keys, key)


def _counted(docs: DataFrame, vocabulary) -> DataFrame:
    """``row, doc_id, n, terms, times`` of each document with a term; of the terms only those that items hold."""

    def make():
        number = vocabulary.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, edges, terms, times = [], [0], [], []
            for text in pc.fill_null(batch.column(2), "").cast(pa.binary()).to_pylist():
                words = terms_of(text)
                n.append(len(words))
                for word, count in Counter(words).items():
                    at = number.get(word)
                    if at is not None:
                        terms.append(at)
                        times.append(count)
                edges.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x, pa.int32())) for x in (terms, times)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *lists], ["row", "doc_id", "n", "terms", "times"])
            return out.filter(pc.greater(out.column(2), 0))

        return step

    schema = f"row bigint, doc_id {dict(docs.dtypes)['doc_id']}, n bigint, terms array<int>, times array<int>"
    return docs.mapInArrow(in_batches(make), schema)


def _found(counted: DataFrame, sent, k: int, segment_postings: int, leaf: int) -> DataFrame:
    """Each task's best ``item, doc_id, row, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, n_docs, n_terms = sent.value
        best = [Best(k) for _ in items]
        held, size, kind = [], 0, None

        def segment() -> None:
            table = pa.Table.from_batches(held)
            table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("row", "ascending")]))
            ids, rows = table.column("doc_id").to_pylist(), table.column("row").to_pylist()
            keys = [(i is None, 0 if i is None else i, r) for i, r in zip(ids, rows)]
            lists = table.column("terms").combine_chunks()
            term = np.asarray(lists.flatten()).astype(np.int64)
            times = np.asarray(table.column("times").combine_chunks().flatten()).astype(np.int64)
            length = np.asarray(table.column("n")).astype(np.int64)
            doc = np.repeat(np.arange(len(keys)), np.diff(np.asarray(lists.offsets)))
            m = 100 - 50 + 50 * length * n_docs // n_terms
            impact = weight[term] * (ONE * times // (SCALE * times + TERM * m[doc]))
            index = Segment(len(keys), len(weight), term, doc, impact)
            for terms, top in zip(items, best):
                top.enter(keys)
                index.search(terms, top, leaf)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                part = part.filter(pc.greater(pc.list_value_length(part.column("terms")), 0))
                if part.num_rows:
                    held.append(part)
                    size += len(part.column("terms").flatten())
                if size >= segment_postings:
                    segment()
                    held, size = [], 0
        if held:
            segment()
        out = [(n, key, -s) for n, top in enumerate(best) for s, key in top.rows]
        if out:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], pa.int32()), pa.array([None if x[1][0] else x[1][1] for x in out], kind),
                    pa.array([x[1][2] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()),
                ],
                ["item", "doc_id", "row", "score"],
            )

    return counted.mapInArrow(run, f"item int, doc_id {dict(counted.dtypes)['doc_id']}, row bigint, score bigint")


def _blocks(items: list[Row], limit: int) -> Iterator[tuple[list[Row], dict[bytes, int]]]:
    """Items whose different terms are at most ``limit`` (one item may have more), and the terms' numbers."""
    block, vocabulary = [], {}
    for item in items:
        new = set(item["terms"]) - vocabulary.keys()
        if block and len(vocabulary) + len(new) > limit:
            yield block, vocabulary
            block, vocabulary, new = [], {}, set(item["terms"])
        for term in sorted(new):
            vocabulary[term] = len(vocabulary)
        block.append(item)
    if block:
        yield block, vocabulary


def search(
    docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", block_terms: int = BLOCK_TERMS, segment_postings: int = SEGMENT_POSTINGS, leaf: int = LEAF_POSTINGS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents by whole-number BM25-like scores.

    The items are the query set; their texts are held by the driver, and searched in blocks of ``block_terms``
    different terms, each of which reads all documents. A null text has no terms; items without terms and documents
    without any of an item's terms give no rows. Equal scores are ranked by id (null last), then repeated rows by
    their place; a repeated item is answered each time. Ids keep their type; other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = []
    for r in items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text")).toLocalIterator():
        asked.append(Row(item_id=r["item_id"], terms=sorted(set(terms_of((r["text"] or "").encode())))))
    answers = None
    for block, vocabulary in _blocks(asked, block_terms):
        counted = stored(_counted(rows, spark.sparkContext.broadcast(vocabulary)))
        n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
        holds = np.zeros(len(vocabulary), np.int64)
        for term, held in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # block_terms rows at most
            holds[term] = held
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in holds], np.int64)
        terms = [np.array([vocabulary[t] for t in item["terms"]], np.int64) for item in block]
        sent = spark.sparkContext.broadcast((terms, weight, n_docs, n_terms))
        found = _found(counted, sent, k, segment_postings, leaf)
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), "row"]
        part = F.pmod(F.shiftright("row", 33), F.lit(PARTS))
        found = found.withColumn("at", F.row_number().over(W.partitionBy("item", part).orderBy(*order))).where(F.col("at") <= k)
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, item["item_id"]) for n, item in enumerate(block)], f"item int, item_id {dict(items.dtypes)[item_col]}")
        answer = found.join(names, "item").select("item_id", "rank", "doc_id", "score")
        answers = answer if answers is None else answers.unionByName(answer)
    if answers is None:
        kinds = dict(items.dtypes)[item_col], dict(rows.dtypes)["doc_id"]
        return spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score bigint")
    return answers
