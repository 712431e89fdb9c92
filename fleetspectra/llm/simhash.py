"""Near-duplicate detection: SimHash fingerprints compared at the codewords of a covering code."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspectra.llm.common import components, in_batches, settled

U = np.uint64
# Generator polynomial of the perfect binary Golay code (23 bits, 12 of data), which covers
# every 23-bit word within 3 bits; the blocks of a 64-bit fingerprint (first bit, bits).
GENERATOR, LENGTH, COVERING = 0b110001110101, 23, 3
BLOCKS = ((0, 22), (22, 21), (43, 21))


def _remainder(x: int) -> int:
    for k in range(LENGTH - 1, 10, -1):
        if x >> k & 1:
            x ^= GENERATOR << (k - 11)
    return x


class Code:
    """All codewords within ``reach`` bits of a word, by its syndrome."""

    def __init__(self, reach: int):
        words = [0]
        patterns = [0]
        for _ in range(reach):
            words = sorted({w | 1 << k for w in words for k in range(LENGTH) if not w >> k & 1})
            patterns += words
        flips = np.array(patterns, np.int64)
        single = np.array([_remainder(1 << k) for k in range(LENGTH)], np.int64)
        bits = np.arange(256)[:, None] >> np.arange(8) & 1
        self.by_byte = [
            np.bitwise_xor.reduce(np.where(bits[:, : len(part)] == 1, part, 0), axis=1)
            for part in (single[:8], single[8:16], single[16:])
        ]
        syndrome = self.syndrome(flips)
        order = np.argsort(syndrome, kind="stable")
        self.flips = flips[order]
        self.home = np.bitwise_count(self.flips.astype(np.uint64)) <= COVERING
        self.first = np.searchsorted(syndrome[order], np.arange((1 << 11) + 1))

    def syndrome(self, word: np.ndarray) -> np.ndarray:
        a, b, c = self.by_byte
        return a[word & 255] ^ b[word >> 8 & 255] ^ c[word >> 16 & 255]

    def anchors(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, codeword number and whether it is the row's nearest, for each codeword in reach."""
        s = self.syndrome(word)
        count = self.first[s + 1] - self.first[s]
        row = np.repeat(np.arange(len(word)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + self.first[s][row]
        return row, (word[row] ^ self.flips[at]) >> 11, self.home[at]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle of a whole text in lower case, in order; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        starts, ends = [0], [sum(map(len, words)) + len(words) - 1]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        edges = np.concatenate([[0], np.cumsum(lengths)])
        starts, ends = edges[: len(words) - shingle + 1].tolist(), (edges[shingle:] - 1).tolist()
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, ends, strict=True)], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of the word shingles of a whole text; each shingle counts as often as it occurs. Zero without words."""
    hashes = shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a bigint) of every document; a text without words has fingerprint zero."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"]
            )

        return step

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(in_batches(make), "doc_id bigint, fp bigint")


def _pieces(n: int, fp: np.ndarray, block: int, rest: int) -> list[np.ndarray]:
    """The bits outside ``block`` cut into ``n`` pieces, as numbers."""
    first, width = BLOCKS[block]
    low = fp & U((1 << first) - 1)
    others = low | (fp >> U(first + width)) << U(first) if first + width < 64 else low
    cuts = [rest * k // n for k in range(n + 1)]
    return [(others >> U(a) & U((1 << b - a) - 1)).astype(np.int64) for a, b in zip(cuts, cuts[1:], strict=False)]


def at_anchors(prints: DataFrame, max_bits: int = 4, finer: bool = False) -> DataFrame:
    """``key, fp, home``: each fingerprint at every anchor where a near one can be.

    Of three blocks, one differs in at most ``max_bits // 3`` bits. In it a fingerprint has one nearest
    codeword, at most 3 bits away (its home); near fingerprints are within 3 + ``max_bits // 3`` of that
    codeword, so they meet there. ``finer`` cuts the other bits into ``max_bits + 1`` pieces of which a near
    pair has one equal, and makes piece and anchor together the key: more copies, far smaller groups.
    """
    reach = COVERING + max_bits // len(BLOCKS)

    def make():
        code = Code(reach)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, prints_, homes = [], [], []
            for block, (first, width) in enumerate(BLOCKS):
                word = (fp >> U(first) & U((1 << width) - 1)).astype(np.int64)
                row, anchor, home = code.anchors(word)
                key = block << 12 | anchor
                if finer:
                    for k, piece in enumerate(_pieces(max_bits + 1, fp, block, 64 - width)):
                        keys.append((key * (max_bits + 1) + k) << 32 | piece[row])
                        prints_.append(fp[row])
                        homes.append(home)
                else:
                    keys.append(key)
                    prints_.append(fp[row])
                    homes.append(home)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.concatenate(prints_).view(np.int64)), pa.array(np.concatenate(homes))],
                ["key", "fp", "home"],
            )

        return step

    return prints.select("fp").mapInArrow(in_batches(make), "key bigint, fp bigint, home boolean")


def _cell_links(home: np.ndarray, there: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each connected part of one cell: (member, smallest member)."""
    nodes, place = np.unique(np.concatenate([home, there]), return_inverse=True)
    at_home, at_there = place[: len(home)], place[len(home) :]
    label = np.arange(len(nodes))
    step = max(1, (1 << 20) // max(1, len(there)))
    for k in range(0, len(home), step):
        near = np.bitwise_count(home[k : k + step, None] ^ there[None, :]) <= max_bits
        for i in np.flatnonzero(near.sum(1) > 1):
            found = np.unique(label[np.append(at_there[near[i]], at_home[k + i])])
            if len(found) > 1:
                label[np.isin(label, found)] = found[0]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def by_cell(links_of: Callable[[pa.Table], Iterator[tuple[np.ndarray, np.ndarray]]]) -> Callable:
    """A function for ``mapInArrow`` over the sorted rows of ``in_cells``: the links of each cell, one cell held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell = pa.Table.from_batches(parts)
            if len(cell) > 1 and pc.any(cell["home"]).as_py():
                for a, b in links_of(cell):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            edges = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for first, end in zip(edges, edges[1:], strict=False):
                if last is not None and (last != at[:, first]).any():
                    yield from found(held)
                    held = []
                held.append(batch.slice(first, end - first))
                last = at[:, first]
        if held:
            yield from found(held)

    return run


#: Partitions of the table of full anchors.
FULL_PARTS = 4


def in_cells(rows: DataFrame, cell_rows: int) -> DataFrame:
    """``key, x, y, home`` and the other columns of ``rows`` (``key, home`` and any others), a cell's rows together.

    A cell's home rows are to be compared with all of its rows. An anchor is one cell unless it is full: then it is cut
    into cells of about ``cell_rows`` home rows by ``cell_rows`` others, and each row goes to the cells of its stripe,
    once as a home row and once as an other, so every pair still meets and no task gets a whole hot anchor. An anchor
    is one of some ten thousand keys (more where keys are finer), so the table of the full ones is small.
    """
    more = [c for c in rows.columns if c not in ("key", "home")]
    full = settled(
        rows.groupBy("key")
        .agg(F.sum(F.col("home").cast("int")).alias("homes"), F.count("*").alias("all"))
        .where(F.col("all") > cell_rows)
        .select(
            "key", F.greatest(F.lit(1), F.ceil(F.col("homes") / cell_rows)).cast("int").alias("gh"),
            F.ceil(F.col("all") / cell_rows).cast("int").alias("ga"),
        )
        .repartition(FULL_PARTS)
    )
    one = (F.lit(0).alias("x"), F.lit(0).alias("y"), "home", *more)
    if full.isEmpty():
        cells = rows.select("key", *one)
    else:
        rows = rows.join(full, "key", "left")
        stripe, whole = F.xxhash64(*more, F.lit(7)), F.col("gh").isNull()
        at_home = rows.where(~whole & F.col("home")).select(
            "key", F.pmod(stripe, "gh").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ga") - 1)).alias("y"), "home", *more
        )
        others = rows.where(~whole).select(
            "key", F.explode(F.sequence(F.lit(0), F.col("gh") - 1)).alias("x"), F.pmod(stripe, "ga").cast("int").alias("y"),
            F.lit(False).alias("home"), *more,
        )
        cells = rows.where(whole).select("key", *one).union(at_home).union(others)
    return cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def links(prints: DataFrame, max_bits: int = 4, cell_rows: int = 16_384, finer: bool = False) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints of at most ``max_bits`` differing bits, or chains of such links."""

    def star(cell: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fp, home = cell["fp"].to_numpy().view(np.uint64), cell["home"].to_numpy()
        yield _cell_links(fp[home], fp, max_bits)

    return in_cells(at_anchors(prints, max_bits, finer), cell_rows).mapInArrow(by_cell(star), "a bigint, b bigint")


#: From so many distinct fingerprints on, anchors are made finer; the links are the same.
FINER_FROM = 4_000_000


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, finer: bool | None = None
) -> DataFrame:
    """``doc_id, fp, component_id, label`` for each row: its fingerprint, and the smallest id it can reach over links.

    Equal fingerprints link too and go through the search once; ``label`` names the component by one of its
    fingerprints. A null text reads as empty (fingerprint zero); a null id is a component's id only where it
    has no other; repeated rows stay. No documents: no rows.
    """
    prints = settled(fingerprints(docs, id_col, text_col, shingle))
    nodes = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    if finer is None:
        finer = nodes.count() > FINER_FROM
    parts = components(links(nodes, max_bits, finer=finer))
    labelled = nodes.join(parts, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("label")
    )
    ids = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = settled(labelled.join(ids, "label").select("fp", "component_id", "label"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", "label")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of each group of near duplicates, as ``one_of_each`` chooses it."""
    groups = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    return one_of_each(docs, groups, lambda text: int(np.uint64(fingerprint(text, shingle)).view(np.int64)), id_col, text_col)


def one_of_each(docs: DataFrame, groups: DataFrame, print_of: Callable[[str | None], int], id_col: str, text_col: str) -> DataFrame:
    """One row of each ``label`` of ``groups`` (``doc_id, fp, label``): the smallest id's, a null id last.

    Rows that share id and fingerprint (``print_of`` a text) count as one and the smallest text stays. All
    columns are kept.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("m")
    chosen = groups.groupBy("label").agg(first).select("m.doc_id", "m.fp")
    doubled = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if doubled.isEmpty():
        gone = groups.select("doc_id").join(chosen.select("doc_id"), "doc_id", "left_anti")
        return docs.join(gone, docs[id_col].cast("bigint") == gone["doc_id"], "left_anti")
    return _keep_by_print(docs, settled(chosen), print_of, id_col, text_col)


def _keep_by_print(docs: DataFrame, chosen: DataFrame, print_of: Callable[[str | None], int], id_col: str, text_col: str) -> DataFrame:
    """The chosen rows where ids are not unique: by id and fingerprint, then one of those with both equal."""
    packed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                         F.struct(text_col, *[c for c in docs.columns if c != text_col]).alias("row"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = pa.array([print_of(t.as_py()) for t in batch.column(1)], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), values, batch.column(2)], ["doc_id", "fp", "row"])

        return step

    kind = packed.schema["row"].dataType.simpleString()
    marked = packed.mapInArrow(in_batches(make), f"doc_id bigint, fp bigint, row {kind}")
    same = marked["doc_id"].eqNullSafe(chosen["doc_id"]) & (marked["fp"] == chosen["fp"])
    one = marked.join(chosen, same, "left_semi").groupBy("doc_id", "fp").agg(F.min("row").alias("row"))
    return one.select("row.*").select(*docs.columns)
