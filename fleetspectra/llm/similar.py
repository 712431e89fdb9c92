"""Near duplicates by the Jaccard similarity of their word shingles.

SimHash bits compared at the codewords of a covering code propose, MinHash bands add the pairs that differ in too many bits for
that, all bits of both rule out, the shingles decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspectra.llm.common import components, in_batches, in_few_parts, settled, sized_join, stored
from fleetspectra.llm.simhash import COVERING, LENGTH, Code, by_cell, in_cells, one_of_each, shingle_hashes

U = np.uint64
#: Numbers of 64 bits in a wide fingerprint.
LANES = 6
BITS = 64 * LANES
#: Blocks of a codeword's length, and bits that a pair may differ by in one of them to meet at a codeword in any case. With those that
#: meet by where the bits differ, 0.98 of pairs at a similarity of 0.8 do, 0.995 at 0.85 and 0.999 at 0.9.
BLOCKS, NEAR = 8, 1
#: A pair is a candidate too if all ROWS least hashes of one of BANDS bands are equal: 1 - (1 - 0.8 ** 5) ** 30 = 0.99999 at 0.8.
BANDS, ROWS = 30, 5
#: Candidates whose fingerprints differ by so many standard deviations more than expected at the wanted similarity are ruled out.
SLACK = 7.0
_ODD = (np.arange(1, LANES + 1, dtype=U) * U(0x9E3779B97F4A7C15))[None, :]
_SEEDS = np.random.default_rng(29).integers(0, 1 << 63, BANDS * ROWS).astype(U)[:, None]


def bits_at(similarity: float) -> int:
    """Differing bits up to which fingerprints may belong to sets of this Jaccard similarity or more.

    Sets of equal size that share a part ``s`` of their union have the cosine 2s / (1 + s), others a larger one; a bit
    differs with the angle's share of pi. Sets of a few shingles differ in more bits (at 0.8, four of five: 3/16 of them,
    4.6 standard deviations below the bound).
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(BITS * share + SLACK * math.sqrt(BITS * share * (1 - share)))


def wide_fingerprint(text: str | None, shingle: int = 5) -> np.ndarray:
    """LANES numbers of 64 bits; each different shingle counts once. All zero without words."""
    return _wide(shingles(text, shingle))


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The hashes of the different word shingles of a text, in order of their size."""
    return np.unique(shingle_hashes(text, shingle))


def _wide(hashes: np.ndarray) -> np.ndarray:
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 12):
        x = hashes[k : k + (1 << 12), None] + _ODD
        x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
        x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ x >> U(31)).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            ones += bits[j : j + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A number for each of BANDS bands: equal for two sets if all of the band's least hashes are (and else by chance)."""
    least = np.full(BANDS * ROWS, np.iinfo(U).max, U)
    for k in range(0, len(hashes), 1 << 9):
        x = (hashes[None, k : k + (1 << 9)] ^ _SEEDS) * U(0xBF58476D1CE4E5B9)
        x ^= x >> U(32)
        x *= U(0x94D049BB133111EB)
        least = np.minimum(least, x.min(1))
    rows = np.ascontiguousarray(least.reshape(BANDS, ROWS))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], U).view(np.int64)


def set_node(hashes: np.ndarray) -> int:
    """A number that stands for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 5)).view(np.int64))


def node_of(wide: np.ndarray) -> int:
    """A number that stands for a wide fingerprint."""
    return int(np.uint64(xxhash.xxh64_intdigest(wide.tobytes())).view(np.int64))


def _packed(wide: np.ndarray) -> pa.Array:
    data = pa.py_buffer(np.ascontiguousarray(wide, "<u8").tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * LANES), len(wide), [None, data]).cast(pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, LANES), U)
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2][int(edges[0]) : int(edges[-1])], "<u8").reshape(-1, LANES)


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``doc_id, fp, wide, bands`` of every document: the number of its set of shingles, its fingerprint and its bands' keys."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp, wide, bands = [], [], []
            for t in batch.column(1):
                hashes = shingles(t.as_py(), shingle)
                fp.append(set_node(hashes))
                wide.append(_wide(hashes))
                bands.append(band_keys(hashes))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fp, pa.int64()), _packed(np.array(wide, U).reshape(-1, LANES)), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "fp", "wide", "bands"],
            )

        return step

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(in_batches(make), "doc_id bigint, fp bigint, wide binary, bands array<bigint>")


def at_anchors(nodes: DataFrame) -> DataFrame:
    """``key, home, fp, wide``: each set of shingles, in each block of its fingerprint, at every codeword where a near one has its home.

    A block's nearest codeword is COVERING bits away at most, so blocks that differ in NEAR bits meet there.
    """

    def make():
        code = Code(COVERING + NEAR)
        place = 1 << np.arange(LENGTH)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            wide = _unpacked(batch.column(1))
            bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little") if len(wide) else np.zeros((0, BITS), np.uint8)
            keys, rows, homes = [], [], []
            for block in range(BLOCKS):
                row, anchor, home = code.anchors(bits[:, block * LENGTH : (block + 1) * LENGTH] @ place)
                keys.append(block << 12 | anchor)
                rows.append(row)
                homes.append(home)
            row = np.concatenate(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.concatenate(homes)), batch.column(0).take(pa.array(row)), _packed(wide[row])],
                ["key", "home", "fp", "wide"],
            )

        return step

    return nodes.select("fp", "wide").mapInArrow(in_batches(make), "key bigint, home boolean, fp bigint, wide binary")


def in_bands(nodes: DataFrame) -> DataFrame:
    """``key, home, fp, wide``: each set of shingles in each band that it shares with another set."""
    keyed = nodes.select("fp", F.explode("bands").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    rows = nodes.select("fp", "wide", F.explode("bands").alias("key"))
    return sized_join(rows, shared, ["key"], "left_semi").select("key", F.lit(True).alias("home"), "fp", "wide")


#: Pairs of a cell whose fingerprints are compared at once, so that a group of near copies takes no more memory than others.
PAIRS = 1 << 18


class _Parts:
    """Connected parts of the rows of one cell; equal ``fp`` are one member."""

    def __init__(self, cell: pa.Table):
        fp, self.home = cell["fp"].to_numpy(), cell["home"].to_numpy()
        self.names, self.first, self.place = np.unique(fp, return_index=True, return_inverse=True)
        self.label = np.arange(len(self.names))
        self.wide = np.concatenate([_unpacked(part) for part in cell["wide"].chunks])[self.first]

    def near(self, most: int) -> Iterator[tuple[int, np.ndarray]]:
        """A home member, and the members of other parts (as they are by then) whose fingerprints are near."""
        at_home = np.unique(self.place[self.home])
        if len(at_home) == len(self.names):
            after = np.arange(len(self.names))  # each pair once
        else:
            after = np.full(len(self.names), -1)
        other = np.ascontiguousarray(self.wide.T)
        step = max(1, PAIRS // len(self.names))
        for k in range(0, len(at_home), step):
            part = at_home[k : k + step]
            # Half of the bits rules out nearly every pair; the rest is counted for those that are left.
            half = sum(np.bitwise_count(self.wide[part, lane, None] ^ other[lane][None, :]).astype(np.uint16) for lane in range(LANES // 2))
            i, j = np.nonzero((half <= most) & (self.label[part][:, None] != self.label[None, :]))
            left = part[i]
            bits = sum(np.bitwise_count(lane[left] ^ lane[j]).astype(np.uint16) for lane in other)
            good = (j > after[left]) & (bits <= most)
            i, j = i[good], j[good]
            cuts = np.flatnonzero(np.diff(i)) + 1
            for a, b in zip(np.split(i, cuts), np.split(j, cuts), strict=True):
                if len(a):
                    one = int(part[a[0]])
                    b = b[self.label[b] != self.label[one]]
                    if len(b):
                        yield one, b

    def join(self, one: int, others: np.ndarray) -> None:
        found = np.unique(self.label[np.append(others, one)])
        if len(found) > 1:
            self.label[np.isin(self.label, found)] = found[0]

    def star(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, its part's first member) of all members that are not first."""
        moved = np.flatnonzero(self.label != np.arange(len(self.names)))
        return self.names[moved], self.names[self.label[moved]]


def links(nodes: DataFrame, similarity: float = 0.8, cell_rows: int = 16_384) -> DataFrame:
    """Links ``a, b`` between sets that may have ``similarity`` or more, or chains of such links.

    ``nodes`` are ``fp, wide, bands``, each set once. Pairs meet at a codeword or share a band, and their fingerprints are not too far apart.
    """
    return linked(at_anchors(nodes), similarity, cell_rows).unionByName(linked(in_bands(nodes), similarity, cell_rows))


def linked(rows: DataFrame, similarity: float, cell_rows: int) -> DataFrame:
    """Links ``a, b`` between sets (``key, home, fp, wide``) of the same ``key`` whose fingerprints are not too far apart, or chains of such links."""
    most = bits_at(similarity)

    def stars(cell: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        parts = _Parts(cell)
        for one, others in parts.near(most):
            parts.join(one, others)
        yield parts.star()

    return in_cells(rows, cell_rows).mapInArrow(by_cell(stars), "a bigint, b bigint")


def _common(one: np.ndarray, values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many of the sorted ``one`` each set between ``edges`` of ``values`` holds."""
    at = np.searchsorted(one, values)
    total = np.concatenate([[0], np.cumsum(one[np.minimum(at, len(one) - 1)] == values)])
    return total[edges[1:]] - total[edges[:-1]]


def verified_links(sets: DataFrame, similarity: float, cell_rows: int) -> DataFrame:
    """Links ``a, b`` between sets whose Jaccard similarity is ``similarity`` or more, or chains of such links.

    ``sets`` are ``key, home, fp, wide, hashes`` (sorted 64-bit numbers), pairs have the same ``key``. Only a pair that is
    not yet connected is compared, so members of a large group of copies are compared about once a cell.
    """
    most = bits_at(similarity)

    def stars(cell: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        parts = _Parts(cell)
        hashes = cell["hashes"].take(pa.array(parts.first))
        hashes = [np.frombuffer(x.as_py(), "<u8") for x in hashes]
        size = np.array([len(x) for x in hashes])
        for one, others in parts.near(most):
            low, high = np.minimum(size[one], size[others]), np.maximum(size[one], size[others])
            others = others[low >= similarity * high - 1e-9]
            while len(others):
                part = others[:64]
                edges = np.concatenate([[0], np.cumsum(size[part])])
                common = _common(hashes[one], np.concatenate([hashes[x] for x in part]), edges) if size[one] else np.zeros(len(part), np.int64)
                alike = common >= similarity * (size[one] + size[part] - common) - 1e-9
                parts.join(one, part[alike])
                others = others[64:]
                others = others[parts.label[others] != parts.label[one]]
        yield parts.star()

    return in_cells(sets, cell_rows).mapInArrow(by_cell(stars), "a bigint, b bigint")


def _sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``key, home, fp, wide, hashes`` of ``members`` (``fp, first_id, wide, key``): the shingles of the texts they stand for."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes = [shingles(t.as_py(), shingle) for t in batch.column(0)]
            return pa.RecordBatch.from_arrays(
                [pa.array([set_node(x) for x in hashes], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in hashes], pa.binary())], ["fp", "hashes"]
            )

        return step

    # A null id has a hash too; what only shares the id of a wanted text falls out by its number.
    wanted = stored(in_few_parts(members.select(F.xxhash64("first_id").alias("id")).distinct(), members.count()))
    texts = docs.select(F.xxhash64(F.col(id_col).cast("bigint")).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = sized_join(texts, wanted, ["id"], "left_semi").select("text").mapInArrow(in_batches(make), "fp bigint, hashes binary")
    once = found.join(members.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.min("hashes").alias("hashes"))
    return once.join(members, "fp").select("key", F.lit(True).alias("home"), "fp", "wide", "hashes")


#: Sets of shingles that a cell holds to compare them exactly, as a share of the fingerprints that a cell holds.
SET_SHARE = 16


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``doc_id, fp, label`` for each row: the number of its set of shingles, and the component that it is linked to.

    Words are lower-cased (A-Z); a text of fewer words than a shingle is one shingle. Sets link if their exact Jaccard
    similarity (of 64-bit hashes) is ``similarity`` or more; a pair at 0.8 is compared with probability 0.99999 or more, a closer
    one with more. Null texts and texts without words are alike; repeated rows stay. No documents: no rows.
    """
    prints = stored(wide_fingerprints(docs, id_col, text_col, shingle))
    n = prints.count()
    one = F.min(F.struct("wide", "bands")).alias("m")
    nodes = prints.groupBy("fp").agg(one, F.min("doc_id").alias("first_id")).select("fp", "first_id", "m.wide", "m.bands")
    nodes = stored(in_few_parts(nodes, n))
    cell_rows = links.__defaults__[1]
    maybe = components(links(nodes.select("fp", "wide", "bands"), similarity, cell_rows))
    members = nodes.join(maybe, F.col("fp") == F.col("node")).select("fp", "first_id", "wide", F.col("label").alias("key"))
    members = stored(in_few_parts(members, n))
    sets = stored(in_few_parts(_sets(docs, members, id_col, text_col, shingle), members.count()))
    parts = components(verified_links(sets, similarity, max(2, cell_rows // SET_SHARE)))
    named = nodes.select("fp").join(parts, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("label", "fp").alias("label"))
    named = settled(in_few_parts(named, n))
    return prints.select("doc_id", "fp").join(named, "fp").select("doc_id", "fp", "label")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of similar documents, as ``one_of_each`` chooses it."""
    groups = similar_documents(docs, id_col, text_col, shingle, similarity)
    return one_of_each(docs, groups, lambda text: set_node(shingles(text, shingle)), id_col, text_col)
