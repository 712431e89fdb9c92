"""Benchmark decontamination: retrieval of passages by latent semantics and by rare words, then common subsequences and answer checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspectra.llm.common import in_batches
from fleetspectra.llm.textvec import LOWER, U, Texts, chunks, distinct

#: Words in a corpus passage, and how far the next search window begins; bits of the hashed vocabulary.
PASSAGE, STRIDE, BITS = 32, 8, 14
#: Benchmark texts are cut into pieces of at most PIECE words; shorter than LEAST words they name nothing and never match.
PIECE, LEAST = 48, 5
#: Latent dimensions, and more random directions than that while searching for them.
RANK, SPARE, SEED = 64, 16, 23
#: A window and a piece are compared if their cosine is at least COSINE and half of their words are shared.
COSINE, SHARED = 0.45, 0.5
#: Pieces of fewer words than this are looked for within twice their length, others within a window and their length around it.
SHORT = 16
#: Leaked: so much of the piece in order; or so much, and so much of its answer in order.
COPY, PARAPHRASE, ANSWER = 0.7, 0.5, 0.8
#: Benchmark pieces handled at once; a larger benchmark is searched block by block.
BLOCK = 4_000

# Letters in lower case; ASCII punctuation reads as space.
PLAIN = LOWER.copy()
PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32
_PLAIN = PLAIN.tobytes()


def word_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word, without case and punctuation."""
    plain = Texts(np.frombuffer(texts.data.tobytes().translate(_PLAIN), np.uint8), texts.edges)
    start, end, doc = plain.words()
    at, hashes, _ = distinct(plain.data, start, end)
    return hashes[at], doc


def hashed(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(Texts(data, np.array([0, len(data)])))[0]


def place_in_document(doc: np.ndarray) -> np.ndarray:
    """The number of each word in its document."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    return np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))


def common_subsequence(piece: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of the piece (bit-parallel)."""
    return in_order(places(piece), len(piece), region)


def places(piece: list[int]) -> dict[int, int]:
    """Where each word of a piece stands in it, a bit a word."""
    where: dict[int, int] = {}
    for k, w in enumerate(piece):
        where[w] = where.get(w, 0) | 1 << k
    return where


def in_order(where: dict[int, int], size: int, region: list[int]) -> int:
    """``common_subsequence`` of a region with the piece of ``size`` words that stand at ``where``."""
    full = (1 << size) - 1
    state = full
    for w in region:
        if w in where:
            m = state & where[w]
            state = ((state + m) | (state - m)) & full
    return size - state.bit_count()


@dataclass
class Pieces:
    """Benchmark pieces: the item of each, its words' hashes, which words its answer is, and the vocabulary's mask."""

    items: list
    words: list[np.ndarray]
    answers: list[np.ndarray]

    @property
    def features(self) -> list[np.ndarray]:
        return [(w >> U(64 - BITS)).astype(np.int64) for w in self.words]

    @property
    def vocabulary(self) -> np.ndarray:
        known = np.zeros(1 << BITS, bool)
        for f in self.features:
            known[f] = True
        return known


def pieces_of(rows: list) -> Pieces:
    """Cut (item, text, answer) rows; without an answer the last third of a piece stands for it."""
    items, words, answers = [], [], []
    for item, text, answer in rows:
        all_words = hashed(text or "")
        wanted = hashed(answer or "")
        if len(all_words) < LEAST:
            continue
        step = PIECE // 2
        starts = range(0, max(1, len(all_words) - step), step) if len(all_words) > PIECE else [0]
        for a in starts:
            part = all_words[a : a + PIECE]
            items.append(item)
            words.append(part)
            answers.append(wanted if len(wanted) else part[-max(2, len(part) // 3) :])
    return Pieces(items, words, answers)


def _passages(texts: Texts, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Passage, feature and count of the known words, each pair once, by passage; and the number of passages."""
    word, doc = word_hashes(texts)
    passage = np.cumsum(place_in_document(doc) % PASSAGE == 0) - 1
    feature = (word >> U(64 - BITS)).astype(np.int64)
    use = known[feature]
    pair, count = np.unique(passage[use] << BITS | feature[use], return_counts=True)
    return pair >> BITS, pair & ((1 << BITS) - 1), count, int(passage[-1]) + 1 if len(passage) else 0


def passage_frequencies(texts_of: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many passages each feature stands, over all documents, and the number of passages."""

    def run(batches):
        total, passages = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for _, _, texts in chunks(batch.column(0)):
                _, feature, _, n = _passages(texts, known)
                total += np.bincount(feature, minlength=1 << BITS)
                passages += n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found, -1)), pa.array(np.append(total[found], passages))], ["feature", "n"]
        )

    counted = texts_of.select("text").mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    total, passages = np.zeros(1 << BITS), 0
    for feature, n in counted.collect():  # a row per feature: 2**BITS at most
        if feature < 0:
            passages = n
        else:
            total[feature] = n
    return total, passages


def inverse_frequency(total: np.ndarray, passages: int) -> np.ndarray:
    return np.log((passages + 1.0) / (total + 1.0)) + 0.1


#: Features of a chunk that more passages hold than this are added up by a product each.
OFTEN = 16


def _add_by_feature(total: np.ndarray, feature: np.ndarray, row: np.ndarray, weight: np.ndarray, seen: np.ndarray) -> None:
    """Add ``weight * seen[row]`` to the row of ``total`` of each feature."""
    order = np.argsort(feature.astype(np.uint16), kind="stable")
    feature, row, weight = feature.take(order), row.take(order), weight.take(order)
    first = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]]))
    count = np.diff(np.append(first, len(feature)))
    often = count > OFTEN
    for f, a, b in zip(*(x[often].tolist() for x in (feature[first], first, first + count)), strict=True):
        total[f] += weight[a:b] @ seen.take(row[a:b], 0)
    rest = np.repeat(~often, count)
    if rest.any():
        feature, row, weight = feature[rest], row[rest], weight[rest]
        first = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]]))
        part = seen.take(row, 0)
        part *= weight[:, None]
        total[feature[first]] += np.add.reduceat(part, first, axis=0)


def sketch(texts_of: DataFrame, known: np.ndarray, idf: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """AᵀAΩ for the matrix A of all passages (rows of length 1): each task adds up its own, Spark adds up the tasks."""
    width = directions.shape[1]
    names = [f"c{k}" for k in range(width)]

    def run(batches):
        total = np.zeros((1 << BITS, width), np.float32)
        for batch in batches:
            for _, _, texts in chunks(batch.column(0)):
                passage, feature, count, n = _passages(texts, known)
                if not len(passage):
                    continue
                weight = (count * idf[feature]).astype(np.float32)
                length = np.sqrt(np.bincount(passage, weight * weight, n))[passage]
                weight /= length.astype(np.float32)
                starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
                size = np.diff(np.append(starts, len(passage)))
                seen, place = np.zeros((len(starts), width), np.float32), np.empty(len(starts), np.int64)
                order = np.argsort(-size, kind="stable")
                place[order] = np.arange(len(starts))
                at, longer = starts[order], len(size) - np.cumsum(np.bincount(size))
                for k in range(int(size.max())):  # the k-th known word of each passage that has so many
                    n = int(longer[k])
                    row = directions.take(feature[at[:n]], 0)
                    row *= weight[at[:n], None]
                    seen[:n] += row
                    at[:n] += 1
                row = np.repeat(place, size)
                _add_by_feature(total, feature, row, weight, seen)
        found = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(found), *(pa.array(total[found, k].astype(np.float64)) for k in range(width))], ["feature", *names]
        )

    schema = "feature bigint, " + ", ".join(f"{c} double" for c in names)
    parts = texts_of.select("text").mapInArrow(run, schema)
    summed = parts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in names))
    out = np.zeros((1 << BITS, width))
    for row in summed.toArrow().to_batches():  # a row per feature of the benchmark: 2**BITS at most
        out[row.column(0).to_numpy()] = np.stack([row.column(k + 1).to_numpy() for k in range(width)], 1)
    return out


def latent_space(gathered: np.ndarray, directions: np.ndarray, rank: int) -> np.ndarray:
    """Features to latent coordinates: right singular vectors, from the sketch of AᵀA.

    Coordinates that many passages share are scaled down by their singular value; those of single passages are not.
    """
    inner = directions.T.astype(np.float64) @ gathered
    inner = (inner + inner.T) / 2
    value, vector = np.linalg.eigh(inner)
    good = value > max(value.max(), 1e-12) * 1e-6
    root = gathered @ (vector[:, good] / np.sqrt(value[good]))
    left, singular, _ = np.linalg.svd(root, full_matrices=False)
    keep = singular[:rank] > max(singular.max(initial=0.0), 1e-12) * 1e-2  # smaller ones are noise of the sketch
    return (left[:, :rank][:, keep] / np.maximum(1.0, singular[:rank][keep])).astype(np.float32)


#: Hits of the words of pieces held at once; more are searched part by part of the text.
HITS = 1 << 22
#: Regions or blocks looked at together; cosines of windows and pieces together.
SLICE, COMPARED = 1 << 10, 1 << 20


class Anchors:
    """Finds every place where a piece can be leaked, by its rarer words.

    A region that holds ``need`` of a piece's ``size`` words holds at least ``c`` of any ``size - need + c`` different ones.
    So the rarest are looked up, and a place is proposed where ``c`` different ones stand as close together as a region is
    long, if so many words as needed stand in order there. Words are their hashed slots, which can only propose more.
    """

    def __init__(self, pieces: Pieces, idf: np.ndarray):
        self.size = size = np.array([len(w) for w in pieces.words], np.int64)
        self.short = size < SHORT
        self.need = np.ceil(np.where(self.short, COPY, PARAPHRASE) * size - 1e-9).astype(np.int64)
        self.width = np.where(self.short, 2 * size, PASSAGE + 2 * size)
        kinds = np.array([len(np.unique(f)) for f in pieces.features], np.int64)
        self.count = np.clip(kinds - (size - self.need), 1, np.maximum(1, self.need // 3))
        slot, piece = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, f in enumerate(pieces.features):
            different = np.unique(f)
            rare = different[np.argsort(-idf[different], kind="stable")[: size[k] - self.need[k] + self.count[k]]]
            slot.append(rare)
            piece.append(np.full(len(rare), k))
        slot, piece = np.concatenate(slot), np.concatenate(piece)
        order = np.argsort(slot, kind="stable")
        self.piece = piece[order]
        self.first = np.searchsorted(slot[order], np.arange((1 << BITS) + 1))
        self.most = np.diff(self.first)
        # Where each slot stands in its piece, a bit a word (PIECE is below 64); and a coarse table of the pairs that exist.
        pair = np.repeat(np.arange(len(size)), size) << BITS | np.concatenate([*pieces.features, np.zeros(0, np.int64)])
        bit = U(1) << (np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)).astype(U)
        order = np.argsort(pair, kind="stable")
        self.keys, start = np.unique(pair[order], return_index=True)
        self.masks = np.bitwise_or.reduceat(bit[order], start) if len(pair) else np.zeros(0, U)
        self.filter_mask = (1 << max(16, int(16 * len(pair)).bit_length())) - 1
        self.filter = np.zeros(self.filter_mask + 1, bool)
        slot = self._folded(self.keys)
        self.filter[slot] = True
        self.key_at = np.zeros(self.filter_mask + 1, np.int32)  # one of the pairs there
        self.key_at[slot] = np.arange(len(slot))

    def _folded(self, key: np.ndarray) -> np.ndarray:
        """Place in the coarse table; that of a pair is that of its piece (shifted) xor that of its slot."""
        return (key ^ key >> 13) & self.filter_mask

    def read(self, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots and their places in the coarse table, with room after them: no region is longer than four gaps."""
        words = np.concatenate([feature, np.zeros(4 * int(self.width.max()), np.int64)])
        return words, self._folded(words)

    def regions(self, feature: np.ndarray, doc: np.ndarray, blocks: np.ndarray):
        """``piece, at, begin, end`` of the regions that may be leaked, once each; ``at`` is a window's first word (begin, for short pieces)."""
        gap = int(self.width.max())
        place = np.arange(len(feature)) + doc * gap  # further apart than a region, if in different documents
        total = np.concatenate([[0], np.cumsum(self.most[feature])])
        far = int(place[-1]) + 2 * gap
        where, slots = np.zeros(far, np.int32), np.zeros(far, np.int32)
        where[place], slots[place] = np.arange(len(place)), feature
        edges = np.searchsorted(doc, np.arange(doc[-1] + 2))
        words = self.read(feature)
        a = 0
        while a < len(feature):
            b = max(a + 1, int(np.searchsorted(total, total[a] + HITS, side="right")) - 1)
            stop = min(len(feature), b + gap)
            n = self.most[feature[a:stop]]
            row = np.repeat(np.arange(a, stop), n)
            at = self.first[feature[row]] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            key = np.sort(self.piece[at] * far + place[row])
            # Hits of which the c-th next one of the same piece is as near as a region is long.
            mine = key // far
            spot = key - mine * far
            partner = np.minimum(np.arange(len(key)) + self.count[mine] - 1, max(0, len(key) - 1))
            ahead = np.arange(len(key)) + self.count[mine] <= len(key)
            close = np.flatnonzero(ahead & (mine[partner] == mine) & (key[partner] - key < self.width[mine]))
            piece = mine[close]
            then = close + self.count[piece] - 1
            n = np.searchsorted(key, key[close] + self.width[piece]) - close
            first, last, slot = where[spot[close]], where[spot[then]], slots.take(spot)
            good = [np.zeros(0, np.int64)]
            for part in np.array_split(np.arange(len(close)), max(1, int(n.sum()) >> 20)):
                group = np.repeat(part, n[part])
                hit = close[group] + np.arange(len(group)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                kind = np.sort((group - part[:1]) << BITS | slot.take(hit))
                kinds = np.bincount(kind[np.diff(kind, prepend=-1) != 0] >> BITS, minlength=len(part))
                good.append(part[kinds >= self.count[piece[part]]])
            good = np.concatenate(good)
            piece, first, last = piece[good], first[good], last[good]
            yield from self._around(piece, first, last, words, edges[doc[first]], edges[doc[first] + 1], blocks)
            a = b

    def _around(self, piece, first, last, words, doc_first, doc_end, blocks):
        """Regions around the words from ``first`` to ``last`` that hold ``need`` words of the piece in order."""
        size, short = self.size[piece], self.short[piece]
        low = np.maximum(doc_first, last + 1 - np.where(short, 2 * size, PASSAGE + size))
        high = np.where(short, first + 1, np.minimum(doc_end, first + size + 1))
        low = np.where(short, low, np.searchsorted(blocks, low))
        high = np.where(short, high, np.searchsorted(blocks, high))
        # Candidates with the same regions count once.
        order = np.lexsort((high, low, piece))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(piece[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
        some = order[new & (high > low)[order]]
        # All regions of a candidate together must hold enough of the piece's words in order, before any of them is looked at.
        lo, hi = low[some], high[some] - 1
        begin = np.where(short[some], lo, np.maximum(doc_first[some], blocks[np.minimum(lo, len(blocks) - 1)] - size[some]))
        end = np.where(short[some], hi + 2 * size[some], blocks[np.minimum(hi, len(blocks) - 1)] + size[some] + PASSAGE)
        some = some[self._holding(piece[some], begin, np.minimum(doc_end[some], end), words)]
        piece, low, high, doc_first, doc_end, size, short = (x[some] for x in (piece, low, high, doc_first, doc_end, size, short))
        n = high - low
        for part in np.array_split(np.arange(len(n)), max(1, int(n.sum()) >> 20)):
            m = n[part]
            row = np.repeat(part, m)
            at = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
            at = np.where(short[row], at, blocks[np.minimum(at, len(blocks) - 1)])
            _, once = np.unique(piece[row] * len(words[0]) + at, return_index=True)
            row, at = row[once], at[once]
            begin = np.where(short[row], at, np.maximum(doc_first[row], at - size[row]))
            end = np.minimum(doc_end[row], at + np.where(short[row], 2, 1) * size[row] + np.where(short[row], 0, PASSAGE))
            good = self._holding(piece[row], begin, end, words)
            yield from zip(piece[row[good]].tolist(), at[good].tolist(), begin[good].tolist(), end[good].tolist(), strict=True)

    def _masks(self, piece, begin, end, words):
        """``row, mask``: for each word of a region that is one of the piece's, where it stands there; by region, in order."""
        feature, folded = words
        width = max(1, int((end - begin).max(initial=0)))
        slot = np.lib.stride_tricks.sliding_window_view(folded, width)[begin]
        slot ^= self._folded(piece << BITS)[:, None]
        near = self.filter.take(slot)
        near &= np.arange(width) < (end - begin)[:, None]
        at = np.flatnonzero(near)
        row = at // width
        key = piece[row] << BITS | feature[begin[row] + at - row * width]
        found = self.key_at.take(slot.ravel()[at])
        other = np.flatnonzero(self.keys[found] != key)
        found[other] = np.minimum(np.searchsorted(self.keys, key[other]), len(self.keys) - 1)
        sure = self.keys[found] == key
        return row[sure], self.masks[found[sure]]

    def _enough(self, row, mask, piece) -> np.ndarray:
        """Whether the words of each region cover ``need`` places of the piece, which is no less than stand in order."""
        first = np.flatnonzero(np.diff(row, prepend=-1))
        covered = np.zeros(len(piece), U)
        if len(first):
            covered[row[first]] = np.bitwise_or.reduceat(mask, first)
        return np.bitwise_count(covered) >= self.need[piece]

    def _holding(self, piece, begin, end, words) -> np.ndarray:
        """The numbers of the regions that hold ``need`` words of their piece in order."""
        good = [np.zeros(0, np.int64)]
        for k in range(0, len(piece), SLICE):
            one = slice(k, k + SLICE)
            good.append(k + np.flatnonzero(self._in_order(piece[one], begin[one], end[one], words) >= self.need[piece[one]]))
        return np.concatenate(good)

    def _in_order(self, piece: np.ndarray, begin: np.ndarray, end: np.ndarray, words: tuple) -> np.ndarray:
        """Length of the longest common subsequence of slots of each piece and region; less than ``need`` may read as 0."""
        out = np.zeros(len(piece), np.int64)
        row, mask = self._masks(piece, begin, end, words)
        rows = np.flatnonzero(self._enough(row, mask, piece))
        if not len(rows):
            return out
        number = np.full(len(piece), -1)
        number[rows] = np.arange(len(rows))
        row, mask = number[row], mask[number[row] >= 0]
        row = row[row >= 0]
        count = np.bincount(row, minlength=len(rows))
        packed = np.zeros((len(rows), int(count.max())), U)
        packed[row, np.arange(len(row)) - (np.cumsum(count) - count)[row]] = mask
        full = (U(1) << self.size[piece[rows]].astype(U)) - U(1)
        state = full.copy()
        for k in range(packed.shape[1]):
            m = state & packed[:, k]
            state = ((state + m) | (state - m)) & full
        out[rows] = self.size[piece[rows]] - np.bitwise_count(state)
        return out


@dataclass
class Index:
    """What a task needs to search: pieces, their latent vectors, the table from features to latent coordinates, and their rarer words."""

    pieces: Pieces
    table: np.ndarray
    vectors: np.ndarray
    anchors: Anchors

    @cached_property
    def padded(self) -> np.ndarray:
        out = np.zeros((len(self.table) + 1, self.table.shape[1]), np.float32)  # row by row, as it is read
        out[:-1] = self.table
        return out

    @cached_property
    def places(self) -> list[dict[int, int]]:
        return [places(w.tolist()) for w in self.pieces.words]

    @cached_property
    def answer_places(self) -> list[dict[int, int]]:
        return [places(w.tolist()) for w in self.pieces.answers]

    def search(self, texts: Texts, has: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(document, piece, share in order, share of the answer, cosine) of what is leaked, the best window of each."""
        word, doc = word_hashes(texts)
        if not len(word) or not self.pieces.items:
            return []
        feature = (word >> U(64 - BITS)).astype(np.int64)
        blocks = np.flatnonzero(place_in_document(doc) % STRIDE == 0)
        block_doc = doc[blocks]
        # Sums of each STRIDE words: their rows one after the other, a row of zeros where a block is shorter.
        size = np.diff(np.append(blocks, len(feature)))
        padded = np.append(feature, len(self.table))
        part = np.empty((len(blocks), self.padded.shape[1]), np.float32)
        for a in range(0, len(blocks), SLICE):  # a slice stays in the processor's cache
            begin, n, some = blocks[a : a + SLICE], size[a : a + SLICE], part[a : a + SLICE]
            self.padded.take(padded[begin], 0, some, "clip")
            more = np.empty_like(some)
            for k in range(1, STRIDE):
                some += self.padded.take(padded[np.where(k < n, begin + k, len(feature))], 0, more, "clip")
        window = part.copy()
        for k in range(1, PASSAGE // STRIDE):
            if k < len(blocks):
                np.add(window[:-k], part[k:], out=window[:-k], where=(block_doc[k:] == block_doc[:-k])[:, None])
        length = np.sqrt((window * window).sum(1))
        found = []
        step = max(1, COMPARED // len(self.pieces.items))
        doc_end = np.searchsorted(doc, np.arange(texts.n), side="right")
        sizes = np.array([len(w) for w in self.pieces.words])
        ahead = np.lib.stride_tricks.sliding_window_view(np.concatenate([feature, np.zeros(PASSAGE, np.int64)]), PASSAGE)
        for a in range(0, len(window), step):
            cosine = (window[a : a + step] / np.maximum(length[a : a + step, None], 1e-9)) @ self.vectors.T
            row, piece = np.divmod(np.flatnonzero(cosine >= COSINE), len(self.pieces.items))
            begin = blocks[a + row]
            inside = has.take(ahead[begin] + (piece << BITS)[:, None])
            inside &= np.arange(PASSAGE) < (doc_end[block_doc[a + row]] - begin)[:, None]
            near = np.flatnonzero(np.count_nonzero(inside, axis=1) >= SHARED * np.minimum(PASSAGE, sizes[piece]))
            found += [(int(block_doc[a + row[i]]), int(piece[i]), int(begin[i]), float(cosine[row[i], piece[i]])) for i in near]
        doc_first = np.searchsorted(doc, np.arange(texts.n), side="left")
        best: dict[tuple[int, int], tuple[float, float, float]] = {}

        def look(d: int, p: int, begin: int, end: int, cosine: float, share_only: bool) -> None:
            if (d, p) in best and best[d, p][0] >= 1.0:
                return
            region, size = word[begin:end].tolist(), len(self.pieces.words[p])
            share = in_order(self.places[p], size, region) / size
            if share < (COPY if share_only else PARAPHRASE):
                return
            size = len(self.pieces.answers[p])
            answered = in_order(self.answer_places[p], size, region) / max(1, size)
            if share >= COPY or answered >= ANSWER:
                best[d, p] = max(best.get((d, p), (0.0, 0.0, 0.0)), (share, answered, cosine))

        if found:  # what can't hold half of a longer piece in order is ruled out together
            d, p, begin = (np.array(x) for x in list(zip(*found, strict=True))[:3])
            low, high = np.maximum(doc_first[d], begin - sizes[p]), np.minimum(doc_end[d], begin + PASSAGE + sizes[p])
            stays = self.anchors.short[p]
            stays[self.anchors._holding(p, low, high, self.anchors.read(feature))] = True
            found = [(*found[i][:2], int(low[i]), int(high[i]), found[i][3]) for i in np.flatnonzero(stays).tolist()]
        for d, p, low, high, cosine in sorted(found, key=lambda x: -x[4]):
            look(d, p, low, high, cosine, False)
        for p, at, begin, end in self.anchors.regions(feature, doc, blocks):
            w = np.searchsorted(blocks, at, side="right") - 1
            cosine = float(window[w] @ self.vectors[p]) / max(float(length[w]), 1e-9)
            look(int(doc[at]), p, begin, end, cosine, bool(self.anchors.short[p]))
        return sorted((d, p, *s) for (d, p), s in best.items())

    def membership(self) -> np.ndarray:
        has = np.zeros((len(self.pieces.items), 1 << BITS), bool)
        for k, f in enumerate(self.pieces.features):
            has[k, f] = True
        return has


def build(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", answer_col: str | None = None) -> list[Index]:
    """One index per block of benchmark pieces.

    Only words of the benchmark can raise a product with one of its pieces, so the matrix has their columns;
    its rows are all passages of all documents. Null and short benchmark texts are left out.
    """
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"), answer.alias("answer"))
    texts_of = docs.select(F.col("text").cast("string").alias("text"))
    indexes: list[Index] = []
    block: list = []
    for row in items.where("text is not null").orderBy("item", "text").toLocalIterator():
        block.append((row["item"], row["text"], row["answer"]))
        if len(block) == BLOCK:
            indexes.append(_index(texts_of, block))
            block = []
    if block:
        indexes.append(_index(texts_of, block))
    return indexes


def _index(texts_of: DataFrame, rows: list) -> Index:
    pieces = pieces_of(rows)
    known = pieces.vocabulary
    total, passages = passage_frequencies(texts_of, known)
    idf = inverse_frequency(total, passages)
    rank = min(RANK, int(known.sum()))
    directions = np.random.default_rng(SEED).standard_normal((1 << BITS, rank + SPARE)).astype(np.float32)
    gathered = sketch(texts_of, known, idf, directions)
    for f in pieces.features:  # the pieces are passages too
        feature, count = np.unique(f, return_counts=True)
        weight = count * idf[feature]
        weight /= max(1e-9, np.sqrt((weight * weight).sum()))
        gathered[feature] += weight[:, None] * (weight @ directions[feature])
    space = latent_space(gathered, directions, rank) if pieces.items else np.zeros((1 << BITS, 1), np.float32)
    table = (space * (idf * known)[:, None]).astype(np.float32)
    vectors = np.stack([table[f].sum(0) for f in pieces.features]) if pieces.items else np.zeros((0, table.shape[1]), np.float32)
    vectors /= np.maximum(np.sqrt((vectors * vectors).sum(1, keepdims=True)), 1e-9)
    return Index(pieces, table, vectors, Anchors(pieces, idf))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``doc_id, item_id, share, answer_share, cosine``: a row for each document and benchmark item it holds.

    A document is searched whole. Found are: any item that 0.7 of the words of stand in order, or half of them and 0.8 of
    its answer, in 32 words (from every eighth word on) and its length before and after; of items of fewer than 16 words,
    0.7 in order within twice their length; and what else the latent search proposes. An item that is null, empty or shorter than five words is found nowhere; a
    null or empty document holds nothing; repeated rows are found each; null ids are returned as such.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    item_type = benchmark.schema[names.get("id_col", "item_id")].dataType
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {item_type.simpleString()}, share double, answer_share double, cosine double"
    found = None
    for index in build(docs, benchmark, names.get("item_text_col", "text"), names.get("id_col", "item_id"), names.get("answer_col")):
        part = docs.mapInArrow(in_batches(_searcher(index, item_type)), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    return found


def _searcher(index: Index, item_type):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(item_type)

    def make():
        has = index.membership()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, out = [], []
            for first, _, texts in chunks(batch.column(1)):
                best: dict = {}
                for d, p, *scores in index.search(texts, has):
                    key = (first + d, index.pieces.items[p])
                    best[key] = max(best.get(key, (0.0, 0.0, 0.0)), tuple(scores))
                rows += [k[0] for k in best]
                out += [(k[1], *v) for k, v in best.items()]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], kind), *(pa.array(c, pa.float64()) for c in columns[1:])],
                ["doc_id", "item_id", "share", "answer_share", "cosine"],
            )

        return step

    return make


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns, judged where they lie."""
    kept = docs
    for index in build(docs.select(F.col(text_col).alias("text")), benchmark, names.get("item_text_col", "text"), names.get("id_col", "item_id"), names.get("answer_col")):
        kept = kept.mapInArrow(in_batches(_filter(index, text_col)), docs.schema)
    return kept


def _filter(index: Index, text_col: str):
    def make():
        has = index.membership()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            stays = np.ones(batch.num_rows, bool)
            for first, _, texts in chunks(batch.column(batch.schema.get_field_index(text_col)).cast(pa.string())):
                for d, *_ in index.search(texts, has):
                    stays[first + d] = False
            return batch.filter(pa.array(stays))

        return step

    return make
