"""Whole texts as numpy arrays: words, lines, hashes and counts, for a chunk of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_IN_WORD = (~IS_SPACE).tobytes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random number for each byte, from a fixed seed.
BYTE_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


#: A second modulus: strings that a polynomial modulo 2**64 confuses whatever its base is (of Thue and Morse's kind) differ here.
PRIME = (1 << 31) - 1
BASE31, INVERSE31 = 1_103_515_245, pow(1_103_515_245, -1, PRIME)
BYTE_VALUE31 = np.random.default_rng(12).integers(1, PRIME, 256, dtype=np.uint64)


def _power(kind: str, base: int, n: int, modulus: int = 0) -> np.ndarray:
    """The first ``n`` powers of ``base``, modulo 2**64 or another modulus below 2**32."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.empty(size, np.uint64)
        have[0] = 1
        if modulus:
            done = 1
            while done < size:
                more = min(done, size - done)
                have[done : done + more] = have[:more] * U(pow(base, done, modulus)) % U(modulus)
                done += more
        else:
            have[1:] = U(base)
            have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * CHUNK_BYTES:
            _powers[kind] = have
    return have


def _folded(x: np.ndarray) -> np.ndarray:
    """``x`` in place, congruent modulo PRIME (2**31 - 1) and below 2**33."""
    high = x >> U(31)
    x &= U(PRIME)
    x += high
    return x


class Rolling:
    """Hashes of any stretch of ``data`` from two running sums: polynomials modulo 2**64 and modulo a prime."""

    def __init__(self, data: np.ndarray):
        n, at = len(data), data.astype(np.intp)
        term = BYTE_VALUE.take(at)
        term *= _power("up", BASE, n + 1)[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(term, out=self.sums[1:])
        self.down = _power("down", INVERSE, n + 1)
        term = BYTE_VALUE31.take(at)
        term *= _power("up31", BASE31, n + 1, PRIME)[:n]
        self.sums31 = np.zeros(n + 1, np.uint64)  # below 2**63: terms are below 2**32
        np.cumsum(_folded(term), out=self.sums31[1:])
        self.down31 = _power("down31", INVERSE31, n + 1, PRIME)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        second = (self.sums31[end] - self.sums31[start]) % U(PRIME) * self.down31[start] % U(PRIME)
        return (self.sums[end] - self.sums[start]) * self.down[start] + second * U(0xC2B2AE3D27D4EB4F)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


#: Stretches of at most so many bytes are told apart eight bytes at a time, longer ones by their hashes.
EIGHTS = 8


def _spelling(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each stretch of 1 to 8 * EIGHTS bytes, the same for the same bytes."""
    padded = np.zeros((len(data) >> 3) + 3, np.uint64)
    padded.view(np.uint8)[: len(data)] = data
    size = end - start
    key = size.astype(np.uint64) * U(0xD6E8FEB86659FD93)
    rest, k = np.arange(len(size)), 0
    while len(rest):
        at, left = start[rest] + 8 * k, size[rest] - 8 * k
        shift = (at & 7).astype(np.uint64) << U(3)
        place = at >> 3
        eight = padded.take(place) >> shift
        eight |= padded.take(place + 1) << U(1) << (U(63) - shift)
        eight &= ~U(0) >> (U(64) - (np.minimum(left, 8).astype(np.uint64) << U(3)))
        if k == 0:
            key = mix(eight + key)
        else:
            key[rest] = mix(key[rest] * U(BASE) + eight)
        rest, k = rest[left > 8], k + 1
    return key


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one byte or more: which different one each is; their hashes (those of ``Rolling``); where each is first."""
    long = np.flatnonzero(end - start > 8 * EIGHTS)
    key = _spelling(data, start, np.minimum(end, start + 8 * EIGHTS))
    if len(long):
        hashes = Rolling(data).of(start[long], end[long])
        key[long] = hashes
    at, found = pd.factorize(key)
    first = np.zeros(len(found), np.int64)
    first[at[::-1]] = np.arange(len(at))[::-1]
    out = _short_hashes(data, start[first], np.minimum(end[first] - start[first], 8 * EIGHTS))
    if len(long):
        out[at[long]] = hashes
    return at, out, first


def _short_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What ``Rolling`` makes of stretches of at most 8 * EIGHTS bytes, added up byte by byte, the longest first."""
    order = np.argsort((8 * EIGHTS - size).astype(np.uint8), kind="stable")
    place, longer = start[order], len(size) - np.cumsum(np.bincount(size, minlength=8 * EIGHTS))
    up, up31 = _power("up", BASE, 8 * EIGHTS), _power("up31", BASE31, 8 * EIGHTS, PRIME)
    total, total31 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    for k in range(8 * EIGHTS):
        n = int(longer[k])
        if not n:
            break
        byte = data.take(place[:n]).astype(np.intp)
        place[:n] += 1
        total[:n] += (BYTE_VALUE * up[k]).take(byte)
        total31[:n] += (BYTE_VALUE31 * up31[k] % U(PRIME)).take(byte)
    out = np.empty(len(size), np.uint64)
    out[order] = total + total31 % U(PRIME) * U(0xC2B2AE3D27D4EB4F)
    return mix(out + size.astype(np.uint64) * U(0xD6E8FEB86659FD93))


class Texts:
    """The UTF-8 bytes of some documents, end to end; ``edges`` holds where each begins, and the end."""

    def __init__(self, data: np.ndarray, edges: np.ndarray):
        self.data, self.edges, self.n = data, edges, len(edges) - 1

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """Per document the sum of a value per byte."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.edges[1:]] - total[self.edges[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each word."""
        inside = np.frombuffer(self.data.tobytes().translate(_IN_WORD), bool)
        full = np.flatnonzero(self.edges[1:] > self.edges[:-1])
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        first, last = self.edges[full], self.edges[full + 1] - 1
        begins[first], ends[last] = inside[first], inside[last]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return start, end, np.repeat(np.arange(self.n), np.diff(np.searchsorted(start, self.edges)))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (without the line feed) and document of each line of documents that aren't empty."""
        full = np.flatnonzero(self.edges[1:] > self.edges[:-1])
        breaks = np.flatnonzero(self.data == 10)
        start = np.concatenate([self.edges[full], breaks + 1])
        end = np.concatenate([breaks, self.edges[full + 1]])
        doc = np.concatenate([full, np.searchsorted(self.edges, breaks, side="right") - 1])
        doc_end = np.concatenate([np.searchsorted(self.edges, breaks, side="right") - 1, full])
        a, b = np.lexsort((start, doc)), np.lexsort((end, doc_end))
        return start[a], end[b], doc[a]


def chunks(array: pa.Array, limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, Texts]]:
    """Runs of at most ``rows`` rows and about ``limit`` bytes (a longer text alone): first row, end row, texts. Null reads as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    _, offsets, data = array.buffers()
    n = len(array)
    edges = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(edges, edges[at] + limit, side="right")) - 1)
        end = min(end, n, at + rows)
        yield at, end, Texts(raw[edges[at] : edges[end]], edges[at : end + 1] - edges[at])
        at = end


def repeats(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (document, hash) row: the number of its group, and each group's count."""
    group, found = pd.factorize(mix(value + doc.astype(np.uint64) * U(0xA24BAED4963EE407)))
    return group, np.bincount(group, minlength=len(found))


def repeated_words(word_hash: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> np.ndarray:
    """Per document the words that stand in a window of ``width`` words found twice or more in it."""
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    window = np.zeros(n, np.uint64)
    for k in range(width):
        window = window * U(BASE) + word_hash[k : k + n]
    whole = np.flatnonzero(doc[:n] == doc[width - 1 :])
    group, count = repeats(doc[whole], window[whole])
    twice = whole[count[group] >= 2]
    change = np.zeros(len(word_hash) + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + width, -1)
    return np.bincount(doc[np.cumsum(change[:-1]) > 0], minlength=n_docs)


def repeated_lines(texts: Texts, rolling: Rolling) -> np.ndarray:
    """Per document the lines with a word that equal an earlier line."""
    start, end, doc = texts.lines()
    inside = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(~IS_SPACE[texts.data], out=inside[1:])
    full = inside[end] > inside[start]
    start, end, doc = start[full], end[full], doc[full]
    if not len(doc):
        return np.zeros(texts.n, np.int64)
    group, count = repeats(doc, rolling.of(start, end))
    first = np.zeros(len(count), np.int64)
    first[group[::-1]] = doc[::-1]
    return np.bincount(doc, minlength=texts.n) - np.bincount(first, minlength=texts.n)


def byte_grams(data: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Hash number (below ``2**bits``) of the ``width`` bytes from each place on that has so many after it."""
    n = max(0, len(data) - width + 1)
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = key << U(8) | data[k : k + n]
    return (key * U(BASE) + U(width * 0xBF58476D1CE4E5B9 % (1 << 64)) >> U(64 - bits)).astype(np.int64)


def add_counts(counts: np.ndarray, doc: np.ndarray, gram: np.ndarray) -> None:
    """Count each document's grams into its row of ``counts``."""
    width = counts.shape[1]
    counts += np.bincount(doc * width + gram, minlength=counts.size).reshape(counts.shape)


def owner(texts: Texts) -> np.ndarray:
    """The document of each byte."""
    return np.repeat(np.arange(texts.n), np.diff(texts.edges))


def damped(counts: np.ndarray) -> np.ndarray:
    """Rows of log counts with length 1 (empty rows stay 0)."""
    x = np.log1p(counts).astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def pack(row: np.ndarray) -> bytes:
    """A sparse row as bytes: places, then values."""
    at = np.flatnonzero(row)
    return at.astype("<u2").tobytes() + row[at].astype("<f4").tobytes()


def unpack(parts: list[bytes], width: int) -> np.ndarray:
    """Packed rows as one dense matrix."""
    x = np.zeros((len(parts), width), np.float32)
    for k, part in enumerate(parts):
        n = len(part) // 6
        x[k, np.frombuffer(part, "<u2", n)] = np.frombuffer(part, "<f4", n, 2 * n)
    return x
