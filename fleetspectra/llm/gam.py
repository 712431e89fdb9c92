"""Quality classifier: a generalised additive model with pairwise interactions, boosted into lookup tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspectra.llm.common import in_batches, labelled, settled
from fleetspectra.llm.linear import sigmoid
from fleetspectra.llm.rules import features
from fleetspectra.llm.textvec import Rolling, Texts, chunks, repeated_lines, repeated_words, repeats

#: Labelled rows of each class that the tables are learned from at most (about).
PER_CLASS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 64, 8, 10, 150, 60, 0.15
NAMES = [
    "log_bytes", "log_words", "mean_word", "symbols", "upper", "digits", "punctuation", "exclaim", "bars", "lines", "not_ascii",
    "distinct_words", "top_word", "repeated_lines", "repeated_words", "short_words", "long_words", "pure_words", "same_as_last", "entropy",
]


def _table(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


IS_SYMBOL, IS_PUNCTUATION = _table(b"#*$%&|<>@^~=_{}[]\\/"), _table(b".,;:!?'\"()-")
IS_UPPER, IS_DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))
IS_LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


def measures(texts: Texts) -> np.ndarray:
    """One row of numbers for each document, from its text alone."""
    data, n = texts.data, texts.n
    size = np.diff(texts.edges).astype(float)
    start, end, doc = texts.words()
    words = np.bincount(doc, minlength=n).astype(float)
    per_byte, per_word = np.maximum(size, 1), np.maximum(words, 1)
    rolling = Rolling(data)
    word = rolling.of(start, end)
    length = (end - start).astype(float)
    group, count = repeats(doc, word)
    first = np.zeros(len(count), np.int64)
    first[group] = doc
    top = np.zeros(n)
    np.maximum.at(top, first, count)
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(IS_LETTER[data], out=letters[1:])
    pure = letters[end] - letters[start] >= end - start - 1
    again = np.zeros(len(doc), bool)
    if len(doc):
        again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    histogram = np.bincount(np.repeat(np.arange(n), np.diff(texts.edges)) * 256 + data, minlength=n * 256).reshape(n, 256)
    share = histogram / per_byte[:, None]

    def of_bytes(mask: np.ndarray) -> np.ndarray:
        return histogram[:, mask].sum(1) / per_byte

    def of_words(value: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=value, minlength=n) / per_word

    high = np.arange(256) >= 128
    return np.stack(
        [
            np.log1p(size), np.log1p(words), of_words(length), of_bytes(IS_SYMBOL), of_bytes(IS_UPPER), of_bytes(IS_DIGIT),
            of_bytes(IS_PUNCTUATION), of_bytes(_table(b"!")), of_bytes(_table(b"|")), of_bytes(_table(b"\n")), of_bytes(high),
            np.bincount(first, minlength=n) / per_word, top / per_word, repeated_lines(texts, rolling) / per_word,
            repeated_words(word, doc, n) / per_word, of_words(length <= 3), of_words(length >= 15), of_words(pure), of_words(again),
            -(share * np.log2(np.maximum(share, 1e-12))).sum(1),
        ],
        axis=1,
    )


def _stump_tree(gain_g: np.ndarray, gain_h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """The step function of a tree of ``depth`` levels over ordered bins, from sums of gradients and curvatures."""
    out = np.zeros(len(gain_g))

    def grow(a: int, b: int, left: int) -> None:
        g, h = np.cumsum(gain_g[a:b]), np.cumsum(gain_h[a:b])
        total_g, total_h = g[-1], h[-1]
        if left and b - a > 1:
            score = g[:-1] ** 2 / (h[:-1] + ridge) + (total_g - g[:-1]) ** 2 / (total_h - h[:-1] + ridge)
            k = int(np.argmax(score))
            if score[k] > total_g**2 / (total_h + ridge) + 1e-12:
                grow(a, a + k + 1, left - 1)
                grow(a + k + 1, b, left - 1)
                return
        out[a:b] = -total_g / (total_h + ridge)

    grow(0, len(gain_g), depth)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """The best cut of a grid into four by one cut of each axis, as a grid of steps."""
    gg, hh = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b, c = gg[:-1, :-1], gg[:-1, -1:] - gg[:-1, :-1], gg[-1:, :-1] - gg[:-1, :-1]
    ha, hb, hc = hh[:-1, :-1], hh[:-1, -1:] - hh[:-1, :-1], hh[-1:, :-1] - hh[:-1, :-1]
    d, hd = gg[-1, -1] - a - b - c, hh[-1, -1] - ha - hb - hc
    score = sum(x**2 / (y + ridge) for x, y in ((a, ha), (b, hb), (c, hc), (d, hd)))
    i, j = np.unravel_index(int(np.argmax(score)), score.shape)
    out = np.empty_like(g)
    for rows, cols, x, y in (
        (slice(0, i + 1), slice(0, j + 1), a, ha), (slice(0, i + 1), slice(j + 1, None), b, hb),
        (slice(i + 1, None), slice(0, j + 1), c, hc), (slice(i + 1, None), slice(j + 1, None), d, hd),
    ):
        out[rows, cols] = -x[i, j] / (y[i, j] + ridge)
    return out


class Tables:
    """Cuts and one table per feature, a table per chosen pair, and an offset."""

    def __init__(self, offset: float, cuts: list[np.ndarray], single: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]]):
        self.offset, self.cuts, self.single, self.pairs = offset, cuts, single, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.cuts:
            return np.full(len(x), sigmoid(np.array(self.offset)))
        bins = [np.searchsorted(cut, x[:, k], side="left") for k, cut in enumerate(self.cuts)]
        total = np.full(len(x), self.offset)
        for k, table in enumerate(self.single):
            total += table[bins[k]]
        for i, j, table in self.pairs:
            total += table[_coarse(bins[i], len(self.cuts[i])), _coarse(bins[j], len(self.cuts[j]))]
        return sigmoid(total)


def _coarse(bins: np.ndarray, cuts: int) -> np.ndarray:
    return bins * PAIR_BINS // (cuts + 1)


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, ridge: float = 2.0) -> Tables:
    """Learn the tables: in each round every feature in turn gets a small tree on what is left unexplained; then the pairs do."""
    if not len(y) or y.min() == y.max():
        return Tables(6.0 if not len(y) or y[0] > 0 else -6.0, [], [], [])
    weight = weight / weight.mean()
    rate = float((weight * y).sum() / weight.sum())
    offset = float(np.log(rate / (1 - rate)))
    cuts = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]))
            cuts.append(values)
        else:
            cuts.append((values[1:] + values[:-1]) / 2)
    bins = [np.searchsorted(cut, x[:, k], side="left") for k, cut in enumerate(cuts)]
    single = [np.zeros(len(cut) + 1) for cut in cuts]
    margin = np.full(len(y), offset)
    for _ in range(rounds):
        for k, at in enumerate(bins):
            p = sigmoid(margin)
            g = np.bincount(at, weight * (p - y), len(single[k]))
            h = np.bincount(at, weight * p * (1 - p), len(single[k]))
            step = RATE * _stump_tree(g, h, 2, ridge)
            single[k] += step
            margin += step[at]
    coarse = [_coarse(at, len(cut)) for at, cut in zip(bins, cuts, strict=True)]
    p = sigmoid(margin)
    found = []
    for i in range(len(cuts)):
        for j in range(i + 1, len(cuts)):
            at = coarse[i] * PAIR_BINS + coarse[j]
            g = np.bincount(at, weight * (p - y), PAIR_BINS**2).reshape(PAIR_BINS, -1)
            h = np.bincount(at, weight * p * (1 - p), PAIR_BINS**2).reshape(PAIR_BINS, -1)
            step = _pair_tree(g, h, ridge)
            found.append((float((step * g + 0.5 * step**2 * (h + ridge)).sum()), i, j))
    pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in sorted(found)[:PAIRS]]
    for _ in range(pair_rounds):
        for i, j, table in pairs:
            at = coarse[i] * PAIR_BINS + coarse[j]
            p = sigmoid(margin)
            g = np.bincount(at, weight * (p - y), PAIR_BINS**2).reshape(PAIR_BINS, -1)
            h = np.bincount(at, weight * p * (1 - p), PAIR_BINS**2).reshape(PAIR_BINS, -1)
            step = RATE * _pair_tree(g, h, ridge)
            table += step
            margin += step[coarse[i], coarse[j]]
    return Tables(offset, cuts, single, pairs)


def train(
    docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    per_class: int = PER_CLASS,
) -> Tables:
    """Tables from about ``per_class`` labelled rows a class among those that ``use`` allows, weighted back to the labels' proportions."""
    sample = settled(labelled(docs, labels, id_col, label_col, use, per_class))

    def rows_of(texts: Texts) -> list[bytes]:
        return [row.tobytes() for row in measures(texts)]

    got = features(docs, sample, rows_of, id_col, text_col)
    x = np.array([np.frombuffer(r["row"], np.float64) for r in got]).reshape(len(got), len(NAMES))
    y = np.array([r["label"] > 0 for r in got], np.float64)
    return boost(x, y, np.array([r["weight"] for r in got], np.float64))


def score(docs: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: for each row the probability of good quality, by adding up the tables' entries.

    The whole text is measured; a null text reads as empty, an empty text gets the tables' value for no words;
    repeated rows and null ids are scored like any other row.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [tables.score(measures(texts)) for _, _, texts in chunks(batch.column(1), rows=1024)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts))], ["doc_id", "score"])

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(in_batches(make), f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


