"""Quality rules: fixed text counts and a calibrated logistic regression over hashed word and character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspectra.llm.common import in_batches, labelled, settled
from fleetspectra.llm.linear import calibrate, fifth_first, fit_logistic, sigmoid
from fleetspectra.llm.textvec import (
    BASE, IS_SPACE, U, Rolling, Texts, add_counts, byte_grams, chunks, damped, owner, pack, repeated_lines, repeated_words, unpack,
)

#: Size of the hashed vocabulary, and the labelled rows of each class that the model is fitted on at most (about).
BITS, PER_CLASS = 12, 2000
#: A document stays if its probability of good quality is at least KEEP_FROM.
KEEP_FROM = 0.3
# Symbols that are counted; the limits of the fixed rules.
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20


def gram_counts(texts: Texts, bits: int = BITS) -> np.ndarray:
    """Counts of hashed character 3- and 5-grams (as written) and word 1- and 2-grams of each document."""
    counts = np.zeros((texts.n, 1 << bits))
    doc = owner(texts)
    for width in (3, 5):
        gram = byte_grams(texts.data, width, bits)
        same = doc[: len(gram)] == doc[width - 1 :] if len(gram) else np.zeros(0, bool)
        add_counts(counts, doc[: len(gram)][same], gram[same])
    start, end, word_doc = texts.words()
    if len(start):
        word = Rolling(texts.data).of(start, end)
        add_counts(counts, word_doc, (word >> U(64 - bits)).astype(np.int64))
        pair = word[:-1] * U(BASE) + word[1:]
        same = word_doc[:-1] == word_doc[1:]
        add_counts(counts, word_doc[:-1][same], (pair[same] * U(0xD6E8FEB86659FD93) >> U(64 - bits)).astype(np.int64))
    return counts


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    start, end, doc = texts.words()
    rolling = Rolling(texts.data)
    return {
        "n_words": np.bincount(doc, minlength=texts.n),
        "word_chars": texts.sums(((texts.data & 0xC0) != 0x80) & ~IS_SPACE[texts.data]),
        "n_symbols": texts.sums(SYMBOLS[texts.data]),
        "n_dup_lines": repeated_lines(texts, rolling),
        "n_repeat_words": repeated_words(rolling.of(start, end), doc, texts.n),
    }


class Model:
    """Weights, offset and calibration; without examples of both classes, a constant."""

    def __init__(self, weights: np.ndarray | None, slope: float, offset: float, bits: int):
        self.weights, self.slope, self.offset, self.bits = weights, slope, offset, bits

    def probability(self, texts: Texts) -> np.ndarray:
        if self.weights is None:
            return np.full(texts.n, self.offset)
        margin = damped(gram_counts(texts, self.bits)) @ self.weights
        return sigmoid(self.slope * margin.astype(np.float64) + self.offset)


def features(docs: DataFrame, sample: DataFrame, make_rows, id_col: str, text_col: str) -> list:
    """The packed feature rows of the sampled documents, in order of their ids. The sample's size is bounded."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[bytes] = []
            for _, _, texts in chunks(batch.column(1), rows=256):
                rows += make_rows(texts)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.binary()), batch.column(2), batch.column(3)], ["doc_id", "row", "label", "weight"]
            )

        return step

    kind = dict(sample.dtypes)["label"]
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label", "weight")  # rows: the sample's bound
    got = chosen.mapInArrow(in_batches(make), f"doc_id bigint, row binary, label {kind}, weight double").collect()
    return sorted(got, key=lambda r: (r["doc_id"], bytes(r["row"])))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    per_class: int = PER_CLASS, bits: int = BITS,
) -> Model:
    """Fit on a sample of about ``per_class`` labelled rows a class, weighted back to the labels' proportions.

    Four fifths fit the weights, the others calibrate them.
    """
    sample = settled(labelled(docs, labels, id_col, label_col, F.lit(True), per_class).repartition(1))  # rows: the sample's bound

    def rows_of(texts: Texts) -> list[bytes]:
        return [pack(row) for row in damped(gram_counts(texts, bits))]

    got = features(docs, sample, rows_of, id_col, text_col)
    y = np.array([r["label"] > 0 for r in got], np.float64)
    if not len(y) or y.min() == y.max():
        return Model(None, 1.0, float(y[0]) if len(y) else 1.0, bits)
    order, n = fifth_first(len(y))
    x = unpack([bytes(got[k]["row"]) for k in order], 1 << bits)
    y, weight = y[order], np.array([got[k]["weight"] for k in order])
    even = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y == 0).sum()))
    w, b = fit_logistic(x[n:], y[n:, None], even[n:])
    slope, offset = calibrate((x[:n] @ w[:, 0] + b[0]).astype(np.float64), y[:n], weight[:n])
    return Model(w[:, 0], slope, float(slope * b[0] + offset), bits)


def judge(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM,
) -> DataFrame:
    """Each row's fixed counts, ``base_failed``, ``probability`` of good quality, and ``kept``.

    A null or empty text has no words and fails the fixed rules; texts are judged whole; repeated rows and
    null ids are judged like any other row.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = []
            for _, _, texts in chunks(batch.column(1), rows=256):
                parts.append({**base_counts(texts), "probability": model.probability(texts)})
            columns = [pa.array(np.concatenate([p[c] for p in parts])) for c in [*names, "probability"]]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names, "probability"])

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, {', '.join(f'{c} bigint' for c in names)}, probability double"
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    judged = rows.mapInArrow(in_batches(make), schema).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= keep_from))


def kept_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, judged where they lie."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            stays = []
            for _, _, texts in chunks(batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()), rows=256):
                base = base_counts(texts)
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED_PERCENT * base["n_words"])
                stays.append(~failed & (model.probability(texts) >= keep_from))
            return batch.filter(pa.array(np.concatenate(stays)))

        return step

    return docs.mapInArrow(in_batches(make), docs.schema)
