"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspectra.llm.common import bounded_sample, in_batches, settled
from fleetspectra.llm.linear import fifth_first, fit_logistic
from fleetspectra.llm.rules import features
from fleetspectra.llm.textvec import Texts, add_counts, byte_grams, chunks, damped, owner, pack, unpack

#: Size of the hashed n-gram vocabulary, and the documents of each language that are learned from at most (about).
BITS, PER_LANGUAGE = 12, 800
#: A prediction is ambiguous if the two nearest codewords' probabilities differ by less than this.
CLEAR_BY = 0.2
UNKNOWN = "und"
#: Letters in lower case, bytes of other scripts as they are, everything else a space.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """A row of bits for each of ``n`` classes.

    Up to six classes get every split of the classes; more get random words, the set of fifty with the largest least distance.
    """
    if n <= 1:
        return np.zeros((n, 0), np.int64)
    if n <= 6:
        splits = np.arange((1 << (n - 1)) - 1)
        rows = [np.ones(len(splits), np.int64)]
        return np.stack(rows + [splits >> k & 1 for k in range(n - 1)])
    rng, best = np.random.default_rng(seed), None
    length = int(np.ceil(10 * np.log2(n)))
    for _ in range(50):
        code = rng.integers(0, 2, (n, length))
        far = (code[:, None, :] != code[None, :, :]).sum(2) + length * np.eye(n, dtype=int)
        if best is None or far.min() > best[0]:
            best = (far.min(), code)
    return best[1][:, (best[1].min(0) != best[1].max(0))]


def gram_rows(texts: Texts, bits: int = BITS) -> np.ndarray:
    """Damped counts of hashed 1- to 4-grams of the folded bytes."""
    counts = np.zeros((texts.n, 1 << bits))
    doc, data = owner(texts), FOLD[texts.data]
    for width in (1, 2, 3, 4):
        gram = byte_grams(data, width, bits)
        same = doc[: len(gram)] == doc[width - 1 :] if len(gram) else np.zeros(0, bool)
        add_counts(counts, doc[: len(gram)][same], gram[same])
    return damped(counts)


class Model:
    """Languages, their codewords, the bits' classifiers and how much each bit counts."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, offsets: np.ndarray, trust: np.ndarray, bits: int):
        self.languages, self.code, self.weights, self.offsets, self.trust, self.bits = languages, code, weights, offsets, trust, bits

    def decode(self, rows: np.ndarray) -> np.ndarray:
        """Probability of each language: the smaller the loss of its codeword, the higher."""
        if len(self.languages) < 2:
            return np.ones((len(rows), len(self.languages)))
        margin = rows @ self.weights + self.offsets
        signs = 2.0 * self.code - 1
        loss = np.stack([(self.trust * np.logaddexp(0, -margin * s)).sum(1) for s in signs], 1)
        near = np.exp(loss.min(1, keepdims=True) - loss)
        return near / near.sum(1, keepdims=True)


def train(
    docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE, bits: int = BITS,
) -> Model:
    """One logistic regression per bit of the code, from about ``per_language`` documents of each language where ``use`` allows.

    A bit counts by its log odds of being right on the fifth of the sample that it wasn't fitted on.
    """
    known = docs.where(use & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).cast("string").alias("label"))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = settled(bounded_sample(known, "label", per_language))
    got = features(docs, sample, lambda texts: [pack(r) for r in gram_rows(texts, bits)], id_col, text_col)
    languages = sorted({r["label"] for r in got})
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((1 << bits, 0)), np.zeros(0), np.zeros(0), bits)
    order, n = fifth_first(len(got))
    x = unpack([bytes(got[k]["row"]) for k in order], 1 << bits)
    label = np.array([languages.index(got[k]["label"]) for k in order])
    even = (1.0 / np.maximum(np.bincount(label), 1))[label]
    w, b = fit_logistic(x[n:], code[label][n:], even[n:], rounds=100)
    right = (((x[:n] @ w + b) > 0) == (code[label][:n] > 0)).mean(0)
    right = np.clip(right, 0.51, 0.999)
    trust = np.log(right / (1 - right))
    return Model(languages, code, w, b, trust / trust.mean(), bits)


def _has_letter(texts: Texts) -> np.ndarray:
    """Whether each text has a letter; only texts without ASCII letters are decoded for it."""
    plain = texts.sums((texts.data | 32) - 97 < 26) > 0
    for k in np.flatnonzero(~plain):
        part = texts.data[texts.edges[k] : texts.edges[k + 1]]
        if (part >= 128).any():
            plain[k] = any(c.isalpha() for c in part.tobytes().decode("utf-8", "replace"))
    return plain


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for each row, from its whole text.

    A null text and a text without a letter are ``und`` with score 0; so is everything if nothing was learned.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores, unclear = [], [], []
            for _, _, texts in chunks(batch.column(1), rows=256):
                p = model.decode(gram_rows(texts, model.bits))
                lettered = _has_letter(texts) if model.languages else np.zeros(texts.n, bool)
                order = np.argsort(-p, axis=1, kind="stable")
                best = p.max(1, initial=0.0)
                second = np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(texts.n)
                names += [model.languages[order[k, 0]] if lettered[k] else UNKNOWN for k in range(texts.n)]
                scores.append(np.where(lettered, best, 0.0))
                unclear.append(~lettered | (best - second < CLEAR_BY))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(unclear))],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(in_batches(make), f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, ambiguous boolean")
