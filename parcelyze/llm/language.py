"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's letters are lower-cased, all else becomes a space, and every run of two to four bytes is hashed to one of
``BUCKETS`` subwords. The text is the mean of its subwords' embeddings; a linear layer and softmax give the
languages. Embeddings and layer are trained by stochastic gradient descent in numpy on a sample with at most ``most_rows``
labelled documents, the same number of each language. A fifth of the sample is held back: it sets a temperature that makes the
scores probabilities, and the least score at which accepted predictions reach ``precision``.

Defined results. Null text, or text without letters: ``und``, score 0, not accepted. Ties go to the first
language in order. Without any labelled rows all is ``und``. Of more than ``most_languages`` labels the most frequent are learned. A null
id is predicted but never learned from, and counts as not held out; of an id's several texts with one label one is learned from.
Very long texts are read whole. Rows that repeat give equal rows; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import labelled_sample, remainder
from .shared import slices, small_batches

BUCKETS = 4096
_STEP = 512 << 10
_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[0x80:] = np.arange(0x80, 0x100)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def subword_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, BUCKETS) counts of hashed subwords; runs across a row's end or of spaces only do not count."""
    rows = len(offsets) - 1
    clean = _CLEAN[raw]
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets))
    out = np.zeros(rows * BUCKETS, np.int64)
    wide = clean.astype(np.uint32)
    with np.errstate(over="ignore"):
        value = wide * _MIX[0]
        for n in range(2, 5):
            m = len(clean) - n + 1
            if m <= 0:
                break
            value = value[:m] + wide[n - 1 :] * _MIX[n - 1]
            keep = row[:m] == row[n - 1 :]
            if n == 2:
                keep &= (clean[:m] != 32) | (clean[1:] != 32)
            else:
                keep &= clean[1 : m + 1] != 32
            at = ((value ^ (value >> np.uint32(15))) * _MIX[1] >> np.uint32(20)).astype(np.int64)
            out += np.bincount((row[:m].astype(np.int64) * BUCKETS + at)[keep], minlength=rows * BUCKETS)
    return out.reshape(rows, BUCKETS)


def has_letters(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row holds a letter, of any script."""
    low = raw | 0x20
    ascii_letter = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (raw < 0x80))])
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~out):
        part = raw[offsets[i] : offsets[i + 1]]
        if len(part) and part.max() >= 0x80:
            out[i] = any(map(str.isalpha, part.tobytes().decode("utf-8", "replace")))
    return out


@dataclass
class Model:
    names: list[str]
    subword_logits: np.ndarray  # embeddings times layer: (BUCKETS, languages)
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        z = (counts @ self.subword_logits / total + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(counts: np.ndarray, labels: list[str], *, width: int = 16, epochs: int = 40, rate: float = 0.5, precision: float = 0.99, seed: int = 7) -> Model:
    """Trains on rows of subword counts; a fifth of them calibrates."""
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    x = counts.astype(np.float32)
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    back, train = order[: len(y) // 5], order[len(y) // 5 :]
    table = rng.normal(0, 0.1, (BUCKETS, width)).astype(np.float32)
    layer = rng.normal(0, 0.1, (width, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    seen = [np.full_like(p, 1e-6) for p in (table, layer, bias)]
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            mean = x[part] @ table
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            for param, old, grad in zip((table, layer, bias), seen, (x[part].T @ (p @ layer.T), mean.T @ p, p.sum(axis=0))):
                old += grad * grad
                param -= rate * 0.2 * grad / np.sqrt(old)
    model = Model(names, (table @ layer).astype(np.float64), bias.astype(np.float64), 1.0, 0.0)
    if len(back):
        held = counts[back]

        def loss(t: float) -> float:
            model.temperature = t
            return float(-np.log(model.probabilities(held)[np.arange(len(back)), y[back]] + 1e-12).mean())

        model.temperature = min(np.geomspace(0.25, 8, 26), key=loss)
        p = model.probabilities(held)
        score, right = p.max(axis=1), p.argmax(axis=1) == y[back]
        rank = np.argsort(-score, kind="stable")
        good = np.cumsum(right[rank]) / np.arange(1, len(rank) + 1) >= precision
        model.threshold = float(score[rank][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, raw, at in slices(batch.column(1), _STEP):
            counts = subword_counts(raw, at)
            shares = (counts * (1024 / np.maximum(counts.sum(axis=1, keepdims=True), 1))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in shares], pa.binary())], ["label", "counts"])


def _predict(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = held.value
        for batch in batches:
            for i, j, raw, at in slices(batch.column(2), _STEP):
                letters = has_letters(raw, at)
                if model is None:
                    names, score = ["und"] * (j - i), np.zeros(j - i)
                else:
                    p = model.probabilities(subword_counts(raw, at))
                    names = [model.names[k] if ok else "und" for k, ok in zip(p.argmax(axis=1), letters)]
                    score = np.where(letters, p.max(axis=1), 0.0)
                cut = model.threshold if model is not None else 2.0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(names, pa.string()), pa.array(score), pa.array(letters & (score >= cut))], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return run


def train_languages(docs: DataFrame, *, most_rows: int = 4000, most_languages: int = 200) -> Model | None:
    """A model from at most ``most_rows`` of the rows of ``docs`` (doc_id, label, text)."""
    # Of very many labels the most frequent are learned: the sample and the model stay bounded.
    counts = docs.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "label")
    names = [r[0] for r in counts.limit(most_languages).collect()]
    if not names:
        return None
    docs = docs.where(F.col("label").isin(names))
    sample = labelled_sample(docs, docs.select("doc_id", "label"), max(1, most_rows // len(names)), "languages")
    rows = sample.select("label", "text").mapInArrow(_count_rows, "label string, counts binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r[0], r[1]))
    counts = np.stack([np.frombuffer(r[1], np.float16) for r in rows]).astype(np.float32)
    return fit(counts, [r[0] for r in rows])


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", *, folds: int = 5, held_out: int = 0, most_rows: int = 4000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) for each row; learns from rows outside the held-out fold only."""
    small_batches(docs.sparkSession)
    fold = remainder(F.col("doc_id"), folds)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    labelled = rows.where(F.col("label").isNotNull() & F.col("text").isNotNull() & (fold != held_out))
    model = train_languages(labelled, most_rows=most_rows)
    held = docs.sparkSession.sparkContext.broadcast(model)
    return rows.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "text").mapInArrow(_predict(held), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
