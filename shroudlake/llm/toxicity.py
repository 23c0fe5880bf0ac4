"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, word pairs and pairs with one word skipped of a lower-cased
text (runs of ASCII letters, digits and non-ASCII bytes). FTRL-proximal keeps a learning rate
for each coordinate and sets weights of weak evidence to exactly zero, so the model is a
short list of (index, weight) that is sent to the executors; its size is bounded by 2**bits.

Fitting reads a bounded sample of labelled rows (``rows``); scoring reads every whole text.

Defined cases: a null or empty text has the score of the bias alone; equal texts score alike; rows
with a null doc_id are scored and never learnt from; labels that are null, or of ids that have no
document, are ignored; without labels of both kinds all scores are the prior; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MUL_A, NON_ALNUM, ascii_lower, mix, pair_hash, run_hash, sample_labels, small_batches, spans_of, tidy, trim, utf8, words

BITS = 20
#: Labelled rows that fitting reads at most.
ROWS = 8000


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float


def features(b: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, index) of every word, word pair and skip pair."""
    b = ascii_lower(b)
    s, e, d = words(b, off, NON_ALNUM)
    h = run_hash(b, s, e)
    one = d[:-1] == d[1:]
    two = d[:-2] == d[2:]
    idx = np.concatenate([mix(h), pair_hash(h[:-1], h[1:], 1)[one], pair_hash(h[:-2], h[2:], 2)[two]])
    return np.concatenate([d, d[:-1][one], d[:-2][two]]), (idx >> np.uint64(64 - bits)).astype(np.int64)


def ftrl(rows: list[np.ndarray], y: np.ndarray, bits: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 12.0, l2: float = 1.0, epochs: int = 4) -> Model:
    """Per-coordinate FTRL-proximal on binary rows of indices; the last coordinate is the bias, without L1.

    alpha, l1 and epochs have the least logistic loss in cross-validation over the folds that may be learnt from, one left out at a time.
    """
    bias = 1 << bits
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)
    rng = np.random.default_rng(11)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        if i[-1] == bias:
            w[-1] = -z[bias] / ((beta + np.sqrt(n[bias])) / alpha)
        return w

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i = np.append(rows[k].astype(np.int64), bias)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[k]
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g * g
    w = weights(np.arange(bias + 1))
    live = np.flatnonzero(w[:bias])
    return Model(live, w[live], float(w[bias]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, bits: int = BITS) -> Model:
    """From at most ``rows`` labelled documents; features are made on the executors."""
    small_batches(docs.sparkSession)
    picked = sample_labels(labels, "toxic", rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = utf8(batch.column(1))
            out = []
            for i in range(batch.num_rows):
                _, idx = features(b[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]), bits)
                out.append(np.unique(idx).astype(np.int32).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "y", "x"])

    got = texts.mapInArrow(tidy(run), "doc_id long, y int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    y = got.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.1, 0.01, 0.99))
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p))))
    model = ftrl([np.frombuffer(x.as_buffer(), np.int32) for x in got.column("x")], y, bits)
    del got
    trim()
    return model


def score(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """(doc_id, score) of every row, in Arrow batches."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.index, model.weight, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight, bias = sent.value
        dense = np.zeros(1 << bits)
        dense[index] = weight
        for batch in batches:
            b, off = utf8(batch.column(1))
            logit = np.full(batch.num_rows, bias)
            for i, j in spans_of(off, 1 << 18):
                d, idx = features(b[off[i] : off[j]], off[i : j + 1] - off[i], bits)
                hit = np.flatnonzero(dense[idx])
                once = np.unique((d[hit] << bits) | idx[hit])  # a feature counts once in a text
                np.add.at(logit, i + (once >> bits), dense[once & ((1 << bits) - 1)])
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(tidy(run), "doc_id long, score double")
