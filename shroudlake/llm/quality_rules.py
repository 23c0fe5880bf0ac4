"""Quality rules: counted base rules, then hashed word and character n-gram logistic regression.

The regression is trained on labelled quality rows (a bounded sample, ``rows``), calibrated by a
two-parameter logistic fit on held-out rows, and scored in Arrow batches against a fixed
threshold on the calibrated probability.

Defined cases: a null or empty text has zero counts and fails the base rules; equal texts get equal
verdicts; rows with a null doc_id are judged and never learnt from; without labels of both kinds
the method keeps all that passes the base rules; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MUL_A, MUL_B, WHITE, byte_class, mix, pair_hash, run_hash, sample_labels, small_batches, spans_of, tidy, trim, utf8, words

BITS = 18
#: Labelled rows that fitting reads at most.
ROWS = 3000
#: A document stays from this calibrated probability of good quality on.
KEEP = 0.3
SYMBOLS = byte_class([ord(c) for c in "#*$%&|<>"])
CONTINUED = byte_class(range(0x80, 0xC0))
LINE_END = byte_class([10])


def counted(b: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each document of a block."""
    n = len(off) - 1
    s, e, d = words(b, off)
    per = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[off])
    out = {"n_words": np.bincount(d, minlength=n), "word_chars": per(~WHITE[b] & ~CONTINUED[b]), "n_symbols": per(SYMBOLS[b])}
    ls, le, ld = words(b, off, LINE_END)  # lines without a byte have no word
    has = np.searchsorted(s, le) > np.searchsorted(s, ls)
    ls, le, ld = ls[has], le[has], ld[has]
    lh = pair_hash(run_hash(b, ls, le), ld.astype(np.uint64), 3)
    _, first = np.unique(lh, return_index=True)
    again = np.ones(len(lh), bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(ld[again], minlength=n)
    h = run_hash(b, s, e)
    three = np.flatnonzero(d[:-2] == d[2:])
    g = pair_hash(pair_hash(pair_hash(h[three], h[three + 1], 4), h[three + 2], 5), d[three].astype(np.uint64), 6)
    order = np.argsort(g)
    sg = g[order]
    same = np.zeros(len(g) + 1, bool)
    same[1:-1] = sg[1:] == sg[:-1]
    twice = three[order[same[:-1] | same[1:]]]
    flag = np.zeros(len(s), bool)
    for k in range(3):
        flag[twice + k] = True
    out["n_repeat_words"] = np.bincount(d[flag], minlength=n)
    return out


def characters(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, document) of each character: its UTF-8 bytes as one number."""
    at = np.flatnonzero(~CONTINUED[b])
    size = np.diff(np.append(at, len(b)))
    code = b[at].astype(np.uint64)
    for k in range(1, 4):
        long = np.flatnonzero(size > k)
        code[long] = code[long] << np.uint64(8) | b[at[long] + k]
    return code, np.searchsorted(off, at, "right") - 1


def grams(b: np.ndarray, off: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(document, index) of the word n-grams (1, 2), and of the character n-grams (3 and 4 characters)."""
    s, e, d = words(b, off)
    h = run_hash(b, s, e)
    one = d[:-1] == d[1:]
    w = np.concatenate([mix(h), pair_hash(h[:-1], h[1:], 1)[one]])
    wd = np.concatenate([d, d[:-1][one]])
    x, xd = characters(b, off)
    x = x * MUL_A
    in3, in4 = np.flatnonzero(xd[:-2] == xd[2:]), np.flatnonzero(xd[:-3] == xd[3:])
    x3 = (x[in3] * MUL_B + x[in3 + 1]) * MUL_B + x[in3 + 2]
    x4 = ((x[in4] * MUL_B + x[in4 + 1]) * MUL_B + x[in4 + 2]) * MUL_B + x[in4 + 3]
    shift = np.uint64(64 - bits)
    c = np.concatenate([mix(x3), mix(x4 + np.uint64(1))])
    return [(wd, (w >> shift).astype(np.int64)), (np.concatenate([xd[in3], xd[in4]]), (c >> shift).astype(np.int64))]


@dataclass
class Model:
    word: np.ndarray
    char: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0


def means(b: np.ndarray, off: np.ndarray, model: Model, bits: int) -> np.ndarray:
    """The uncalibrated logit of each document: the bias and the mean weight of each kind of n-gram."""
    n = len(off) - 1
    out = np.full(n, model.bias)
    for (d, idx), w in zip(grams(b, off, bits), (model.word, model.char)):
        out += np.bincount(d, w[idx], n) / np.maximum(1, np.bincount(d, minlength=n))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int, rate: float = 3.0, epochs: int = 12) -> Model:
    """Adagrad on rows of (index, share); word indices below 2**bits, character ones above; a fifth of the rows calibrates."""
    rng = np.random.default_rng(5)
    order = rng.permutation(len(rows))
    held, used = order[: len(rows) // 5], order[len(rows) // 5 :]
    w, g2 = np.zeros(2 << bits), np.full(2 << bits, 1e-8)
    bias, b2 = 0.0, 1e-8
    for _ in range(epochs):
        for k in rng.permutation(used):
            i, x = rows[k]
            e = 1 / (1 + np.exp(-np.clip(bias + w[i] @ x, -35, 35))) - y[k]
            g = e * x
            g2[i] += g * g
            w[i] -= rate * g / np.sqrt(g2[i]) * 0.1
            b2 += e * e
            bias -= 0.3 * e / np.sqrt(b2)
    model = Model(w[: 1 << bits].astype(np.float32), w[1 << bits :].astype(np.float32), bias)
    z = np.array([bias + w[rows[k][0]] @ rows[k][1] for k in held])
    t = y[held]
    if len(held) >= 20 and 0 < t.mean() < 1:
        hi, lo = (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2)
        t = np.where(t > 0, hi, lo)
        a, c, scale = 1.0, 0.0, max(1.0, float(np.std(z)))
        for _ in range(400):
            e = 1 / (1 + np.exp(-np.clip(a * z + c, -35, 35))) - t
            a -= 0.5 * float((e * z).mean()) / scale**2
            c -= 0.5 * float(e.mean())
        model.slope, model.shift = max(a, 1e-3), c
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, bits: int = BITS) -> Model:
    small_batches(docs.sparkSession)
    picked = sample_labels(labels, "quality", rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = utf8(batch.column(1))
            idx, share = [], []
            for i in range(batch.num_rows):
                both = grams(b[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]), bits)
                u, x = [], []
                for k, (_, g) in enumerate(both):
                    v, c = np.unique(g, return_counts=True)
                    u.append(v + (k << bits))
                    x.append(c / max(1, len(g)))
                idx.append(np.concatenate(u).astype(np.int32).tobytes())
                share.append(np.concatenate(x).astype(np.float32).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(idx, pa.binary()), pa.array(share, pa.binary())], ["doc_id", "y", "i", "x"])

    got = texts.mapInArrow(tidy(run), "doc_id long, y int, i binary, x binary").toArrow().sort_by([("doc_id", "ascending"), ("i", "ascending")])
    y = got.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32), 10.0)
    # views of the Arrow buffers, not copies
    rows = [(np.frombuffer(i.as_buffer(), np.int32), np.frombuffer(x.as_buffer(), np.float32)) for i, x in zip(got.column("i"), got.column("x"))]
    model = train(rows, y, bits)
    del rows, got
    trim()
    return model


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def verdicts(texts: pa.Array, model: Model, keep: float, bits: int) -> dict[str, np.ndarray]:
    """The columns of judge() for a batch of texts."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    parts, logit = [], [np.zeros(0)]
    b, off = utf8(texts)
    for i, j in spans_of(off, 1 << 18):
        own, o = b[off[i] : off[j]], off[i : j + 1] - off[i]
        parts.append(counted(own, o))
        logit.append(means(own, o, model, bits))
    out = {k: np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]]).astype(np.int64) for k in names}
    p = 1 / (1 + np.exp(-np.clip(model.slope * np.concatenate(logit) + model.shift, -35, 35)))
    failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    return out | {"base_failed": failed, "kept": ~failed & (p >= keep), "probability": p}


def judge(docs: DataFrame, model: Model, keep: float = KEEP, bits: int = BITS) -> DataFrame:
    """Counts, base verdict, calibrated probability and final verdict of every row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = verdicts(batch.column(1), sent.value, keep, bits)
            yield pa.record_batch([batch.column(0), *map(pa.array, got.values())], ["doc_id", *got])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), OUT)


def keep(docs: DataFrame, model: Model, threshold: float = KEEP, bits: int = BITS) -> DataFrame:
    """The rows of docs that judge() keeps, with all columns; one pass, nothing shuffled."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(verdicts(batch.column(at), sent.value, threshold, bits)["kept"], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
