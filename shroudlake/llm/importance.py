"""Quality classifier by importance resampling.

Two bag-of-hashed-n-gram models over ``buckets`` buckets: the target, fitted on labelled good rows
(a bounded sample, ``rows``), and the raw corpus, counted over all documents. A document's log
weight is the sum over its words and word pairs of log target - log raw. Adding Gumbel noise
drawn from the document's id and taking the k largest samples k documents without replacement
in proportion to their weights. k is ``share`` of all documents, by default the labelled share of
good rows.

The k-th largest key is found by counting keys in 4096 bins and narrowing to one bin, so no task
sorts all keys. Ties at the k-th key are ordered by a hash of doc_id, then doc_id.

Defined cases: a null or empty text has log weight 0; rows with a null doc_id are scored and never
sampled; rows that share an id share their noise and count singly, so exactly k rows are kept; without good labels all weights are 0;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_ALNUM, ascii_lower, durable, labelled, mix, pair_hash, run_hash, sample_labels, sized, small_batches, spans_of, tidy, utf8, words

BUCKETS = 10_000
#: Labelled rows that the target model reads at most.
ROWS = 20_000
#: Added to each bucket's count.
SMOOTH = 1.0


def grams(b: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    b = ascii_lower(b)
    s, e, d = words(b, off)
    h = run_hash(b, s, e)
    one = d[:-1] == d[1:]
    both = np.concatenate([mix(h), pair_hash(h[:-1], h[1:], 1)[one]])
    return np.concatenate([d, d[:-1][one]]), ((both >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """n-grams of each bucket over all rows: each task sums its own; at most ``buckets`` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            b, off = utf8(batch.column(0))
            for i, j in spans_of(off, 1 << 18):
                total += np.bincount(grams(b[off[i] : off[j]], off[i : j + 1] - off[i], buckets)[1], minlength=buckets)
        live = np.flatnonzero(total)
        yield pa.record_batch([pa.array(live), pa.array(total[live])], ["bucket", "n"])

    out = np.zeros(buckets)
    for r in texts.select("text").mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    p, q = target + SMOOTH, raw + SMOOTH
    return np.log(p / p.sum()) - np.log(q / q.sum())


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, n_grams, log_weight) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = sent.value
        for batch in batches:
            b, off = utf8(batch.column(1))
            n, w = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, j in spans_of(off, 1 << 18):
                d, g = grams(b[off[i] : off[j]], off[i : j + 1] - off[i], len(r))
                n[i:j], w[i:j] = np.bincount(d, minlength=j - i), np.bincount(d, r[g], j - i)
            yield pa.record_batch([batch.column(0), pa.array(n), pa.array(w)], ["doc_id", "n_grams", "log_weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_grams long, log_weight double")


def kth_bin(keys: DataFrame, k: int, bins: int = 4096, rounds: int = 5) -> tuple[float, float, int]:
    """(low, high, above): a range that holds the k-th largest key, and how many keys are at high or above."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    hi, above = float(np.nextafter(hi, np.inf)), 0
    for _ in range(rounds):
        width = (hi - lo) / bins
        if width <= 0 or lo + width <= lo:
            break
        at = F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1)).alias("bin")
        got = {r["bin"]: r["count"] for r in keys.where((F.col("key") >= lo) & (F.col("key") < hi)).groupBy(at).count().collect()}
        for b in sorted(got, reverse=True):
            if above + got[b] >= k:
                break
            above += got[b]
        # one width of slack each way, for rounding
        new_lo, new_hi = max(lo, lo + (b - 1) * width), min(hi, lo + (b + 2) * width)
        above = keys.where(F.col("key") >= new_hi).count()
        if got[b] <= 1000:
            return new_lo, new_hi, above
        lo, hi = new_lo, new_hi
    return lo, hi, above


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, rows: int = ROWS, buckets: int = BUCKETS, seed: int = 17) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key, kept) of every row."""
    small_batches(docs.sparkSession)
    picked = sample_labels(labels, "quality", rows)
    good = F.broadcast(picked.where("y = 1").select("doc_id"))
    target = counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(good, "doc_id", "left_semi"), buckets)
    if share is None:
        share = labelled(labels, "quality").agg(F.avg("y")).first()[0]
        share = 1.0 if share is None else float(share)
    raw = counts(docs, buckets)
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    keyed = weigh(docs, log_ratio(target, raw)).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    # written once, with a number for each row, so rows that share an id and a key can be told apart
    keyed = durable(keyed.withColumn("row", F.monotonically_increasing_id()), "importance")
    keys = keyed.where("doc_id is not null").select("doc_id", "row", F.col("gumbel_key").alias("key"))
    n = keys.count()
    k = round(share * n)
    shown = lambda kept: keyed.select("doc_id", "n_grams", "log_weight", "gumbel_key", kept.alias("kept"))
    if not 0 < k < n:
        return shown(F.col("doc_id").isNotNull() & F.lit(k > 0))
    lo, hi, above = kth_bin(keys, k)
    # the rest of the k come from one narrow bin
    edge = keys.where((F.col("key") >= lo) & (F.col("key") < hi)).orderBy(F.desc("key"), F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "row").limit(k - above)
    drawn = sized(edge.select("row", F.lit(True).alias("drawn")), "importance-edge")
    keyed = keyed.join(drawn, "row", "left")
    return shown(F.col("doc_id").isNotNull() & ((F.col("gumbel_key") >= hi) | F.coalesce("drawn", F.lit(False))))
