"""Streaming forms: the state feed, and detection over arriving documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import detect_pii


def latest_state(events: DataFrame, key: str, ts: str, state: str) -> DataFrame:
    """The last state of each key; works on a stream in update mode."""
    return events.groupBy(key).agg(F.max_by(state, ts).alias("state"), F.max(ts).alias("at"))


def detect_stream(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Detections over a stream of documents; no state, so any output mode that appends will do."""
    return detect_pii(documents, [key])


def timed_out(calls: DataFrame, limits: dict[str, float]) -> DataFrame:
    """calls(stage, seconds) with timed_out by each stage's limit; stages without a limit never are."""
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])[F.col("stage")]
    return calls.withColumn("timed_out", F.coalesce(F.col("seconds") > limit, F.lit(False)))


#: Seconds.
LIMITS = {"pipeline": 90.0, "server": 45.0, "user": 180.0, "ocr": 15.0, "offscreen": 12.0}
